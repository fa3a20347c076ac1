"""Delimited text in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_delimited(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType | int,
    sep: str = ",",
    tag: str | None = None,
) -> DataFrame:
    """Read delimited text; compression follows the file suffix.

    ``schema`` is a declared schema, or a number of fields to read without one
    (all strings ``_c0``, ``_c1`` ...).  Fields split at every delimiter, also
    inside quotes.  Empty, missing or unreadable fields are null, surplus ones
    are dropped.  ``tag`` ("name" or "path") puts the source file in front.
    """
    if isinstance(schema, int):
        schema = ", ".join(f"_c{i} STRING" for i in range(schema))
    df = (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("quote", "")
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    if tag is None:
        return df
    field = {"name": "file_name", "path": "file_path"}[tag]
    return df.select(F.col(f"_metadata.{field}").alias(f"source_{tag}"), "*")


def load_lines(spark: SparkSession, path: str) -> DataFrame:
    """Read text as lines, for files whose rows have to be cleaned before splitting."""
    return spark.read.text(path)


def store_delimited(df: DataFrame, path: str, sep: str = "\t", codec: str | None = None) -> None:
    """Write fields joined by ``sep`` without quoting; null is an empty field."""
    fields = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    lines = df.select(F.array_join(F.array(*fields), sep).alias("value"))
    lines.write.text(path, compression=codec)
