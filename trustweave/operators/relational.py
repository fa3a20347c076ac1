"""Relational helpers where the dataflow scripts' rules differ from Spark's.

Everything else the scripts use (projection, equi-join, sums, ordering) is the
plain DataFrame method and has no wrapper here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustweave.functions.scalar import literal_pattern


def positional(df: DataFrame, *positions: int) -> DataFrame:
    """``$0, $2``: columns by position."""
    return df.select(*[F.col(f"`{df.columns[i]}`") for i in positions])


def as_schema(df: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Rename and retype all columns in order; a failed cast gives null."""
    if len(fields) != len(df.columns):
        raise ValueError(f"{len(fields)} fields declared for {len(df.columns)} columns")
    return df.select(
        *[
            F.col(f"`{old}`").try_cast(kind).alias(new)
            for old, (new, kind) in zip(df.columns, fields.items())
        ]
    )


def qualified(df: DataFrame, relation: str) -> DataFrame:
    """Prefix every column with ``relation::`` so that a join keeps both sides."""
    return df.select(*[F.col(f"`{c}`").alias(f"{relation}::{c}") for c in df.columns])


def matches(text: Column, pattern: str) -> Column:
    """Whole-string regular expression match; null stays null."""
    return text.rlike(rf"\A(?:{pattern})\z")


def field_count(line: Column, sep: str = ",", quoted: bool = False) -> Column:
    """Number of fields in a line by its one-character separator.

    With ``quoted``, separators between double quotes do not count.
    """
    if quoted:
        line = F.regexp_replace(line, r'"(?:[^"]|"")*"', "")
    return F.length(line) - F.length(F.replace(line, F.lit(sep), F.lit(""))) + 1


def with_arity(lines: DataFrame, arity: int, column: str = "value", sep: str = ",", quoted: bool = False) -> DataFrame:
    """Keep the lines that have exactly ``arity`` fields."""
    return lines.filter(field_count(F.col(column), sep, quoted) == arity)


def split_fields(lines: DataFrame, arity: int, column: str = "value", sep: str = ",") -> DataFrame:
    """Fields of each line as ``_c0``, ``_c1`` ... (strings, no quote handling)."""
    parts = F.split(F.col(column), literal_pattern(sep), -1)
    return lines.select(*[F.get(parts, F.lit(i)).alias(f"_c{i}") for i in range(arity)])


def count_all(df: DataFrame, name: str = "cnt") -> DataFrame:
    """Count tuples whose first field is not null; an empty input gives no row."""
    first = F.col(f"`{df.columns[0]}`")
    return df.agg(F.count(first).alias(name), F.count(F.lit(1)).alias("_rows")).where("_rows > 0").drop("_rows")


def group_bags(df: DataFrame, keys: Sequence[str], bag: str = "bag", part: Column | None = None) -> DataFrame:
    """Group rows into nested bags: ``keys..., bag``, one row per key.

    A bag is one field, so it must fit into a row.  Where a key may own much of
    a table, name a ``part``: an expression over the rows that cuts every bag,
    whatever its size; the result has one row per key and part, and the parts of
    a key together are its bag.
    """
    rows = df.select(*[F.col(f"`{k}`") for k in keys], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
                     *([] if part is None else [part.alias("part")]))
    names = [f"`{k}`" for k in keys] + ([] if part is None else ["part"])
    return rows.groupBy(*names).agg(F.collect_list("_row").alias(bag))


def flatten_bag(df: DataFrame, bag: str = "bag") -> DataFrame:
    """Bag back to rows."""
    return df.select(F.inline(bag))


def ordered_desc(df: DataFrame, column: str) -> DataFrame:
    """Global order by one column, largest first.

    Ties are ordered by a hash of the row, so that the range partitioning can
    also cut through one value that many rows share.
    """
    return df.orderBy(F.desc(column), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
