"""What several operators need: packed rows, tables in the shared folder, word rules."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustweave.session import scratch_path

#: ASCII white space; words are maximal runs of anything else.
SPACES = b" \t\n\v\f\r"
#: Matches one word, for Spark's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, *without: str, **more: Column) -> DataFrame:
    """The whole row as ``_doc``, without some columns, beside what an operator needs.

    Operators add columns beside ``_doc``, so no column of the input can clash.
    """
    row = F.struct(F.lit(0).alias("_"), *[F.col(quoted(c)) for c in docs.columns if c not in without])
    return docs.select(row.alias("_doc"), *[c.alias(n) for n, c in more.items()])


def beside(docs: DataFrame, columns: list[str]) -> list[Column]:
    """The input's columns out of ``_doc``, without those an operator replaces."""
    fields = docs.schema["_doc"].dataType.fieldNames()
    new = {"_", *[c.lower() for c in columns]}
    return [F.col("_doc")[f].alias(f) for f in fields if f.lower() not in new]


def restored(rows: DataFrame, docs: DataFrame, changed: Column) -> DataFrame:
    """The columns of ``docs`` out of ``_doc`` and ``text``; ``n_chars`` follows a changed text."""
    columns = {c: F.col("text") if c == "text" else F.col("_doc")[c] for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.length("text")).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[c.alias(n) for n, c in columns.items()])


def text_of(docs: DataFrame) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col("text"), F.lit(""))


class Scratch:
    """Tables in the shared folder that one operator writes and reads again.

    A written table cuts the lineage: a lost executor costs a re-read.  ``free``
    deletes a table that no later result depends on.  With ``tidy`` the shuffle files
    behind a table go as soon as it is written, not when the driver collects its garbage.
    """

    def __init__(self, spark: SparkSession, label: str, tidy: bool = False):
        self.spark, self.root, self.n, self.tidy = spark, scratch_path(spark, label), 0, tidy

    def keep(self, df: DataFrame, **options: str) -> DataFrame:
        path = self._path()
        self._write(lambda: df.write.options(**options).parquet(path))
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch = path
        return kept

    def keep_by(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` in buckets by ``key``: joins by it shuffle the other side only."""
        path, table = self._path(), f"scratch_{uuid.uuid4().hex}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._write(lambda: df.repartition(parts, key).write.bucketBy(parts, key).option("path", path).saveAsTable(table, format="parquet"))
        kept = self.spark.table(table)
        kept._scratch, kept._table = path, table
        return kept

    def _path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def _write(self, write: Callable[[], None]) -> None:
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, None)
        if self.tidy:
            self.spark.conf.set(key, "true")
        try:
            write()
        finally:
            if self.tidy:
                self.spark.conf.unset(key) if before is None else self.spark.conf.set(key, before)

    def free(self, *tables: DataFrame | None) -> None:
        for table in [t._table for t in tables if hasattr(t, "_table")]:
            self.spark.sql(f"DROP TABLE {table}")
        for path in [t._scratch for t in tables if t is not None]:
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str | None = None) -> None:
    """Texts can be long: fewer rows (and bytes) a batch than the default, unless the session says how many."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if most is not None and spark.conf.get(key, None) is None:
            spark.conf.set(key, most)


def released() -> None:
    """Gives what a task has freed back to the system; workers outlive a task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def per_batch(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema, rows: int = 1000) -> DataFrame:
    """``mapInArrow`` over slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield function(batch.slice(at, rows))
        pa.default_memory_pool().release_unused()  # workers outlive a task

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
