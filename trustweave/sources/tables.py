"""Where runs, operations, captures and profiles are kept.

All of it is parquet below one root folder.  Metadata tables only ever grow;
what a repeated job would write again (captures, distributions, confidences) is
partitioned so that the repetition replaces its own partition and nothing else.
Bucket specs are small files of their own, which only the first writer can create.
"""

from __future__ import annotations

import json
import re
import time
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from trustweave import schema
from trustweave.session import CODEC, durable, empty

CAPTURE_RUN = "capture_run"
RUN_ID = "[A-Za-z0-9_.-]+"
#: What the files of one write have in common in their names.
WRITE = re.compile("[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
#: So long a spec of another driver may be empty before it counts as given up.
SPEC_SECONDS = 10.0

_LAYOUT = {
    "runs": (schema.RUNS, ["scope"]),
    "operations": (schema.OPERATIONS, ["scope"]),
    "loads": (schema.LOADS, ["scope"]),
    "growths": (schema.GROWTHS, ["scope"]),
    "scores": (schema.SCORES, ["scope"]),
    "bucket_spec": (schema.BUCKET_SPEC, ["scope", "var", "col_idx"]),
    "dist": (schema.DIST, ["scope", "var", "run_id"]),
    "profile": (schema.PROFILE, ["scope", "var"]),
    "confidence": (schema.CONFIDENCE, ["scope", "run_id"]),
}
_REPLACED = {"dist", "confidence"}
_FROZEN = {"bucket_spec"}
# A repeated job writes the same rows once more; they are the same in every column.
_REPEATABLE = {"profile"}


class Tables:
    """Typed access to the tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, name: str, compat: bool) -> str:
        return f"{self.root}/{name}{'_compat' if compat else ''}"

    def read(self, name: str, compat: bool = False, scope: str | None = None) -> DataFrame:
        """A metadata or profile table as it is now; empty before its first write.

        With ``scope`` only that scope's folder is listed.  ``compat`` names the
        profiles made the original's way, which are kept apart.
        """
        columns, _ = _LAYOUT[name]
        base = self._path(name, compat)
        path = base if scope is None else f"{base}/scope={_folder(scope)}"
        try:
            reader = self.spark.read.option("basePath", base).schema(columns)
            frame = reader.json(path) if name in _FROZEN else reader.parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return empty(self.spark, columns)
        frame = frame.select(*_names(columns))
        return frame.distinct() if name in _REPEATABLE else frame

    def write(self, name: str, rows: DataFrame, compat: bool = False, dealt: bool = False) -> None:
        """Append rows, or replace the partitions they belong to.

        Bucket specs are neither: one that is there already stays.  Rows are rebalanced by partition first: small partitions get one file,
        a large one is split over several tasks.  Rows that are ``dealt``, read from few
        files and of few partitions, are written as they are.
        """
        _, parts = _LAYOUT[name]
        if name in _FROZEN:
            self._freeze(name, rows, compat)
        else:
            self._save(name, rows if dealt else rows.hint("rebalance", *parts), compat)

    def _freeze(self, name: str, rows: DataFrame, compat: bool) -> None:
        """Create a file per key unless there is one; of several drivers the first wins.

        As atomic as the store's creation of files without overwriting.  The driver
        handles the rows: one per inspected column of a script's variables.
        """
        columns, parts = _LAYOUT[name]
        context = self.spark.sparkContext
        lost = []
        for row in rows.select(*_names(columns)).collect():
            folders = "/".join(f"{c}={_folder(str(row[c]))}" for c in parts)
            path = context._jvm.org.apache.hadoop.fs.Path(f"{self._path(name, compat)}/{folders}/spec.json")
            store = path.getFileSystem(context._jsc.hadoopConfiguration())
            text = json.dumps({c: row[c] for c in _names(columns) if c not in parts})
            try:
                out = store.create(path, False)
            except Py4JJavaError as error:
                if not store.exists(path):
                    raise error
                lost.append((store, path))
                continue
            out.write(text.encode())
            out.close()
        until = time.monotonic() + SPEC_SECONDS
        for store, path in lost:  # another driver may be about to write its content
            while store.getFileStatus(path).getLen() == 0:
                if time.monotonic() > until:
                    raise RuntimeError(f"{path} was begun and not written; delete it if its driver is gone")
                time.sleep(0.1)

    def write_row(self, name: str, row: DataFrame) -> None:
        """Append a single row."""
        self._save(name, row)

    def compact(self, name: str) -> None:
        """Rewrite an event table with few files per scope; nobody may write meanwhile."""
        _, parts = _LAYOUT[name]
        rows = durable(self.read(name), "compact")
        self._save(name, rows.hint("rebalance", *parts), replace=True)

    def _save(self, name: str, rows: DataFrame, compat: bool = False, replace: bool = False) -> None:
        columns, parts = _LAYOUT[name]
        writer = rows.select(*_names(columns)).write.option("compression", CODEC).partitionBy(*parts)
        if replace or name in _REPLACED:
            writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self._path(name, compat))
        else:
            writer.mode("append").parquet(self._path(name, compat))

    # -- captures ---------------------------------------------------------

    def capture_path(self, scope: str, var: str, run_id: str | None = None) -> str:
        base = f"{self.root}/captures/{quote(scope, safe='')}/{quote(var, safe='')}"
        return base if run_id is None else f"{base}/{CAPTURE_RUN}={run_id}"

    def write_capture(self, df: DataFrame, scope: str, var: str, run_id: str, append: bool = False) -> DataFrame:
        """Persist one variable of one run and return the stored rows."""
        check_run_id(run_id)
        _check_names(df)
        path = self.capture_path(scope, var, run_id)
        df.write.option("compression", CODEC).mode("append" if append else "overwrite").parquet(path)
        return self.read_capture(scope, var, run_id)

    def write_captures(self, df: DataFrame, scope: str, var: str, run_id: str) -> None:
        """Persist one variable of many runs at once; ``run_id`` names a column.

        One distributed write.  Rows are rebalanced by run, so that a run with
        much of the data is written by several tasks.
        """
        _check_names(df.drop(run_id))
        rows = df.withColumnRenamed(run_id, CAPTURE_RUN)
        (
            rows.hint("rebalance", CAPTURE_RUN)
            .write.mode("overwrite")
            .option("compression", CODEC)
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(CAPTURE_RUN)
            .parquet(self.capture_path(scope, var))
        )

    def read_capture(self, scope: str, var: str, run_id: str) -> DataFrame:
        """Rows of one variable of one run; no other run is listed or opened."""
        return self.spark.read.parquet(self.capture_path(scope, var, run_id))

    def read_captures(
        self, scope: str, var: str, run_ids: list[str] | None = None, columns: T.StructType | None = None,
        writes: list[str] | None = None,
    ) -> DataFrame:
        """Rows of several runs with their run in ``capture_run``.

        With ``run_ids`` only those runs' folders are listed, with ``writes`` only
        files of these writes are read.  ``columns`` are
        looked up by name in every capture; one that a capture lacks is null.
        """
        base = self.capture_path(scope, var)
        paths = [base] if run_ids is None else [self.capture_path(scope, var, r) for r in run_ids]
        if columns is None:
            columns = self.spark.read.option("basePath", base).parquet(paths[0]).drop(CAPTURE_RUN).schema
        # declared, so that a run named 007 does not become the number 7
        declared = T.StructType(columns.fields + [T.StructField(CAPTURE_RUN, T.StringType())])
        reader = self.spark.read.option("basePath", base).schema(declared)
        if writes is not None:
            reader = reader.option("pathGlobFilter", "*{" + ",".join(writes) + "}*")
        return reader.parquet(*paths)

    def writes(self, scope: str, var: str, run_id: str) -> set[str] | None:
        """The writes a capture consists of, by its files' names; none if a name does not tell."""
        names = [f.rsplit("/", 1)[-1] for f in self.read_capture(scope, var, run_id).inputFiles()]
        found = [WRITE.search(n) for n in names]
        return {m[0] for m in found} if all(found) else None


def _folder(value: str) -> str:
    """A partition value as it is spelled in a folder's name."""
    odd = set('"#%\'*/:=?\\{[]^\x7f')
    return "".join(f"%{ord(c):02X}" if c in odd or ord(c) < 32 else c for c in value)


def check_run_id(run_id: str) -> None:
    """Run ids name folders."""
    if run_id is None or not re.fullmatch(RUN_ID, str(run_id)):
        raise ValueError(f"run id {run_id!r}: only letters, digits, '_', '.' and '-' are allowed")


def _names(columns: str) -> list[str]:
    return T.StructType.fromDDL(columns).names


def _check_names(df: DataFrame) -> None:
    names = [c.lower() for c in df.columns]
    if CAPTURE_RUN in names:
        raise ValueError(f"column name '{CAPTURE_RUN}' is reserved")
    repeated = {c for c in names if names.count(c) > 1}
    if repeated:
        raise ValueError(f"columns {sorted(repeated)} occur twice; qualify them before the capture")
