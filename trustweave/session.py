"""Session defaults and the shared folder for data that must outlive a task."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Of everything stored: ids and texts take much less room than with Spark's default.
CODEC = "zstd"
_local_roots: dict[str, str] = {}
_scratch: list[str] = []


def local_session(app: str, cores: str | int = "*", memory: str = "8g", **conf) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.cpu_count() or 8)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session may go without ``spark.checkpoint.dir``; it gets a
    temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="trustweave-")
    return _local_roots[app]


def shared_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_root(spark)}/trustweave/{label}-{uuid.uuid4().hex}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path for data that only results of this driver read; see :func:`free_scratch`."""
    path = shared_path(spark, label)
    _scratch.append(path)
    return path


def free_scratch(spark: SparkSession) -> None:
    """Delete this driver's scratch tables; results that were not stored are lost with them."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while _scratch:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(hadoop).delete(path, True)


def empty(spark: SparkSession, columns: str) -> DataFrame:
    """No rows; the optimizer knows, and drops the joins it takes part in."""
    fields = T.StructType.fromDDL(columns)
    row = [F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
    return spark.range(1).select(*row).where(F.lit(False))


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the table.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation
    of everything before.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
