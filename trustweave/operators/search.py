"""Search over run metadata: current records, hits, captured data and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = ["scope", "run_id"]
RUN_TYPE = "run"
OPERATION_TYPE = "operation"

# Column order of the two listings of a metadata search.
RUN_COLUMNS = ["run_id", "scope", "info", "start", "finish"]
OPERATION_COLUMNS = [
    "run_id", "srcvar", "srcidx", "operation", "dstvar", "dstidx", "score",
    "column_type", "inspected_columns", "confidence", "start",
]


def current_runs(runs: DataFrame) -> DataFrame:
    """One row per run from its events; a null ``finish`` means it did not end well."""
    at = lambda event: F.max(F.when(F.col("event") == event, F.col("at")))
    return runs.groupBy(*RUN).agg(
        F.max("info").alias("info"), at("start").alias("start"), at("finish").alias("finish")
    )


def current_operations(
    operations: DataFrame, score: DataFrame | None = None, confidence: DataFrame | None = None
) -> DataFrame:
    """Operation records with list columns as text, their score and confidence.

    ``score`` has ``scope, run_id, dst_idx, score``; ``confidence`` has
    ``scope, run_id, var, confidence`` (text).
    """
    view = operations
    if score is not None:
        view = view.join(score, [*RUN, "dst_idx"], "left")
    else:
        view = view.withColumn("score", F.lit(None).cast("double"))
    if confidence is not None:
        view = view.join(confidence.withColumnRenamed("var", "dst_var"), [*RUN, "dst_var"], "left")
    else:
        view = view.withColumn("confidence", F.lit(None).cast("string"))
    return view.select(
        *RUN,
        _sources("src_vars").alias("srcvar"),
        _sources("src_idxs").alias("srcidx"),
        "operation",
        F.col("dst_var").alias("dstvar"),
        F.col("dst_idx").alias("dstidx"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.col("column_types").alias("column_type"),
        F.array_join(F.col("inspected_columns").cast("array<string>"), ",").alias("inspected_columns"),
        F.coalesce("confidence", F.lit("")).alias("confidence"),
        F.col("started").alias("start"),
    )


def _sources(column: str) -> Column:
    """Comma list of sources; a load has none and shows a dash."""
    return F.when(F.col("is_load"), F.lit("-")).otherwise(F.array_join(column, ","))


def union_metadata(runs: DataFrame, operations: DataFrame) -> DataFrame:
    """Run and operation records as one relation, told apart by ``_type``."""
    return runs.withColumn("_type", F.lit(RUN_TYPE)).unionByName(
        operations.withColumn("_type", F.lit(OPERATION_TYPE)), allowMissingColumns=True
    )


def metadata_sql(records: DataFrame, sql: str, view: str = "records") -> DataFrame:
    """Free SQL over the records, registered as a view under ``view``."""
    records.createOrReplaceTempView(view)
    return records.sparkSession.sql(sql)


def join_run_of_operation(operation_hits: DataFrame, runs: DataFrame) -> DataFrame:
    """Run record of every operation hit."""
    return operation_hits.select(*RUN, "dstvar", "dstidx", "srcvar").join(
        runs.select(*RUN, "info", F.col("start").alias("run_start"), "finish"), RUN
    )


def anti_excluded_runs(operation_hits: DataFrame, run_hits: DataFrame) -> DataFrame:
    """Operation hits whose run was not already hit as a whole."""
    return operation_hits.join(run_hits.select(*RUN), RUN, "left_anti")


def distinct_runs(hits: DataFrame) -> DataFrame:
    """The runs behind any hits."""
    return hits.select(*RUN).distinct()


def search_hits(hits: DataFrame, operations: DataFrame) -> DataFrame:
    """Operations whose captures a search returns.

    A run hit stands for all operations of the run; a single operation hit
    counts only if its run is not hit as a whole.
    """
    columns = [*RUN, "dstvar", "dstidx"]
    run_hits = hits.where(F.col("_type") == RUN_TYPE).select(*RUN).distinct()
    of_runs = operations.select(*columns).join(run_hits, RUN, "left_semi")
    single = anti_excluded_runs(hits.where(F.col("_type") == OPERATION_TYPE), run_hits)
    return of_runs.unionByName(single.select(*columns).distinct())


def search_data(expanded: DataFrame, captured: DataFrame) -> DataFrame:
    """Captured rows behind the hits: ``run_id, dstidx, dstvar`` and the data.

    ``captured`` has ``scope, run_id, dstvar`` and one row per captured row.
    """
    return expanded.join(captured, [*RUN, "dstvar"])


def search_meta(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Run table and operation table of the hits, in their fixed column order."""
    return (
        hits.where(F.col("_type") == RUN_TYPE).select(RUN_COLUMNS),
        hits.where(F.col("_type") == OPERATION_TYPE).select(OPERATION_COLUMNS),
    )


def search_semantics(hits: DataFrame, operations: DataFrame) -> DataFrame:
    """``srcvar, operation, dstvar`` of every operation of the runs hit."""
    return operations.join(distinct_runs(hits), RUN, "left_semi").select(
        "run_id", "srcvar", "operation", "dstvar"
    )
