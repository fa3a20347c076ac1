"""Test every captured variable of a finished run against earlier runs."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustweave.operators import trust
from trustweave.session import durable
from trustweave.sources.tables import CAPTURE_RUN, Tables


#: Up to so many unprofiled runs of a variable are opened by their folders.
LISTED_RUNS = 1000


def captured() -> Column:
    """Operations whose rows were stored; other loads point at their source.

    Logs written before there was a column for it say so by the path.
    """
    return F.coalesce(F.col("captured"), F.col("path").contains(f"/{CAPTURE_RUN}="))


def check_run(tables: Tables, scope: str, run_id: str, compat: bool = False) -> DataFrame:
    """Confidence of all inspected columns of a run; also stored.

    Bucket specs and distributions are kept, so a check reads only captures that
    were not profiled before — normally the run itself.  What reaches the driver
    is metadata: the run's own operations, and ids of at most ``LISTED_RUNS``
    unprofiled runs a variable.  The
    history is whatever captures exist now, unfinished and later runs included.
    """
    return _check(tables, scope, run_id, compat)


def check_runs(tables: Tables, scope: str, runs: DataFrame, compat: bool = False) -> DataFrame:
    """Confidence of all inspected columns of many runs (``run_id``) in one job; also stored.

    Each run is tested against all others but those flagged before, whether or
    not they are in ``runs``; flags of this check hold for later ones only, so
    the result does not depend on an order.  Captures are profiled once for all
    samples.  Divergences are runs times samples per variable, since every sample
    has a mean of its own.  What reaches the driver are the ways in which
    variables were registered (normally one each), not the runs.
    """
    return _check(tables, scope, durable(runs.select("run_id").distinct(), "samples"), compat)


def _check(tables: Tables, scope: str, sample: str | DataFrame, compat: bool) -> DataFrame:
    operations = tables.read("operations", scope=scope)
    own = _of(operations, sample).where(captured())
    kinds = ["var", "columns", "kinds"]
    inspected = own.where(F.size("inspected_columns") > 0).select(
        F.col("dst_var").alias("var"), F.col("inspected_columns").alias("columns"),
        F.split("column_types", ",").alias("kinds"), "run_id", "started",
    ).groupBy(*kinds).agg(F.max_by("run_id", F.struct("started", "run_id")).alias("run_id"), F.max("started").alias("at"))
    variables = []
    for r in sorted(inspected.collect(), key=lambda r: (r["var"], r["at"], r["run_id"])):
        # other runs may have the columns in another order: their names count
        schema = tables.read_capture(scope, r["var"], r["run_id"]).schema
        variables.append({**r.asDict(), "fields": {i: schema[i] for i in r["columns"]}})
    ways = defaultdict(dict)  # a variable registered in several ways is profiled in as many steps
    for v in variables:
        ways[sum(x["var"] == v["var"] for x in variables[:variables.index(v)])][v["var"]] = v
    for way in ways.values():
        _profile_pending(tables, scope, sample, operations, way, compat)

    named = F.col("var").isin(sorted({v["var"] for v in variables}))
    samples = sample if isinstance(sample, str) else own.select("scope", F.col("dst_var").alias("var"), "run_id")
    result = trust.confidence(
        tables.read("dist", compat, scope).where(named),
        _current(tables, tables.read("profile", compat, scope).where(named), scope).drop("version"),
        samples,
        trust.corrupted_runs(tables.read("confidence", scope=scope).where(named)),
    ).drop("scope")
    captures = operations.where(captured()).groupBy(F.col("dst_var").alias("var")).agg(
        (F.count(F.lit(1)) - 1).alias("n_found"))
    listed = (
        own.select(F.col("dst_var").alias("var"), "run_id", F.explode_outer("inspected_columns").alias("col_idx"))
        .join(captures, "var", "left")
        .join(result, ["var", "run_id", "col_idx"], "left")
    )
    missing = F.when(F.col("col_idx").isNull(), "not_inspected").otherwise("insufficient_history")
    rows = listed.select(
        F.lit(scope).alias("scope"), "var", "run_id", "col_idx",
        F.coalesce("n_history", "n_found", F.lit(0)).cast("long").alias("n_history"),
        "jsd", "mu", "sd", "log_density", "confidence",
        F.coalesce("corrupted", F.lit(False)).alias("corrupted"),
        F.coalesce("status", missing).alias("status"),
    )
    tables.write("confidence", rows)
    return _of(tables.read("confidence", scope=scope), sample)


def _of(rows: DataFrame, sample: str | DataFrame) -> DataFrame:
    """The rows of the tested run or runs."""
    return rows.where(F.col("run_id") == sample) if isinstance(sample, str) else rows.join(sample, "run_id", "left_semi")


def _current(tables: Tables, rows: DataFrame, scope: str) -> DataFrame:
    """Profiles, or captures without a ``version``, at the version of the stored rows."""
    versions = tables.read("growths", scope=scope).where("writes IS NULL").groupBy(*trust.RUN).agg(F.count(F.lit(1)).alias("_v"))
    version = F.coalesce("_v", F.lit(0)).cast("long")
    joined = rows.join(versions, trust.RUN, "left")
    if "version" in rows.columns:
        return joined.where(F.col("version") == version).drop("_v")
    return joined.withColumn("version", version).drop("_v")


def _profile_pending(tables, scope, sample, operations, variables, compat) -> None:
    """Fill in missing bucket specs and distributions of the tested runs' variables.

    Specs stem from the earliest good run that is not tested itself, or from a
    tested one if there is no other.
    """
    corrupted = trust.corrupted_runs(tables.read("confidence", scope=scope))
    tested = _of(operations, sample).select("run_id").distinct().withColumn("_tested", F.lit(True))
    captures = operations.where(captured() & F.col("dst_var").isin(list(variables))).select(
        "scope", F.col("dst_var").alias("var"), "run_id", "started"
    )
    first = {
        r["var"]: r
        for r in captures.join(corrupted.withColumn("_out", F.lit(True)), trust.RUN, "left").join(tested, "run_id", "left")
        .groupBy("var")
        .agg(
            (F.count(F.lit(1)) - 1).alias("n_found"),
            F.min_by("run_id", F.when(F.col("_out").isNull(), F.struct(
                F.col("_tested").isNotNull(), "started", "run_id"))).alias("run"),
        )
        .collect()
    }
    testable = {
        v: row for v, row in variables.items()
        if v in first and first[v]["n_found"] >= trust.MIN_HISTORY
    }
    if not testable:
        return
    _fill_specs(tables, scope, testable, first, compat)

    wanted = reduce(
        DataFrame.unionByName,
        [captures.where(F.col("var") == v).withColumn(
            "col_idx", F.explode(F.lit(list(r["columns"])).cast("array<int>"))) for v, r in testable.items()],
    ).select(*trust.RUN_COL)
    out = corrupted.join(tested, "run_id", "left_anti")
    pending = _current(tables, wanted.join(out, trust.RUN, "left_anti"), scope).join(
        tables.read("profile", compat, scope), [*trust.RUN_COL, "version"], "left_anti"
    )
    pending = durable(pending, "pending")
    todo = pending.groupBy("var").agg(F.countDistinct("run_id").alias("n")).collect()
    if not todo:
        return
    spec = tables.read("bucket_spec", compat, scope)
    counts, merged = [], False
    for row in todo:
        var, way = row["var"], testable[row["var"]]
        of_var = pending.where(F.col("var") == var)
        runs, grown = of_var.select("run_id").distinct(), {}
        if row["n"] <= LISTED_RUNS:  # their folders only, and of what grew only the new files
            grown = _grown(tables, scope, of_var, var, compat)
            runs = [r["run_id"] for r in runs.collect() if r["run_id"] not in grown]
        if runs:
            obs = _observe(tables, scope, var, runs, way["columns"], way)
            counts.append(trust.histogram_counts(obs, spec, way["columns"], scope, var))
        if grown:
            merged = True
            new = sorted({w for writes in grown.values() for w in writes})
            if new:
                obs = _observe(tables, scope, var, sorted(grown), way["columns"], way, new)
                counts.append(trust.histogram_counts(obs, spec, way["columns"], scope, var))
            counts.append(_counted_before(tables, scope, var, sorted(grown), compat))
    counted = reduce(DataFrame.unionByName, counts)
    if merged:
        counted = counted.groupBy(*trust.RUN_COL, "bucket").agg(F.sum("n").alias("n"))
    # captures are read once; distribution and profile both come from the counts
    counted = durable(counted, "counts")
    complete = pending.join(trust.profile_counts(counted), trust.RUN_COL, "left")
    frequencies = trust.relative_frequency(counted, compat, keep=True)
    # a run's distributions are replaced together: those of its other columns are written again
    others = tables.read("dist", compat, scope).join(pending.select(*trust.RUN).distinct(), trust.RUN, "left_semi")
    others = durable(others.join(pending, trust.RUN_COL, "left_anti"), "others")
    frequencies = frequencies.join(pending.select(*trust.RUN_COL, "version"), trust.RUN_COL)
    tables.write("dist", frequencies.unionByName(others), compat)
    tables.write("profile", complete.fillna(0, ["n", "n_bad"]), compat)


def _last_profiles(tables, scope, var, compat) -> DataFrame:
    """The latest profile of each column of a variable's captures."""
    rows = tables.read("profile", compat, scope).where(F.col("var") == var)
    return rows.groupBy(*trust.RUN_COL).agg(
        F.max("version").alias("version"), F.max_by("n", "version").alias("n"), F.max_by("n_bad", "version").alias("n_bad"))


def _grown(tables, scope, pending, var, compat) -> dict[str, list[str]]:
    """Runs whose counts can be carried on, with the writes since; pending runs are few.

    All pending columns must have been counted at the same version, their stored
    counts must be those of that version and complete, and every later growth must
    have named its writes.  Any other run is read whole.
    """
    runs = pending.select("run_id").distinct()
    growths = tables.read("growths", scope=scope).where(F.col("var") == var).join(runs, "run_id", "left_semi")
    events = defaultdict(dict)
    for r in growths.orderBy("at", F.col("writes").isNotNull()).collect():
        events[r["run_id"]].setdefault(r["growth"], None)
        if r["writes"] is not None:
            events[r["run_id"]][r["growth"]] = r["writes"]
    if not events:
        return {}
    stored = tables.read("dist", compat, scope).where(F.col("var") == var).groupBy(*trust.RUN_COL, "version").agg(
        F.sum("n").alias("stored"))
    last = _last_profiles(tables, scope, var, compat).join(stored, [*trust.RUN_COL, "version"], "left").select(
        *trust.RUN_COL, F.when(F.coalesce("stored", F.lit(0)) == F.col("n"), F.col("version")).alias("at_version"))
    bases = pending.join(last, trust.RUN_COL, "left").groupBy("run_id").agg(
        F.min("at_version").alias("lo"), F.max("at_version").alias("hi"), F.count("at_version").alias("n"),
        F.count(F.lit(1)).alias("columns")).collect()
    grown = {}
    for b in bases:
        if b["n"] < b["columns"] or b["lo"] != b["hi"] or b["run_id"] not in events:
            continue
        since = list(events[b["run_id"]].values())[b["lo"]:]
        if all(writes is not None for writes in since):
            grown[b["run_id"]] = [w for writes in since for w in writes]
    return grown


def _counted_before(tables, scope, var, runs, compat) -> DataFrame:
    """Stored counts of some runs of a variable, unusable values included."""
    some = (F.col("var") == var) & F.col("run_id").isin(runs)
    dist = tables.read("dist", compat, scope).where(some).select(*trust.RUN_COL, "bucket", "n")
    bad = _last_profiles(tables, scope, var, compat).where(some).select(
        *trust.RUN_COL, F.lit(None).cast("int").alias("bucket"), F.col("n_bad").alias("n"))
    return dist.unionByName(bad.where("n > 0"))


def _fill_specs(tables, scope, testable, first, compat) -> None:
    """Freeze base and step of columns that have none, from the earliest good run."""
    known = {
        (r["var"], r["col_idx"])
        for r in tables.read("bucket_spec", compat, scope).where(F.col("var").isin(list(testable))).collect()
    }
    specs = []
    for var, row in testable.items():
        missing = [i for i in row["columns"] if (var, i) not in known]
        if missing and first[var]["run"] is not None:
            obs = _observe(tables, scope, var, [first[var]["run"]], missing, row)
            specs.append(trust.bucket_spec(obs, scope, var, compat))
    if specs:
        tables.write("bucket_spec", reduce(DataFrame.unionByName, specs), compat)


def _observe(tables, scope, var, runs, columns, row, writes=None) -> DataFrame:
    """Observations of some runs, given as a list or, if there are many, as a table."""
    listed = isinstance(runs, list)
    fields = T.StructType([row["fields"][i] for i in columns])
    only = {} if writes is None else {"writes": writes}
    frame = tables.read_captures(scope, var, sorted(runs) if listed else None, fields, **only)
    if not listed:
        frame = frame.join(runs.withColumnRenamed("run_id", CAPTURE_RUN), CAPTURE_RUN, "left_semi")
    return trust.observations(
        frame,
        {i: row["fields"][i].name for i in columns},
        {i for i in columns if row["kinds"][i] == "s"},
        CAPTURE_RUN,
    )
