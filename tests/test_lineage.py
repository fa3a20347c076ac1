import random
import re
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.common import last_nodes, order_operations, order_requests
from trustweave.operators import lineage
from trustweave.session import durable

NINE = [
    ("raw", []), ("measured", ["raw"]), ("cleaned", ["raw"]), ("count", ["measured"]), ("ldata", ["cleaned"]),
    ("rdata", ["cleaned"]), ("aggregated", ["count", "ldata"]), ("combined", ["count", "ldata"]),
    ("matched", ["ldata", "rdata"]),
]


def log(spark, steps, run="r"):
    rows = [("s", run, i, src, "op", var, not src, f"p/{var}") for i, (var, src) in enumerate(steps, 1)]
    requests = spark.createDataFrame(
        rows, "scope STRING, run_id STRING, op_seq LONG, src_vars ARRAY<STRING>, operation STRING, "
        "dst_var STRING, is_load BOOLEAN, path STRING")
    return lineage.register_operations(requests)


def scores(spark, operations, *verdicts):
    events = None
    for var, feedback in verdicts:
        given = spark.createDataFrame([("s", "r", var, feedback)], "scope STRING, run_id STRING, var STRING, feedback DOUBLE")
        new = lineage.evaluate(operations, given)
        events = new if events is None else events.unionByName(new)
    named = lineage.scores(events).join(operations, ["scope", "run_id", "dst_idx"])
    return {r["dst_var"]: r["score"] for r in named.collect()}


def test_nine_operations_scored_twice(spark):
    operations = log(spark, NINE)
    assert scores(spark, operations, ("matched", 1.0)) == {
        "raw": 2, "cleaned": 2, "ldata": 1, "rdata": 1, "matched": 1}
    assert scores(spark, operations, ("matched", 1.0), ("combined", 1.0)) == {
        "raw": 4, "measured": 1, "cleaned": 3, "count": 1, "ldata": 2, "rdata": 1, "combined": 1, "matched": 1}


def test_self_join_credits_its_source_twice(spark):
    operations = log(spark, [("a", []), ("pair", ["a", "a"])])
    assert lineage.lineage_edges(operations).count() == 2
    assert scores(spark, operations, ("pair", 0.5)) == {"a": 1.0, "pair": 0.5}


def test_first_registration_wins(spark):
    operations = log(spark, [("a", []), ("b", ["a"]), ("b", ["b"]), ("c", ["b", "zz"])])
    rows = {r["dst_var"]: r for r in operations.collect()}
    assert rows["b"]["src_vars"] == ["a"] and rows["b"]["src_idxs"] == ["p/a#a"]
    assert rows["c"]["src_idxs"] == [rows["b"]["dst_idx"], None]


def test_violations(spark):
    operations = log(spark, [("a", []), ("b", ["c"]), ("c", ["c"]), ("d", ["x"]), ("e", ["a", "d"])])
    runs = spark.createDataFrame([("s", "r")], "scope STRING, run_id STRING")
    found = {(r["dst_var"], r["src_var"], r["violation"]) for r in lineage.validate_order(operations, runs).collect()}
    assert found == {("b", "c", "processing_order"), ("c", "c", "self_source"), ("d", "x", "processing_order")}
    nothing = lineage.validate_order(operations, runs.where("run_id = 'other'"))
    assert nothing.where("violation = 'unknown_run'").count() == 5


def test_known_totals_over_all_customers(spark):
    operations = order_operations(spark, "/root/testdata/sf0.01")
    paths = lineage.path_counts(operations, last_nodes(operations))
    assert tuple(paths.agg(F.count("*"), F.max("paths"), F.sum("paths")).first()) == (15000, 393, 107978)


def raw_log(spark, steps, run):
    rows = [("s", run, i, var, src) for i, (var, src) in enumerate(steps, 1)]
    return spark.createDataFrame(rows, "scope STRING, run_id STRING, op_seq LONG, dst_idx STRING, src_idxs ARRAY<STRING>")


def aim(spark, run, *nodes):
    return spark.createDataFrame([("s", run, n) for n in nodes], "scope STRING, run_id STRING, dst_idx STRING")


@pytest.fixture(params=[lineage.TASK_SIZE, 0], ids=["in tasks", "over tasks"])
def either_way(request, monkeypatch):
    monkeypatch.setattr(lineage, "TASK_SIZE", request.param)


@pytest.mark.parametrize("extra", [0, 297])
def test_odd_sources_at_any_size(spark, either_way, extra):
    """Null and unknown sources lead nowhere, a later one counts, in runs of 3 and of 300 operations."""
    steps = [("a", [None, "unknown", "c"]), ("b", ["a"]), ("c", [])] + [(f"x{i}", ["c"]) for i in range(extra)]
    operations = raw_log(spark, steps, "r")
    targets = aim(spark, "r", "b", "unknown")
    found = {(r["target_idx"], r["dst_idx"], r["paths"]) for r in lineage.path_counts(operations, targets).collect()}
    assert found == {("b", "b", 1), ("b", "a", 1), ("b", "c", 1)}
    assert lineage.lineage_ancestors(operations, targets).count() == 3


@pytest.mark.parametrize("extra", [0, 297])
def test_a_cycle_is_reported_at_any_size(spark, either_way, extra):
    extra = extra if lineage.TASK_SIZE else extra // 12
    steps = [("a", ["b"]), ("b", ["c"]), ("c", ["a"])] + [(f"x{i}", ["x%d" % (i - 1)] if i else []) for i in range(extra)]
    operations = raw_log(spark, steps, "r")
    with pytest.raises(lineage.LineageCycle):
        lineage.path_counts(operations, aim(spark, "r", "b"))
    if extra:  # nothing wrong upstream of others
        assert lineage.path_counts(operations, aim(spark, "r", "x9")).count() == 10


def test_long_chain_and_wide_run(spark):
    """24 steps in a row, each read by the last one too."""
    steps = [("v0", [])] + [(f"v{i}", [f"v{i - 1}"]) for i in range(1, 24)]
    steps.append(("end", [f"v{i}" for i in range(24)]))
    operations = log(spark, steps)
    found = lineage.path_counts(operations, operations.where("dst_var = 'end'"))
    assert found.where("dst_idx = 'p/v0#v0'").first()["paths"] == 24
    assert found.count() == 25


def test_more_paths_than_a_long_holds(spark, either_way):
    steps = [("v0", [])] + [(f"v{i}", [f"v{i - 1}"] * 2) for i in range(1, 70)]
    operations = raw_log(spark, steps, "r")
    found = {r["dst_idx"]: r["paths"] for r in lineage.path_counts(operations, aim(spark, "r", "v69")).collect()}
    assert found["v0"] == 2.0**69 and found["v69"] == 1 and len(found) == 70


def test_a_cycle_in_a_run_of_100000(spark, monkeypatch):
    rows = spark.range(100_000).select(
        F.lit("s").alias("scope"), F.lit("r").alias("run_id"), F.col("id").alias("op_seq"), F.concat(F.lit("v"), "id").alias("dst_idx"),
        F.array(F.concat(F.lit("v"), F.when(F.col("id") == 0, 7).otherwise(F.floor(F.col("id") / 7)).cast("string"))).alias("src_idxs"))
    operations = durable(rows, "operations")
    with pytest.raises(lineage.LineageCycle):  # v1 reads v0, v7 reads v1, v0 reads v7
        lineage.path_counts(operations, aim(spark, "r", "v99999"))
    monkeypatch.setattr(lineage, "TASK_SIZE", 0)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    with pytest.raises(lineage.LineageCycle):
        lineage.path_counts(operations, aim(spark, "r", "v99999"))
    after = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assert len(set(after) - set(jobs)) < 60


def test_many_targets_and_runs_in_one_task(spark, monkeypatch):
    """Every node a target, runs cut into slices: as many paths as a plain count finds."""
    monkeypatch.setattr(lineage, "ROWS", 50)
    draw, logs, targets, expected = random.Random(4), [], [], {}
    for run in range(12):
        steps = [(f"n{i}", [f"n{draw.randrange(i)}" for _ in range(draw.randrange(4))] if i else []) for i in range(20)]
        steps.append((None, ["n1"]))
        logs.append(raw_log(spark, steps, f"r{run}"))
        targets.append(aim(spark, f"r{run}", *[v for v, _ in steps if v]))
        for at, (target, _) in enumerate(steps[:-1]):
            paths = {target: 1}
            for var, src in reversed(steps[:at + 1]):
                for x in src:
                    if var in paths:
                        paths[x] = paths.get(x, 0) + paths[var]
            expected |= {(f"r{run}", target, k): v for k, v in paths.items()}
    found = lineage.path_counts(reduce(DataFrame.unionByName, logs).coalesce(3), reduce(DataFrame.unionByName, targets)).collect()
    assert {(r["run_id"], r["target_idx"], r["dst_idx"]): r["paths"] for r in found} == expected and len(found) == len(expected)


def test_an_operation_log_can_be_stored_as_it_is(spark, workspace):
    requests = order_requests(spark, "/root/testdata/sf0.001")
    assert "captured" not in requests.columns
    workspace.tables.write("operations", lineage.register_operations(requests))
    stored = workspace.tables.read("operations")
    assert stored.where("captured").isEmpty() and stored.where("captured IS NULL").isEmpty()
    assert stored.count() == requests.count()
    said = lineage.register_operations(requests.withColumn("captured", F.col("is_load")))
    assert said.where("captured").count() == requests.where("is_load").count() > 0


def test_a_run_and_its_targets_meet_in_one_task(spark):
    """Joins by shuffle, whose small partitions are put together."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "24",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k"}
    before = {k: spark.conf.get(k) for k in settings}
    operations = durable(order_operations(spark, "/root/testdata/sf0.01"), "operations")
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        paths = lineage.path_counts(operations, last_nodes(operations))
        assert tuple(paths.agg(F.count("*"), F.max("paths"), F.sum("paths")).first()) == (15000, 393, 107978)
        assert lineage.lineage_ancestors(operations, last_nodes(operations)).count() == 15000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_verdicts_go_with_their_targets(spark, either_way, monkeypatch):
    """Several verdicts on a variable and on a run; nothing is joined with the paths of runs that fit into a task."""
    monkeypatch.setattr(lineage, "FEW", 0)
    operations = durable(log(spark, NINE), "operations")
    given = spark.createDataFrame(
        [("s", "r", "matched", 1.0), ("s", "r", "matched", 0.5), ("s", "r", "ldata", 4.0), ("s", "r", "ldata", None), ("t", "r", "raw", 9.0)],
        "scope STRING, run_id STRING, var STRING, feedback DOUBLE")
    events = lineage.evaluate(operations, given)
    if lineage.TASK_SIZE:
        assert "Exchange" not in plan(events) and "Join" not in plan(events)
    names = {r["dst_idx"]: r["dst_var"] for r in operations.collect()}
    found = sorted((names[r["dst_idx"]], r["evaluated_var"], r["delta"]) for r in events.where("delta IS NOT NULL").collect())
    expected = [(v, "matched", x * n) for x in (1.0, 0.5) for v, n in (("raw", 2), ("cleaned", 2), ("ldata", 1), ("rdata", 1), ("matched", 1))]
    assert found == sorted(expected + [(v, "ldata", 4.0) for v in ("raw", "cleaned", "ldata")])
    assert events.where("delta IS NULL").count() == 3


def test_runs_without_targets_are_dropped_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(lineage, "FEW", 0)
    monkeypatch.setattr(lineage, "ROWS", 40)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    logs = reduce(DataFrame.unionByName, [raw_log(spark, [("v0", [])] + [(f"v{i}", [f"v{i - 1}"]) for i in range(1, 25)], f"r{n}") for n in range(9)])
    logs = logs.unionByName(raw_log(spark, [("v9", ["v9"])], None))
    targets = reduce(DataFrame.unionByName, [aim(spark, f"r{n}", "v9") for n in (0, 3, 4, 8)] + [aim(spark, None, "v9")])
    spark.conf.set(size, "7")
    try:
        found = lineage.path_counts(durable(logs, "log"), targets).groupBy("run_id").count().collect()
    finally:
        spark.conf.set(size, before)
    assert {tuple(r) for r in found} == {(f"r{n}", 10) for n in (0, 3, 4, 8)}


def test_indices_that_names_give_are_not_moved(spark):
    requests = order_requests(spark, "/root/testdata/sf0.001")
    text = plan(lineage.register_operations(requests))
    read = re.findall(r"ReadSchema: struct<([^\n]*)", text)
    assert read and not any("idx" in columns for columns in read)
