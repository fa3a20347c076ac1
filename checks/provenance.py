"""Runs, operations, lineage, scores and search over one lineage per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.common import (
    NODES_SQL, PATHS_SQL, RUNS_SQL, customer_runs, last_nodes, order_nodes, order_operations,
    order_requests, registry, table,
)
from trustweave.operators import lineage, search
from trustweave.plans.workspace import Workspace
from trustweave.session import durable, shared_path
from trustweave.sources.tables import Tables

QUERIES, ORACLES, query = registry()


SRC_SQL = "CASE WHEN k = 1 THEN '-' ELSE 'v' || (k - 1) || ',v' || (k // 2) END"
SCORE_SQL = """CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN -1.0 ELSE 0.5 END"""


# -- registration --------------------------------------------------------------------

@query(f"WITH {RUNS_SQL} SELECT run_id, 'orders' AS scope, info, start_s FROM runs")
def start_run(spark, d):
    ws = Workspace(spark)
    ws.start_runs(customer_runs(spark, d).where("event = 'start'"))
    return ws.tables.read("runs").select("run_id", "scope", "info", F.unix_seconds("at").alias("start_s"))


@query(f"WITH {RUNS_SQL} SELECT run_id, start_s, finish_s, finish_s IS NULL AS failed FROM runs")
def finish_run(spark, d):
    ws = Workspace(spark)
    events = customer_runs(spark, d)
    ws.start_runs(events.where("event = 'start'"))
    ws.finish_runs(events.where("event = 'finish'"))
    return ws.runs_view().select(
        "run_id", F.unix_seconds("start").alias("start_s"), F.unix_seconds("finish").alias("finish_s"),
        F.col("finish").isNull().alias("failed"))


@query(f"""WITH {NODES_SQL} SELECT run_id, k AS op_seq, dst_var, dst_idx, operation,
           o_orderkey, k = 1 AS is_load FROM nodes""")
def register_operation(spark, d):
    """Some variables are registered twice; the first registration stays."""
    requests = order_requests(spark, d)
    again = requests.where("o_orderstatus = 'F'").select(
        *[(F.col(c) + 1000).alias(c) if c == "op_seq" else F.lit("again").alias(c) if c == "operation" else c
          for c in requests.columns])
    ws = Workspace(spark)
    ws.start_runs(customer_runs(spark, d).where("event = 'start'"))
    return ws.register(requests.unionByName(again)).select(
        "run_id", "op_seq", "dst_var", "dst_idx", "operation", "o_orderkey", "is_load")


@query(f"""WITH {NODES_SQL}, listed AS (
             SELECT run_id, dst_idx, string_agg(src_idx, ',' ORDER BY src_k DESC) AS srcidx FROM edges GROUP BY ALL)
           SELECT n.run_id, n.dst_var, CASE WHEN k = 1 THEN '' ELSE srcidx END AS srcidx
           FROM nodes n LEFT JOIN listed USING (run_id, dst_idx)""")
def resolve_src_idx(spark, d):
    return order_operations(spark, d).select("run_id", "dst_var", F.array_join("src_idxs", ",").alias("srcidx"))


@query(f"""WITH {NODES_SQL}, asked AS (
             SELECT run_id, k, dst_var, CASE WHEN o_orderstatus = 'P' THEN 'v' || (k + 1)
               WHEN k % 5 = 0 THEN 'v' || k ELSE 'v' || (k - 1) END AS src_var FROM nodes WHERE k > 1)
           SELECT a.run_id, a.k AS op_seq, a.dst_var, a.src_var,
             CASE WHEN a.src_var = a.dst_var THEN 'self_source' ELSE 'processing_order' END AS violation
           FROM asked a LEFT JOIN nodes s ON s.run_id = a.run_id AND s.dst_var = a.src_var
           WHERE a.src_var = a.dst_var OR s.k IS NULL OR s.k >= a.k
           UNION ALL SELECT run_id, k, dst_var, NULL, 'unknown_run' FROM nodes
           WHERE run_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING')""")
def validate_order(spark, d):
    k = F.col("op_seq")
    asked = (
        F.when(k == 1, F.array().cast("array<string>"))
        .when(F.col("o_orderstatus") == "P", F.array(F.concat(F.lit("v"), (k + 1).cast("string"))))
        .when(k % 5 == 0, F.array("dst_var"))
        .otherwise(F.array(F.concat(F.lit("v"), (k - 1).cast("string")))))
    runs = customer_runs(spark, d).where("info <> 'BUILDING'")
    return lineage.validate_order(order_requests(spark, d).withColumn("src_vars", asked), runs).drop("scope")


# -- lineage -----------------------------------------------------------------------------

@query(f"WITH {NODES_SQL} SELECT run_id, dst_idx, src_idx FROM edges")
def lineage_edges(spark, d):
    return lineage.lineage_edges(order_operations(spark, d)).drop("scope")


def _named(paths: DataFrame, operations: DataFrame) -> DataFrame:
    names = operations.select("scope", "run_id", "dst_idx", "dst_var")
    targets = names.select("scope", "run_id", F.col("dst_idx").alias("target_idx"), F.col("dst_var").alias("target"))
    return paths.join(names, ["scope", "run_id", "dst_idx"]).join(targets, ["scope", "run_id", "target_idx"])


@query(f"""WITH RECURSIVE {PATHS_SQL} SELECT run_id, 'v' || target AS target, 'v' || k AS dst_var FROM paths""")
def lineage_ancestors(spark, d):
    operations = durable(order_operations(spark, d), "operations")
    found = lineage.lineage_ancestors(operations, last_nodes(operations))
    return _named(found, operations).select("run_id", "target", "dst_var")


@query(f"""WITH RECURSIVE {PATHS_SQL} SELECT run_id, 'v' || target AS target, 'v' || k AS dst_var, paths FROM paths""")
def path_counts(spark, d):
    operations = durable(order_operations(spark, d), "operations")
    counted = lineage.path_counts(operations, last_nodes(operations))
    return _named(counted, operations).select("run_id", "target", "dst_var", F.col("paths").cast("long").alias("paths"))


def verdicts(operations: DataFrame) -> DataFrame:
    """Feedback on each run's last variable, by the status of its order."""
    status = F.col("o_orderstatus")
    feedback = F.when(status == "F", 1.0).when(status == "O", -1.0).otherwise(0.5)
    return last_nodes(operations).select("scope", "run_id", F.col("dst_var").alias("var"), feedback.alias("feedback"))


@query(f"""WITH RECURSIVE {PATHS_SQL}
           SELECT p.run_id, n.dst_idx, 'v' || target AS evaluated_var, CAST(p.paths * {SCORE_SQL.replace('o_orderstatus', 't.o_orderstatus')} AS DOUBLE) AS delta
           FROM paths p JOIN nodes n ON n.run_id = p.run_id AND n.k = p.k
           JOIN nodes t ON t.run_id = p.run_id AND t.k = p.target""")
def propagate_score(spark, d):
    operations = durable(order_operations(spark, d), "operations")
    return lineage.evaluate(operations, verdicts(operations)).select("run_id", "dst_idx", "evaluated_var", "delta")


@query(f"""WITH RECURSIVE {PATHS_SQL}
           SELECT n.run_id, n.dst_idx, n.dst_var, CAST(sum(f) AS DOUBLE) AS score FROM (
             SELECT p.run_id, p.k, p.paths * {SCORE_SQL.replace('o_orderstatus', 't.o_orderstatus')} AS f
             FROM paths p JOIN nodes t ON t.run_id = p.run_id AND t.k = p.target
             UNION ALL SELECT run_id, k, 2.0 FROM nodes WHERE k = 1) s
           JOIN nodes n ON n.run_id = s.run_id AND n.k = s.k GROUP BY ALL""")
def evaluate(spark, d):
    """Two rounds of verdicts add up: one on the last variable, one on the load."""
    operations = durable(order_operations(spark, d), "operations")
    tables = Tables(spark, shared_path(spark, "scores"))
    loads = operations.where("is_load").select(
        "scope", "run_id", F.col("dst_var").alias("var"), F.lit(2.0).alias("feedback"))
    for round_ in (verdicts(operations), loads):
        tables.write("scores", lineage.evaluate(operations, round_), dealt=True)  # one scope
    names = operations.select("scope", "run_id", "dst_idx", "dst_var")
    return lineage.scores(tables.read("scores")).join(names, ["scope", "run_id", "dst_idx"]).drop("scope")


# -- search ----------------------------------------------------------------------------------

def records(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Current runs, current operations and both as one relation."""
    runs = search.current_runs(customer_runs(spark, d))
    log = durable(order_operations(spark, d), "operations")
    operations = search.current_operations(log)
    priced = operations.join(
        log.select("scope", "run_id", F.col("dst_var").alias("dstvar"), F.col("o_totalprice").alias("price")),
        ["scope", "run_id", "dstvar"])
    return runs, priced, search.union_metadata(runs, priced)


HITS = "SELECT * FROM records WHERE (_type = 'run' AND info = 'BUILDING') OR (_type = 'operation' AND price > 400000)"


def hits(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    runs, operations, relation = records(spark, d)
    return search.metadata_sql(relation, HITS), runs, operations


HITS_SQL = f"""{NODES_SQL}, {RUNS_SQL},
run_hits AS (SELECT * FROM runs WHERE info = 'BUILDING'),
op_hits AS (SELECT * FROM nodes WHERE o_totalprice > 400000),
hit_runs AS (SELECT run_id FROM run_hits UNION SELECT run_id FROM op_hits),
expanded AS (SELECT n.* FROM nodes n WHERE run_id IN (SELECT run_id FROM run_hits)
             UNION ALL SELECT * FROM op_hits WHERE run_id NOT IN (SELECT run_id FROM run_hits))"""


@query(f"""WITH {HITS_SQL} SELECT run_id, 'run' AS _type, CAST(NULL AS VARCHAR) AS dstvar, info FROM run_hits
           UNION ALL SELECT run_id, 'operation', dst_var, NULL FROM op_hits""")
def metadata_sql(spark, d):
    found, *_ = hits(spark, d)
    return found.select("run_id", "_type", "dstvar", "info")


@query(f"""WITH {NODES_SQL}, {RUNS_SQL}
           SELECT run_id, 'run' AS _type, info, start_s, CAST(NULL AS VARCHAR) AS srcvar, CAST(NULL AS VARCHAR) AS operation FROM runs
           UNION ALL SELECT run_id, 'operation', NULL, CAST(epoch(o_orderdate) AS BIGINT), {SRC_SQL}, operation FROM nodes""")
def union_metadata(spark, d):
    _, _, relation = records(spark, d)
    return relation.select("run_id", "_type", "info", F.unix_seconds("start").alias("start_s"), "srcvar", "operation")


@query(f"""WITH {HITS_SQL} SELECT o.run_id, dst_var AS dstvar, info, start_s, finish_s
           FROM op_hits o JOIN runs USING (run_id)""")
def join_run_of_operation(spark, d):
    found, runs, _ = hits(spark, d)
    return search.join_run_of_operation(found.where("_type = 'operation'"), runs).select(
        "run_id", "dstvar", "info", F.unix_seconds("run_start").alias("start_s"),
        F.unix_seconds("finish").alias("finish_s"))


@query(f"""WITH {HITS_SQL} SELECT run_id, dst_var AS dstvar FROM op_hits
           WHERE run_id NOT IN (SELECT run_id FROM run_hits)""")
def anti_excluded_runs(spark, d):
    found, *_ = hits(spark, d)
    return search.anti_excluded_runs(found.where("_type = 'operation'"), found.where("_type = 'run'")).select(
        "run_id", "dstvar")


@query(f"WITH {HITS_SQL} SELECT run_id FROM hit_runs")
def distinct_runs(spark, d):
    found, *_ = hits(spark, d)
    return search.distinct_runs(found).select("run_id")


@query(f"WITH {HITS_SQL} SELECT run_id, dst_var AS dstvar, dst_idx AS dstidx FROM expanded")
def union_search_hits(spark, d):
    found, _, operations = hits(spark, d)
    return search.search_hits(found, operations).drop("scope")


@query(f"""WITH {HITS_SQL} SELECT run_id, dst_idx AS dstidx, dst_var AS dstvar, l_partkey, l_linenumber, l_quantity
           FROM expanded JOIN lineitem ON l_orderkey = o_orderkey""")
def search_data(spark, d):
    """The captured rows of an order's operation are its line items."""
    found, _, operations = hits(spark, d)
    nodes = order_nodes(spark, d).select(
        F.lit("orders").alias("scope"), F.col("o_custkey").cast("string").alias("run_id"),
        F.concat(F.lit("v"), F.col("k").cast("string")).alias("dstvar"), "o_orderkey")
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    captured = items.join(nodes, F.col("l_orderkey") == F.col("o_orderkey"))
    return search.search_data(search.search_hits(found, operations), captured).select(
        "run_id", "dstidx", "dstvar", "l_partkey", "l_linenumber", "l_quantity")


@query(f"""WITH {HITS_SQL} SELECT 'run' AS listing, run_id, info AS a, CAST(start_s AS VARCHAR) AS b FROM run_hits
           UNION ALL SELECT 'operation', run_id, {SRC_SQL}, dst_idx FROM op_hits""")
def search_meta(spark, d):
    found, *_ = hits(spark, d)
    runs, operations = search.search_meta(found)
    return runs.select(
        F.lit("run").alias("listing"), "run_id", F.col("info").alias("a"),
        F.unix_seconds("start").cast("string").alias("b"),
    ).unionByName(operations.select(
        F.lit("operation").alias("listing"), "run_id", F.col("srcvar").alias("a"), F.col("dstidx").alias("b")))


@query(f"""WITH {HITS_SQL} SELECT run_id, {SRC_SQL} AS srcvar, operation, dst_var AS dstvar FROM nodes
           WHERE run_id IN (SELECT run_id FROM hit_runs)""")
def search_semantics(spark, d):
    found, _, operations = hits(spark, d)
    return search.search_semantics(found, operations)
