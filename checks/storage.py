"""Sources, sinks, captures and the metadata and profile tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import (
    COUNTS_SQL, NODES_SQL, OBS_SQL, QUARTER_SQL, RUNS_SQL, SHIPPED, SPEC_SQL,
    customer_runs, day, first_run, order_operations, quarter, registry, shipped, table,
)
from trustweave.operators import search, trust
from trustweave.plans.workspace import Workspace
from trustweave.session import durable, shared_path
from trustweave.sources.delimited import load_delimited, store_delimited
from trustweave.sources.tables import Tables

QUERIES, ORACLES, query = registry()
PART_SCHEMA = "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"
PART_SQL = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"


def stored(spark, d, name: str, sep: str = ",", codec: str | None = None) -> str:
    """Write a given table as delimited text into the shared folder."""
    path = shared_path(spark, f"text-{name}")
    store_delimited(table(spark, d, name), path, sep, codec=codec)
    return path


def imported(spark, d) -> Workspace:
    """A workspace holding all quarters of lineitem and all days of events."""
    ws = Workspace(spark)
    items = table(spark, d, "lineitem").select("l_orderkey", *SHIPPED.values(), "l_shipdate", quarter().alias("q"))
    ws.import_history("sales", "shipped", items, "q", F.min("l_shipdate"), list(SHIPPED.values()))
    events = table(spark, d, "events").select("event_id", "value", "event_type", "ts", day().alias("d"))
    ws.import_history("web", "visits", events, "d", F.min("ts"), ["value", "event_type"])
    return ws


# -- delimited text ---------------------------------------------------------------

@query("""SELECT n_nationkey, n_name, n_regionkey, 'LOADER_nation' AS operation, 'n,s,n' AS kinds FROM nation""")
def prov_load(spark, d):
    path = stored(spark, d, "nation")
    ws = Workspace(spark)
    run = ws.start_run("loads", "round trip")
    rows = run.load(path, "nation", "n_nationkey INT, n_name STRING, n_regionkey INT", column_types="n,s,n")
    log = ws.tables.read("operations").where((F.col("run_id") == run.run_id) & F.col("is_load")).first()
    return rows.select("*", F.lit(log["operation"]).alias("operation"), F.lit(log["column_types"]).alias("kinds"))


@query(PART_SQL)
def load_delimiter(spark, d):
    return load_delimited(spark, stored(spark, d, "part", sep="|"), PART_SCHEMA, sep="|")


@query("""SELECT p_partkey, TRY_CAST(p_name AS DOUBLE) AS p_name, p_brand, p_type, p_size, p_retailprice,
          CAST(NULL AS VARCHAR) AS missing FROM part""")
def load_schema_cast(spark, d):
    schema = PART_SCHEMA.replace("p_name STRING", "p_name DOUBLE") + ", missing STRING"
    return load_delimited(spark, stored(spark, d, "part"), schema)


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS _c0, s_name AS _c1, CAST(s_nationkey AS VARCHAR) AS _c2,
          CAST(s_acctbal AS VARCHAR) AS _c3 FROM supplier""")
def load_noschema(spark, d):
    return load_delimited(spark, stored(spark, d, "supplier"), 4)


@query("SELECT s_suppkey, s_name, TRUE AS from_text, TRUE AS below_path FROM supplier")
def load_tag_source(spark, d):
    path = stored(spark, d, "supplier")
    schema = "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE"
    names = load_delimited(spark, path, schema, tag="name")
    paths = load_delimited(spark, path, schema, tag="path").select("s_suppkey", "source_path")
    return names.join(paths, "s_suppkey").select(
        "s_suppkey", "s_name", F.col("source_name").rlike(r"\Apart-.*\.txt\z").alias("from_text"),
        F.col("source_path").contains(path).alias("below_path"))


@query(PART_SQL)
def load_compressed(spark, d):
    return load_delimited(spark, stored(spark, d, "part", codec="bzip2"), PART_SCHEMA)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def load_plain(spark, d):
    return load_delimited(spark, stored(spark, d, "nation"), "n_nationkey INT, n_name STRING, n_regionkey INT")


@query("SELECT o_orderkey || chr(9) || o_custkey || chr(9) || coalesce(nullif(o_orderstatus, 'P'), '') AS value FROM orders")
def store_delimited_text(spark, d):
    path = shared_path(spark, "text-orders")
    status = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    store_delimited(table(spark, d, "orders").select("o_orderkey", "o_custkey", status), path)
    return spark.read.text(path)


QUERIES["store_delimited"] = QUERIES.pop("store_delimited_text")
ORACLES["store_delimited"] = ORACLES.pop("store_delimited_text")


# -- captures ---------------------------------------------------------------------------

@query("""SELECT s_suppkey, s_name, n_name, 'supplier,nation' AS srcvar, 'JOIN' AS operation
          FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 0""")
def capture(spark, d):
    ws = Workspace(spark)
    run = ws.start_run("captures")
    suppliers = run.load(stored(spark, d, "supplier"), "supplier",
                         "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE")
    nations = run.load(stored(spark, d, "nation"), "nation", "n_nationkey INT, n_name STRING, n_regionkey INT")
    joined = suppliers.where("s_acctbal >= 0").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = run.capture(joined.select("s_suppkey", "s_name", "n_name"), "located", ["supplier", "nation"], "JOIN",
                       inspected=["s_suppkey"])
    log = ws.operations_view().where((F.col("run_id") == run.run_id) & (F.col("dstvar") == "located")).first()
    return rows.select("*", F.lit(log["srcvar"]).alias("srcvar"), F.lit(log["operation"]).alias("operation"))


@query(f"""SELECT l_orderkey, l_quantity, l_extendedprice, l_returnflag FROM lineitem
           WHERE {QUARTER_SQL} = (SELECT max({QUARTER_SQL}) FROM lineitem)""")
def read_capture(spark, d):
    ws = imported(spark, d)
    last = ws.tables.read("runs").where("scope = 'sales'").agg(F.max("run_id")).first()[0]
    return ws.tables.read_capture("sales", "shipped", last).drop("l_shipdate")


@query(f"""WITH {NODES_SQL}, {RUNS_SQL}
           SELECT run_id, 'run' AS _type, info, start_s, finish_s, CAST(NULL AS VARCHAR) AS dstidx, CAST(NULL AS VARCHAR) AS srcvar FROM runs
           UNION ALL SELECT run_id, 'operation', NULL, CAST(epoch(o_orderdate) AS BIGINT), NULL, dst_idx,
             CASE WHEN k = 1 THEN '-' ELSE 'v' || (k - 1) || ',v' || (k // 2) END FROM nodes""")
def metadata_store(spark, d):
    tables = Tables(spark, shared_path(spark, "metadata"))
    tables.write("runs", customer_runs(spark, d))
    tables.write("operations", order_operations(spark, d))
    records = search.union_metadata(
        search.current_runs(tables.read("runs")), search.current_operations(tables.read("operations")))
    return records.select(
        "run_id", "_type", "info", F.unix_seconds("start").alias("start_s"),
        F.unix_seconds("finish").alias("finish_s"), "dstidx", "srcvar")


# -- profiles -----------------------------------------------------------------------------

@query(f"""WITH {OBS_SQL}, {SPEC_SQL}, {COUNTS_SQL}
           SELECT scope, var, run_id, col_idx, count(*) AS buckets, round(sum(p), 9) AS mass, CAST(sum(n) AS BIGINT) AS n
           FROM dist JOIN counts USING (scope, var, run_id, col_idx, bucket) WHERE var = 'shipped' GROUP BY ALL""")
def persist_distribution(spark, d):
    """Profiles are written in two steps; the second finds only what is missing."""
    tables = Tables(spark, shared_path(spark, "profiles"))
    obs = shipped(spark, d)
    spec = durable(trust.bucket_spec(first_run(spark, d, shipped), "sales", "shipped"), "spec")
    early = F.col("run_id") < "19980"
    for part in (obs.where(early), obs):
        missing = part.join(tables.read("profile").select("run_id").distinct(), "run_id", "left_anti")
        counts = durable(trust.histogram_counts(missing, spec, list(SHIPPED), "sales", "shipped"), "counts")
        tables.write("dist", trust.relative_frequency(counts, keep=True).withColumn("version", F.lit(0)))
        tables.write("profile", trust.profile_counts(counts).withColumn("version", F.lit(0)))
    sums = tables.read("dist").groupBy(*trust.RUN_COL).agg(
        F.count(F.lit(1)).alias("buckets"), F.round(F.sum("p"), 9).alias("mass"))
    return sums.join(tables.read("profile").select(*trust.RUN_COL, "n"), trust.RUN_COL)


@query(f"""WITH {OBS_SQL}, {SPEC_SQL} SELECT scope, var, col_idx, base, step FROM spec WHERE var = 'shipped'""")
def persist_bucket_spec(spark, d):
    """A spec saved for one column stays; a later check adds only the others."""
    tables = Tables(spark, shared_path(spark, "specs"))
    obs = first_run(spark, d, shipped)
    for columns in ([0], list(SHIPPED)):
        wanted = trust.bucket_spec(obs.where(F.col("col_idx").isin(columns)), "sales", "shipped")
        tables.write("bucket_spec", wanted.join(tables.read("bucket_spec"), trust.COL, "left_anti"))
    return tables.read("bucket_spec")
