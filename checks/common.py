"""Shared inputs of the registered queries, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustweave.operators import lineage, trust


def registry() -> tuple[dict, dict, Callable]:
    """Queries, their SQL twins, and the decorator that registers both."""
    queries, oracles = {}, {}

    def query(sql: str | None = None):
        def register(fn):
            queries[fn.__name__] = fn
            if sql:
                oracles[fn.__name__] = sql
            return fn
        return register

    return queries, oracles, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- text hash ---------------------------------------------------------------

def hash_sql(text: str) -> str:
    """The 32-bit text hash in SQL: UTF-16 units, base 31, signed."""
    units = (
        f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) > 65535 "
        "THEN [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024] "
        "ELSE [unicode(c)] END))"
    )
    folded = (
        f"list_reduce(list_transform({units}, lambda u: CAST(u AS BIGINT)), "
        "lambda a, u: (a * 31 + u) % 4294967296, CAST(0 AS BIGINT))"
    )
    return (
        f"CASE WHEN {text} IS NULL THEN NULL WHEN {text} = '' THEN 0 "
        f"ELSE (({folded}) + 2147483648) % 4294967296 - 2147483648 END"
    )


# -- captured runs: quarters of lineitem, days of events ---------------------------

SHIPPED = {0: "l_quantity", 1: "l_extendedprice", 2: "l_returnflag"}
VISITS = {0: "value", 1: "event_type"}


def quarter() -> Column:
    return (F.year("l_shipdate") * 10 + F.quarter("l_shipdate")).cast("string")


def day() -> Column:
    return (F.year("ts") * 10000 + F.month("ts") * 100 + F.dayofmonth("ts")).cast("string")


def shipped(spark: SparkSession, sf_dir: str, only: Column | str = "true") -> DataFrame:
    """Observations of lineitem; a run is a quarter."""
    return trust.observations(table(spark, sf_dir, "lineitem").where(only), SHIPPED, {2}, quarter())


def visits(spark: SparkSession, sf_dir: str, only: Column | str = "true") -> DataFrame:
    """Observations of events; a run is a day."""
    return trust.observations(table(spark, sf_dir, "events").where(only), VISITS, {1}, day())


VARIABLES = (("sales", "shipped", shipped, SHIPPED), ("web", "visits", visits, VISITS))


def first_run(spark: SparkSession, sf_dir: str, observe) -> DataFrame:
    """Observations of the earliest run."""
    name, run = {shipped: ("lineitem", quarter()), visits: ("events", day())}[observe]
    earliest = table(spark, sf_dir, name).select(F.min(run)).scalar()
    # before the observation, which no filter passes where it hashes text
    return observe(spark, sf_dir, run == earliest)


QUARTER_SQL = "CAST(year(l_shipdate) * 10 + quarter(l_shipdate) AS VARCHAR)"
DAY_SQL = "strftime(ts, '%Y%m%d')"

# Texts are hashed once per distinct value.
OBS_SQL = f"""
flags AS (SELECT l_returnflag AS f, CAST({hash_sql('l_returnflag')} AS DOUBLE) AS h
          FROM (SELECT DISTINCT l_returnflag FROM lineitem)),
kinds AS (SELECT event_type AS e, CAST({hash_sql('event_type')} AS DOUBLE) AS h
          FROM (SELECT DISTINCT event_type FROM events)),
obs AS (
  SELECT 'sales' AS scope, 'shipped' AS var, {QUARTER_SQL} AS run_id, 0 AS col_idx, l_quantity AS value FROM lineitem
  UNION ALL SELECT 'sales', 'shipped', {QUARTER_SQL}, 1, l_extendedprice FROM lineitem
  UNION ALL SELECT 'sales', 'shipped', {QUARTER_SQL}, 2, h FROM lineitem JOIN flags ON f = l_returnflag
  UNION ALL SELECT 'web', 'visits', {DAY_SQL}, 0, value FROM events
  UNION ALL SELECT 'web', 'visits', {DAY_SQL}, 1, h FROM events JOIN kinds ON e = event_type)"""

SPEC_SQL = """
firsts AS (SELECT var, min(run_id) AS run_id FROM obs GROUP BY var),
spec AS (SELECT scope, var, col_idx, min(value) AS base, (max(value) - min(value)) / 1000 AS step
         FROM obs JOIN firsts USING (var, run_id) GROUP BY scope, var, col_idx)"""

COUNTS_SQL = """
counts AS (
  SELECT scope, var, run_id, col_idx,
    CAST(CASE WHEN step = 0 THEN CASE WHEN value = base THEN 0 WHEN value > base THEN 2147483647 ELSE -2147483648 END
         ELSE greatest(least(floor((value - base) / step), 2147483647), -2147483648) END AS INTEGER) AS bucket,
    count(*) AS n
  FROM obs JOIN spec USING (scope, var, col_idx) GROUP BY ALL),
dist AS (SELECT scope, var, run_id, col_idx, bucket,
           n / CAST(sum(n) OVER (PARTITION BY scope, var, run_id, col_idx) AS DOUBLE) AS p FROM counts)"""


def jsd_sql(sample: str, corrupted: str = "FALSE") -> str:
    """Mean of the history and every run's divergence from it."""
    return f"""
members AS (SELECT DISTINCT scope, var, run_id, col_idx FROM dist
            WHERE run_id = {sample} OR NOT ({corrupted})),
sizes AS (SELECT scope, var, col_idx, count(*) AS n_history FROM members WHERE run_id <> {sample} GROUP BY ALL),
used AS (SELECT dist.* FROM dist JOIN members USING (scope, var, run_id, col_idx)),
mean AS (SELECT scope, var, col_idx, bucket, sum(p) / any_value(n_history) AS m
         FROM used JOIN sizes USING (scope, var, col_idx) WHERE run_id <> {sample}
         GROUP BY scope, var, col_idx, bucket),
terms AS (
  SELECT u.scope, u.var, u.run_id, u.col_idx, p, m,
    CASE WHEN m IS NULL THEN p * ln(2)
         ELSE p * ln(2 * p / (p + m)) + m * ln(2 * m / (p + m)) END AS t
  FROM used u LEFT JOIN mean USING (scope, var, col_idx, bucket)),
jsds AS (SELECT scope, var, run_id, col_idx,
           greatest((sum(t) + ln(2) * (1 - sum(coalesce(m, 0)))) / 2, 0) AS jsd
         FROM terms GROUP BY ALL),
stats AS (SELECT scope, var, col_idx, max(jsd) FILTER (run_id = {sample}) AS jsd,
            avg(jsd) FILTER (run_id <> {sample}) AS mu, stddev_samp(jsd) FILTER (run_id <> {sample}) AS sd
          FROM jsds GROUP BY ALL),
result AS (SELECT scope, var, col_idx, n_history, jsd, mu, sd,
             -0.5 * ((jsd - mu) / sd) ** 2 - ln(sd) - 0.5 * ln(2 * pi()) AS log_density
           FROM stats JOIN sizes USING (scope, var, col_idx))"""


def all_jsd_sql() -> str:
    """Every run as a sample: its history is all other runs."""
    return """
runs AS (SELECT DISTINCT scope, var, run_id, col_idx FROM dist),
pairs AS (SELECT s.scope, s.var, s.col_idx, s.run_id AS sample, r.run_id
          FROM runs s JOIN runs r USING (scope, var, col_idx)),
sizes AS (SELECT scope, var, col_idx, sample, count(*) - 1 AS n_history FROM pairs GROUP BY ALL),
used AS (SELECT scope, var, col_idx, sample, run_id, bucket, p FROM dist JOIN pairs USING (scope, var, col_idx, run_id)),
mean AS (SELECT scope, var, col_idx, sample, bucket, sum(p) / any_value(n_history) AS m
         FROM used JOIN sizes USING (scope, var, col_idx, sample) WHERE run_id <> sample
         GROUP BY scope, var, col_idx, sample, bucket),
terms AS (
  SELECT u.scope, u.var, u.col_idx, u.sample, u.run_id, m,
    CASE WHEN m IS NULL THEN p * ln(2)
         ELSE p * ln(2 * p / (p + m)) + m * ln(2 * m / (p + m)) END AS t
  FROM used u LEFT JOIN mean USING (scope, var, col_idx, sample, bucket)),
jsds AS (SELECT scope, var, col_idx, sample, run_id, greatest((sum(t) + ln(2) * (1 - sum(coalesce(m, 0)))) / 2, 0) AS jsd
         FROM terms GROUP BY ALL),
stats AS (SELECT scope, var, col_idx, sample, max(jsd) FILTER (run_id = sample) AS jsd,
            avg(jsd) FILTER (run_id <> sample) AS mu, stddev_samp(jsd) FILTER (run_id <> sample) AS sd
          FROM jsds GROUP BY ALL),
result AS (SELECT scope, var, col_idx, sample AS run_id, n_history, jsd, mu, sd,
             -0.5 * ((jsd - mu) / sd) ** 2 - ln(sd) - 0.5 * ln(2 * pi()) AS log_density
           FROM stats JOIN sizes USING (scope, var, col_idx, sample))"""


def ranked(df: DataFrame, key: str, order: Sequence[str], chunk: Column, name: str) -> DataFrame:
    """1-based rank of each row within its key, in ``order``.

    ``chunk`` is a monotone coarsening of the order (a month for a date).  Rows
    are numbered inside (key, chunk) and shifted by the number of rows in the
    key's earlier chunks, so a key with a large share of the rows is sorted by
    many tasks instead of one.
    """
    cut = df.withColumn("_chunk", chunk)
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        cut.groupBy(key, "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(key, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    inside = F.row_number().over(Window.partitionBy(key, "_chunk").orderBy(*order))
    return (
        cut.withColumn("_inside", inside)
        .join(shifts, [key, "_chunk"])
        .withColumn(name, (F.col("_inside") + F.col("_shift")).cast("long"))
        .drop("_chunk", "_inside", "_shift")
    )


# -- lineage: a run per customer, an operation per order ------------------------------

def order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their number ``k`` within the customer."""
    orders = table(spark, sf_dir, "orders")
    return ranked(
        orders, "o_custkey", ["o_orderdate", "o_orderkey"], F.date_trunc("month", "o_orderdate"), "k"
    )


def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations: node k reads nodes k-1 and k div 2, node 1 is a load."""
    k = F.col("k")
    name = lambda n: F.concat(F.lit("v"), n.cast("string"))
    none = F.array().cast("array<string>")
    return order_nodes(spark, sf_dir).select(
        F.lit("orders").alias("scope"),
        F.col("o_custkey").cast("string").alias("run_id"),
        k.alias("op_seq"),
        F.when(k > 1, F.array(name(k - 1), name(F.expr("k DIV 2")))).otherwise(none).alias("src_vars"),
        F.col("o_orderpriority").alias("operation"),
        name(k).alias("dst_var"),
        (k == 1).alias("is_load"),
        F.lit("n,s").alias("column_types"),
        F.array().cast("array<int>").alias("inspected_columns"),
        F.col("o_orderdate").cast("timestamp").alias("started"),
        F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("path"),
        F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_totalprice"),
    )


def order_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.register_operations(order_requests(spark, sf_dir))


def last_nodes(operations: DataFrame) -> DataFrame:
    """The last operation of every run."""
    return operations.groupBy("scope", "run_id").agg(
        F.max_by(F.struct("dst_var", "dst_idx", "o_orderstatus"), "op_seq").alias("t")
    ).select("scope", "run_id", "t.*")


def customer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run events: every customer starts, those with a balance finish."""
    customers = table(spark, sf_dir, "customer")
    start = F.lit(1704067200) + F.col("c_custkey")
    events = F.array(
        F.struct(F.lit("start").alias("event"), start.alias("s")),
        F.struct(F.when(F.col("c_acctbal") >= 0, "finish").alias("event"),
                 (start + F.col("c_nationkey") + 1).alias("s")),
    )
    return customers.select(
        F.lit("orders").alias("scope"), F.col("c_custkey").cast("string").alias("run_id"),
        F.col("c_mktsegment").alias("info"), F.explode(events).alias("e"),
    ).where("e.event IS NOT NULL").select(
        "scope", "run_id", "info", "e.event", F.timestamp_seconds("e.s").alias("at"))


INDEX_SQL = "CASE WHEN k = 1 THEN 'orders/' || o_orderkey || '#v1' ELSE md5('orders|' || o_custkey || '|v' || k) END"

NODES_SQL = f"""
ranks AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
nodes AS (SELECT CAST(o_custkey AS VARCHAR) AS run_id, k, 'v' || k AS dst_var, {INDEX_SQL} AS dst_idx,
            o_orderkey, o_orderstatus, o_orderpriority AS operation, o_totalprice, o_orderdate FROM ranks),
edges AS (SELECT n.run_id, n.k, n.dst_idx, s.k AS src_k, s.dst_idx AS src_idx
          FROM nodes n JOIN nodes s ON n.run_id = s.run_id AND s.k = n.k - 1
          UNION ALL
          SELECT n.run_id, n.k, n.dst_idx, s.k, s.dst_idx
          FROM nodes n JOIN nodes s ON n.run_id = s.run_id AND s.k = n.k // 2 WHERE n.k > 1)"""

PATHS_SQL = f"""
{NODES_SQL},
lasts AS (SELECT run_id, max(k) AS k FROM nodes GROUP BY run_id),
walk(run_id, target, k) AS (
  SELECT run_id, k, k FROM lasts
  UNION ALL
  SELECT w.run_id, w.target, e.src_k FROM walk w JOIN edges e ON e.run_id = w.run_id AND e.k = w.k),
paths AS (SELECT run_id, target, k, count(*) AS paths FROM walk GROUP BY ALL)"""

RUNS_SQL = """
runs AS (SELECT CAST(c_custkey AS VARCHAR) AS run_id, c_mktsegment AS info, 1704067200 + c_custkey AS start_s,
           CASE WHEN c_acctbal >= 0 THEN 1704067200 + c_custkey + c_nationkey + 1 END AS finish_s FROM customer)"""


# -- access log: an event is one access record of the location user_id --------------------

def access_records(events: DataFrame) -> DataFrame:
    """First and last access as ``mm:ss.s`` text, and the number of accesses."""
    first = F.minute("ts") * 600 + F.expr("CAST(extract(SECOND FROM ts) * 10 AS BIGINT)")
    last = (first + F.floor(F.col("value") * 10)) % 36000
    text = lambda t: F.format_string("%02d:%02d.%d", F.floor(t / 600), F.floor(t % 600 / 10), t % 10)
    return events.select(
        "event_id", "event_type", F.col("user_id").cast("string").alias("LocationID"),
        text(first).alias("FirstAccess"), text(last).alias("LastAccess"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("AccessCount"),
    )


def access_lines(events: DataFrame) -> DataFrame:
    """The log as raw lines: 19 fields, but 20 for errors and no id for some signups."""
    r = access_records(events)
    unnamed = (F.col("event_type") == "signup") & (F.col("AccessCount") > 90)
    id_ = F.when(unnamed, "").otherwise(F.col("event_id").cast("string"))
    extra = F.when(F.col("event_type") == "error", '"a,b"').otherwise("")
    fields = [id_, F.col("LocationID"), F.lit("1"), F.col("FirstAccess"), F.col("LastAccess"),
              F.col("AccessCount").cast("string"), F.col("event_id").cast("string"), extra,
              *[F.lit("")] * 11]
    return r.select(F.array_join(F.array(*fields), ",").alias("value"))


CLOCK_SQL = """
clocks AS (
  SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
    minute(ts) * 600 + (microsecond(ts) // 100000) AS a,
    (minute(ts) * 600 + (microsecond(ts) // 100000) + CAST(floor(value * 10) AS BIGINT)) % 36000 AS b
  FROM events)"""
SECONDS_SQL = "CAST(((b - a + 36000) % 36000) // 10 AS BIGINT)"

ACCESS_SQL = f"""{CLOCK_SQL},
named AS (SELECT CAST(user_id AS VARCHAR) AS LocationID, {SECONDS_SQL} AS Duration, k AS AccessCount FROM clocks
          WHERE event_type <> 'error' AND NOT (event_type = 'signup' AND k > 90)),
sums AS (SELECT LocationID, CAST(sum(Duration) AS BIGINT) AS TotalDuration,
           CAST(sum(AccessCount) AS BIGINT) AS TotalAccesses FROM named GROUP BY LocationID)"""
