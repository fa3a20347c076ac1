"""The shipped scripts end to end, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import ACCESS_SQL, access_lines, registry, table
from trustweave.plans import anomaly, qualify, wifi
from trustweave.plans.workspace import Workspace
from trustweave.session import shared_path
from trustweave.sources.delimited import load_lines, store_delimited

QUERIES, ORACLES, query = registry()


def _log(spark, d) -> str:
    """The access log as text files in the shared folder."""
    path = shared_path(spark, "access-log")
    access_lines(table(spark, d, "events")).write.text(path)
    return path


def _lines(spark, d):
    return load_lines(spark, _log(spark, d))


@query(f"WITH {ACCESS_SQL} SELECT LocationID, TotalDuration FROM sums ORDER BY TotalDuration DESC")
def wifi_time_rank(spark, d):
    return wifi.time_rank(_lines(spark, d))


@query(f"WITH {ACCESS_SQL} SELECT LocationID, TotalAccesses FROM sums ORDER BY TotalAccesses DESC")
def wifi_access_rank(spark, d):
    return wifi.access_rank(_lines(spark, d))


DENSITY = "TotalAccesses / nullif(CAST(TotalDuration AS DOUBLE), 0) AS Density"


@query(f"WITH {ACCESS_SQL} SELECT LocationID, {DENSITY} FROM sums ORDER BY Density DESC")
def wifi_density_rank(spark, d):
    return wifi.density_rank(_lines(spark, d))


@query(f"WITH {ACCESS_SQL} SELECT LocationID, {DENSITY}, 'density' AS srcvar FROM sums ORDER BY Density DESC")
def wifi_rank_captured(spark, d):
    """The log is written as text, loaded, and captured after every step."""
    path = _log(spark, d)
    ws = Workspace(spark)
    run = ws.start_run("wifi", "access ranking")
    ranked = wifi.captured_rank(run, path)
    run.finish()
    log = ws.operations_view().where((F.col("run_id") == run.run_id) & (F.col("dstvar") == "density_scored")).first()
    return ranked.withColumn("srcvar", F.lit(log["srcvar"]))


QUALIFIED_SQL = """
standards AS (SELECT p_brand AS Platform, max(p_size) AS MaxMem, CAST(max(p_size) - 10 AS INTEGER) AS MinMem
              FROM part GROUP BY p_brand),
softwares AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_extendedprice AS Name,
                p_brand AS Platform, CAST(l_quantity AS INTEGER) AS MaxMem, p_size AS MinMem,
                CAST(l_discount * 100 AS FLOAT) AS Rate FROM lineitem JOIN part ON l_partkey = p_partkey),
qualified AS (SELECT Name, Rate FROM softwares w JOIN standards s USING (Platform)
              WHERE w.MaxMem <= s.MaxMem AND w.MinMem <= s.MinMem)"""


@query(f"""WITH {QUALIFIED_SQL}
           SELECT 'qualified' AS branch, count(*) AS cnt FROM qualified
           UNION ALL SELECT 'liked', count(*) FROM qualified WHERE Rate >= 4.0
           UNION ALL SELECT 'disliked', count(*) FROM qualified WHERE Rate < 4.0""")
def benchmark_qualify(spark, d):
    """Platforms are part brands; candidates are line items, one name each."""
    part = table(spark, d, "part")
    standards = part.groupBy(F.col("p_brand").alias("Platform")).agg(
        F.max("p_size").alias("MaxMem")).withColumn("MinMem", F.col("MaxMem") - 10)
    items = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    softwares = items.select(
        F.concat_ws("-", F.hex("l_orderkey"), F.hex("l_linenumber"), F.hex("l_partkey"),
                    F.col("l_extendedprice").cast("string"), F.col("l_suppkey").cast("string"),
                    F.col("l_shipdate").cast("string"), F.col("l_tax").cast("string")).alias("Name"),
        F.col("p_brand").alias("Platform"), F.col("l_quantity").cast("int").alias("MaxMem"),
        F.col("p_size").alias("MinMem"), (F.col("l_discount") * 100).cast("float").alias("Rate"))
    ws = Workspace(spark)
    run = ws.start_run("qualification")
    paths = {}
    for name, df in (("standards", standards), ("softwares", softwares)):
        paths[name] = shared_path(spark, name)
        store_delimited(df, paths[name], ",", codec="gzip")
    loaded = [
        run.load(paths["standards"], "standards", "Platform STRING, MaxMem INT, MinMem INT"),
        run.load(paths["softwares"], "softwares", "Name STRING, Platform STRING, MaxMem INT, MinMem INT, Rate FLOAT"),
    ]
    counts = qualify.qualify(run, *loaded)
    run.finish()
    frames = [df.select(F.lit(branch).alias("branch"), "cnt") for branch, df in counts.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("""SELECT * FROM (VALUES ('clean', 'gen', 'ok', FALSE), ('clean', 'result', 'ok', FALSE),
          ('perturbed', 'gen', 'ok', FALSE), ('perturbed', 'result', 'ok', TRUE)) AS t(run, var, status, corrupted)""")
def anomaly_demo(spark, d):
    """Every order asks for ten numbers in [0, 50); the last run is perturbed."""
    path = shared_path(spark, "bounds")
    bounds = table(spark, d, "orders").select(F.lit(0), F.lit(50), F.lit(10), F.col("o_orderkey"))
    store_delimited(bounds, path, ",")
    ws = Workspace(spark)
    checked = anomaly.demonstrate(ws, "demo", path)
    ids = {run.run_id: label for label, run in checked.items()}
    label = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    rows = ws.tables.read("confidence").where(F.col("run_id").isin(list(ids)))
    return rows.select(F.get(F.array(label[F.col("run_id")]), F.lit(0)).alias("run"), "var", "status", "corrupted")
