"""Distribution-trust operators over lineitem quarters and event days."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.common import COUNTS_SQL, OBS_SQL, SHIPPED, SPEC_SQL, VARIABLES, all_jsd_sql, first_run, jsd_sql, registry, shipped
from trustweave.operators import trust
from trustweave.session import durable, empty

QUERIES, ORACLES, query = registry()
#: The last, the first and the middle run as samples.
SAMPLES = [
    "(SELECT max(run_id) FROM dist WHERE dist.var = 'shipped')",
    "(SELECT min(run_id) FROM dist WHERE dist.var = 'shipped')",
    """(SELECT r FROM (SELECT run_id AS r, row_number() OVER (ORDER BY run_id) AS i, count(*) OVER () AS n
        FROM (SELECT DISTINCT run_id FROM dist WHERE dist.var = 'shipped')) WHERE i = (n + 1) // 2)""",
]
CORRUPTED_SQL = "right(run_id, 1) = '3'"


def both_counts(spark, d) -> DataFrame:
    """Bucket counts of both variables, written once: raw data is read once."""
    frames = []
    for scope, var, observe, columns in VARIABLES:
        spec = trust.bucket_spec(first_run(spark, d, observe), scope, var)
        frames.append(trust.histogram_counts(observe(spark, d), spec, list(columns), scope, var))
    return durable(frames[0].unionByName(frames[1]), "counts")


def no_runs(spark) -> DataFrame:
    return empty(spark, "scope STRING, var STRING, run_id STRING")


def known_corrupted(profile: DataFrame) -> DataFrame:
    """A fixed rule standing for earlier verdicts: run ids that end in 3."""
    return profile.where(F.col("run_id").endswith("3")).select(*trust.RUN).distinct()


def both(spark, d):
    counts = both_counts(spark, d)
    return trust.relative_frequency(counts), trust.profile_counts(counts)


def last_run(profile: DataFrame) -> str:
    return profile.where("var = 'shipped'").agg(F.max("run_id")).first()[0]


CHAIN = f"WITH {OBS_SQL}, {SPEC_SQL}, {COUNTS_SQL}"
LAST = "(SELECT max(run_id) FROM dist WHERE dist.var = 'shipped')"
CHAIN_JSD = f"{CHAIN}, {jsd_sql(LAST)}"
ROUNDED = "round(jsd, 9) AS jsd, round(mu, 9) AS mu, round(sd, 9) AS sd, round(log_density, 5) AS log_density"


@query(f"WITH {OBS_SQL} SELECT scope, var, run_id, col_idx, min(value) AS lo, max(value) AS hi FROM obs GROUP BY ALL")
def min_max(spark, d):
    frames = [
        trust.of_variable(trust.min_max(observe(spark, d), "run_id", "col_idx"), scope, var)
        for scope, var, observe, _ in VARIABLES]
    return frames[0].unionByName(frames[1])


@query(f"WITH {OBS_SQL}, {SPEC_SQL} SELECT scope, var, col_idx, base, step FROM spec")
def bucket_spec(spark, d):
    frames = [trust.bucket_spec(first_run(spark, d, observe), scope, var) for scope, var, observe, _ in VARIABLES]
    return frames[0].unionByName(frames[1])


@query(f"{CHAIN} SELECT scope, var, run_id, col_idx, bucket, n FROM counts")
def histogram_count(spark, d):
    return both_counts(spark, d)


@query(f"{CHAIN} SELECT scope, var, run_id, col_idx, bucket, round(p, 12) AS p FROM dist")
def relative_frequency(spark, d):
    return trust.relative_frequency(both_counts(spark, d)).withColumn("p", F.round("p", 12))


@query(f"{CHAIN} SELECT scope, var, run_id, col_idx, bucket, round(p, 12) AS p FROM dist WHERE var = 'shipped'")
def histogram(spark, d):
    spec = trust.bucket_spec(first_run(spark, d, shipped), "sales", "shipped")
    return trust.histogram(shipped(spark, d), spec, list(SHIPPED), "sales", "shipped").withColumn("p", F.round("p", 12))


@query(f"""{CHAIN} SELECT DISTINCT scope, var, run_id FROM dist
           WHERE NOT ({CORRUPTED_SQL}) AND run_id <> {LAST}""")
def history_select(spark, d):
    profile = trust.profile_counts(both_counts(spark, d))
    captures = profile.select(*trust.RUN).distinct()
    return trust.history_select(captures, last_run(profile), known_corrupted(profile))


@query(f"""{CHAIN} SELECT scope, var, run_id, col_idx, count(*) AS buckets FROM dist
           WHERE NOT ({CORRUPTED_SQL}) OR run_id = {LAST} GROUP BY ALL""")
def anti_corrupted_history(spark, d):
    dist, profile = both(spark, d)
    rows = trust.usable(dist, trust.history_members(profile, last_run(profile), known_corrupted(profile)))
    return rows.groupBy(*trust.RUN_COL).agg(F.count(F.lit(1)).alias("buckets"))


def _means(spark, d, corrupted):
    dist, profile = both(spark, d)
    members = durable(trust.history_members(profile, last_run(profile), corrupted(profile)), "members")
    rows = trust.usable(dist, members)
    return rows, trust.history_mean(rows), members


@query(f"{CHAIN_JSD} SELECT scope, var, col_idx, bucket, round(m, 12) AS m FROM mean")
def history_mean(spark, d):
    _, mean, _ = _means(spark, d, lambda p: no_runs(spark))
    return mean.withColumn("m", F.round("m", 12))


@query(f"""{CHAIN}, {jsd_sql(LAST, CORRUPTED_SQL)}
           SELECT scope, var, col_idx, bucket, round(m, 12) AS m FROM mean""")
def mean_distribution(spark, d):
    _, mean, _ = _means(spark, d, known_corrupted)
    return mean.withColumn("m", F.round("m", 12))


@query(f"""{CHAIN_JSD} SELECT scope, var, run_id, col_idx, bucket, round(p, 12) AS p, round(m, 12) AS m
           FROM used LEFT JOIN mean USING (scope, var, col_idx, bucket)""")
def dist_align(spark, d):
    rows, mean, _ = _means(spark, d, lambda p: no_runs(spark))
    aligned = trust.align(rows, mean)
    return aligned.select(*trust.RUN_COL, "bucket", F.round("p", 12).alias("p"), F.round("m", 12).alias("m"))


def _divergences(spark, d, corrupted):
    rows, mean, members = _means(spark, d, corrupted)
    return trust.jsd(trust.align(rows, mean), members)


@query(f"{CHAIN_JSD} SELECT scope, var, run_id, col_idx, round(jsd, 9) AS jsd FROM jsds")
def jsd(spark, d):
    values = _divergences(spark, d, lambda p: no_runs(spark))
    return values.select(*trust.RUN_COL, F.round("jsd", 9).alias("jsd"))


@query(f"""{CHAIN}, {jsd_sql(LAST, CORRUPTED_SQL)}
           SELECT scope, var, col_idx, round(jsd, 9) AS jsd, round(mu, 9) AS mu, round(sd, 9) AS sd FROM stats""")
def mean_stddev(spark, d):
    stats = trust.mean_stddev(_divergences(spark, d, known_corrupted))
    return stats.select(*trust.COL, *[F.round(c, 9).alias(c) for c in ("jsd", "mu", "sd")])


def _rounded(confidences: DataFrame) -> DataFrame:
    return confidences.select(
        *trust.RUN_COL, "n_history", *[F.round(c, 9).alias(c) for c in ("jsd", "mu", "sd")],
        F.round("log_density", 5).alias("log_density"), "corrupted", "status")


@query(f"""{CHAIN_JSD}
           SELECT scope, var, {LAST} AS run_id, col_idx, n_history, {ROUNDED}, exp(log_density) < 1e-5 AS corrupted,
             'ok' AS status FROM result WHERE var = 'shipped'""")
def confidence(spark, d):
    spec = trust.bucket_spec(first_run(spark, d, shipped), "sales", "shipped")
    counts = durable(trust.histogram_counts(shipped(spark, d), spec, list(SHIPPED), "sales", "shipped"), "counts")
    dist, profile = trust.relative_frequency(counts), trust.profile_counts(counts)
    return _rounded(trust.confidence(dist, profile, last_run(profile), no_runs(spark)))


def _flag_sql() -> str:
    parts = [
        f"SELECT * FROM (WITH {jsd_sql(s, CORRUPTED_SQL)} "
        f"SELECT scope, var, {s} AS run_id, bool_or(exp(log_density) < 1e-5) AS corrupted "
        "FROM result WHERE var = 'shipped' GROUP BY scope, var)" for s in SAMPLES]
    return f"{CHAIN} " + " UNION ALL ".join(parts)


@query(_flag_sql())
def flag_corrupted(spark, d):
    dist, profile = both(spark, d)
    out = known_corrupted(profile)
    dist, profile = durable(dist, "dist"), durable(profile, "profile")
    runs = [r["run_id"] for r in profile.where("var = 'shipped'").select("run_id").distinct().orderBy("run_id").collect()]
    samples = runs[-1], runs[0], runs[(len(runs) - 1) // 2]
    tested = F.col("var") == "shipped"
    checks = [trust.confidence(dist.where(tested), profile.where(tested), s, out) for s in samples]
    return trust.flag_corrupted(reduce(DataFrame.unionByName, checks))


@query(f"""WITH {OBS_SQL}, {SPEC_SQL}, {COUNTS_SQL}
SELECT * FROM (WITH {jsd_sql("(SELECT max(run_id) FROM dist WHERE dist.var = 'shipped')")}
  SELECT scope, var, (SELECT max(run_id) FROM dist WHERE dist.var = 'shipped') AS run_id, col_idx + 1 AS col_idx,
    n_history, {ROUNDED}, exp(log_density) < 1e-5 AS corrupted, 'ok' AS status FROM result WHERE var = 'shipped')
UNION ALL
SELECT * FROM (WITH {jsd_sql("(SELECT max(run_id) FROM dist WHERE dist.var = 'visits')")}
  SELECT scope, var, (SELECT max(run_id) FROM dist WHERE dist.var = 'visits'), col_idx + 1,
    n_history, {ROUNDED}, exp(log_density) < 1e-5, 'ok' FROM result WHERE var = 'visits')""")
def check_run(spark, d):
    from checks.storage import imported
    ws = imported(spark, d)
    frames = []
    for scope in ("sales", "web"):
        runs = ws.tables.read("runs").where(F.col("scope") == scope)
        frames.append(ws.check_run(scope, runs.agg(F.max("run_id")).first()[0]))
    return _rounded(frames[0].unionByName(frames[1]))


@query(f"""{CHAIN}, {all_jsd_sql()}
SELECT scope, var, run_id, col_idx + 1 AS col_idx, n_history, {ROUNDED}, exp(log_density) < 1e-5 AS corrupted, 'ok' AS status
FROM result WHERE var = 'shipped'""")
def check_runs(spark, d):
    """All quarters tested in one job, each against all others."""
    from checks.storage import imported
    ws = imported(spark, d)
    return _rounded(ws.check_runs("sales", ws.tables.read("runs", scope="sales").select("run_id")))
