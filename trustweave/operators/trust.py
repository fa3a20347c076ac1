"""Distribution test: histograms, divergence from the history, confidence.

All operators work on long-form tables keyed by ``(scope, var)`` so that one
job handles every inspected column of a variable and every run.  The shuffle
keys are (run, column, bucket): within the range of the first run a partial
aggregate leaves about a thousand rows per run and column in each map task;
values outside it have buckets of their own, without a limit.

A sample is one run, or a table of runs (``scope, var, run_id``) that are all
tested at once; the tables in between then have a ``sample`` column.  Every
sample has a mean of its own, the history without it, so testing s samples
against r runs takes s times r divergences.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustweave.functions import scalar as S
from trustweave.session import durable

THRESHOLD = 1e-5
MIN_HISTORY = 2
RESOLUTION = 1000
# Sums of about a thousand doubles are not exact; below this a divergence or a
# spread is rounding noise and counts as zero.
NOISE = 1e-14

VAR = ["scope", "var"]
COL = [*VAR, "col_idx"]
RUN = [*VAR, "run_id"]
RUN_COL = [*RUN, "col_idx"]


def is_textual(kind: str) -> bool:
    """Column class from a Spark type name: text unless it is numeric."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    return not kind.startswith(numeric)


def observations(
    df: DataFrame,
    columns: Mapping[int, str],
    textual: Collection[int] = (),
    run_id: str | Column = "run_id",
) -> DataFrame:
    """Unpivot one variable's inspected columns to ``run_id, col_idx, value``.

    ``columns`` maps column numbers to names; those in ``textual`` are hashed,
    the others read as numbers.  A missing or unreadable value becomes null.
    Only the named columns are read from the source.
    """
    values = [
        (S.string_hash(F.col(f"`{c}`").cast("string")).cast("double")
         if i in textual else S.to_double(F.col(f"`{c}`"))).alias(f"_v{i}")
        for i, c in columns.items()
    ]
    run = run_id if isinstance(run_id, Column) else F.col(run_id)
    wide = df.select(run.alias("run_id"), *values)
    pairs = ", ".join(f"{i}, _v{i}" for i in columns)
    return wide.select("run_id", F.expr(f"stack({len(columns)}, {pairs}) AS (col_idx, value)"))


def of_variable(df: DataFrame, scope: str, var: str) -> DataFrame:
    """Put scope and variable in front of a table about one variable.

    They are constants, so they are added after an aggregate, not carried
    through it as grouping keys.
    """
    return df.select(F.lit(scope).alias("scope"), F.lit(var).alias("var"), "*")


def min_max(obs: DataFrame, *keys: str) -> DataFrame:
    """Smallest and largest usable value per key."""
    usable = F.when(~F.isnan("value"), F.col("value"))
    return obs.groupBy(*keys).agg(F.min(usable).alias("lo"), F.max(usable).alias("hi"))


def bucket_spec(first_run: DataFrame, scope: str, var: str, compat: bool = False) -> DataFrame:
    """``base`` and ``step`` per column from the observations of one run.

    A column without a usable value gets no spec.  ``compat`` starts the search
    for the maximum at the smallest positive double and keeps six significant
    digits, like the original.
    """
    bounds = min_max(first_run, "col_idx").where("lo IS NOT NULL")
    hi, keep = F.col("hi"), lambda c: c
    if compat:
        hi, keep = F.greatest(hi, F.lit(4.9e-324)), S.six_digits
    spec = bounds.select(
        "col_idx", keep(F.col("lo")).alias("base"), keep((hi - F.col("lo")) / RESOLUTION).alias("step")
    )
    return of_variable(spec, scope, var)


def histogram_counts(obs: DataFrame, spec: DataFrame, columns: Collection[int], scope: str, var: str) -> DataFrame:
    """Rows per ``(run, column, bucket)``; unusable values have a null bucket.

    A column without a spec has unusable values only.  The spec side of the
    join has one row per inspected column of one variable, so broadcasting it
    is bounded by the schema's width.
    """
    narrow = (
        spec.where((F.col("scope") == scope) & (F.col("var") == var) & F.col("col_idx").isin(list(columns)))
        .groupBy("col_idx")
        .agg(F.min(F.struct("base", "step")).alias("s"))
        .select("col_idx", "s.base", "s.step")
    )
    bucket = S.bucketize(F.col("value"), F.col("base"), F.col("step"))
    counts = (
        obs.join(F.broadcast(narrow), "col_idx", "left")
        .select("run_id", "col_idx", bucket.alias("bucket"))
        .groupBy("run_id", "col_idx", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return of_variable(counts, scope, var)


def profile_counts(counts: DataFrame) -> DataFrame:
    """Usable and unusable values per ``(run, column)``."""
    n = F.col("n")
    usable = F.col("bucket").isNotNull()
    return counts.groupBy(*RUN_COL).agg(
        F.sum(F.when(usable, n).otherwise(0)).alias("n"),
        F.sum(F.when(~usable, n).otherwise(0)).alias("n_bad"),
    )


def relative_frequency(counts: DataFrame, compat: bool = False, keep: bool = False) -> DataFrame:
    """Counts to probabilities: the sparse distribution of each run's column.

    ``keep`` leaves the counts beside them.

    Both inputs of the join derive from the same aggregate, so its exchange is
    computed once.
    """
    totals = profile_counts(counts).select(*RUN_COL, F.col("n").alias("total"))
    p = F.col("n") / F.col("total")
    return (
        counts.join(totals, RUN_COL)
        .where(F.col("bucket").isNotNull())
        .select(*RUN_COL, "bucket", (S.six_digits(p) if compat else p).alias("p"), *(["n"] if keep else []))
    )


def histogram(
    obs: DataFrame, spec: DataFrame, columns: Collection[int], scope: str, var: str, compat: bool = False
) -> DataFrame:
    """Distribution of every observed run and column."""
    return relative_frequency(histogram_counts(obs, spec, columns, scope, var), compat)


def history_select(captures: DataFrame, sample_run: str | Column, corrupted: DataFrame) -> DataFrame:
    """Runs a sample is compared with: the others, without the corrupted ones."""
    others = captures.where(F.col("run_id") != _col(sample_run))
    return others.join(corrupted.select(*RUN), RUN, "left_anti")


def history_members(profile: DataFrame, sample_run: str | Column | DataFrame, corrupted: DataFrame) -> DataFrame:
    """The sample's and the usable history's profile rows, with the history's size.

    Adds ``is_sample`` and, per column, ``n_found`` (other captures), ``n_history``
    (those not corrupted) and ``mass``, the total of their mean distribution: 1
    unless some capture has no usable value.
    """
    flagged = corrupted.select(*RUN).distinct().withColumn("_out", F.lit(True))
    known = profile.join(flagged, RUN, "left")
    if isinstance(sample_run, DataFrame):
        samples = sample_run.select(*VAR, F.col("run_id").alias("sample")).distinct()
        known, sample_run = known.join(samples, VAR), F.col("sample")
    is_sample = F.col("run_id") == _col(sample_run)
    marked = known.select(
        *RUN_COL, *_sample(known), "n", is_sample.alias("is_sample"), (is_sample | F.col("_out").isNull()).alias("_kept")
    )
    past = ~F.col("is_sample")
    used = past & F.col("_kept")
    count = lambda condition: F.count(F.when(condition, 1))
    key = [*COL, *_sample(marked)]
    sizes = marked.groupBy(*key).agg(
        count(past).alias("n_found"),
        count(used).alias("n_history"),
        F.try_divide(count(used & (F.col("n") > 0)), count(used)).alias("mass"),
    )
    return marked.where("_kept").drop("n", "_kept").join(sizes, key)


def usable(dist: DataFrame, members: DataFrame) -> DataFrame:
    """Distributions of the members."""
    return dist.join(members.select(*RUN_COL, *_sample(members), "is_sample", "n_history"), RUN_COL)


def history_mean(rows: DataFrame) -> DataFrame:
    """Mean distribution of the history in ``rows``.

    A bucket absent from a run counts as 0 there, so sums are divided by the
    number of runs, those without any usable value included.
    """
    mean = F.sum("p") / F.max("n_history")
    return rows.where(~F.col("is_sample")).groupBy(*COL, *_sample(rows), "bucket").agg(mean.alias("m"))


def align(rows: DataFrame, mean: DataFrame) -> DataFrame:
    """Each run's distribution next to the mean: ``p`` and ``m`` per bucket.

    Only buckets the run has are listed.  What the mean holds elsewhere enters
    the divergence through its total, which keeps the join at one row per
    ``rows`` row instead of runs times buckets.
    """
    return rows.join(mean, [*COL, *_sample(rows), "bucket"], "left")


def jsd(aligned: DataFrame, members: DataFrame) -> DataFrame:
    """Jensen–Shannon divergence (nats) of each member's column from the mean.

    Members without any bucket get the divergence of an empty distribution.
    """
    p, m = F.col("p"), F.col("m")
    middle = (p + m) / 2
    shared = S.jsd_term(p, middle) + S.jsd_term(m, middle)
    key = [*RUN_COL, *_sample(members)]
    terms = aligned.groupBy(*key).agg(
        F.sum(F.when(m.isNull(), p * S.LN2).otherwise(shared)).alias("terms"),
        F.sum(F.coalesce(m, F.lit(0.0))).alias("met"),
    )
    rest = F.coalesce("mass", F.lit(0.0)) - F.coalesce("met", F.lit(0.0))
    value = (F.coalesce("terms", F.lit(0.0)) + rest * S.LN2) / 2
    return members.join(terms, key, "left").select(
        *members.columns, F.when(value < NOISE, F.lit(0.0)).otherwise(value).alias("jsd")
    )


def mean_stddev(divergences: DataFrame) -> DataFrame:
    """Per column: the sample's divergence, the history's mean and sample deviation."""
    sample = F.col("is_sample")
    past = F.when(~sample, F.col("jsd"))
    return divergences.groupBy(*COL, *_sample(divergences)).agg(
        F.max(F.when(sample, F.col("run_id"))).alias("run_id"),
        F.max("n_found").alias("n_found"),
        F.max("n_history").alias("n_history"),
        F.max(F.when(sample, F.col("jsd"))).alias("jsd"),
        F.avg(past).alias("mu"),
        F.stddev_samp(past).alias("sd"),
    )


def confidence(
    dist: DataFrame, profile: DataFrame, sample_run: str | Column | DataFrame, corrupted: DataFrame
) -> DataFrame:
    """Confidence of one run's columns against the rest of the history, or of many runs'.

    The confidence is a two-sided density: it may exceed 1, and a sample that is
    unusually close to the mean loses density as well.  ``log_density`` is kept
    because the density underflows to 0 for strong anomalies.
    """
    # one small row per captured column, used three times below
    members = durable(history_members(profile, sample_run, corrupted), "members")
    rows = usable(dist, members)
    stats = mean_stddev(jsd(align(rows, history_mean(rows)), members)).where("run_id IS NOT NULL")
    status = (
        F.when(F.col("n_found") < MIN_HISTORY, "insufficient_history")
        .when(F.col("n_history") == 0, "all_history_corrupted")
        .when(F.coalesce("sd", F.lit(0.0)) <= NOISE, "degenerate_history")
        .otherwise("ok")
    )
    log_density = F.when(
        F.col("status") == "ok", S.normal_log_density(F.col("jsd"), F.col("mu"), F.col("sd"))
    )
    enough = F.col("n_found") >= MIN_HISTORY
    return (
        stats.withColumn("status", status)
        .withColumn("log_density", log_density)
        .select(
            *RUN_COL,
            "n_history",
            *[F.when(enough, F.col(c)).alias(c) for c in ("jsd", "mu", "sd")],
            "log_density",
            F.exp("log_density").alias("confidence"),
            F.coalesce(F.exp("log_density") < THRESHOLD, F.lit(False)).alias("corrupted"),
            "status",
        )
    )


def flag_corrupted(confidences: DataFrame) -> DataFrame:
    """A capture is corrupted if any inspected column is below the threshold."""
    return confidences.groupBy(*RUN).agg(F.bool_or("corrupted").alias("corrupted"))


def corrupted_runs(confidences: DataFrame) -> DataFrame:
    """``scope, var, run_id`` of the captures flagged so far."""
    return confidences.where("corrupted").select(*RUN).distinct()


def _sample(rows: DataFrame) -> list[str]:
    """The further key of tables about many samples."""
    return ["sample"] if "sample" in rows.columns else []


def _col(value: str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
