import math

import pytest
from pyspark.sql import functions as F

from trustweave.operators import trust

DIST = "scope STRING, var STRING, run_id STRING, col_idx INT, bucket INT, p DOUBLE"
RUNS = "scope STRING, var STRING, run_id STRING"
HISTORY = {"a": {0: 0.5, 1: 0.5}, "b": {0: 0.6, 1: 0.4}, "c": {0: 0.4, 1: 0.6}}


def check(spark, history, sample, corrupted=()):
    runs = dict(history, sample=sample)
    dist = spark.createDataFrame(
        [("s", "v", r, 0, b, p) for r, d in runs.items() for b, p in d.items()], DIST)
    profile = spark.createDataFrame(
        [("s", "v", r, 0, 10 if d else 0, 0) for r, d in runs.items()],
        "scope STRING, var STRING, run_id STRING, col_idx INT, n LONG, n_bad LONG")
    flagged = spark.createDataFrame([("s", "v", r) for r in corrupted], RUNS)
    rows = trust.confidence(dist, profile, "sample", flagged).collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize("sample, jsd, log_density, corrupted", [
    ({0: 0.5, 1: 0.5}, 0.0, 4.250210315, False),
    ({0: 0.55, 1: 0.45}, 0.001253662068, 4.653689455, False),
    ({0: 0.45, 1: 0.45, 2: 0.1}, 0.035973756650, -57.36364879, True),
    ({5: 1.0}, math.log(2), -27876.1197, True),
])
def test_known_confidences(spark, sample, jsd, log_density, corrupted):
    row = check(spark, HISTORY, sample)
    assert row["jsd"] == pytest.approx(jsd, abs=1e-11)
    assert row["mu"] == pytest.approx(0.003372926619, abs=1e-11)
    assert row["sd"] == pytest.approx(0.002921040137, abs=1e-11)
    assert row["log_density"] == pytest.approx(log_density, rel=1e-8)
    assert row["confidence"] == pytest.approx(math.exp(log_density), rel=1e-5)
    assert (row["corrupted"], row["status"], row["n_history"]) == (corrupted, "ok", 3)


@pytest.mark.parametrize("history, out, status", [
    ({"a": HISTORY["a"]}, (), "insufficient_history"),
    ({"a": HISTORY["a"], "b": HISTORY["a"], "c": HISTORY["a"]}, (), "degenerate_history"),
    (HISTORY, ("a", "b", "c"), "all_history_corrupted"),
    (HISTORY, ("a", "b"), "degenerate_history"),
    (HISTORY, ("a",), "degenerate_history"),  # two mirrored runs are equally far from their mean
])
def test_statuses(spark, history, out, status):
    row = check(spark, history, HISTORY["b"], out)
    assert (row["status"], row["corrupted"], row["confidence"]) == (status, False, None)


def test_corrupted_sample_is_still_compared(spark):
    assert check(spark, HISTORY, {5: 1.0}, ("sample",))["status"] == "ok"


def test_empty_captures_take_part(spark):
    row = check(spark, dict(HISTORY, d={}), {})
    # the mean holds 3/4 of the mass, an empty sample meets none of it
    assert row["jsd"] == pytest.approx(0.75 * math.log(2) / 2)
    assert row["n_history"] == 4


def test_divergence_properties(spark):
    import random

    rnd = random.Random(4)
    runs = {}
    for r in range(12):
        weights = {rnd.randrange(-5, 40): rnd.random() for _ in range(20)}
        total = sum(weights.values())
        runs[f"r{r}"] = {b: w / total for b, w in weights.items()}
    dist = spark.createDataFrame([("s", "v", r, 0, b, p) for r, d in runs.items() for b, p in d.items()], DIST)
    buckets = {b for d in runs.values() for b in d}
    mean = {b: sum(d.get(b, 0) for d in runs.values()) / len(runs) for b in buckets}
    members = dist.select(*trust.RUN_COL).distinct().select(
        "*", F.lit(False).alias("is_sample"), F.lit(len(runs)).alias("n_history"), F.lit(1.0).alias("mass"))
    rows = trust.usable(dist, members)
    got = trust.jsd(trust.align(rows, trust.history_mean(rows)), members)

    def slow(p):
        term = lambda x, y: x * math.log(x / y) if x else 0.0
        return sum(term(p.get(b, 0), (p.get(b, 0) + mean[b]) / 2) + term(mean[b], (p.get(b, 0) + mean[b]) / 2)
                   for b in buckets) / 2

    for row in got.collect():
        assert row["jsd"] == pytest.approx(slow(runs[row["run_id"]]), abs=1e-12)
        assert 0 <= row["jsd"] <= math.log(2)


def test_histogram_counts_bad_values(spark):
    rows = [("r", x) for x in ("0", "1", "x", None, "10", "-1", "NaN")]
    obs = trust.observations(spark.createDataFrame(rows, "run_id STRING, c STRING"), {2: "c"})
    spec = spark.createDataFrame([("s", "v", 2, 0.0, 0.01)], "scope STRING, var STRING, col_idx INT, base DOUBLE, step DOUBLE")
    counts = trust.histogram_counts(obs, spec, [2], "s", "v")
    profile = trust.profile_counts(counts).first()
    assert (profile["n"], profile["n_bad"]) == (5, 2)
    dist = {r["bucket"]: r["p"] for r in trust.relative_frequency(counts).collect()}
    assert dist == {0: 0.4, 100: 0.2, 1000: 0.2, -100: 0.2} and sum(dist.values()) == pytest.approx(1)


def test_column_without_spec_is_all_bad(spark):
    obs = trust.observations(spark.createDataFrame([("r", 1.0)], "run_id STRING, c DOUBLE"), {0: "c"})
    spec = spark.createDataFrame([], "scope STRING, var STRING, col_idx INT, base DOUBLE, step DOUBLE")
    profile = trust.profile_counts(trust.histogram_counts(obs, spec, [0], "s", "v")).first()
    assert (profile["n"], profile["n_bad"]) == (0, 1)


def test_spec_compat_keeps_six_digits_and_a_positive_maximum(spark):
    rows = spark.createDataFrame([("r", -1234567.5), ("r", -3.0)], "run_id STRING, c DOUBLE")
    obs = trust.observations(rows, {0: "c"})
    exact, old = (trust.bucket_spec(obs, "s", "v", compat).first() for compat in (False, True))
    assert (exact["base"], exact["step"]) == (-1234567.5, (-3.0 + 1234567.5) / 1000)
    assert (old["base"], old["step"]) == (-1234570.0, 1234.57)


def test_lineitem_quarters(spark):
    """The values of the worked large-table case."""
    from checks import trust as registered

    rows = registered.QUERIES["confidence"](spark, "/root/testdata/sf0.01").where("col_idx = 1").collect()
    assert [(r["run_id"], r["n_history"], r["jsd"], r["mu"], r["sd"], r["log_density"], r["corrupted"]) for r in rows] == [
        ("20014", 27, 0.202075477, 0.071185081, 0.004718615, pytest.approx(-380.29313, abs=2e-5), True)]


def test_many_samples_at_once_equal_one_by_one(spark):
    import random

    rnd = random.Random(7)
    rows, profile = [], []
    for var in "vw":
        for r in range(9):
            empty = (var, r) == ("w", 4)
            weights = {} if empty else {rnd.randrange(12): rnd.random() for _ in range(8)}
            total = sum(weights.values())
            rows += [("s", var, f"r{r}", 1, b, w / total) for b, w in weights.items()]
            profile.append(("s", var, f"r{r}", 1, 0 if empty else 8, 0))
    dist = spark.createDataFrame(rows, DIST)
    profile = spark.createDataFrame(profile, "scope STRING, var STRING, run_id STRING, col_idx INT, n LONG, n_bad LONG")
    flagged = spark.createDataFrame([("s", "v", "r2"), ("s", "w", "r7")], RUNS)
    samples = profile.where("run_id IN ('r0', 'r2', 'r4')").select("scope", "var", "run_id")
    many = trust.confidence(dist, profile, samples.union(samples), flagged).orderBy("var", "run_id").collect()
    single = [r for run in ("r0", "r2", "r4") for r in trust.confidence(dist, profile, run, flagged).collect()]
    assert len(many) == 6
    for got, want in zip(many, sorted(single, key=lambda r: (r["var"], r["run_id"]))):
        assert [got[c] for c in (*trust.RUN_COL, "n_history", "status", "corrupted")] == [
            want[c] for c in (*trust.RUN_COL, "n_history", "status", "corrupted")]
        assert [got[c] for c in ("jsd", "mu", "sd", "log_density")] == pytest.approx(
            [want[c] for c in ("jsd", "mu", "sd", "log_density")], rel=1e-9)
