import math

from pyspark.sql import functions as F

from trustweave.functions import faults
from trustweave.functions import scalar as S


def values(df):
    return [tuple(r) for r in df.collect()]


def test_string_hash_known_values(spark):
    known = {"": 0, "hello": 99162322, "polygenelubricants": -2147483648, "é😀": 1996812, "Windows": -1280820637}
    df = spark.createDataFrame([(t, h) for t, h in known.items()], "t STRING, h INT")
    assert all(a == b for a, b in values(df.select(S.string_hash(F.col("t")), "h")))
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(S.string_hash(F.col("t"))).first()[0] is None


def test_bucketize(spark):
    cases = [
        (0.0, 0.0, 0.05, 0), (50.0, 0.0, 0.05, 1000), (-0.01, 0.0, 0.05, -1), (100.0, 0.0, 0.05, 2000),
        (7.0, 7.0, 0.0, 0), (8.0, 7.0, 0.0, 2147483647), (6.0, 7.0, 0.0, -2147483648),
        (math.nan, 0.0, 0.05, 0), (math.nan, 0.0, 0.0, 0), (math.inf, 0.0, 0.05, 2147483647),
        (-1e300, 0.0, 0.05, -2147483648), (None, 0.0, 0.05, None), (1.0, None, None, None),
    ]
    df = spark.createDataFrame(cases, "v DOUBLE, base DOUBLE, step DOUBLE, want INT")
    got = values(df.select(S.bucketize(F.col("v"), F.col("base"), F.col("step")), "want"))
    assert all(a == b for a, b in got), got


def test_unreadable_number_is_null(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("",), (None,)], "t STRING")
    assert values(df.select(S.to_double(F.col("t")))) == [(1.5,), (None,), (None,), (None,)]


def test_six_digits(spark):
    df = spark.createDataFrame([(1234567.5,), (0.1234567,)], "v DOUBLE")
    assert values(df.select(S.six_digits(F.col("v")))) == [(1234570.0,), (0.123457,)]


def test_split_csv(spark):
    df = spark.createDataFrame([("a,b",), ("a,,b,,",), ("",)], "t STRING")
    assert values(df.select(S.split_csv(F.col("t")))) == [(["a", "b"],), (["a", "", "b"],), ([""],)]


def test_confidence_text_both_ways(spark):
    df = spark.createDataFrame([(3, 45.0), (0, 0.15), (4, 1e-24)], "i INT, c DOUBLE")
    text = df.agg(S.confidence_string(F.col("i"), F.col("c")).alias("t"))
    assert text.first()["t"] == "0:0.150000,3:45.0000,4:1.00000e-24"
    short = spark.createDataFrame([("0:0.15,3:45,4:1e-24",), ("",)], "t STRING")
    assert values(short.select(S.parse_confidence(F.col("t")))) == [({0: 0.15, 3: 45.0, 4: 1e-24},), (None,)]


def test_duration(spark):
    cases = [("23:27.7", "56:36.5", 1988), ("24:05.1", "24:05.1", 0), ("30:09", "30:25.2", 16), ("58:00.0", "02:00.0", 240), ("00:00.1", "00:00.0", 3599), ("x", "00:01.0", None)]
    df = spark.createDataFrame(cases, "a STRING, b STRING, want LONG")
    got = values(df.select(S.duration(F.col("a"), F.col("b")), "want"))
    assert all(a == b for a, b in got), got


def test_density_ratio_of_empty_span(spark):
    df = spark.createDataFrame([(33, 113), (1, 0)], "a INT, s INT")
    assert values(df.select(S.density_ratio(F.col("a"), F.col("s")))) == [(33 / 113,), (None,)]


def test_perturb_truncates_and_saturates(spark):
    df = spark.createDataFrame([(7,), (-3,), (0,), (2000000000,)], "i INT")
    assert values(df.select(faults.perturb(F.col("i"), 2.0))) == [(21,), (-9,), (0,), (2147483647,)]
    small = spark.createDataFrame([(3,), (-3,)], "i INT")
    assert values(small.select(faults.perturb(F.col("i"), 0.5))) == [(4,), (-4,)]


def test_random_generate_is_repeatable_and_in_bounds(spark):
    bounds = spark.createDataFrame([(0, 50, 10_000), (-5, 5, 7), (3, 9, 0)], "origin INT, boundary INT, length INT")
    drawn = faults.random_generate(bounds, seed=3)
    counts = {(r[0], r[1]): (r[2], r[3], r[4]) for r in drawn.groupBy("origin", "boundary").agg(
        F.count("*"), F.min("value"), F.max("value")).collect()}
    assert counts == {(0, 50): (10_000, 0, 49), (-5, 5): (7, *counts[(-5, 5)][1:])}
    assert -5 <= counts[(-5, 5)][1] <= counts[(-5, 5)][2] < 5
    again = faults.random_generate(bounds.repartition(5), seed=3)
    assert drawn.exceptAll(again).isEmpty() and again.exceptAll(drawn).isEmpty()
    spread = drawn.where("boundary = 50").groupBy("value").count().agg(F.min("count"), F.max("count")).first()
    assert 130 < spread[0] and spread[1] < 275


def test_drop_keeps_the_given_share(spark):
    kept = faults.drop(spark.range(20_000), 0.25, seed=5).count()
    assert abs(kept / 20_000 - 0.25) < 0.02
    assert faults.drop(spark.range(100), 0.0, seed=5).count() == 0
    three, five = [faults.drop(spark.range(2000).repartition(n), 0.4, seed=5) for n in (3, 5)]
    assert three.exceptAll(five).isEmpty() and five.exceptAll(three).isEmpty()
    assert faults.drop(spark.range(100), 1.0, seed=5).count() == 100
