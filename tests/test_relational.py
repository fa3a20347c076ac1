import pytest
from pyspark.sql import functions as F

from checks.common import ranked
from trustweave.operators import relational as R
from trustweave.sources.delimited import load_delimited, load_lines, store_delimited

def line(number, place, first, last, accesses, agent="Browser"):
    """One line of an access log; a quoted agent with a comma in it makes 20 fields of 19."""
    return ",".join([str(number), place, "7", first, last, str(accesses), str(number), agent] + ["x"] * 11)


SEEN = [("kiosk", "10:00.0", "10:42.5", 3), ("kiosk", "11:30.2", "12:00.2", 9), ("hall", "59:50.0", "00:20.9", 4)]
LOG = ["oops", *[line(i, *seen) for i, seen in enumerate(SEEN, 1)], line(8, "hall", "01:00.0", "02:00.0", 5, '"A, B"')]


def test_arity_with_and_without_quotes(spark):
    lines = spark.createDataFrame([(x,) for x in LOG], "value STRING")
    assert [r[0] for r in lines.select(R.field_count(F.col("value"))).collect()] == [1, 19, 19, 19, 20]
    assert R.with_arity(lines, 19).count() == 3
    assert R.with_arity(lines, 19, quoted=True).count() == 4


def test_matches_is_whole_string(spark):
    df = spark.createDataFrame([("a",), ("a\n",), ("ba",), ("",), (None,)], "t STRING")
    assert [r[0] for r in df.select(R.matches(F.col("t"), "a|b")).collect()] == [True, False, False, False, None]
    assert df.filter(~R.matches(F.col("t"), "")).count() == 3


def test_count_all(spark):
    df = spark.createDataFrame([(1, 2), (None, 3)], "a INT, b INT")
    assert [r["cnt"] for r in R.count_all(df).collect()] == [1]
    assert R.count_all(df.where("b > 9")).collect() == []
    assert [r["cnt"] for r in R.count_all(df.where("a IS NULL")).collect()] == [0]


@pytest.mark.parametrize("size", [30, 3000])
def test_bags_lose_nothing_and_keep_their_shape(spark, size):
    rows = spark.range(size).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id").withColumn(
        "k", F.when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.col("k")))
    whole, cut = R.group_bags(rows, ["k"]), R.group_bags(rows, ["k"], part=F.col("id") % 4)
    assert whole.columns == ["k", "bag"] and whole.count() == 3
    assert cut.columns == ["k", "part", "bag"] and cut.count() == 10  # null keys have two parts
    assert cut.agg(F.max(F.size("bag"))).first()[0] <= size / 4
    for bags in (whole, cut):
        flat = R.flatten_bag(bags)
        assert flat.columns == ["k", "id"]
        assert flat.exceptAll(rows).isEmpty() and rows.exceptAll(flat).isEmpty()


def test_as_schema_and_positional(spark):
    df = spark.createDataFrame([("1", "x", "2.5")], "a STRING, b STRING, c STRING")
    typed = R.as_schema(df, {"n": "int", "bad": "int", "d": "double"})
    assert typed.dtypes == [("n", "int"), ("bad", "int"), ("d", "double")]
    assert tuple(typed.first()) == (1, None, 2.5)
    assert R.positional(df, 2, 0).columns == ["c", "a"]
    with pytest.raises(ValueError):
        R.as_schema(df, {"n": "int"})


def test_rank_in_chunks_is_the_plain_rank(spark):
    from pyspark.sql import Window

    rows = spark.range(2000).select((F.col("id") % 7).alias("k"), (F.hash("id") % 500).alias("d"), "id")
    got = ranked(rows, "k", ["d", "id"], F.floor(F.col("d") / 50), "r")
    want = rows.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("d", "id")).cast("long"))
    assert got.select(want.columns).exceptAll(want).isEmpty() and got.count() == 2000


def test_delimited_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b', None), (2, "", 0.5)], "i INT, t STRING, d DOUBLE")
    path = str(tmp_path / "out")
    store_delimited(df, path)
    assert sorted(r[0] for r in load_lines(spark, path).collect()) == ['1\ta"b\t', "2\t\t0.5"]
    back = load_delimited(spark, path, "i INT, t STRING, d DOUBLE, more STRING", sep="\t")
    assert sorted(map(tuple, back.collect())) == [(1, 'a"b', None, None), (2, None, 0.5, None)]


def test_quotes_do_not_protect_delimiters(spark, tmp_path):
    (tmp_path / "q.csv").write_text('1,"a,b",c\n2\n3,x,y,z,surplus\n')
    rows = load_delimited(spark, str(tmp_path / "q.csv"), 3, tag="name").collect()
    assert [tuple(r) for r in rows] == [
        ("q.csv", "1", '"a', 'b"'), ("q.csv", "2", None, None), ("q.csv", "3", "x", "y")]
