"""Physical plans: pruned scans, pushed filters, bounded broadcasts, no cross joins."""

import re

from pyspark.sql import functions as F

from checks.common import SHIPPED, ranked, shipped, table
from trustweave.functions import scalar as S
from trustweave.operators import trust

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_histogram_reads_inspected_columns_once(spark):
    spec = spark.createDataFrame(
        [("sales", "shipped", i, 0.0, 1.0) for i in SHIPPED],
        "scope STRING, var STRING, col_idx INT, base DOUBLE, step DOUBLE")
    text = plan(trust.histogram_counts(shipped(spark, SF), spec, list(SHIPPED), "sales", "shipped"))
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert scans == ["l_quantity:double,l_extendedprice:double,l_returnflag:string,l_shipdate:timestamp_ntz"]
    assert "partial_count" in text and "Python" not in text
    # constants are not grouping keys
    assert "keys=[run_id" in text


def test_theta_condition_stays_in_the_equi_join(spark):
    on = (F.col("l_partkey") == F.col("p_partkey")) & (F.col("l_quantity") <= F.col("p_size"))
    text = plan(table(spark, SF, "lineitem").join(table(spark, SF, "part"), on))
    assert "HashJoin" in text or "SortMergeJoin" in text
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    text = plan(table(spark, SF, "lineitem").filter((F.col("l_quantity") <= 10) & (F.col("l_discount") >= 0.05)))
    assert "LessThanOrEqual(l_quantity,10.0)" in text and "GreaterThanOrEqual(l_discount,0.05)" in text


def test_a_capture_is_read_by_run(spark):
    from checks.storage import imported

    ws = imported(spark, SF)
    one = ws.tables.read_capture("sales", "shipped", "19981").select("l_quantity")
    assert "ReadSchema: struct<l_quantity:double>" in plan(one)
    assert all("capture_run=19981" in f for f in one.inputFiles())
    some = ws.tables.read_captures("sales", "shipped").where("capture_run = '19982'")
    assert re.search(r"PartitionFilters: \[[^\]]*capture_run", plan(some))


def test_rank_does_not_put_a_key_into_one_task(spark):
    orders = table(spark, SF, "orders")
    text = plan(ranked(orders, "o_custkey", ["o_orderdate", "o_orderkey"], F.date_trunc("month", "o_orderdate"), "k"))
    assert re.search(r"hashpartitioning\(o_custkey#\d+L?, _chunk", text)


def test_hash_runs_in_the_jvm(spark):
    text = plan(table(spark, SF, "documents").select(S.string_hash(F.col("text"))))
    assert "reflect(java.util.Objects" in text and "Python" not in text
