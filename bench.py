"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs once to warm up and then $BENCH_REPEATS times (default 3); the
median counts.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import provenance, relational, storage, trust, workflows  # noqa: E402
from checks.common import quarter, table  # noqa: E402
from trustweave.plans.workspace import Workspace  # noqa: E402
from trustweave.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]
MODULES = (storage, relational, trust, provenance, workflows)
HEADLINE = (
    "confidence histogram min_max string_hash path_counts evaluate register_operation "
    "search_data search_semantics wifi_time_rank wifi_density_rank join_theta_post sum_by_key group_by"
).split()


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def history(spark, which=None, ws=None) -> Workspace:
    """Quarters of lineitem as captured runs."""
    ws = ws or Workspace(spark)
    items = table(spark, SF_DIR, "lineitem").select(*COLUMNS, "l_shipdate", quarter().alias("q"))
    items = items if which is None else items.where(which)
    ws.import_history("sales", "shipped", items, "q", F.min("l_shipdate"), COLUMNS)
    return ws


def timed(action, setup=lambda: None) -> float:
    seconds = []
    for _ in range(REPEATS + 1):
        given = setup()
        start = time.perf_counter()
        action(given)
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds[1:]), 3)


def main() -> None:
    spark = local_session("bench", CPUS, memory="16g")
    queries = {name: fn for module in MODULES for name, fn in module.QUERIES.items()}
    results = {name: timed(lambda _, fn=queries[name]: drain(fn(spark, SF_DIR))) for name in HEADLINE}

    items = table(spark, SF_DIR, "lineitem")
    last = items.agg(F.max(quarter())).first()[0]

    def new_run(_=None):
        ws = Workspace(spark)
        run = ws.start_run("bench")
        run.loaded(items, f"{SF_DIR}/lineitem.parquet", "lineitem")
        return run

    results["capture_and_read_back"] = timed(
        lambda run: drain(run.capture(items, "copy", ["lineitem"], "COPY")), new_run)
    results["check_run_first"] = timed(lambda ws: drain(ws.check_run("sales", last)), lambda: history(spark))

    def profiled():
        """All runs but the last are profiled; the last one arrives afterwards."""
        ws = history(spark, F.col("q") < last)
        ws.check_run("sales", items.where(quarter() < last).agg(F.max(quarter())).first()[0])
        history(spark, F.col("q") == last, ws)
        return ws

    results["check_run_incremental"] = timed(lambda ws: drain(ws.check_run("sales", last)), profiled)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(results.values()), 3), "unit": "sec",
        "queries": results, "sf": float(os.path.basename(SF_DIR.rstrip("/")).replace("sf", "") or 0),
    }))


if __name__ == "__main__":
    main()
