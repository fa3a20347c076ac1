"""Benchmark qualification: which candidates stay within their platform's limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustweave.operators import relational as R
from trustweave.plans.workspace import Run

LIKED = 4.0


def qualify(run: Run, standards: DataFrame, softwares: DataFrame) -> dict[str, DataFrame]:
    """Capture every step and return the three counts.

    ``standards(Platform, MaxMem, MinMem)`` and ``softwares(Name, Platform,
    MaxMem, MinMem, Rate)`` must be registered in ``run`` under these names.
    """
    s, w = R.qualified(standards, "standards"), R.qualified(softwares, "softwares")
    pairs = s.join(w, F.col("`standards::Platform`") == F.col("`softwares::Platform`"))
    joined = run.capture(pairs, "join1", ["standards", "softwares"], "JOIN-1")
    within = (F.col("`softwares::MaxMem`") <= F.col("`standards::MaxMem`")) & (
        F.col("`softwares::MinMem`") <= F.col("`standards::MinMem`"))
    names = joined.filter(within).select(F.col("`softwares::Name`").alias("Name"))
    qualified = run.capture(names, "qualified", ["join1"], "QUALIFICATION")

    liked = run.capture(softwares.filter(F.col("Rate") >= LIKED), "liked", ["softwares"], "FILTER_LIKED")
    join2 = run.capture(
        qualified.join(liked, "Name").select("Name"), "join2", ["qualified", "liked"], "JOIN-2")
    disliked = run.capture(softwares.filter(F.col("Rate") < LIKED), "disliked", ["softwares"], "FILTER_DISLIKED")
    join3 = run.capture(
        qualified.join(disliked, "Name").select("Name"), "join3", ["qualified", "disliked"], "JOIN-3")
    return {"qualified": R.count_all(qualified), "liked": R.count_all(join2), "disliked": R.count_all(join3)}
