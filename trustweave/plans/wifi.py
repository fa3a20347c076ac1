"""Access-log ranking: time, accesses and density per location."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustweave.functions import scalar as S
from trustweave.operators import relational as R
from trustweave.plans.workspace import Run

FIELDS = 19
NAMED = {"LocationID": "string", "FirstAccess": "string", "LastAccess": "string", "AccessCount": "int"}


def clean(lines: DataFrame) -> DataFrame:
    """Fields of the well-formed lines; a line with an empty first field goes too."""
    fields = R.split_fields(R.with_arity(lines, FIELDS), FIELDS)
    return fields.filter(~R.matches(F.col(fields.columns[0]), ""))


def name(cleaned: DataFrame) -> DataFrame:
    return R.as_schema(R.positional(cleaned, 1, 3, 4, 5), NAMED)


def time(named: DataFrame) -> DataFrame:
    return named.select("LocationID", S.duration(F.col("FirstAccess"), F.col("LastAccess")).alias("Duration"))


def total(df: DataFrame, column: str, alias: str) -> DataFrame:
    return df.groupBy("LocationID").agg(F.sum(column).alias(alias))


def score(timed: DataFrame, accessed: DataFrame) -> DataFrame:
    density = S.density_ratio(F.col("TotalAccesses"), F.col("TotalDuration")).alias("Density")
    return timed.join(accessed, "LocationID").select("LocationID", density)


def time_rank(lines: DataFrame) -> DataFrame:
    """Locations by total connection time."""
    return R.ordered_desc(total(time(name(clean(lines))), "Duration", "TotalDuration"), "TotalDuration")


def access_rank(lines: DataFrame) -> DataFrame:
    """Locations by total number of accesses."""
    return R.ordered_desc(total(name(clean(lines)), "AccessCount", "TotalAccesses"), "TotalAccesses")


def density_rank(lines: DataFrame) -> DataFrame:
    """Locations by accesses per second of connection time.

    Both totals come from one aggregate over the log, which is what joining the
    two rankings on the location gives.
    """
    named = name(clean(lines))
    seconds = S.duration(F.col("FirstAccess"), F.col("LastAccess"))
    both = named.where(F.col("LocationID").isNotNull()).groupBy("LocationID").agg(
        F.sum(seconds).alias("TotalDuration"), F.sum("AccessCount").alias("TotalAccesses"))
    density = S.density_ratio(F.col("TotalAccesses"), F.col("TotalDuration")).alias("Density")
    return R.ordered_desc(both.select("LocationID", density), "Density")


def captured_rank(run: Run, path: str, parts: int = 64) -> DataFrame:
    """The density ranking with every intermediate table captured.

    Bags are always cut into ``parts`` by a hash of the row, so that a location
    with a large share of the log does not become one row.
    """
    def bags_of(df: DataFrame, bag: str) -> DataFrame:
        return R.group_bags(df, ["LocationID"], bag, F.pmod(F.xxhash64(*df.columns), F.lit(parts)))

    lines = run.loaded(run.workspace.spark.read.text(path), path, "raw", format="text")
    cleaned = run.capture(clean(lines), "cleaned", ["raw"], "Cleaning")
    named = run.capture(name(cleaned), "named", ["cleaned"], "Naming", inspected=["AccessCount"])
    timed = run.capture(time(named), "timed", ["named"], "ConvertTime", inspected=["Duration"])

    bags = bags_of(timed, "timed")
    timed_bags = run.capture(bags, "timed_grouped", ["timed"], "TimeGrouping")
    timed_sums = run.capture(
        total(R.flatten_bag(timed_bags, "timed"), "Duration", "TotalDuration"),
        "timed_summed", ["timed_grouped"], "TimeAccumulation", inspected=["TotalDuration"])

    bags = bags_of(named, "named")
    access_bags = run.capture(bags, "access_grouped", ["named"], "AccessGrouping")
    access_sums = run.capture(
        total(R.flatten_bag(access_bags, "named"), "AccessCount", "TotalAccesses"),
        "access_summed", ["access_grouped"], "AccessAccumulation", inspected=["TotalAccesses"])

    density = timed_sums.join(access_sums, "LocationID")
    density = run.capture(density, "density", ["timed_summed", "access_summed"], "Combining")
    ratio = S.density_ratio(F.col("TotalAccesses"), F.col("TotalDuration")).alias("Density")
    scored = run.capture(
        density.select("LocationID", ratio), "density_scored", ["density"], "DensityScoring", inspected=["Density"])
    return R.ordered_desc(scored, "Density")
