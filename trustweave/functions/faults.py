"""Fault injection over whole tables, to exercise the distribution test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustweave.functions.scalar import INT_MAX, INT_MIN

CHUNK = 4096


def perturb(value: Column, amplitude: float) -> Column:
    """``value * (1 + amplitude)`` cut off towards zero, within the int range."""
    scaled = value.cast("double") * F.lit(1.0 + amplitude)
    return F.greatest(F.least(scaled, F.lit(float(INT_MAX))), F.lit(float(INT_MIN))).cast("int")


def drop(df: DataFrame, rate: float, seed: int, key: Sequence[str] | None = None) -> DataFrame:
    """Keep each row with probability ``rate`` (the name follows the original).

    The draw is a hash of seed and row, or of ``key`` columns, so it is the same
    under any partitioning; rows equal in them stay or go together.
    """
    bits = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in (key or df.columns)])
    # 53 bits give an even draw from [0, 1)
    return df.filter(F.shiftrightunsigned(bits, 11) / F.lit(float(2**53)) < F.lit(rate))


def random_generate(
    df: DataFrame,
    origin: str = "origin",
    boundary: str = "boundary",
    length: str = "length",
    seed: int = 0,
    name: str = "value",
) -> DataFrame:
    """Give each row ``length`` ints drawn uniformly from [origin, boundary).

    A sequence is first cut into chunks, which are spread over all tasks, so a
    single huge sequence does not end in one task.  The draw is a hash of seed, row and
    position instead of a stateful generator: a task that is run again after a
    lost executor yields the same numbers.  Rows equal in every column draw the
    same sequence, so give such rows a number of their own.
    """
    inputs = df.columns
    backwards = F.col(boundary) < F.col(origin)
    checked = df.withColumn("_span", F.when(backwards, F.raise_error(F.lit(f"{boundary} is below {origin}")).cast("long"))
                            .otherwise(F.col(boundary).cast("long") - F.col(origin)))
    chunks = F.sequence(F.lit(0), F.expr(f"CAST((`{length}` - 1) DIV {CHUNK} AS INT)"))
    draws = checked.where(F.col(length) > 0).withColumn("_chunk", F.explode(chunks)).hint("rebalance")
    first = F.col("_chunk") * CHUNK
    last = F.least(first + CHUNK, F.col(length)) - 1
    draws = draws.withColumn("_pos", F.explode(F.sequence(first, last)))
    bits = F.xxhash64(F.lit(seed), *[F.col(c) for c in inputs], F.col("_pos"))
    # remainder of 63 well-mixed bits: the bias is below span / 2**63
    value = F.pmod(F.shiftrightunsigned(bits, 1), F.col("_span")) + F.col(origin)
    return draws.select(*inputs, value.cast("int").alias(name))
