"""Column expressions of the distribution test, the log files and the access log.

Every function takes columns and returns a column; none of them is a Python
UDF, so they run inside the executors' JVM next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MAX = 2147483647
INT_MIN = -2147483648
LN2 = 0.6931471805599453
HALF_LN_2PI = 0.9189385332046727
#: An hour in tenths of a second.
HOUR = 36_000


def to_double(value: Column) -> Column:
    """Number in a text or numeric column; unreadable text gives null."""
    return value.try_cast("double")


def string_hash(value: Column) -> Column:
    """32-bit polynomial hash (base 31 over UTF-16 units) of the whole text.

    This is the JVM's own string hash, reached through a static method, so one
    call reads the text once however long it is.
    """
    hashed = F.reflect(F.lit("java.util.Objects"), F.lit("hashCode"), value)
    return F.when(value.isNotNull(), hashed.cast("int"))


def bucketize(value: Column, base: Column, step: Column) -> Column:
    """Histogram bucket ``floor((value - base) / step)`` as a saturating int.

    A zero step puts ``base`` into bucket 0 and everything else at the end of
    the int range on its side; not-a-number goes to 0, null stays null.
    """
    offset = value - base
    ratio = offset / F.nullif(step, F.lit(0.0))
    on_zero_step = (
        F.when(F.isnan(offset) | (offset == 0), F.lit(0))
        .when(offset > 0, F.lit(INT_MAX))
        .otherwise(F.lit(INT_MIN))
    )
    return (
        F.when(value.isNull() | base.isNull() | step.isNull(), F.lit(None).cast("int"))
        .when(step == 0, on_zero_step)
        .when(F.isnan(ratio), F.lit(0))
        .when(ratio >= INT_MAX, F.lit(INT_MAX))
        .when(ratio <= INT_MIN, F.lit(INT_MIN))
        .otherwise(F.floor(ratio).cast("int"))
    )


def jsd_term(p: Column, m: Column) -> Column:
    """``p * ln(p / m)`` in nats, and 0 where ``p`` is 0."""
    return F.when(p == 0, F.lit(0.0)).otherwise(p * F.ln(p / F.nullif(m, F.lit(0.0))))


def normal_log_density(x: Column, mu: Column, sd: Column) -> Column:
    """Log density of N(mu, sd) at ``x``; null unless ``sd`` is positive."""
    z = (x - mu) / F.nullif(sd, F.lit(0.0))
    return F.when(sd > 0, F.lit(-0.5) * z * z - F.ln(sd) - F.lit(HALF_LN_2PI))


def normal_density(x: Column, mu: Column, sd: Column) -> Column:
    """Density of N(mu, sd) at ``x`` — not a probability, it can exceed 1."""
    return F.exp(normal_log_density(x, mu, sd))


def six_digits(value: Column) -> Column:
    """``value`` after a round trip through ``%g`` text (six significant digits)."""
    return F.format_string("%g", value).cast("double")


def literal_pattern(sep: str) -> str:
    """Pattern for a literal separator, in the form that splits without a regex engine."""
    return sep if len(sep) == 1 and sep.isalnum() or sep in ",:;\t " else f"\\{sep}" if len(sep) == 1 else f"\\Q{sep}\\E"


def split_csv(text: Column, sep: str = ",") -> Column:
    """Comma list to array; trailing empty items are dropped, '' gives ['']."""
    trimmed = F.when(text.endswith(sep), F.rtrim(text, F.lit(sep))).otherwise(text)
    return F.split(trimmed, literal_pattern(sep), -1)


def parse_confidence(text: Column) -> Column:
    """``'0:0.15,3:45'`` to a map from column number to confidence."""
    as_map = F.str_to_map(F.when(text != "", text), F.lit(","), F.lit(":"))
    return F.transform_keys(
        F.transform_values(as_map, lambda _, v: v.cast("double")), lambda k, _: k.cast("int")
    )


def confidence_string(col_idx: Column, confidence: Column) -> Column:
    """Aggregate: ``idx:value`` pairs of one variable, in column order.

    The group is one captured table's inspected columns, so its size is bounded
    by the width of a schema.
    """
    pairs = F.array_sort(F.collect_list(F.struct(col_idx.alias("i"), confidence.alias("c"))))
    return F.array_join(F.transform(pairs, lambda x: F.format_string("%d:%g", x.i, x.c)), ",")


def clock_tenths(text: Column) -> Column:
    """``mm:ss.s`` to tenths of a second; null when it does not look like that."""
    parts = F.split(text, ":", -1)
    minutes = F.get(parts, F.lit(0)).try_cast("long")
    tenths = (F.get(parts, F.lit(1)).try_cast("decimal(5,1)") * 10).cast("long")
    return F.when(F.size(parts) == 2, minutes * 600 + tenths)


def duration(first: Column, last: Column) -> Column:
    """Whole seconds from one ``mm:ss.s`` clock text to another.

    The clock shows no hours, so an end before the start is in the next hour; a
    span of a full hour or more cannot be told from its remainder.
    """
    tenths = F.pmod(clock_tenths(last) - clock_tenths(first), F.lit(HOUR))
    return F.floor(tenths / 10).cast("long")


def density_ratio(accesses: Column, seconds: Column) -> Column:
    """Accesses per second; null for an empty span."""
    return F.try_divide(accesses.cast("double"), seconds.cast("double"))
