"""Where a pattern matches, in code points, with Spark's own functions.

Null texts give null; empty texts and empty arrays give empty arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256
#: Code points of a block of text.
_CUT = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(numbers: Column, add: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Running sums of an array of numbers (or what else ``add`` does, from 0 on).

    Sums are taken in blocks and blocks are shifted by the sums of those before, so
    the work per number is bounded for any length that fits into a row.
    """
    none = F.array().cast("array<int>")

    def sums(part: Column) -> Column:
        last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0))
        return F.aggregate(part, none, lambda a, n: F.concat(a, F.array(add(last(a), n).cast("int"))))

    def in_blocks(n: Column) -> Column:
        count = F.ceil(F.size(n) / F.lit(_BLOCK)).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda b: sums(F.slice(n, b * _BLOCK + 1, F.lit(_BLOCK))))

    def shifted(blocks: Column) -> Column:
        return let(sums(F.transform(blocks, lambda b: F.element_at(b, -1))), lambda ends: F.flatten(F.transform(
            blocks, lambda b, i: let(F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1)), lambda before: F.transform(b, lambda n: add(before, n).cast("int"))))))

    return let(numbers, lambda n: F.when(F.size(n) > 0, let(in_blocks(n), shifted)).otherwise(none))


def blocks(text: Column) -> Column:
    """A text cut into blocks, so that a place far inside need not be sought from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CUT}}}"), F.lit(0))


def between(cut: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text given as :func:`blocks`."""
    first = F.floor(start / _CUT).cast("int")
    some = F.slice(cut, first + 1, F.floor((F.greatest(end, start + 1) - 1) / _CUT).cast("int") - first + 1)
    return F.when(end > start, F.substr(F.array_join(some, ""), start - first * _CUT + 1, end - start)).otherwise(F.lit(""))


def matches(text: Column, pattern: str, hint: str | None = None) -> Column:
    """All matches, leftmost first.  Texts without ``hint`` are not searched."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<string>")
    return found if hint is None else F.when(F.contains(text, F.lit(hint)), found).otherwise(none)


def placed(text: Column, pattern: str, found: Column) -> Column:
    """``found`` as ``array<struct<start, end, text>>``.

    The text between the matches comes from splitting at the same pattern, so
    starts are running sums of lengths.
    """
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.length(b) + F.length(m))
    ends = F.zip_with(found, running(steps), lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("text")))
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    return F.when(F.size(found) > 0, ends).otherwise(none)


def digest(spans: Column) -> Column:
    """``kind:start:end`` of spans in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
