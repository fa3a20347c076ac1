"""Quality rules with thresholds that follow the corpus.

``measure`` computes signals of every whole text.  Each signal's distribution
per language and source is kept as a mergeable quantile sketch: integer buckets
with counts, exact below 64 and within 1/32 above.  Sketches merge by adding
counts, so a hot source is pre-aggregated in the scan, and the sketch of a
language or of everything is the sum of its parts.  A signal's fence is the
upper quartile plus a multiple of the quartile distance, but at least a margin
above the median; documents beyond a fence are rejected.  A source with few
documents takes the fences of its language, a small language those of all.

Defined results: a null text counts as empty; a document without words fails
the base rules; null languages and sources are groups of their own; repeated
rows are judged alike; an empty table gives an empty one; columns of the input
named like a result are replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from trustweave.llm.shared import SPACES, Scratch, beside, packed, per_batch, restored

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
#: Signal, in thousandths: numerator, denominator, and the least distance of its fence from the median.
SIGNALS = {
    "symbols": ("n_symbols", "n_words", 250),
    "repeats": ("n_repeat_words", "n_words", 400),
    "lines": ("n_dup_lines", "n_words", 50),
    "length": ("word_chars", "n_words", 4000),
}
SPREAD = 4
#: Documents from which a group's own sketch is used.
MIN_GROUP = 100


def _counts(text: str) -> tuple[int, int, int, int, int]:
    raw = text.encode()
    words = raw.split()  # bytes split at ASCII white space only
    n = len(words)
    white = len(raw) - len(raw.translate(None, SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen: set = set()
        twice = {w for w in windows if w in seen or seen.add(w)}
        covered = -1  # last word counted
        for i, w in enumerate(windows):
            if w in twice:
                repeated += i + 2 - max(covered, i - 1)
                covered = i + 2
    return n, len(text) - white, symbols, len(lines) - len(set(lines)), repeated


def measure(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``_doc, lang, source, text`` and the counts of each text; no shuffle."""
    lang, source = [F.col(c) if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source")]
    rows = packed(docs, "text", text=F.col("text"), lang=lang.cast("string"), source=source.cast("string"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(zip(*[_counts(t or "") for t in batch.column("text").to_pylist()])) or [()] * len(COUNTS)
        kept = [c for c in batch.schema.names if keep_text or c != "text"]
        arrays = [batch.column(c) for c in kept] + [pa.array(c, pa.int64()) for c in found]
        return pa.RecordBatch.from_arrays(arrays, [*kept, *COUNTS])

    fields = [f for f in rows.schema if keep_text or f.name != "text"]
    counts = [T.StructField(c, T.LongType()) for c in COUNTS]
    return per_batch(rows, run, T.StructType([*fields, *counts]))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _signal(name: str) -> Column:
    over, under, _ = SIGNALS[name]
    return F.when(F.col("n_words") > 0, F.expr(f"{over} * 1000 DIV {under}"))


def bucket(value: Column) -> Column:
    """Number of the bucket of a whole number; its five leading bits from 64 on."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return (shift * 32 + F.call_function("shiftright", value, shift)).cast("int")


def low_end(number: Column) -> Column:
    """Least value of a bucket."""
    shift = F.greatest(F.floor(number / 32).cast("int") - 1, F.lit(0))
    return F.when(number < 64, number.cast("long")).otherwise(
        F.call_function("shiftleft", (number - shift * 32).cast("long"), shift))


def sketches(measured: DataFrame) -> DataFrame:
    """``lang, source, signal, bucket, n`` of documents that pass the base rules."""
    named = F.array(*[F.struct(F.lit(s).alias("signal"), bucket(_signal(s)).alias("bucket")) for s in SIGNALS])
    return (
        measured.where(~base_failed()).select("lang", "source", F.inline(named))
        .groupBy("lang", "source", "signal", "bucket").agg(F.count(F.lit(1)).alias("n"))
    )


def fences(sketch: DataFrame) -> DataFrame:
    """One row per language and source with a fence for each signal."""
    level = F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang").alias("l"), F.col("source").alias("s")),
        F.struct(F.lit(1).alias("level"), F.col("lang").alias("l"), F.lit(None).cast("string").alias("s")),
        F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("l"), F.lit(None).cast("string").alias("s")),
    )
    merged = (
        sketch.select("signal", "bucket", "n", F.inline(level))
        .groupBy("level", "l", "s", "signal", "bucket").agg(F.sum("n").alias("n"))
    )
    # a sketch has at most a few hundred buckets, so these windows are small
    w = W.partitionBy("level", "l", "s", "signal")
    ranked = merged.select(
        "*", F.sum("n").over(w.orderBy("bucket")).alias("upto"), F.sum("n").over(w).alias("total"))
    q = lambda share: F.min(F.when(100 * F.col("upto") >= share * F.col("total"), low_end(F.col("bucket"))))
    quartiles = ranked.groupBy("level", "l", "s", "signal").agg(
        q(25).alias("q25"), q(50).alias("q50"), q(75).alias("q75"), F.max("total").alias("total"))
    margin = F.coalesce(*[F.when(F.col("signal") == s, F.lit(v[2])) for s, v in SIGNALS.items()])
    fence = F.greatest(F.col("q75") + SPREAD * (F.col("q75") - F.col("q25")), F.col("q50") + margin)
    table = quartiles.groupBy("level", "l", "s").agg(
        F.max("total").alias("total"), *[F.max(F.when(F.col("signal") == s, fence)).alias(s) for s in SIGNALS])
    own = table.where("level = 0").select(F.col("l").alias("lang"), F.col("s").alias("source"), "total", F.struct(*SIGNALS).alias("own"))
    lang = table.where("level = 1").select(F.col("l").alias("_l"), F.col("total").alias("_t"), F.struct(*SIGNALS).alias("up"))
    every = table.where("level = 2").select(F.struct(*SIGNALS))
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("_l"))).withColumn("top", every.scalar())
    use = F.when(F.col("total") >= MIN_GROUP, F.col("own")).when(F.col("_t") >= MIN_GROUP, F.col("up")).otherwise(F.col("top"))
    return joined.select("lang", "source", use.alias("fence"))


def judge(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``kept`` and the ``reason`` of a rejection."""
    scratch = Scratch(docs.sparkSession, "quality")
    # texts are measured twice rather than stored in between; sketches and fences are small tables
    slim = docs.select([c for c in docs.columns if c in ("text", "lang", "source")])
    sketch = scratch.keep(sketches(measure(slim, keep_text=False)))
    limits = scratch.keep(fences(sketch)).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "fence")
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    rows = measure(docs, keep_text).join(limits, same, "left")
    beyond = F.filter(F.array(*[
        F.when(_signal(s) > F.col("fence")[s], F.lit(s)) for s in SIGNALS]), lambda r: r.isNotNull())
    reason = F.when(F.col("n_words") < MIN_WORDS, "short").when(base_failed(), "repetitive").otherwise(F.get(beyond, F.lit(0)))
    text = ["text"] if keep_text else []
    rows = rows.select("_doc", *text, *COUNTS, base_failed().alias("base_failed"), reason.alias("reason"))
    new = [*COUNTS, "base_failed", "kept", "reason"]
    return rows.select(*beside(rows, ["text", *new]), *text, *COUNTS, "base_failed", F.col("reason").isNull().alias("kept"), "reason")


def accepted(docs: DataFrame) -> DataFrame:
    """``docs`` without those that the rules reject."""
    lang, source = [F.col(c) if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source")]
    judged = judge(packed(docs, "text", text=F.col("text"), lang=lang, source=source))
    return restored(judged.where("kept"), docs, F.lit(False))
