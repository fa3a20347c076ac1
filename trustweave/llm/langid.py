"""Language of web pages by fusing several kinds of evidence.

    log P(language | page) = log prior(host) + tempered log-likelihood of the text
                             + log P(declared markup language | language)

- Text: a naive Bayes model over hashed character trigrams, counted over all
  labelled documents.  A page's likelihood is a mean per trigram, times at most
  ``WEIGHT`` trigrams, so that a long page cannot drown everything else.
- Declared: how often pages of a language declare each value of ``<html lang>``,
  smoothed; pages are counted by their language as the text alone gives it.
- Priors: languages per host, smoothed towards those of its registered domain,
  these towards the address suffix's, and these towards all pages'.  A page's
  own vote is taken out of its host's counts.

All counts are grouped aggregations, pre-aggregated in the map tasks; a host with
a third of all pages is one small row.  The model has one number per language and
trigram bucket (``BUCKETS``), whatever the corpus; languages are the
``max_languages`` most frequent labels.

Defined results: a null or tagless page has no text evidence, a null address
belongs to the host ''; repeated rows are counted each and get equal results;
without labelled documents every language is null; an empty table gives an
empty one; columns of the input named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustweave.llm.shared import Scratch, beside, packed, per_batch

BUCKETS = 1 << 15
WEIGHT = 60
#: Strength of the next level of the hierarchy, in pages.
SMOOTH = 5.0
DECLARED_SMOOTH = 1.0
_UNREAD = ("script", "style")
NEW = ["host", "declared", "text_lang", "lang", "posterior"]


# -- text ------------------------------------------------------------------------

def visible(html: str) -> str:
    """Text outside tags, scripts, styles and comments, in one pass.

    A tag opens where a letter, "/", "!" or "?" follows its "<"; any other "<" is text,
    and so is a tag that never closes.  An open comment, script or style goes on to
    the end.
    """
    low, out, at, seek = html.lower() if html.isascii() else _lower(html), [], 0, 0
    while True:
        start = html.find("<", max(at, seek))
        if start < 0:
            out.append(html[at:])
            return " ".join(out)
        follows = html[start + 1:start + 2]
        if not (follows.isascii() and follows.isalpha() or follows and follows in "/!?"):
            seek = start + 1
            continue
        name = next((n for n in _UNREAD if low.startswith(n, start + 1)), None)
        if html.startswith("<!--", start):
            end, skip = html.find("-->", start + 4), 3
        else:
            end, skip = (low.find(f"</{name}", start) if name else html.find(">", start)), 1
            if name and end >= 0:
                end = html.find(">", end)
            if not name and end < 0:  # nothing closes any more
                out.append(html[at:])
                return " ".join(out)
        out.append(html[at:start])
        if end < 0:
            return " ".join(out)
        at = end + skip


def _lower(text: str) -> str:
    """Lower case that keeps positions."""
    return "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def trigrams(text: str) -> np.ndarray:
    """Bucket of every trigram of letters and single blanks."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    points = np.frombuffer(f" {' '.join(letters.split())} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.empty(0, np.int64)
    h = (points[:-2] * np.uint64(1_000_003) + points[1:-1]) * np.uint64(1_000_003) + points[2:]
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - 15)).astype(np.int64)


def trigram_counts(labelled: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over all texts (``text, lang``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if lang not in counts:
                    if len(counts) >= 256:  # a task holds so many languages at a time
                        yield from sums(counts)
                        counts.clear()
                    counts[lang] = np.zeros(BUCKETS, np.int64)
                counts[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        yield from sums(counts)

    def sums(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            used = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(c[used])], ["lang", "bucket", "n"])

    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, max_languages: int = 100) -> tuple[list[str], np.ndarray]:
    """Languages, and log-probabilities of the buckets in each; more languages than the bound are refused."""
    counts = Scratch(labelled.sparkSession, "langid").keep(trigram_counts(labelled))
    langs = [r["lang"] for r in counts.select("lang").distinct().orderBy("lang").limit(max_languages + 1).collect()]
    if len(langs) > max_languages:
        raise ValueError(f"texts have more than {max_languages} languages: raise max_languages")
    table = np.ones((len(langs), BUCKETS))
    for r in counts.toLocalIterator():  # max_languages x BUCKETS rows at most
        table[langs.index(r["lang"]), r["bucket"]] += r["n"]
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


# -- evidence of a page --------------------------------------------------------------

def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"^(?:www\d*|m)\.", "")


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def declared_in(html: Column) -> Column:
    """Primary language of the html element; '' if there is none."""
    return F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))


def evidence(pages: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """``_doc, host, declared, likelihood`` (one number per language) of every page."""
    rows = packed(pages, html=F.coalesce("html", F.lit("")), host=host_of(F.col("url")))
    rows = rows.select("_doc", "html", "host", F.coalesce(declared_in(F.col("html")), F.lit("")).alias("declared"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for html in batch.column("html").to_pylist():
            found = trigrams(visible(html))
            mean = model[:, found].mean(axis=1) if len(found) else np.zeros(len(langs))
            out.append((mean * min(len(found), WEIGHT)).tolist())
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("_doc", "host", "declared")], pa.array(out, pa.list_(pa.float64()))],
            ["_doc", "host", "declared", "likelihood"])

    fields = [f for f in rows.schema if f.name != "html"]
    return per_batch(rows, run, T.StructType([*fields, T.StructField("likelihood", T.ArrayType(T.DoubleType()))]), 500)


# -- fusion ----------------------------------------------------------------------------

def _best(scores: Column) -> Column:
    """Position (from 0) of the largest; null where all are equal."""
    return F.when(F.array_max(scores) > F.array_min(scores), F.array_position(scores, F.array_max(scores)).cast("int") - 1)


def _votes(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """Pages per language as an array, grouped by ``keys``."""
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.when(F.col("vote") == i, 1.0).otherwise(0.0)) for i in range(n)]).alias("votes"))


def _smoothed(votes: Column, above: Column) -> Column:
    total = F.aggregate(votes, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(votes, above, lambda v, p: (v + SMOOTH * p) / (total + SMOOTH))


def _merged(table: DataFrame, n: int, *keys: str) -> DataFrame:
    return table.groupBy(*keys).agg(F.array(*[F.sum(F.get("votes", F.lit(i))) for i in range(n)]).alias("votes"))


def priors(pages: DataFrame, n: int) -> DataFrame:
    """``host, votes, above``: a host's votes and the distribution its domain passes on."""
    hosts = _votes(pages, n, "host").withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = _merged(hosts, n, "domain", "suffix").withColumnRenamed("votes", "d")
    suffixes = _merged(domains.withColumnRenamed("d", "votes"), n, "suffix").withColumnRenamed("votes", "s")
    every = _merged(suffixes.withColumnRenamed("s", "votes"), n).select(F.transform("votes", lambda v: v + 1.0).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    top = every.select(F.transform("v", lambda v: v / total)).scalar()
    suffixes = suffixes.withColumn("top", top).select("suffix", _smoothed(F.col("s"), F.col("top")).alias("sp"))
    domains = domains.join(suffixes, "suffix").select("domain", _smoothed(F.col("d"), F.col("sp")).alias("above"))
    return hosts.join(domains, "domain").select(F.col("host").alias("_host"), "votes", "above")


def identify(pages: DataFrame, labelled: DataFrame, max_languages: int = 100) -> DataFrame:
    """``pages`` (``url, html``) with ``host, declared, text_lang, lang, posterior``."""
    scratch = Scratch(pages.sparkSession, "pages")
    langs, model = train(labelled, max_languages)
    n = len(langs)
    names = F.array(*map(F.lit, langs)) if n else F.array().cast("array<string>")
    if not n:
        rows = packed(pages, host=host_of(F.col("url")), declared=F.coalesce(declared_in(F.col("html")), F.lit("")))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("text_lang", "string"), ("lang", "string"), ("posterior", "double"))]
        return rows.select(*beside(rows, NEW), "host", "declared", *none)
    seen = scratch.keep(evidence(pages, langs, model).withColumn("vote", _best(F.col("likelihood"))))

    # P(declared | language) for each declared value, from votes of the text alone
    declared = _votes(seen, n, "declared")
    size = _merged(declared, n).select("votes").scalar()
    values = declared.agg(F.count(F.lit(1)).cast("double")).scalar()
    declared = declared.withColumns({"size": size, "values": values}).select(
        F.col("declared").alias("_declared"), F.zip_with("votes", "size", lambda v, t: F.log(
            (v + DECLARED_SMOOTH) / (t + DECLARED_SMOOTH * F.col("values")))).alias("said"))

    rows = seen.join(priors(seen, n), F.col("host") == F.col("_host")).join(declared, F.col("declared") == F.col("_declared"))
    others = F.transform("votes", lambda v, i: v - F.when(i == F.col("vote"), 1.0).otherwise(0.0))
    prior = _smoothed(others, F.col("above"))
    fused = F.zip_with(F.zip_with(F.transform(prior, lambda p: F.log(p)), "likelihood", lambda a, b: a + b), "said", lambda a, b: a + b)
    rows = rows.withColumn("fused", fused).withColumn("best", F.array_max("fused"))
    norm = F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    name = lambda at: F.get(names, at)
    return rows.select(*beside(rows, NEW), "host", "declared", name(F.col("vote")).alias("text_lang"),
                       name(F.array_position("fused", F.col("best")).cast("int") - 1).alias("lang"), (1 / norm).alias("posterior"))
