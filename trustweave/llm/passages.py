"""Near-duplicate passages across documents, by compact windows.

A text is the sequence of its five-word shingles.  For each of ``HASHES`` hash
functions, the Cartesian tree over the hashed sequence gives every position c a
compact window [l, r]: all passages that lie in it and contain c have their
min-hash at c.  A node's range reaches to the nearest smaller values on both
sides; only ranges of at least ``SPAN`` shingles (50 words) are kept, about two in
``SPAN`` positions.

Windows with equal min-hashes meet by sorting: the smallest (document, position)
of a value represents it and every other window is paired with that one, so a
passage in thousands of documents costs thousands of pairs, not their square.
Sorted slices are cut by range, so a very common value is no task's burden; the
representatives of a value in neighbouring slices are paired afterwards.

Pairs of documents whose windows agree in ``AGREE`` hash functions or more on
overlapping intervals are verified on the whole texts: the segments of ``SPAN``
shingles or more in which at least four of five recur, of similarity 0.8 to their
source; where a segment as a whole is not, the longest passage between two runs of
the source that is.  Windows that remain unexplained are paired once more within their
value and a shingle 20 positions to the right, or left, of them, since a common
shingle can have several sources.

What is still unexplained then is searched exactly: every stretch of 50 words
whose min-hash under the first function is that of such a window gets a hash of its
own, and meets the first document that has the same stretch.  A stretch has the same
min-hash wherever it recurs, so no passage that recurs word for word is lost if other
documents have parts of it, unless the first two rounds found passages that overlap
it; a changed one can be, if parts of it hide it in both rounds.  A group of n equal stretches is n pairs here, too.

Defined results: null, empty and short texts have no passages; texts of any
length are searched whole; rows without ``doc_id`` take no part; rows that share
a ``doc_id`` are one document, and repeats inside one document do not count; an
empty table gives an empty one; other columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustweave.llm.shared import Scratch, packed, per_batch, restored
from trustweave.llm.shingles import WIDTH, WordHashes, mixed, windows

MIN_WORDS = 50
SPAN = MIN_WORDS - WIDTH + 1
HASHES, AGREE = 5, 2
ASIDE = 20
SIMILAR = 0.8
#: A shingle that recurs counts 1, one that doesn't counts -4: a positive segment has four of five.
MISS = 4
_FACTORS = [np.uint64(2 * x + 1) for x in np.random.default_rng(77).integers(1, 2**62, HASHES)]

WINDOW = "value long, hash int, doc long, c int, l int, r int, right int, left int, many boolean"
_NAMES = [f.split()[0] for f in WINDOW.split(", ")]
#: A window as it is shuffled: ``place`` holds c, hash and many, ``reach`` how far l and r are from c, ``sides`` right and left.
DENSE = "value long, doc long, place long, reach long, sides long"
_DENSE = [f.split()[0] for f in DENSE.split(", ")]
_SIDE = "doc c l r".split()
PASSAGE = "doc_id long, start int, end int, source_doc_id long, source_start int, source_end int, similarity double"


# -- compact windows -----------------------------------------------------------

def compact_windows(v: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``c, l, r`` of the Cartesian tree's nodes over ``v`` whose range has ``span`` values or more.

    Zeros separate texts.  Of equal values the left one is the higher node.
    """
    n = len(v)
    none = np.empty(0, np.int64)
    if n < span:
        return none, none, none
    longest = int(np.diff(np.r_[-1, np.flatnonzero(v == 0), n]).max()) - 1
    if longest < span:
        return none, none, none
    least = [v]  # least[k][i]: minimum of the 2^k values from i on; no range is longer than a text
    while 2 ** len(least) <= longest:
        low, step = least[-1], 2 ** (len(least) - 1)
        least.append(np.minimum(low[:-step], low[step:]))
    k = span.bit_length() - 1
    inside = np.minimum(least[k][:n - span + 1], least[k][span - 2**k:span - 2**k + n - span + 1])
    # a node has such a range if and only if it is the minimum of some stretch of that length
    padded = np.zeros(n + span - 1, v.dtype)
    padded[span - 1:span - 1 + len(inside)] = inside
    highest, step = padded, 1
    while step * 2 <= span:
        highest = np.maximum(highest[:-step], highest[step:])
        step *= 2
    highest = np.maximum(highest[:n], highest[span - step:span - step + n])
    c = np.flatnonzero((v == highest) & (v > 0))
    own, l, r = v[c], c.copy(), c + 1
    for k in range(len(least) - 1, -1, -1):
        step, low = 2**k, least[k]
        fits = l - step >= 0
        go = fits & (low[np.where(fits, l - step, 0)] > own)
        l = np.where(go, l - step, l)
        fits = r + step <= n
        go = fits & (low[np.where(fits, r, 0)] >= own)
        r = np.where(go, r + step, r)
    wide = r - l >= span
    return c[wide], l[wide], r[wide] - 1


def merged_windows(value: np.ndarray, owner: np.ndarray, c: np.ndarray, l: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping windows of one text with one min-hash become one: first ``c``, whole interval, and whether they were many.

    A line that repeats in a text many times gives a window each time.
    """
    order = np.lexsort((c, value, owner))
    c, l, r, value, owner = (x[order] for x in (c, l, r, value, owner))
    if not len(c):
        return c, l, r, c > 0
    same = np.r_[False, (value[1:] == value[:-1]) & (owner[1:] == owner[:-1]) & (l[1:] <= r[:-1] + 1)]
    first = np.flatnonzero(~same)
    return c[first], np.minimum.reduceat(l, first), np.maximum.reduceat(r, first), np.diff(np.r_[first, len(c)]) > 1


def _at(values: np.ndarray, text: np.ndarray, c: np.ndarray, aside: int) -> np.ndarray:
    """Value ``aside`` positions from each ``c`` in the same text, else 0."""
    there = np.clip(c + aside, 0, len(values) - 1)
    return np.where((text[there] == text[c]) & (there == c + aside), values[there], np.uint64(0)).astype(np.uint32).view(np.int32)


def packed_windows(value, doc, function, c, l, r, right: np.ndarray, left: np.ndarray, many) -> pa.RecordBatch:
    """``DENSE`` columns of ``WINDOW`` ones."""
    columns = value, doc, (c << 4) | (function << 1) | many, ((c - l) << 32) | (r - c), (right.astype(np.int64) << 32) | left.view(np.uint32)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], _DENSE)


def all_windows(docs: DataFrame) -> DataFrame:
    """Compact windows of every text under every hash function, as ``DENSE``; no shuffle."""
    hashes = WordHashes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("doc_id").to_numpy()
        shingles, owner, place = [], [], []
        gap = np.zeros(1, np.uint64)
        for i, text in enumerate(batch.column("text").to_pylist()):
            s = windows(hashes.of(text))
            if len(s) >= SPAN:
                shingles += [s | np.uint64(1), gap]
                owner.append(np.full(len(s) + 1, i))
                place.append(np.arange(len(s) + 1))
        found = []
        if shingles:
            s, owner, place = map(np.concatenate, (shingles, owner, place))
            for f, factor in enumerate(_FACTORS):
                v = np.where(s == 0, s, mixed(s * factor) | np.uint64(1))
                c, l, r = compact_windows(v)
                c, l, r, many = merged_windows(v[c], owner[c], c, l, r)
                at = place[c] - c
                found.append(packed_windows(v[c].view(np.int64), ids[owner[c]], f, place[c], l + at, r + at, _at(s, owner, c, ASIDE), _at(s, owner, c, -ASIDE), many))
        return pa.concat_batches(found) if found else pa.RecordBatch.from_pylist([], pa.schema([(n, pa.int64()) for n in _DENSE]))

    given = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return per_batch(given, run, DENSE, 20)  # few texts at a time stay in the processor's cache


# -- pairs with the representative of a value ------------------------------------

PAIRED = WINDOW + ", adoc long, ac int, al int, ar int, edge boolean"


def _spread(dense: pa.RecordBatch) -> pa.RecordBatch:
    """``WINDOW`` columns of ``DENSE`` ones."""
    value, doc, place, reach, sides = [x.to_numpy() for x in dense.columns]
    c, many = place >> 4, (place & 1).astype(bool)
    ints = [(place >> 1) & 7, c, c - (reach >> 32), c + (reach & 0xFFFFFFFF), sides >> 32]
    function, c, l, r, right = [pa.array(x.astype(np.int32)) for x in ints]
    left = pa.array(sides.astype(np.uint32).view(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(value), function, pa.array(doc), c, l, r, right, left, pa.array(many)], _NAMES)


def _paired(table: pa.Table, hub: tuple | None) -> tuple[pa.RecordBatch, tuple]:
    """Rows of a sorted slice beside their value's first row; that row at the slice's end.

    Rows of the first row's document are kept for the first hash function only, and
    not if they are a value's only row, unless they end the slice.
    """
    value, doc, c, l, r = [table.column(x).to_numpy() for x in ("value", "doc", "c", "l", "r")]
    new = np.r_[True, value[1:] != value[:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(len(value)), 0))
    sides = [x[first] for x in (doc, c, l, r)]
    if hub is not None and hub[0] == value[0]:
        goes_on = value == value[0]
        sides = [np.where(goes_on, h, s) for h, s in zip(hub[2:], sides)]
    alone = (sides[0] == doc) & (sides[1] == c) & ~np.r_[value[1:] == value[:-1], True]
    keep = (sides[0] != doc) | ((table.column("hash").to_numpy() == 0) & ~alone)
    out = pa.RecordBatch.from_arrays(
        [table.column(x).combine_chunks().filter(pa.array(keep)) for x in _NAMES]
        + [pa.array(s[keep], t) for s, t in zip(sides, [pa.int64(), *[pa.int32()] * 3])]
        + [pa.array(np.zeros(keep.sum(), bool))], [*_NAMES, "adoc", "ac", "al", "ar", "edge"])
    return out, (value[-1], table.column("hash")[-1].as_py(), *[s[-1] for s in sides])


def _edge(hub: tuple) -> pa.RecordBatch:
    value, function, doc, c, l, r = hub
    row = {"value": value, "hash": function, "doc": doc, "c": c, "l": l, "r": r, "right": 0, "left": 0, "many": True, "adoc": doc, "ac": c, "al": l, "ar": r, "edge": True}
    schema = pa.schema([(n, pa.int64() if n in ("value", "doc", "adoc") else pa.bool_() if n in ("edge", "many") else pa.int32()) for n in row])
    return pa.RecordBatch.from_pylist([row], schema)


def _first_pairs(found: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Every window of a value with several beside the first one: rows of the slices, rows across slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for batch in batches:
            if batch.num_rows:
                batch = _spread(batch)
                out, last = _paired(pa.Table.from_batches([batch]), hub)
                if hub is None:
                    yield _edge(tuple(batch.column(x)[0].as_py() for x in ("value", "hash", *_SIDE)))
                hub = last
                yield out
        if hub is not None:
            yield _edge(tuple(int(x) for x in hub))

    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = found.repartitionByRange(parts, "value", "doc", "place").sortWithinPartitions("value", "doc", "place")
    rows = scratch.keep(ordered.mapInArrow(run, PAIRED))
    # a value's first rows in neighbouring slices: two for each slice at most
    return rows, scratch.keep(_hub_pairs(rows.where("edge").select(*_NAMES).distinct(), ["value"]))


def _hub_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beside the first row with the same keys."""
    hub = rows.groupBy(*keys).agg(F.min(F.struct(*_SIDE)).alias("h"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(hub, keys).where("doc <> h.doc OR c <> h.c").select(*_NAMES, *[F.col("h")[x].alias("a" + x) for x in _SIDE])


# -- verification ------------------------------------------------------------------

def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... values."""
    total = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=total[1:])
    return total


def _stretch(score: np.ndarray, least: int) -> tuple[int, int] | None:
    """``[start, end)`` of the highest sum among stretches of ``least`` positions or more, if it isn't negative."""
    if len(score) < least:
        return None
    total = _sums(score)
    gain = total[least:] - np.minimum.accumulate(total)[:len(total) - least]
    at = int(gain.argmax())
    return (at - int(np.argmin(total[:at + 1][::-1])), at + least) if gain[at] >= 0 else None


def _similarity(x: np.ndarray, y: np.ndarray) -> float:
    x, y = set(x.tolist()), set(y.tolist())
    common = len(x & y)
    return common / (len(x) + len(y) - common)


def _clusters(anchors: list[list[int]] | np.ndarray, agree: int) -> Iterator[tuple[int, int, int, int]]:
    """Intervals of both texts where windows of ``agree`` hash functions overlap."""
    x = np.asarray(anchors)
    x = x[np.lexsort((x[:, 4], x[:, 3]))]
    reach = np.maximum.accumulate(x[:, 4])
    edges = [0, *(np.flatnonzero(x[1:, 3] > reach[:-1]) + 1).tolist(), len(x)]
    for part in map(x.__getitem__, map(slice, edges, edges[1:])):
        if len(set(part[:, 0].tolist())) >= agree:
            yield part[:, 1].min(), part[:, 2].max(), part[:, 3].min(), part[:, 4].max()


def _whole(a: np.ndarray, b: np.ndarray, start: int, end: int, hit: np.ndarray, place: np.ndarray) -> tuple | None:
    """A stretch of ``b`` beside its place in ``a``, if they are similar; ``hit`` and ``place`` belong to the stretch."""
    at = np.flatnonzero(hit)
    if not len(at) or at[-1] + 1 - at[0] < SPAN:
        return None
    shift = place[at] - at
    ranked, half = np.sort(shift), len(shift) // 2
    middle = (ranked[half] + ranked[-half - 1]) / 2
    close = np.abs(shift - middle) <= (end - start) // 2
    spots = place[at][close]
    if not len(spots):
        return None
    start, end = start + int(at[0]), start + int(at[-1]) + 1
    s, e = int(spots.min()), int(spots.max()) + 1
    similarity = _similarity(a[s:e], b[start:end])
    return (start, end, s, e, similarity) if e - s >= SPAN and similarity >= SIMILAR else None


def _by_runs(a: np.ndarray, b: np.ndarray, al: int, ar: int, lo: int, hi: int, hit: np.ndarray, place: np.ndarray) -> tuple | None:
    """Longest passage in ``b[lo:hi]`` that starts and ends with runs of ``a`` and is similar to what they enclose there."""
    there, here = a[al:ar + 1].tolist(), b[lo:hi].tolist()
    first, runs, end = (place - al).tolist(), [], 0
    for p in np.flatnonzero(hit).tolist():
        if p < end:
            continue
        q = first[p]
        start, back, end, on = p, q, p + 1, q + 1
        while end < len(here) and on < len(there) and there[on] == here[end]:
            end, on = end + 1, on + 1
        while start and back and there[back - 1] == here[start - 1]:
            start, back = start - 1, back - 1
        while runs and runs[-1][0] >= start:
            runs.pop()
        if runs:
            runs[-1][1] = min(runs[-1][1], start)
        runs.append([start, end, back - start])
    if not runs:
        return None
    bs, be, shift = np.array(runs).T
    total = _sums(be - bs)
    able = []
    for i in range(len(bs)):
        mine, its = be[i:] - bs[i], be[i:] + shift[i:] - bs[i] - shift[i]
        common = total[i + 1:] - total[i]
        fits = (mine >= SPAN) & (its >= SPAN) & (common >= SIMILAR * (mine + its - common) - 1e-9)
        able += [(int(mine[j]), i, i + int(j)) for j in np.flatnonzero(fits)]
    for _, i, j in sorted(able, reverse=True):
        start, end, s, e = lo + int(bs[i]), lo + int(be[j]), al + int(bs[i] + shift[i]), al + int(be[j] + shift[j])
        similarity = _similarity(a[s:e], b[start:end])
        if similarity >= SIMILAR:
            return start, end, s, e, similarity
    return None


def passages_of(a: np.ndarray, b: np.ndarray, anchors: list[list[int]] | np.ndarray, agree: int) -> Iterator[tuple[int, int, int, int, float]]:
    """``b`` start and end, ``a`` start and end (in words), similarity; from shingle sequences.

    Where the stretch of most hits is not similar to its source as a whole, the
    source has gaps or jumps there, and its runs are looked at one by one.
    """
    for al, ar, bl, br in _clusters(anchors, agree):
        there, here = a[al:ar + 1], b[bl:br + 1]
        order = np.argsort(there, kind="stable")
        spot = np.minimum(np.searchsorted(there[order], here), len(there) - 1)
        hit = there[order][spot] == here
        place = order[spot] + al
        score = np.where(hit, 1, -MISS)
        todo = [(0, len(here))]
        while todo:
            lo, hi = todo.pop()
            best = _stretch(score[lo:hi], SPAN)
            if best is None:
                continue
            start, end = lo + best[0], lo + best[1]
            found = _whole(a, b, bl + start, bl + end, hit[start:end], place[start:end])
            found = found or _by_runs(a, b, al, ar, bl + lo, bl + hi, hit[lo:hi], place[lo:hi])
            if found is None:
                continue
            start, end, s, e, similarity = found
            yield start, end - 1 + WIDTH, s, e - 1 + WIDTH, similarity
            todo += [(lo, start - bl), (end - bl, hi)]


def _verified(pairs: DataFrame, texts: DataFrame, scratch: Scratch, agree: int) -> DataFrame:
    anchor = F.struct("hash", "al", "ar", "l", "r")
    grouped = pairs.where("doc <> adoc").groupBy("adoc", "doc").agg(F.collect_list(anchor).alias("anchors"))
    some = scratch.keep(grouped.where(F.size(F.array_distinct("anchors.hash")) >= agree))
    # written, so that the pairs of a common source can be split in the join
    sources = scratch.keep(texts.join(some.select(F.col("adoc").alias("doc")).distinct(), "doc", "left_semi"))
    # joined with the source last, so that a source's pairs follow each other
    both = some.join(texts.withColumnRenamed("text", "btext"), "doc").join(sources.select(F.col("doc").alias("adoc"), F.col("text").alias("atext")), "adoc")
    hashes = WordHashes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, last = [], (None, None)
        lists = batch.column("anchors")
        flat, ends = np.column_stack([x.to_numpy() for x in lists.flatten().flatten()]), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for i, (adoc, doc, atext, btext) in enumerate(zip(*[batch.column(x).to_pylist() for x in ("adoc", "doc", "atext", "btext")])):
            if last[0] != atext:
                last = (atext, windows(hashes.of(atext)))
            b = windows(hashes.of(btext))
            rows += [(doc, bs, be, adoc, s, e, sim) for bs, be, s, e, sim in passages_of(last[1], b, flat[ends[i]:ends[i + 1]], agree)]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
        names = [f.split()[0] for f in PASSAGE.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [()] * 7, types)], names)

    found = scratch.keep(per_batch(both.select("adoc", "doc", "atext", "btext", "anchors"), run, PASSAGE, 200))
    scratch.free(some, sources)
    return found


# -- whole stretches ---------------------------------------------------------------

def block_hashes(shingles: np.ndarray) -> np.ndarray:
    """Hash of the ``MIN_WORDS`` words from each position on."""
    n = len(shingles) - SPAN + 1
    h = np.zeros(max(n, 0), np.uint64)
    for at in range(0, SPAN, WIDTH):  # shingles side by side cover all words
        h = mixed(h * _FACTORS[0] + shingles[at:at + n])
    return h


def blocks_of(shingles: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the stretches of ``MIN_WORDS`` words whose min-hash, by the first function, is one of ``values``."""
    least, step = mixed((shingles | np.uint64(1)) * _FACTORS[0]) | np.uint64(1), 1
    n = len(shingles) - SPAN + 1
    while step * 2 <= SPAN:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[:n], least[SPAN - step:SPAN - step + n])
    wanted = np.unique(values)
    starts = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, least), len(wanted) - 1)] == least)
    return starts, block_hashes(shingles)[starts]


def _blocks(texts: DataFrame) -> DataFrame:
    """Stretches whose min-hash is one of ``values``; ``fresh`` ones are not inside a ``known`` passage."""
    hashes = WordHashes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, doc, at, fresh = [], [], [], []
        for i, text, values, known in zip(*[batch.column(x).to_pylist() for x in ("doc", "text", "values", "known")]):
            s = windows(hashes.of(text))
            if len(s) < SPAN:
                continue
            start, h = blocks_of(s, np.array(values, np.int64).view(np.uint64))
            new = np.ones(len(start), bool)
            for k in known or []:
                new &= (start < k["start"]) | (start + MIN_WORDS > k["end"])
            for column, x in zip((key, doc, at, fresh), (h.view(np.int64), np.full(len(start), i), start, new)):
                column.append(x)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
        arrays = [pa.array(np.concatenate(x) if x else [], t) for x, t in zip((key, doc, at, fresh), types)]
        return pa.RecordBatch.from_arrays(arrays, ["key", "doc", "c", "fresh"])

    return per_batch(texts.select("doc", "text", "values", "known"), run, "key long, doc long, c int, fresh boolean", 100)


def _block_pairs(held: DataFrame, texts: DataFrame, known: DataFrame, scratch: Scratch) -> DataFrame:
    """Anchors of stretches with a min-hash in ``held`` (``doc, value``): each beside the same stretch of the first document that has it.

    Stretches inside ``known`` passages stand for others, but look for none.
    """
    blocks = scratch.keep(_blocks(texts.join(held.groupBy("doc").agg(F.collect_set("value").alias("values")), "doc").join(known, "doc", "left")))
    ends = blocks.groupBy("key").agg(F.min("doc").alias("first"), F.max(F.when(F.col("fresh"), F.col("doc"))).alias("last"))
    ends = scratch.keep(ends.where("first < last").drop("last"))  # written, so that a hot key's rows can be split in the join
    some = scratch.keep(blocks.join(ends, "key"))
    scratch.free(blocks)
    first = some.where("doc = first").groupBy("key").agg(F.min(F.struct("doc", "c")).alias("h"))
    met = some.where("fresh AND doc <> first").join(first, "key")
    shift = met.groupBy(F.col("h.doc").alias("adoc"), "doc", (F.col("c") - F.col("h.c")).alias("shift")).agg(
        F.min("c").alias("l"), (F.max("c") + F.lit(SPAN - 1)).alias("r"))
    found = scratch.keep(shift.select("adoc", "doc", F.lit(0).alias("hash"), (F.col("l") - F.col("shift")).alias("al"), (F.col("r") - F.col("shift")).alias("ar"), "l", "r"))
    scratch.free(ends, some)
    return found


def _flagged(rows: DataFrame, known: DataFrame, first: Column, last: Column) -> DataFrame:
    """Rows with ``fresh``: whether no passage known of the document holds the words from ``first`` to ``last``."""
    inside = F.exists("known", lambda k: (k["start"] <= first) & (last < k["end"]))
    return rows.join(known, "doc", "left").withColumn("fresh", ~F.coalesce(inside, F.lit(False))).drop("known")


def _known(passages: DataFrame) -> DataFrame:
    return passages.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_set(F.struct("start", "end")).alias("known"))


def _held(members: DataFrame, known: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc, value`` of windows around which a stretch can recur whose words the later document has in no ``known`` passage.

    Such a stretch has the shingle ``ASIDE`` positions to the right of its window's
    position, or the one to the left.  Windows with many positions go by value alone.
    """
    span = [F.when(F.col("many"), F.col(end)).otherwise(F.col("c")) for end in ("l", "r")]
    rows = _flagged(members, known, *span)
    side = lambda rows, name, key: rows.select("value", "doc", "fresh", F.lit(name).alias("side"), key.alias("key"))
    several = rows.join(rows.where("many").select("value").distinct(), "value", "left_semi")
    sides = side(rows, 1, F.col("right")).union(side(rows, 2, F.col("left"))).where("key <> 0").union(side(several, 0, F.lit(0)))
    keys = ["value", "side", "key"]
    ends = sides.groupBy(*keys).agg(F.min("doc").alias("first"), F.max(F.when(F.col("fresh"), F.col("doc"))).alias("last"))
    ends = scratch.keep(ends.where("first < last").select(*keys))
    held = scratch.keep(sides.join(ends, keys, "left_semi").select("doc", "value").distinct())
    scratch.free(ends)
    return held


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per passage of a document that repeats one of a smaller ``doc_id``.

    ``start`` and ``end`` (exclusive) count words.  The smallest document that has
    a passage is the source of the others.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "passages", tidy=True)
    found = scratch.keep(all_windows(docs))
    rows, across = _first_pairs(found, scratch)
    pairs = rows.where("NOT edge").drop("edge").unionByName(across)
    scratch.free(found)
    texts = scratch.keep_by(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), "text"), "doc")
    first = _verified(pairs, texts, scratch, AGREE)
    position = F.col("c"), F.col("c")
    rest = scratch.keep(_flagged(pairs.where("doc <> adoc").select(*_NAMES), _known(first), *position).where("fresh").drop("fresh").distinct())
    members = scratch.keep(pairs.where("hash = 0").select("value", "doc", "c", "l", "r", "right", "left", "many"))
    scratch.free(rows, across)
    again = _hub_pairs(rest.where("right <> 0"), ["value", "right"]).unionByName(_hub_pairs(rest.where("left <> 0"), ["value", "left"]))
    second = _verified(again, texts, scratch, 1)
    scratch.free(rest)
    found = first.unionByName(second)
    known = scratch.keep(_known(found))
    held = _held(members, known, scratch)
    scratch.free(members)
    third = _verified(_block_pairs(held, texts, known, scratch), texts, scratch, 1)
    scratch.free(held, known, texts)
    return found.unionByName(third).distinct()


# -- taking effect --------------------------------------------------------------------

def without_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of all but their first document.

    What is left of a text keeps its own white space; ``n_chars`` follows.  A
    document of which no word is left goes.
    """
    cuts = repeated_passages(docs).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cuts"))
    rows = packed(docs, "text", text=F.col("text"), _id=F.col("doc_id").cast("long"))
    rows = rows.join(cuts.withColumnRenamed("doc_id", "_id"), "_id", "left").select("_doc", "text", "cuts")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [_cut(t, cuts) if t and cuts else t for t, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column("_doc"), pa.array(texts, pa.string()), batch.column("cuts").is_valid()], ["_doc", "text", "was_cut"])

    schema = T.StructType([*rows.schema.fields[:2], T.StructField("was_cut", T.BooleanType())])
    out = per_batch(rows, run, schema).where("NOT was_cut OR text IS NULL OR text <> ''")
    return restored(out, docs, F.col("was_cut"))


def _cut(text: str, cuts: list[dict]) -> str:
    """``text`` without the words in ``cuts``; empty if no word is left."""
    raw = text.encode()
    white = np.isin(np.frombuffer(raw, np.uint8), list(b" \t\n\v\f\r"))
    starts = np.flatnonzero(~white & np.r_[True, white[:-1]]) if len(raw) else np.empty(0, int)
    ends = np.r_[starts[1:], len(raw)]  # with the white space that follows
    keep = np.ones(len(raw), bool)
    for c in cuts:
        keep[starts[c["start"]]:ends[min(c["end"], len(starts)) - 1]] = False
    left = np.frombuffer(raw, np.uint8)[keep].tobytes()
    return left.decode() if left.split() else ""
