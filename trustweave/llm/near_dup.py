"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document is the set of its distinct five-word shingles.  Documents with equal
sets are one class, found by a 128-bit hash of the whole set, and only classes
are searched.  A class has ``TREES`` signatures of ``DEPTH`` min-hashes; a tree
of the forest is one sorted order of these signatures.

Candidates are found in three rounds, each on what the rounds before have not yet
joined, and confirmed on full sets:

- the hub of all classes of a region, that is with the same first 3 min-hashes: the
  smallest one of those that have the region's most frequent signature, which is
  the least edited copy of a group rather than any of them;
- neighbours in sorted order, a neighbour further away only with a longer common
  prefix (``REACH``), so the depth follows the density of the region;
- in regions of up to ``DENSE`` classes all pairs, if their whole signatures agree to
  within ``MARGIN``, over three standard deviations, of the similarity asked for.
  Two sets of similarity s share 3 min-hashes in some of 16 trees with probability
  1 - (1 - s^3)^16, which is 0.99998 for s = 0.8 and higher above;
- for the classes of denser regions, those that share one of their rarest shingles.
  Of a set of n shingles, a set of similarity s with at least as many has
  2s/(1+s) n, and one with at most as many s n; so the smaller one holds a common
  shingle among its n - 2s/(1+s) n + 1 rarest, and the larger one among its
  n - s n + 1 rarest.  This misses nothing, and edited copies of one text that are
  not near each other do not meet, since what is rarest in them are their own edits.

The first two rounds only save work in the last two.  No task gets a whole region:
smallest members are pre-aggregated, sorted orders are cut by range, and what
shares a rare shingle is paired by blocks of ``BLOCK``.  The work grows with the square
only of the unlinked classes that share even one of their rarest shingles.

Defined results: null and empty texts have no shingles and are linked with
nothing; a text shorter than five words is one shingle; rows without ``doc_id``
are linked with nothing and stay; rows that share a ``doc_id`` are one
document; very long texts are used whole; an empty table gives an empty one;
other columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustweave.llm.components import components
from trustweave.llm.shared import Scratch, per_batch, quoted
from trustweave.llm.shingles import WordHashes, shingle_set

TREES, DEPTH = 16, 8
SHALLOW = 3
#: Common min-hashes, and how far apart in sorted order two classes with them may be.
REACH = {3: 2, 4: 4, 5: 6, 6: 8, 7: 12, 8: 16}
MARGIN, NEAR = 0.12, 0.04
DENSE = 24
BLOCK = 1024
_SEED = 20_240_229


def _multipliers() -> np.ndarray:
    draw = np.random.default_rng(_SEED).integers(1, 2**63, TREES * DEPTH, dtype=np.int64)
    return draw.astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        low = np.minimum(low, (factors[:, None] * shingles[None, at:at + 1024]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_hash, signature`` of every row; no shuffle."""
    factors = _multipliers()
    hashes = WordHashes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, keys, signs = [], [], []
        for text in batch.column("text").to_pylist():
            s = shingle_set(text, hashes)
            n.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()))
            signs.append(_signature(s, factors) if len(s) else None)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.list_(pa.int32()))],
            ["doc_id", "n_shingles", "set_hash", "signature"])

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), run,
                     "doc_id long, n_shingles long, set_hash binary, signature array<int>")


def _trees(classes: DataFrame) -> DataFrame:
    """One row per class and tree: ``tree, sign, rep, n``."""
    sign = lambda t: F.struct(t.alias("tree"), F.slice("signature", t * DEPTH + 1, F.lit(DEPTH)).alias("sign"))
    return classes.select("rep", "n", F.inline(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), sign)))


def _prefix(depth: int) -> Column:
    return F.xxhash64("tree", F.slice("sign", F.lit(1), F.lit(depth)))


def _alike(a: Column, b: Column, percent: int) -> Column:
    """Whether set sizes allow the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _hub_pairs(rows: DataFrame, percent: int) -> DataFrame:
    alike = rows.groupBy("tree", "sign").agg(F.min(F.struct("rep", "n")).alias("low"), F.count(F.lit(1)).alias("c"))
    rank = F.struct(F.col("c"), (-F.col("low.rep")).alias("r"))
    hub = alike.groupBy(_prefix(SHALLOW).alias("key")).agg(F.max_by("low", rank).alias("hub"))
    found = rows.withColumn("key", _prefix(SHALLOW)).join(hub, "key")
    found = found.where((F.col("rep") != F.col("hub.rep")) & _alike(F.col("n"), F.col("hub.n"), percent))
    return found.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct()


def _neighbours(part: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of a sorted slice of one or more trees."""
    if part.num_rows < 2:
        return
    tree, rep, n, comp = [part.column(c).to_numpy() for c in ("tree", "rep", "n", "comp")]
    sign = part.column("sign").combine_chunks().flatten().to_numpy().reshape(-1, DEPTH)
    whole = part.column("signature").combine_chunks().flatten().to_numpy().reshape(-1, TREES * DEPTH)
    agree = (percent / 100 - NEAR) * TREES * DEPTH
    need = SHALLOW
    for step in range(1, min(len(rep), REACH[DEPTH] + 1)):
        while step > REACH[need]:
            need += 1
        same = (tree[step:] == tree[:-step]) & (sign[step:, :need] == sign[:-step, :need]).all(axis=1)
        if not same.any():
            return  # sorted order: rows further apart share no more
        a, b = n[:-step], n[step:]
        same &= (comp[step:] != comp[:-step]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
        at = np.flatnonzero(same)
        at = at[(whole[at] == whole[at + step]).sum(axis=1) >= agree]
        if len(at):
            x, y = rep[at], rep[at + step]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def _neighbour_pairs(rows: DataFrame, percent: int, parts: int) -> DataFrame:
    """Neighbours in every sorted order; tasks hold a slice of bounded size at a time."""
    overlap = REACH[DEPTH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= 32 * overlap:
                part = pa.Table.from_batches(held)
                yield from _neighbours(part, percent)
                held = part.slice(part.num_rows - overlap).to_batches()  # seen again beside what follows
                count = overlap
        if held:
            yield from _neighbours(pa.Table.from_batches(held), percent)

    ordered = rows.repartitionByRange(parts, "tree", "sign", "rep").sortWithinPartitions("tree", "sign", "rep")
    return ordered.select("tree", "sign", "rep", "n", "comp", "signature").mapInArrow(run, "a long, b long").distinct()


def _unit_pairs(part: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the same unit that may be similar: each with each in a block, or one block with another."""
    unit, block, n, comp = [part.column(c).to_numpy() for c in ("unit", "block", "n", "comp")]
    across = part.column("across").to_numpy()
    end = np.searchsorted(unit, unit, side="right")  # sorted by unit
    live, step = np.arange(len(unit)), 0
    while True:
        step += 1
        live = live[live + step < end[live]]
        if not len(live):
            return
        a, b = n[live], n[live + step]
        at = live[(comp[live] != comp[live + step]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
                  & (~across[live] | (block[live] != block[live + step]))]
        yield at, at + step


def _block_pairs(part: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of whole units whose signatures agree."""
    whole = part.column("signature").combine_chunks().flatten().to_numpy().reshape(-1, TREES * DEPTH)
    agree = (percent / 100 - MARGIN) * TREES * DEPTH
    for a, b in _unit_pairs(part, percent):
        near = (whole[a] == whole[b]).sum(axis=1) >= agree
        yield _pairs(part, a[near], b[near])


def _rare_pairs(part: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of whole units: the smaller set has the shingle among its very rarest.

    If this is the rarest shingle two sets have in common, all they have in common is
    what each has from there on; where that is too little, they are not similar
    or meet at a rarer one.
    """
    n, rest, indexed = [part.column(c).to_numpy() for c in ("n", "rest", "indexed")]
    for a, b in _unit_pairs(part, percent):
        meet = ((n[a] <= n[b]) & indexed[a]) | ((n[b] <= n[a]) & indexed[b])
        meet &= (100 + percent) * np.minimum(rest[a], rest[b]) >= percent * (n[a] + n[b])
        yield _pairs(part, a[meet], b[meet])


def _pairs(part: pa.Table, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    rep = part.column("rep").to_numpy()
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[a], rep[b])), pa.array(np.maximum(rep[a], rep[b]))], ["a", "b"])


def _paired(rows: DataFrame, pairs, percent: int) -> DataFrame:
    """Classes with the same ``key`` by ``pairs``; ``rows`` has ``key, rep, n, comp`` and what ``pairs`` needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= 8 * BLOCK:
                part = pa.Table.from_batches(held)
                unit = part.column("unit").to_numpy()
                done = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on
                yield from pairs(part.slice(0, done), percent)
                held = part.slice(done).to_batches()
                count = part.num_rows - done
        if held:
            yield from pairs(pa.Table.from_batches(held), percent)

    blocks = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = rows.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    units = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("unit"),
        (F.col("block") != F.col("other")).alias("across"), "block", *[c for c in rows.columns if c != "key"])
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long").distinct()


def _rarest(sets: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """``key`` (a shingle), ``rep, n, rest, comp, indexed`` for the rarest shingles of every set of ``sets`` (``rep, shingles``).

    ``rest`` is how many shingles, this one included, are no rarer.  Shingles that
    no other set has come first and lead nowhere.
    """
    own = sets.select("rep", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    shared = own.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    ranked = own.join(shared, "key").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("ranked"))
    least = lambda over, under: F.ceil(F.col("n") * over / under)
    lone = F.col("n") - F.size("ranked")
    larger = F.col("n") - least(percent, 100) + 1 - lone
    smaller = F.col("n") - least(2 * percent, 100 + percent) + 1 - lone
    rows = ranked.select("rep", "n", smaller.alias("smaller"), lone.alias("lone"), F.posexplode(F.slice("ranked", F.lit(1), F.greatest(larger, F.lit(0)).cast("int"))).alias("at", "shingle"))
    rows = rows.select(F.col("shingle.key").alias("key"), "rep", F.col("n").cast("long").alias("n"),
                       (F.col("n") - F.col("lone") - F.col("at")).cast("long").alias("rest"), (F.col("at") < F.col("smaller")).alias("indexed"))
    named = rows.join(known.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    useful = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("indexed").alias("any")).where("any AND low <> high")
    return named.join(useful.select("key"), "key", "left_semi")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    left = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("s")), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("t")), "b")
    common = both.select("a", "b", F.size(F.array_intersect("s", "t")).cast("long").alias("i"), (F.size("s") + F.size("t")).cast("long").alias("u"))
    return common.where(100 * F.col("i") >= percent * (F.col("u") - F.col("i"))).select("a", "b")


def _open(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with ``comp`` and ``key``, where classes with one ``key`` are not all in one component."""
    named = rows.join(known.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    keyed = named.withColumn("key", _prefix(SHALLOW))
    mixed = keyed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    return keyed.join(mixed, "key", "left_semi")


def _stars(known: DataFrame) -> DataFrame:
    """Links that stand for all links inside the components known."""
    return known.select(F.col("node").alias("a"), F.col("component").alias("b"))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``.

    Linked are documents whose intersection is at least ``percent`` hundredths
    of their union.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    prints = scratch.keep(fingerprints(docs))
    classes = scratch.keep(
        prints.where("n_shingles > 0").groupBy("set_hash")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
        .where("rep IS NOT NULL"))
    trees = _trees(classes).withColumn("key", _prefix(SHALLOW))
    crowded = trees.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    rows = scratch.keep(trees.join(crowded, "key", "left_semi").drop("key"))
    wanted = rows.select(F.col("rep").alias("doc_id")).distinct()
    hashes = WordHashes()

    def whole_sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(t, hashes).view(np.int64) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], ["rep", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    sets = scratch.keep(per_batch(texts, whole_sets, "rep long, shingles array<long>", 500))

    first = scratch.keep(_confirmed(_hub_pairs(rows, percent), sets, percent))
    known = components(first, scratch)
    open_rows = scratch.keep(_open(rows, known).select("tree", "sign", "rep", "n", "comp").join(classes.select("rep", "signature"), "rep"))
    second = _confirmed(_neighbour_pairs(open_rows, percent, parts), sets, percent)
    known = components(_stars(known).union(second), scratch)
    left = scratch.keep(_open(rows, known).select("key", "rep", "n", "comp"))
    crowd = left.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    dense = crowd.where(F.col("c") > DENSE).select("key")
    sparse = left.join(dense, "key", "left_anti").join(classes.select("rep", "signature"), "rep")
    third = _confirmed(_paired(sparse, _block_pairs, percent), sets, percent)
    crowded = sets.join(left.join(dense, "key", "left_semi").select("rep").distinct(), "rep", "left_semi")
    rare = scratch.keep(_rarest(crowded, known, percent))
    fourth = _confirmed(_paired(rare, _rare_pairs, percent), sets, percent)
    final = components(_stars(known).union(third).union(fourth), scratch)
    # what remains of the tables has no signatures
    prints, classes, old = scratch.keep(prints.drop("signature")), scratch.keep(classes.drop("signature")), (prints, classes)
    scratch.free(*old, rows, sets, first, open_rows, left, rare)

    reps = classes.select("set_hash", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    own = reps.select("set_hash", F.coalesce("component", "rep").alias("component_id"))
    out = prints.select("doc_id", "n_shingles", "set_hash").join(own, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the smallest ``doc_id``."""
    gone = near_duplicates(docs, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))
