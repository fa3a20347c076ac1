"""Near-duplicate vectors by Euclidean p-stable hashing.

Vectors are brought to length one; a hash is the cell of a random projection,
``floor((a·v + b) / WIDTH)`` with normal ``a``.  A table takes several hashes together
as a bucket key.  The number of hashes per table grows with the logarithm of the
number of different vectors, so that unrelated vectors rarely meet, and the number
of tables follows from it: vectors at the similarity asked for share no bucket with a
probability of at most ``MISS``.  What shares a bucket and a label is compared by
exact cosine.

Equal vectors with equal labels are one class, and only classes are hashed.  A
bucket's classes are dealt to blocks of about ``BLOCK``; a task compares one block
with itself or with another, so no task holds a large bucket.  It counts links
where two classes meet for the first time (they share no bucket of an earlier
table), adds them up per class, and passes on which classes are connected as one
row per class, so a dense group of n vectors is no table of n² pairs.  Comparing
them remains quadratic inside a bucket: links have to be counted.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and rows without label, link with nothing, nor do vectors of different
length with each other; of several rows with one ``vec_id`` the one that sorts
first by label and vector counts, usable ones before others; rows without
``vec_id`` stay, link with nothing and have no ``component_id``; an empty table gives an empty
one; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustweave.llm.components import components
from trustweave.llm.hnsw import usable
from trustweave.llm.shared import Scratch

WIDTH = 2.0
MISS = 1e-4
#: Unrelated vectors are taken to be at least this far apart (1.41 is a right angle).
APART = 1.2
BLOCK = 1024
#: A unit of up to so many rows is compared row by row, all such units at once.
SMALL = 32
_SEED = 13
CLASS = "rep long, weight long, label string, dim int, embedding array<double>"


def _meet(distance: float) -> float:
    """Probability that two vectors share the cell of one projection."""
    c = WIDTH / distance
    below = 0.5 * math.erfc(c / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def sizes(classes: int, cosine: float) -> tuple[int, int]:
    """Hashes per table and tables for so many classes."""
    hashes = max(8, math.ceil(math.log(max(2, classes)) / -math.log(_meet(APART))))
    found = _meet(math.sqrt(max(2 - 2 * cosine, 1e-6))) ** hashes
    return hashes, max(1, math.ceil(math.log(MISS) / math.log1p(-found)))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; powers of two first, so that no square overflows."""
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _rows(column: pa.ListArray, dim: int) -> np.ndarray:
    start = column.offsets.to_numpy()
    return column.values.to_numpy()[start[0]:start[-1]].reshape(-1, dim)


def prepared(table: DataFrame) -> DataFrame:
    """``vec_id, label, embedding, class`` once per id; ``class`` is null where nothing can be linked."""
    good = usable(F.col("embedding")) & F.col("label").isNotNull()
    row = F.struct((~good).alias("odd"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    first = table.where("vec_id IS NOT NULL").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(row).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = batch.column("embedding").offsets.to_numpy()
            values = batch.column("embedding").values.to_numpy(zero_copy_only=False) + 0.0  # -0.0 is 0.0
            keys = [xxhash.xxh3_128_digest(values[x:y].tobytes() + (label or "").encode()) if not odd else None
                    for x, y, label, odd in zip(start, start[1:], batch.column("label").to_pylist(), batch.column("odd").to_pylist())]
            columns = [batch.column(c) for c in ("vec_id", "label", "embedding")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.binary())], ["vec_id", "label", "embedding", "class"])

    kept = F.when(~F.col("row.odd"), F.col("row.embedding")).otherwise(F.array().cast("array<double>"))
    return first.select("vec_id", "row.label", kept.alias("embedding"), "row.odd").mapInArrow(
        run, "vec_id long, label string, embedding array<double>, class binary")


def hashed(classes: DataFrame, hashes: int, tables: int) -> DataFrame:
    """``classes`` with ``keys``: a bucket key per table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        factors = np.random.default_rng(_SEED).integers(1, 2**63, hashes, dtype=np.int64) | 1
        for batch in batches:
            dims, column = batch.column("dim").to_numpy(), batch.column("embedding")
            keys = np.zeros((batch.num_rows, tables), np.int64)
            for dim in np.unique(dims).tolist():
                if dim not in planes:
                    draw = np.random.default_rng([_SEED, dim])
                    planes[dim] = draw.normal(size=(dim, tables * hashes)), draw.uniform(0, WIDTH, tables * hashes)
                at = np.flatnonzero(dims == dim)
                towards, shift = planes[dim]
                cells = np.floor((_unit(_rows(column.take(pa.array(at)), dim)) @ towards + shift) / WIDTH).astype(np.int64)
                with np.errstate(over="ignore"):
                    mixed = (cells.reshape(len(at), tables, hashes) + 1_000_003) * factors
                    mixed = (mixed ^ (mixed >> 29)) * factors[::-1]
                    keys[at] = mixed.sum(axis=2)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * tables, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], [*batch.schema.names, "keys"])

    return classes.mapInArrow(run, CLASS + ", keys array<long>")


def dealt(prints: DataFrame) -> DataFrame:
    """``unit, part, across, at, rep`` of classes that share a bucket (of table ``at``) with another one.

    A bucket of b blocks makes a unit of each two, and of each with itself.
    """
    bucket = ["label", "dim", "at", "key"]
    keyed = prints.select("rep", "label", "dim", F.posexplode("keys").alias("at", "key"))
    crowded = keyed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    rows = keyed.join(crowded, bucket).withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.struct(*bucket, F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))
    return rows.select(unit.alias("unit"), "part", (F.col("part") != F.col("other")).alias("across"), "at", "rep")


def _near(x: np.ndarray, unit: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (unit vectors) of one unit with that cosine or more."""
    end = np.searchsorted(unit, unit, side="right")
    begin = np.searchsorted(unit, unit)
    small = end - begin <= SMALL
    live, step = np.flatnonzero(small), 0
    while len(live):
        step += 1
        live = live[live + step < end[live]]
        for at in range(0, len(live), 1 << 16):
            a = live[at:at + (1 << 16)]
            good = np.einsum("ij,ij->i", x[a], x[a + step]) >= cosine
            yield a[good], a[good] + step
    for first in np.unique(begin[~small]):
        last = end[first]
        for at in range(first, last, 128):
            a, b = np.nonzero(x[at:min(at + 128, last)] @ x[at:last].T >= cosine)
            later = b > a
            yield a[later] + at, b[later] + at


def _lowest(rows: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row each row is connected with."""
    low = np.arange(rows)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _compared(part: pa.Table, cosine: float) -> pa.RecordBatch:
    """Of whole units: ``rep, to, n`` of every class with links; ``to`` is a class it is connected with."""
    number, at, block, rep, weight = [part.column(c).to_numpy() for c in ("number", "at", "part", "rep", "weight")]
    across, tables = part.column("across").to_numpy(), len(part.column("keys")[0])
    keys = _rows(part.column("keys").combine_chunks(), tables)
    x = _unit(_rows(part.column("embedding").combine_chunks(), len(part.column("embedding")[0])))
    n, froms, tos = np.zeros(len(rep), np.int64), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, b in _near(x, number, cosine):
        if across.any():
            other = ~across[a] | (block[a] != block[b])
            a, b = a[other], b[other]
        froms.append(a)
        tos.append(b)
        met = np.zeros(len(a), bool)
        for t in range(int(at.max())):
            met |= (keys[a, t] == keys[b, t]) & (t < at[a])
        np.add.at(n, a[~met], weight[b[~met]])
        np.add.at(n, b[~met], weight[a[~met]])
    a, b = np.concatenate(froms), np.concatenate(tos)
    low = _lowest(len(rep), a, b)
    linked = np.unique(np.r_[a, b])
    return pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[low[linked]]), pa.array(n[linked])], ["rep", "to", "n"])


def links(prints: DataFrame, cosine: float) -> DataFrame:
    """``rep, to, n``: connections between classes, and links counted, by unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
            dims = table.column("dim").to_numpy()
            for dim in np.unique(dims):  # a unit has one length
                rows = table.filter(pa.array(dims == dim))
                yield _compared(rows, cosine)

        for batch in batches:
            unit = batch.column("unit")
            held.append(batch)
            count += batch.num_rows
            if count >= 4 * BLOCK:
                table = _numbered(pa.Table.from_batches(held))
                number = table.column("number").to_numpy()
                done = int(np.searchsorted(number, number[-1]))  # the last unit may go on
                if done:
                    yield from whole(table.slice(0, done))
                held, count = table.slice(done).drop_columns(["number"]).to_batches(), table.num_rows - done
        if held:
            yield from whole(_numbered(pa.Table.from_batches(held)))

    vectors = prints.select("rep", "weight", "embedding", "keys")
    units = dealt(prints).join(vectors, "rep")
    dim = F.col("unit.dim").alias("dim")
    key = [F.col("unit")[c] for c in ("label", "dim", "at", "key", "x", "y")]
    rows = units.repartition(*key).sortWithinPartitions(*key)
    return rows.select("unit", dim, "part", "across", "at", "rep", "weight", "embedding", "keys").mapInArrow(run, "rep long, to long, n long")


def _numbered(table: pa.Table) -> pa.Table:
    """Rows sorted by unit, with the unit's number."""
    unit = table.column("unit").combine_chunks()
    fields = [f.dictionary_encode().indices.to_numpy() if pa.types.is_string(f.type) else f.to_numpy() for f in unit.flatten()]
    new = np.zeros(table.num_rows, bool)
    for f in fields:
        new[1:] |= f[1:] != f[:-1]
    return table.append_column("number", pa.array(np.cumsum(new)))


def near_vectors(table: DataFrame, cosine: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of ``vec_id, embedding, label``.

    Linked are vectors with equal labels and at least this cosine.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "near-vectors")
    rows = scratch.keep(prepared(table))
    grouped = rows.where("class IS NOT NULL").groupBy("class").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = scratch.keep(grouped.select("class", "rep", "weight", "label", F.size("embedding").alias("dim"), "embedding"))
    prints = scratch.keep(hashed(classes.drop("class"), *sizes(classes.count(), cosine)))
    found = scratch.keep(links(prints, cosine))
    joined = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")), scratch)
    counted = found.groupBy("rep").agg(F.sum("n").alias("n"))
    own = classes.select("class", "rep", "weight").join(counted, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    own = own.select("class", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", "class").join(own, "class", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    without = table.where("vec_id IS NULL").select(F.lit(None).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(without).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
