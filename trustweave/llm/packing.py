"""Packing token sequences by minimum bin slack.

``pieces`` tokenizes every document, adds an end id and cuts what is longer
than a window; a full window is a sequence of its own.  The rests are shorter
than a window, so all that matters about them is how many there are of each
length: ``plan`` takes those counts (at most ``window - 1`` numbers, whatever the
corpus) and fills window after window.  The longest rest left opens a window;
a subset-sum over the lengths left, with bit sets as the tables of the dynamic
program, finds the fill closest to the window, and backtracking gives the count
of each length.  The same fill is repeated as often as the counts allow, so the
plan has at most a few thousand fills.

``assign`` numbers the rests of each length and looks their places up in the
plan.  Numbers come from per-chunk counts (a chunk is one written part), so a
length that a third of all documents have is not gathered in one task.

Tokens come from ``tiktoken`` with the rank file of the same vocabulary, which
gives the ids of the ``tokenizers`` file several times faster; a text that holds
the end-of-text string, or that it refuses, goes through ``tokenizers`` itself.

Defined results: a null or empty text is the end id alone; very long texts are
cut into full windows; repeated rows are packed each; a null ``doc_id`` stays
null; an empty table gives an empty one; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustweave.llm.shared import Scratch, bounded_batches

WINDOW = 1024
END = 0
END_TEXT = "<|endoftext|>"
#: The vocabulary's split of text into words, without backtracking.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, number long"


def encoder(tokenizer: str) -> Callable[[str], list[int]]:
    """Ids of a text by the ``tokenizers`` file ``tokenizer``; its rank file lies beside it."""
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(tokenizer.removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    whole: list[Tokenizer] = []

    def slow(text: str) -> list[int]:
        whole.extend([] if whole else [Tokenizer.from_file(tokenizer)])
        return whole[0].encode(text, add_special_tokens=False).ids

    def encode(text: str) -> list[int]:
        if END_TEXT in text:
            return slow(text)
        try:
            return fast.encode_ordinary(text)
        except (KeyboardInterrupt, SystemExit, GeneratorExit):
            raise
        except BaseException:  # the pattern engine gives up on some texts, and its panic is no Exception
            return slow(text)

    return encode


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``window`` ids: all of a document but its last are full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                yield cut(batch.slice(at, 1000), encode)
        pa.default_memory_pool().release_unused()

    def cut(batch: pa.RecordBatch, encode: Callable[[str], list[int]]) -> pa.RecordBatch:
        rows, parts = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            ids = np.array([*encode(text), END] if text else [END], "<u4")
            for start in range(0, len(ids), window):
                part = ids[start:start + window]
                rows.append((i, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
                if with_ids:
                    parts.append(part.view(np.int32))
        row, *numbers = map(np.array, zip(*rows))
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        arrays = [batch.column("doc_id").take(pa.array(row))] + [pa.array(n, pa.int64()) for n in numbers]
        if with_ids:
            arrays, names = [*arrays, pa.array(parts, pa.list_(pa.int32()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(arrays, names)

    bounded_batches(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths and how often to take them, closest to ``room`` from below; long ones first."""
    lengths = sorted(n for n, c in counts.items() if c and n <= room)
    mask = (1 << (room + 1)) - 1
    tables = [1]  # bit s of table i: some multiset of the first i lengths sums to s
    for n in lengths:
        bits, left, step = tables[-1], min(counts[n], room // n), 1
        while left:  # 1, 2, 4, ... copies and the rest give every number of copies
            take = min(step, left)
            bits |= (bits << (n * take)) & mask
            left, step = left - take, step * 2
        tables.append(bits)
    total, chosen = tables[-1].bit_length() - 1, {}
    for i in range(len(lengths), 0, -1):
        n = lengths[i - 1]
        for k in range(min(counts[n], total // n), -1, -1):
            if tables[i - 1] >> (total - k * n) & 1:
                break
        if k:
            chosen[n] = k
            total -= k * n
    return chosen


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """Fills as ``(times, {length: count})`` that use up ``counts``."""
    left = {n: c for n, c in counts.items() if c}
    fills = []
    while left:
        longest = max(left)
        left[longest] -= 1
        take = fill(left, window - longest)
        left[longest] += 1
        take[longest] = take.get(longest, 0) + 1
        times = min(left[n] // k for n, k in take.items())
        fills.append((times, take))
        for n, k in take.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return fills


def _places(fills: list[tuple[int, dict[int, int]]]) -> tuple[list[tuple], int]:
    """``length, low, high, each, sequence, offset``: rests numbered low to high go into sequences from ``sequence`` on, ``each`` to a sequence."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, take in fills:
        offset = 0
        for n in sorted(take, reverse=True):
            low = used.get(n, 0)
            used[n] = low + take[n] * times
            rows.append((n, low, used[n], take[n], sequence, offset))
            offset += n * take[n]
        sequence += times
    return rows, sequence


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``, and their ids if wanted."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    # written once: the numbers below come from the order in these files
    cut = scratch.keep(pieces(docs, tokenizer, window, with_ids).withColumn("key", F.monotonically_increasing_id()))
    chunk = F.call_function("shiftright", F.col("key"), F.lit(33))
    # the id is the row's number within the part that wrote it
    rests = cut.where(F.col("length") < window).withColumn("chunk", chunk)
    sizes = scratch.keep(rests.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # window - 1 rows at most
    rows, sequences = _places(plan(counts, window))
    places = spark.createDataFrame(rows or [(0, 0, 0, 1, 0, 0)], "length long, low long, high long, each long, first long, at long")

    before = W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = W.partitionBy("length", "chunk").orderBy("key")
    numbered = (
        rests.withColumn("_n", F.row_number().over(within) - 1).join(starts, ["length", "chunk"])
        .withColumn("rank", F.col("before") + F.col("_n"))
    )
    # at most one row per length and fill, whatever the corpus
    here = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")) & (F.col("length") == F.col("_length"))
    placed = numbered.join(F.broadcast(places.withColumnRenamed("length", "_length")), here)
    step = F.col("rank") - F.col("low")
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ids = ["ids"] if with_ids else []
    shared = placed.select(*out, (F.col("first") + F.floor(step / F.col("each"))).alias("sequence_id"),
                           (F.col("at") + (step % F.col("each")) * F.col("length")).alias("offset"), *ids)
    full = cut.where(F.col("length") == window).select(
        *out, (F.col("key") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *ids)
    return shared.unionByName(full)
