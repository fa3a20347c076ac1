"""Alignment of two tokenizers' cuts of the same texts.

Every text is cut by a byte-level vocabulary (A: ranks as tiktoken reads them) and
by a SentencePiece model (B).  Both cuts cover the bytes of a space and the text.
Where a token of A and one of B end at the same byte there is a cut; the tokens
between two cuts are a group, and all of its A tokens are linked with all of its
B tokens.

Cuts are found for all texts of a batch in lockstep.  The state is one vector of
pointers into A's and one into B's tokens, with a lane for every ``STRETCH`` bytes
of a text.  A step compares the ends of all lanes' two tokens, emits a cut (and so
closes a group of links) where they are equal, advances the pointer with the
smaller end, or both, and drops the lanes that are through.  A lane only looks
for common ends inside its stretch, so a long text is many lanes, not many steps.

``aligned`` gives the ids and the cuts of every document.  ``link_counts`` counts
for each pair of ids the documents that hold it linked, and ``digest`` reports
per document.  Links are kept as distinct pairs of ids with their number.  For the
counts, documents are taken together in chunks of about ``CHUNK`` bytes: a chunk
adds up its pairs before they are shuffled, and gets their counts back once.  So
a pair that occurs everywhere is one row a chunk; no row is made per link.

Memory does not grow with the table or a chunk: a worker cuts and links ``PART`` bytes
at a time (or one longer text) and only numbers the pairs of its open chunk.  A row
holds one document or ``BLOCK`` pairs, and row groups are small, since Spark reads a
group's rows together.  For the scores a chunk's counts come sorted before its documents.

Defined results: null and empty texts, and texts whose bytes a tokenizer does not
give back, have no tokens, no groups and no links; texts of any length are cut
whole; every row counts as a document of its own, also if rows repeat or have no
``doc_id``; an empty table gives an empty one; other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustweave.llm.packing import SPLIT
from trustweave.llm.pieces import Units, Vocabulary
from trustweave.llm.shared import Scratch, bounded_batches, released

STRETCH = 256
CHUNK = 2_000_000
#: Bytes of text that a worker takes at a time; pairs in a row; words that a worker remembers.
PART, BLOCK, WORDS = 250_000, 4096, 60_000
#: Arrow batches hold no more than this (or one row).
BATCH = "4m"
#: Of the written chunks; the size is looked at every few rows, as one can be large.
ROW_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "10"}
#: Groups with more links than this are counted by distinct ids.
LARGE = 4096
ALIGNED = "doc_id long, ids_a array<int>, ids_b array<int>, cuts_a array<int>, cuts_b array<int>"
#: A row is a document (``which`` pairs of its chunk it holds, and how many ``times``) or, from ``first`` on, some of a chunk's pairs.
COUNTED = (
    "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, which binary, times binary, "
    "first int, pairs array<long>, held array<long>"
)
SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


# -- tokens ---------------------------------------------------------------------------

class Side:
    """Ids of texts, and the bytes of every id."""

    def __init__(self, raw: dict[int, bytes], of: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.raw = pa.array([raw.get(i, b"") for i in range(max(raw) + 1)], pa.large_binary())
        self.size = np.diff(np.frombuffer(self.raw.buffers()[1], np.int64))[: len(self.raw)]
        self.of = of


def ranked(ranks: str, tokenizer: str) -> Side:
    """A byte-level vocabulary; ``tokenizer`` is the same one for texts its pattern engine gives up on."""
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(ranks, "rb") as lines:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=known, special_tokens={})
    whole: list[Tokenizer] = []

    def ids(text: str) -> list[int]:
        try:
            return fast.encode_ordinary(" " + text)
        except (KeyboardInterrupt, SystemExit, GeneratorExit):
            raise
        except BaseException:  # the pattern engine's panic is no Exception
            if not whole:
                whole.append(Tokenizer.from_file(tokenizer))
                whole[0].encode_special_tokens = True
            return whole[0].encode(" " + text, add_special_tokens=False).ids

    def of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(ids(t), np.int32) for t in texts]
        return np.concatenate([*found, np.empty(0, np.int32)]), np.cumsum([0, *map(len, found)])

    return Side({i: b for b, i in known.items()}, of)


def pieced(model: str) -> Side:
    """A SentencePiece model, by its own library; words are cut once."""
    import sentencepiece

    words = Vocabulary(model)
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    space = next(i for i, (text, _) in words.pieces.items() if text == " ")
    cut = lambda units: [ids or [space] for ids in library.encode([u[1:] for u in units], num_threads=1)]  # it adds the space itself
    return Side(words.raw, Units(words, cut, WORDS).of)


def _exact(side: Side, ids: np.ndarray, start: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Which texts the ids spell byte for byte."""
    spelled = side.raw.take(pa.array(ids))
    at = np.frombuffer(spelled.buffers()[1], np.int64)[spelled.offset:][start] if len(ids) else np.zeros(len(start), np.int64)
    data = memoryview(spelled.buffers()[2] or b"").cast("B")
    return np.array([data[at[i]:at[i + 1]] == r for i, r in enumerate(raw)], bool)


def _only(ids: np.ndarray, start: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(start)
    return ids[np.repeat(keep, size)], np.r_[0, np.cumsum(np.where(keep, size, 0))]


# -- cuts -----------------------------------------------------------------------------

def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the tokens of both sides that end at the same byte.

    ``lanes`` are the first bytes of the lanes, rising; the last one goes to the end.
    """
    last = ends_a[-1] if len(ends_a) else 0
    limit = np.r_[lanes[1:], last]
    a, b = np.searchsorted(ends_a, lanes, "right"), np.searchsorted(ends_b, lanes, "right")
    ends_a, ends_b = np.r_[ends_a, last + 1], np.r_[ends_b, last + 1]  # beyond all limits
    cut_a, cut_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while True:
        x, y = ends_a[a], ends_b[b]
        live = np.maximum(x, y) <= limit
        if not live.all():  # a pointer has left its stretch: nothing in common comes after
            a, b, x, y, limit = a[live], b[live], x[live], y[live], limit[live]
            if not len(a):
                return np.sort(np.concatenate(cut_a)), np.sort(np.concatenate(cut_b))
        same = x == y
        cut_a.append(a[same])
        cut_b.append(b[same])
        a, b = a + (x <= y), b + (y <= x)


def _cut(texts: list[str | None], a: Side, b: Side) -> list[tuple[np.ndarray, np.ndarray]]:
    """``ids_a, ids_b, cuts_a, cuts_b`` of texts, each as values and starts."""
    given = [t or "" for t in texts]
    raw = [(" " + t).encode() for t in given]
    (ids_a, start_a), (ids_b, start_b) = a.of(given), b.of(given)
    good = np.array([bool(t) for t in given], bool) & _exact(a, ids_a, start_a, raw) & _exact(b, ids_b, start_b, raw)
    (ids_a, start_a), (ids_b, start_b) = _only(ids_a, start_a, good), _only(ids_b, start_b, good)
    length = np.where(good, [len(r) for r in raw], 0)
    begin = np.cumsum(length) - length
    many = -(-length // STRETCH)
    lanes = np.repeat(begin, many) + STRETCH * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    cut_a, cut_b = common_ends(np.cumsum(a.size[ids_a]), np.cumsum(b.size[ids_b]), lanes)
    first = np.searchsorted(cut_a, start_a)  # a text's last tokens end together
    own = np.repeat(np.arange(len(texts)), np.diff(first))
    return [(ids_a, start_a), (ids_b, start_b), (cut_a + 1 - start_a[own], first), (cut_b + 1 - start_b[own], first)]


def _lists(values: np.ndarray, start: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(values, pa.int32()))


def _slices(sizes: np.ndarray) -> Iterator[slice]:
    """Rows of about ``PART`` bytes; a longer row is one of its own."""
    at, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > at and total + size > PART:
            yield slice(at, i)
            at, total = i, 0
        total += size
    if at < len(sizes):
        yield slice(at, len(sizes))


def aligned(docs: DataFrame, ranks: str, tokenizer: str, model: str) -> DataFrame:
    """``doc_id, ids_a, ids_b, cuts_a, cuts_b``; a cut is the number of tokens up to it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = ranked(ranks, tokenizer), pieced(model)
        for batch in batches:
            text = batch.column("text")
            for rows in _slices(pc.binary_length(text).fill_null(0).to_numpy()):
                part = batch.slice(rows.start, rows.stop - rows.start)
                found = [_lists(*x) for x in _cut(part.column("text").to_pylist(), a, b)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *found], ["doc_id", "ids_a", "ids_b", "cuts_a", "cuts_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from cut(batches)
        released()

    bounded_batches(docs.sparkSession, size=BATCH)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ALIGNED)


# -- links ----------------------------------------------------------------------------

def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    start = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[start[0]:start[-1]].astype(np.int64), start - start[0]


def _products(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of each group, given first positions and numbers: its group, and both positions."""
    size = n_a * n_b
    group = np.repeat(np.arange(len(size)), size)
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return group, a[group] + k // n_b[group], b[group] + k % n_b[group]


class Linked:
    """The groups and links of a batch of aligned documents."""

    def __init__(self, batch: pa.RecordBatch):
        (self.ids_a, self.start_a), (self.ids_b, self.start_b) = _flat(batch.column("ids_a")), _flat(batch.column("ids_b"))
        (cut_a, self.first), (cut_b, _) = _flat(batch.column("cuts_a")), _flat(batch.column("cuts_b"))
        self.doc = np.repeat(np.arange(batch.num_rows), np.diff(self.first))
        self.end_a, self.end_b = cut_a + self.start_a[self.doc], cut_b + self.start_b[self.doc]
        self.n_a, self.n_b = np.diff(self.end_a, prepend=0), np.diff(self.end_b, prepend=0)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of ids of all documents; per document which of them it holds (as starts and numbers) and how often."""
        at_a, at_b, size = self.end_a - self.n_a, self.end_b - self.n_b, self.n_a * self.n_b
        usual = size <= LARGE
        group, a, b = _products(at_a[usual], self.n_a[usual], at_b[usual], self.n_b[usual])
        docs, codes = [self.doc[usual][group]], [self.ids_a[a] << 32 | self.ids_b[b]]
        times = [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(~usual):
            x, many_x = np.unique(self.ids_a[at_a[g]:self.end_a[g]], return_counts=True)
            y, many_y = np.unique(self.ids_b[at_b[g]:self.end_b[g]], return_counts=True)
            codes.append((x[:, None] << 32 | y[None, :]).ravel())
            times.append((many_x[:, None] * many_y[None, :]).ravel())
            docs.append(np.full(len(codes[-1]), self.doc[g]))
        known = pa.array(np.concatenate(codes)).dictionary_encode()
        distinct = known.dictionary.to_numpy().astype(np.int64)
        key = np.concatenate(docs) * max(1, len(distinct)) + known.indices.to_numpy()
        if usual.all():
            held, times = np.unique(key, return_counts=True)
        else:
            held, row = np.unique(key, return_inverse=True)
            sums = np.zeros(len(held), np.int64)
            np.add.at(sums, row, np.concatenate(times))
            times = sums
        start = np.searchsorted(held, np.arange(len(self.first)) * max(1, len(distinct)))
        return distinct, start, held % max(1, len(distinct)), times

    def spelled(self, table: pa.Array, size_a: int, size_b: int) -> list[str]:
        """Per document the hash of its groups, written as ids with their separators."""
        last_a, last_b = np.zeros(len(self.ids_a), np.int64), np.zeros(len(self.ids_b), np.int64)
        last_a[self.end_a - 1] = 1
        last_b[self.end_b - 1] = 1
        order = np.empty(len(self.ids_a) + len(self.ids_b), np.int64)
        # tokens of the other side that stand before: those of groups before, and for B those of the own group
        order[np.arange(len(self.ids_a)) + np.repeat(self.end_b - self.n_b, self.n_a)] = self.ids_a + size_a * last_a
        order[np.arange(len(self.ids_b)) + np.repeat(self.end_a, self.n_b)] = self.ids_b + size_b * last_b + 2 * size_a
        text = table.take(pa.array(order))
        at = np.frombuffer(text.buffers()[1], np.int64)[self.start_a + self.start_b] if len(order) else np.zeros(len(self.start_a), np.int64)
        data = memoryview(text.buffers()[2] or b"").cast("B")
        return [hashlib.sha256(data[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(at[:-1], at[1:])]


class Numbered:
    """The distinct pairs of a chunk, numbered as they come, and how many documents hold each."""

    def __init__(self):
        self.size, self.pairs, self.held = 0, pa.array([], pa.int64()), np.empty(0, np.int64)

    def of(self, distinct: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Numbers of distinct pairs, each held by so many more documents."""
        number = pc.index_in(pa.array(distinct, pa.int64()), value_set=self.pairs).fill_null(-1).to_numpy().astype(np.int64)
        new = number < 0
        number[new] = len(self.pairs) + np.arange(new.sum())
        self.pairs = pa.concat_arrays([self.pairs, pa.array(distinct[new], pa.int64())])
        self.held = np.r_[self.held, np.zeros(new.sum(), np.int64)]
        self.held[number] += held
        return number


def _counted(chunk: int, rows: int, **known) -> pa.RecordBatch:
    """Rows of ``COUNTED``; columns that are not given are null."""
    fields = [("chunk", pa.int64()), *[(n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()),
              ("which", pa.binary()), ("times", pa.binary()), ("first", pa.int32()), ("pairs", pa.list_(pa.int64())), ("held", pa.list_(pa.int64()))]
    known["chunk"] = np.full(rows, chunk)
    return pa.RecordBatch.from_arrays([pa.array(known[n], k) if n in known else pa.nulls(rows, k) for n, k in fields], [n for n, _ in fields])


def _small(times: np.ndarray) -> np.ndarray:
    """In as few bytes each as the largest one needs."""
    return times.astype(next(k for k in ("<i1", "<i2", "<i4", "<i8") if times.max(initial=0) <= np.iinfo(k).max))


def chunked(documents: DataFrame, size_a: int = 1 << 17, size_b: int = 1 << 17) -> DataFrame:
    """Aligned documents with their chunk: what is known of each, who holds which pairs of ids how often, and the chunks' pairs."""

    def spell(size: int, end: str) -> pa.Array:
        kind = pa.large_string()
        return pc.binary_join_element_wise(pa.array(np.arange(size)).cast(kind), pa.scalar(end, kind), pa.scalar("", kind)).cast(pa.large_binary())

    def pairs(number: int, chunk: Numbered) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(chunk.pairs), BLOCK):
            part = slice(at, at + BLOCK)
            yield _counted(number, 1, first=[at], pairs=[chunk.pairs[part].to_numpy()], held=[chunk.held[part]])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_arrays([spell(size_a, ","), spell(size_a, "|"), spell(size_b, ","), spell(size_b, ";")])
        number, chunk = TaskContext.get().partitionId() << 32, Numbered()
        for batch in batches:
            tokens = [np.diff(batch.column(c).offsets.to_numpy().astype(np.int64)) for c in ("ids_a", "ids_b")]
            sizes = 2 * (tokens[0] + tokens[1])
            for rows in _slices(sizes):
                size = int(sizes[rows].sum())
                if chunk.size and chunk.size + size > CHUNK:
                    yield from pairs(number, chunk)
                    number, chunk = number + 1, Numbered()
                chunk.size += size
                part = batch.slice(rows.start, rows.stop - rows.start)
                linked = Linked(part)
                distinct, start, which, times = linked.pairs()
                which = chunk.of(distinct, np.bincount(which, minlength=len(distinct)))[which].astype("<i4")
                links = np.r_[0, np.cumsum(linked.n_a * linked.n_b)]
                own = list(zip(start[:-1].tolist(), start[1:].tolist()))
                yield _counted(
                    number, part.num_rows, doc_id=part.column("doc_id"), n_a=tokens[0][rows], n_b=tokens[1][rows], n_groups=np.diff(linked.first),
                    n_links=np.diff(links[linked.first]), groups_sha256=linked.spelled(table, size_a, size_b),
                    which=[which[x:y].tobytes() for x, y in own], times=[_small(times[x:y]).tobytes() for x, y in own])
        yield from pairs(number, chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from counted(batches)
        released()

    return documents.mapInArrow(run, COUNTED)


def link_counts(chunks: DataFrame) -> DataFrame:
    """``id_a, id_b, documents`` (that hold the two linked) ``, best``: whether no other pair of ``id_a`` is held by more."""
    found = chunks.select(F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("held").alias("held"))))
    counts = found.groupBy("pair").agg(F.sum("held").alias("documents"))
    counts = counts.select("pair", F.shiftright("pair", 32).cast("int").alias("id_a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("id_b"), "documents")
    # an A id has at most as many partners as B has ids
    return counts.withColumn("best", F.col("documents") == F.max("documents").over(W.partitionBy("id_a")))


#: What the scores need: a chunk's counts (twice the documents, plus whether it is the best) by number, then its documents.
TOLD = ["chunk", "at", "told", "doc"]
KNOWN = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of documents, from rows sorted by chunk and number."""
    now, told, counts, top = None, [], np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        chunk, docs = batch.column("chunk").to_numpy(), batch.column("doc").is_valid().to_numpy(zero_copy_only=False)
        edges = np.r_[0, 1 + np.flatnonzero(np.diff(chunk) | np.diff(docs)), len(chunk)]
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if x == y:
                continue
            if chunk[x] != now:
                now, told, counts, top = chunk[x], [], np.empty(0, np.int64), np.empty(0, np.int64)
            if not docs[x]:
                told.append(batch.column("told").slice(x, y - x).to_numpy())
                continue
            if told:
                counts, told = np.concatenate(told), []
                counts, top = counts >> 1, counts & 1
            doc = batch.column("doc").slice(x, y - x)
            get = dict(zip([f.name for f in doc.type], doc.flatten()))
            n_best, count_sum = [], []
            for which, times in zip(get["which"], get["times"]):
                which, times = np.frombuffer(which.as_buffer(), "<i4"), times.as_buffer()
                times = np.frombuffer(times, f"<i{times.size // max(1, len(which)) or 1}").astype(np.int64)
                n_best.append(int(times @ top[which]))
                count_sum.append(int(times @ counts[which]))
            yield pa.RecordBatch.from_arrays(
                [*[get[c] for c in KNOWN], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), get["groups_sha256"]],
                [c.split()[0] for c in SCORED.split(", ")])


def digest(documents: DataFrame) -> DataFrame:
    """One row per aligned document: tokens, groups, links, how common its links are, and the hash of its groups."""
    scratch = Scratch(documents.sparkSession, "align")
    chunks = scratch.keep(chunked(documents), **ROW_GROUPS)
    counts = scratch.keep(link_counts(chunks).select("pair", F.expr("2 * documents + int(best)").alias("told")))
    asked = chunks.where("pairs IS NOT NULL").select("chunk", "first", F.posexplode("pairs").alias("at", "pair"))
    told = asked.join(counts, "pair").select("chunk", (F.col("first") + F.col("at")).alias("at"), "told")
    docs = chunks.where("pairs IS NULL").select("chunk", F.struct(*KNOWN, "groups_sha256", "which", "times").alias("doc"))
    whole = told.unionByName(docs, allowMissingColumns=True).select(*TOLD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _scores(batches)
        released()

    return whole.repartition("chunk").sortWithinPartitions("chunk", F.col("at").asc_nulls_last()).mapInArrow(run, SCORED)
