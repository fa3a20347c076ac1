"""Encoding and decoding with a SentencePiece vocabulary.

The model's kind decides how a text is cut, as in the sentencepiece library:

- A unigram model maximizes the sum of piece scores.  An Aho-Corasick automaton
  over all pieces reads a text once; at every position the pieces that end there
  come out along its output links, and each relaxes the best score of its end (of
  equal sums, the one whose last piece is longer counts).  A character that no
  piece covers costs more than any piece and becomes its bytes.
- A BPE model merges neighbours: of all pairs whose union is a piece, the one of
  the highest score first, the left one of equals.  Its scores are only ranks of
  merges, so their sum says nothing, and the same pass over the automaton keeps at
  each position the one piece that merging would leave as the last one of the
  prefix (see ``Merger``).  Characters left without a piece become bytes.

No piece has a space after another character, so a text falls apart before each
run of spaces; words are encoded once and remembered.  Where a vocabulary has
such pieces, whole texts are encoded instead.

Texts are taken as they are, with one space put before them, and ``decode``
gives them back exactly.  So "▁" in a text stays itself; sentencepiece takes it
for a space.

Defined results: a null text has null ids and decodes to null; an empty text has
no ids; texts of any length are encoded whole; repeated rows alike; an empty
table gives an empty one; columns of the input named like a result are replaced.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustweave.llm.shared import beside, bounded_batches, packed, slices

SPACE = "▁"
#: A character without a piece costs this much more than the worst piece.
UNKNOWN = 10.0
_UNITS = re.compile(" +[^ ]*|[^ ]+")
#: Words (some 200 bytes each) and pairs of pieces that a worker remembers.
_WORDS, _PAIRS = 800_000, 300_000


#: ``ModelProto.trainer_spec.model_type``
_TRAINER, _TYPE, UNIGRAM, BPE = 2, 3, 1, 2


def _fields(raw: bytes):
    """Numbers and values of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, raw[at:at + size]
            at += size


def _model_type(model: str) -> int:
    with open(model, "rb") as file:
        trainer = next((v for k, v in _fields(file.read()) if k == _TRAINER), b"")
    return next((v for k, v in _fields(trainer) if k == _TYPE), UNIGRAM)


class Vocabulary:
    """Pieces and scores of a model file."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = range(sp.get_piece_size())
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in size if sp.is_byte(i)}
        special = {i for i in size if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.pieces = {i: (sp.id_to_piece(i).replace(SPACE, " "), sp.get_score(i)) for i in size if i not in special}
        self.merges = _model_type(model) == BPE
        self.apart = not any(re.search("[^ ] ", text) for text, _ in self.pieces.values())
        self.raw = {i: text.encode() for i, (text, _) in self.pieces.items()} | {i: bytes([b]) for b, i in self.bytes.items()}


class Units:
    """Ids of many texts at once.

    Texts fall apart into words (or stay whole, if a piece goes beyond one); a word
    is cut when it is first met, and its ids are kept in flat arrays, so a text's
    ids are gathered from its words' numbers.  What is kept is dropped when it
    grows beyond a bound.
    """

    def __init__(self, vocabulary: Vocabulary, cut: Callable[[list[str]], list[list[int]]], remembered: int = 200_000):
        self.cut, self.apart, self.remembered = cut, vocabulary.apart, remembered
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = _Numbers()
        self.ids, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (and the last one's end)."""
        if len(self.known) > self.remembered or len(self.ids) > 16 * self.remembered:
            self._forget()
        number, before, many = self.known.__getitem__, len(self.known), [0]
        words: list[int] = []
        for text in texts:
            if text:
                words += map(number, _UNITS.findall(" " + text) if self.apart else [" " + text])
            many.append(len(words))
        if len(self.known) > before:
            found = self.cut(list(islice(self.known, before, None)))
            size = np.array([len(f) for f in found], np.int64)
            self.start = np.r_[self.start, len(self.ids) + np.cumsum(size) - size]
            self.size = np.r_[self.size, size]
            self.ids = np.r_[self.ids, np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))]
        which = np.array(words, np.int64)
        size = self.size[which]
        end = np.cumsum(size)
        ids = self.ids[np.arange(size.sum()) + np.repeat(self.start[which] - (end - size), size)]
        return ids, np.r_[0, end][many]


class _Numbers(dict):
    """Numbers words in the order they are asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        usual = [s for _, s in vocabulary.pieces.values() if s > -1e6]
        self.unknown = min(usual) - UNKNOWN
        for i, (text, score) in vocabulary.pieces.items():
            self.automaton.add_word(text, (i, len(text), score))
        self.automaton.make_automaton()

    def viterbi(self, text: str) -> list[int]:
        """Best segmentation of a text, spaces included."""
        n, unknown = len(text), self.unknown
        best = [0.0] + [float("-inf")] * n
        piece, size = [-1] * (n + 1), [1] * (n + 1)  # the last piece (-1: bytes) and its length
        at = 0  # positions before this one are final
        for end, (i, length, score) in self.automaton.iter(text):
            while at < end:
                total = best[at] + unknown
                at += 1
                if total > best[at]:
                    best[at], piece[at], size[at] = total, -1, 1
            end += 1
            total = best[end - length] + score
            if total > best[end] or (total == best[end] and length > size[end]):
                best[end], piece[end], size[end] = total, i, length
        while at < n:
            total = best[at] + unknown
            at += 1
            if total > best[at]:
                best[at], piece[at], size[at] = total, -1, 1
        ids: list[int] = []
        while n:
            ids += [piece[n]] if piece[n] >= 0 else [self.vocabulary.bytes[b] for b in reversed(text[n - 1].encode())]
            n -= size[n]
        return ids[::-1]

    cut = viterbi

    def encode(self, text: str) -> list[int]:
        return Units(self.vocabulary, lambda words: [self.cut(w) for w in words]).of([text])[0].tolist()


class Merger(Encoder):
    """Encoder of a BPE model.

    Of the pieces that end at a position, one alone can be the last piece of the
    prefix up to there: the one that merging leaves beside the piece before it.
    Whether two pieces stay two depends on them only, so it is found by merging
    the two once, and remembered.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary)
        self.size = max(vocabulary.raw) + 1
        self.text_of = {i: text for i, (text, _) in vocabulary.pieces.items()}
        self.stays: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The symbols that merging in the model's order leaves."""
        n, piece = len(text), self.automaton.get
        end = list(range(1, n + 1))  # of the symbol that starts here; 0: none does
        before = list(range(-1, n))  # start of the symbol before the one that starts here
        open_pairs = []
        for i in range(n - 1):
            found = piece(text[i:i + 2], None)
            if found:
                open_pairs.append((-found[2], i, i + 2))
        heapify(open_pairs)
        while open_pairs:
            _, start, stop = heappop(open_pairs)
            middle = end[start]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the two has been merged since
            end[start], end[middle], before[stop] = stop, 0, start
            around = [(before[start], stop)] if start else []
            if stop < n:
                around.append((start, end[stop]))
            for i, j in around:
                found = piece(text[i:j], None)
                if found:
                    heappush(open_pairs, (-found[2], i, j))
        symbols, at = [], 0
        while at < n:
            symbols.append(text[at:end[at]])
            at = end[at]
        return symbols

    def _symbol(self, i: int) -> str:
        """A piece, a character without one (numbered after all pieces), or nothing."""
        return "" if i < 0 else self.text_of[i] if i < self.size else chr(i - self.size)

    def _stay(self, before: int, piece: int) -> bool:
        """Whether merging leaves the two (or a first one alone) as they are."""
        x, y = self._symbol(before), self._symbol(piece)
        if len(self.stays) > _PAIRS:
            self.stays.clear()
        stay = self.stays[before * self.size + piece] = self.merged(x + y) == [x, y][not x:]
        return stay

    def cut(self, text: str) -> list[int]:
        n, size, get = len(text), self.size, self.stays.get
        last, width = [-1] * (n + 1), [1] * (n + 1)  # the last piece of each prefix
        at = 1  # prefixes shorter than this are final
        for end, (piece, length, _) in self.automaton.iter(text):
            while at <= end:  # no piece ended here: a character without one
                if last[at] < 0:
                    last[at] = size + ord(text[at - 1])
                at += 1
            end += 1
            if last[end] < 0:
                before = last[end - length]
                stay = get(before * size + piece)
                if self._stay(before, piece) if stay is None else stay:
                    last[end], width[end] = piece, length
        ids: list[int] = []
        while n:
            piece = last[n]
            if 0 <= piece < size:
                ids.append(piece)
            else:
                ids += [self.vocabulary.bytes[b] for b in reversed(text[n - 1].encode())]
            n -= width[n]
        return ids[::-1]


def encoder_of(vocabulary: Vocabulary) -> Encoder:
    return Merger(vocabulary) if vocabulary.merges else Encoder(vocabulary)


@functools.lru_cache(maxsize=1)
def _units(model: str) -> Units:
    """A worker's own encoder; what it remembers serves all its tasks."""
    vocabulary = Vocabulary(model)
    encoder = encoder_of(vocabulary)
    return Units(vocabulary, lambda words: [encoder.cut(w) for w in words], _WORDS)


def decode_ids(vocabulary: Vocabulary, ids: list[int]) -> str:
    raw = vocabulary.raw
    return b"".join([raw[i] for i in ids]).decode(errors="replace")[1:]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` with ``ids``."""
    rows = packed(docs, "text", "ids", text=F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(model)
        for batch in slices(batches, 500):
            text = batch.column("text")
            ids, start = units.of(text.to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(ids), mask=text.is_null())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["_doc", "text", "ids"])
        pa.default_memory_pool().release_unused()

    bounded_batches(docs.sparkSession)
    out = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    return out.select(*beside(out, ["text", "ids"]), "text", "ids")


def _texts(vocabulary: Vocabulary, table: pa.Array, lists: pa.ListArray) -> pa.Array:
    """What lists of ids spell, without the space before."""
    start = lists.offsets.to_numpy()
    spelled = table.take(lists.values.slice(start[0], start[-1] - start[0]))
    at = np.frombuffer(spelled.buffers()[1], np.int64, len(spelled) + 1)[start - start[0]] if len(spelled) else np.zeros(len(start), np.int64)
    data = np.frombuffer(spelled.buffers()[2], np.uint8, int(at[-1])) if at[-1] else np.empty(0, np.uint8)
    some = np.diff(at) > 0
    kept = np.ones(len(data), bool)
    kept[at[:-1][some]] = False
    offsets = (at - np.r_[0, np.cumsum(some)]).astype(np.int32)
    texts = pa.StringArray.from_buffers(len(lists), pa.py_buffer(offsets), pa.py_buffer(data[kept]))
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        texts = pa.array([decode_ids(vocabulary, i or []) for i in lists.to_pylist()], pa.string())
    return pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), texts)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` (``ids``) with ``decoded``; bytes that are no UTF-8 become U+FFFD."""
    rows = packed(encoded, "ids", "decoded", ids=F.col("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model)
        table = pa.array([vocabulary.raw.get(i, b"") for i in range(max(vocabulary.raw) + 1)], pa.large_binary())
        for batch in slices(batches, 500):
            texts = _texts(vocabulary, table, batch.column("ids"))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], ["_doc", "ids", "decoded"])
        pa.default_memory_pool().release_unused()

    bounded_batches(encoded.sparkSession)
    out = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))
    return out.select(*beside(out, ["ids", "decoded"]), "ids", "decoded")


def digest(decoded: DataFrame) -> DataFrame:
    """One row per document: how many ids, their hash, and whether decoding gave the text back."""
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"),
                          F.length("text").cast("long").alias("n_chars"), F.col("decoded").eqNullSafe(F.col("text")).alias("exact"))
