"""Packing: every id once, in order, no gaps, little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm import brute
from trustweave.llm import packing

FILE = public_tokenizers.path("byte_bpe_50k.json")


def best(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= room}
    return max(sums)


def test_fill_is_closest():
    draw = random.Random(1)
    for _ in range(200):
        counts = {draw.randrange(1, 40): draw.randrange(1, 4) for _ in range(draw.randrange(6))}
        room = draw.randrange(90)
        take = packing.fill(counts, room)
        assert all(0 < k <= counts[n] for n, k in take.items())
        assert sum(n * k for n, k in take.items()) == best(counts, room)


def test_plan_uses_everything_once():
    draw = random.Random(2)
    counts = {n: draw.randrange(1, 2000) for n in range(1, 1024) if draw.random() < 0.7}
    fills = packing.plan(counts)
    used = defaultdict(int)
    for times, take in fills:
        assert sum(n * k for n, k in take.items()) <= 1024
        for n, k in take.items():
            used[n] += k * times
    assert used == counts
    tokens, room = sum(n * c for n, c in counts.items()), 1024 * sum(t for t, _ in fills)
    assert tokens > 0.99 * room and len(fills) < 8000


def test_pieces_are_packed_without_loss(spark):
    texts = brute.ODD + ["<|endoftext|> x", "a" + " " * 3000 + "b", "word " * 5000, "　 \n\n x"] * 2
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [(i, t, "clash") for i, t in enumerate(texts + real)] + [(None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset string").repartition(5)
    out = packing.pack(df, FILE, with_ids=True).collect()
    model = Tokenizer.from_file(FILE)
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    for i, text, _ in rows:
        parts = sorted(docs[i], key=lambda r: r.start)
        ids = [x for r in parts for x in r.ids]
        assert ids == [*model.encode(text or "", add_special_tokens=False).ids, 0]
        assert [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        assert {r.doc_tokens for r in parts} == {len(ids)}
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        assert sum(r.length for r in parts) <= 1024
    tokens = sum(r.length for r in out)
    assert tokens > 0.98 * 1024 * (len(sequences) - 1)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), FILE).count() == 0
