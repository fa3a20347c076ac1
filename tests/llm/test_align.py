"""Alignment of two tokenizers against a plain version."""

import hashlib
import os
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.brute import ODD
from trustweave.llm import align

RANKS, JSON, MODEL = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def unbyte():
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(other)}


@pytest.fixture(scope="module")
def tokens():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    a = Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    b, back = sentencepiece.SentencePieceProcessor(model_file=MODEL), unbyte()

    def of(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        raw_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        return ids_a, raw_a, ids_b, raw_b

    return of


def brute(texts, tokens):
    groups = []
    for text in texts:
        found = []
        if text:
            ids_a, raw_a, ids_b, raw_b = tokens(text)
            whole = (" " + text).encode()
            if b"".join(raw_a) == whole == b"".join(raw_b):
                ends = [np.cumsum([len(r) for r in raw]).tolist() for raw in (raw_a, raw_b)]
                common = sorted(set(ends[0]) & set(ends[1]))
                at = [0, 0]
                for c in common:
                    to = [ends[k].index(c, at[k]) + 1 for k in (0, 1)]
                    found.append((ids_a[at[0]:to[0]], ids_b[at[1]:to[1]]))
                    at = to
        groups.append(found)
    count = Counter(p for g in groups for p in {(x, y) for a, b in g for x in a for y in b})
    best = {}
    for (x, _), n in count.items():
        best[x] = max(n, best.get(x, 0))
    out = []
    for g in groups:
        links = [(x, y) for a, b in g for x in a for y in b]
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(count[p] == best[p[0]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(spelled.encode()).hexdigest() if g else ""))
    return out


def found(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


MORE = ["<|endoftext|> x <s> </s> <unk> <0x41>", "\x00\x01 a", "日本語のテキスト 中文 \U0001f469‍\U0001f4bb" * 50, "=" * 9000, "  leading   and  trailing  ", "a b　c ﬁ",
        "ab" * 20000, " ".join(f"w{i}" for i in range(9000)), "﻿x", "tab\there\r\nnew"]


def test_odd_texts_equal_the_plain_version(spark, tokens):
    texts = ODD + MORE + ODD
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, chunk string").repartition(3)
    got = found(align.digest(align.aligned(df, RANKS, JSON, MODEL)))
    assert got == dict(enumerate(brute(texts, tokens)))


def test_table_equals_the_plain_version(spark, tokens, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    expected = dict(zip([r.doc_id for r in rows], brute([r.text for r in rows], tokens)))
    assert found(align.digest(align.aligned(docs.repartition(5), RANKS, JSON, MODEL))) == expected


def test_common_ends_in_any_lanes():
    draw = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(np.r_[draw.integers(1, 300, draw.integers(0, 200)), 300]) for _ in range(2))
        lanes = np.unique(np.r_[0, draw.integers(0, 299, draw.integers(0, 9))])
        x, y = align.common_ends(a, b, lanes)
        both = np.intersect1d(a, b)
        assert a[x].tolist() == b[y].tolist() == both.tolist()


def test_large_groups_are_counted_by_distinct_ids(spark, tokens, monkeypatch):
    texts = ODD + MORE
    monkeypatch.setattr(align, "LARGE", 2)
    import pyarrow as pa
    a, b = align.ranked(RANKS, JSON), align.pieced(MODEL)
    parts = [align._lists(*x) for x in align._cut(texts, a, b)]
    linked = align.Linked(pa.RecordBatch.from_arrays(parts, ["ids_a", "ids_b", "cuts_a", "cuts_b"]))
    _, start, _, times = linked.pairs()
    assert [int(times[x:y].sum()) for x, y in zip(start, start[1:])] == [r[3] for r in brute(texts, tokens)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = align.digest(align.aligned(df, RANKS, JSON, MODEL))
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and out.count() == 0


def test_rows_without_id_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "some words"), (1, "some words"), (1, "some words")], "doc_id long, text string")
    rows = align.digest(align.aligned(df, RANKS, JSON, MODEL)).collect()
    assert len(rows) == 3 and {r.count_sum for r in rows} == {6} and {r.n_best for r in rows} == {2}


def test_rows_of_chunks_stay_small(spark):
    """No row holds a whole chunk, and a chunk goes on over batches."""
    draw = np.random.default_rng(4)
    texts = [" ".join("".join(chr(97 + c) for c in draw.integers(0, 26, 6)) for _ in range(100)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, 5)
    try:
        rows = align.chunked(align.aligned(df, RANKS, JSON, MODEL)).collect()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    pairs = [r.pairs for r in rows if r.pairs is not None]
    assert max(map(len, pairs)) <= 4096 < sum(map(len, pairs))
    assert sorted(r.doc_id for r in rows if r.pairs is None) == list(range(40))
    assert len({r.chunk for r in rows}) == 1 and len({p for part in pairs for p in part}) == sum(map(len, pairs))


def test_a_worker_forgets_words():
    a, b = align.ranked(RANKS, JSON), align.pieced(MODEL)
    texts = [" ".join(f"x{i}q" for i in range(500 * k, 500 * k + 500)) for k in range(300)]
    known = []
    for rows in align._slices(np.array([len(t) for t in texts])):
        align._cut(texts[rows], a, b)
        known.append(len(b.of.__self__.known))
    assert max(known) < 110_000


def test_small_chunks_in_small_batches(tokens, monkeypatch):
    """Without Spark, so that the bounds can be set."""
    from types import SimpleNamespace

    import pyarrow as pa
    texts = [t for t in [*ODD, *MORE, "", None, *ODD] if len(t or "") < 5000]
    a, b = align.ranked(RANKS, JSON), align.pieced(MODEL)
    for k, v in {"CHUNK": 400, "PART": 100, "BLOCK": 7, "TaskContext": SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 2))}.items():
        monkeypatch.setattr(align, k, v)
    names = ["doc_id", "ids_a", "ids_b", "cuts_a", "cuts_b"]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(texts)))[i:i + 3], *[align._lists(*x) for x in align._cut(texts[i:i + 3], a, b)]], names) for i in range(0, len(texts), 3)]
    run = align.chunked(SimpleNamespace(mapInArrow=lambda function, schema: function))
    rows = [r for batch in run(iter(batches)) for r in batch.to_pylist()]
    assert len({r["chunk"] for r in rows}) > 5 and all(r["chunk"] >> 32 == 2 for r in rows)
    count = Counter()
    for r in rows:
        if r["pairs"] is not None:
            assert 0 < len(r["pairs"]) <= 7
            count.update(dict(zip(r["pairs"], r["held"])))
    best = {}
    for pair, n in count.items():
        best[pair >> 32] = max(n, best.get(pair >> 32, 0))
    told = []
    for r in rows:
        if r["pairs"] is None:
            told.append((r["chunk"], None, None, {k: r[k] for k in (*align.KNOWN, "groups_sha256", "which", "times")}))
        else:
            told += [(r["chunk"], r["first"] + i, 2 * count[p] + (count[p] == best[p >> 32]), None) for i, p in enumerate(r["pairs"])]
    told.sort(key=lambda t: (t[0], 1 << 40 if t[1] is None else t[1]))
    doc = pa.struct([*[(k, pa.int64()) for k in align.KNOWN], ("groups_sha256", pa.string()), ("which", pa.binary()), ("times", pa.binary())])
    table = pa.Table.from_pylist([dict(zip(align.TOLD, t)) for t in told], pa.schema([("chunk", pa.int64()), ("at", pa.int32()), ("told", pa.int64()), ("doc", doc)]))
    expected = dict(enumerate(brute(texts, tokens)))
    for size in (3, 50, 10**6):
        got = [r for batch in align._scores(iter(table.to_batches(size))) for r in batch.to_pylist()]
        assert {r["doc_id"]: tuple(r.values())[1:] for r in got} == expected and len(got) == len(texts)
