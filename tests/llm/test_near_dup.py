"""Near duplicates against all pairs on small tables."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from trustweave.llm import near_dup
from trustweave.llm.components import components
from trustweave.llm.near_dup import deduplicated, near_duplicates
from trustweave.llm.shared import Scratch


def expected(rows, percent):
    sets = {i: brute.shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def planted():
    draw = random.Random(5)
    word = lambda: "w%d" % draw.randrange(3000)
    rows = []
    for group in range(12):
        base = [word() for _ in range(200)]
        for _ in range(draw.choice([1, 2, 3, 25])):
            copy = list(base)
            for _ in range(draw.randrange(6)):
                copy[draw.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_equals_all_pairs(spark, percent):
    rows = list(enumerate(brute.ODD + planted()))
    real = [(r.doc_id + 10_000, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    df = spark.createDataFrame(rows + real, "doc_id long, text string").repartition(7)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, percent).collect()}
    assert found == expected(rows + real, percent)


def test_odd_rows(spark):
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(7, text, 1, "x"), (7, text, 1, "x"), (3, text.upper(), 2, "y"), (None, text, 3, "z"), (None, None, 4, None), (9, None, 5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int, kept string")
    found = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in near_duplicates(df).collect())
    assert found == [(-1, 0, -1, True), (-1, 56, -1, True), (3, 56, 3, True), (7, 56, 3, False), (7, 56, 3, False), (9, 0, 9, True)]
    kept = deduplicated(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, r.component_id) for r in kept.collect()) == [(-1, 3), (-1, 4), (3, 2), (9, 5)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 9), (1000, 200), (200, 1001), (9, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    found = dict(map(tuple, components(df, Scratch(spark, "test")).collect()))
    assert found == {**{i: 100 for i in range(100, 161)}, 5: 5, 9: 5, 200: 200, 1000: 200, 1001: 200}


def test_pairs_far_apart_in_a_sparse_region():
    n, draw = 700, np.random.default_rng(4)
    whole = draw.integers(0, 2**31, (n, near_dup.TREES * near_dup.DEPTH)).astype(np.int32)
    whole[-1] = whole[0]
    whole[:, :3] = 7  # one bucket of the first tree
    whole[:, 3] = np.arange(n)
    columns = {"rep": np.arange(n), "n": np.full(n, 100), "comp": np.arange(n), "signature": list(whole)}
    sorted_slice = pa.table({**columns, "tree": np.zeros(n, np.int32), "sign": list(whole[:, :near_dup.DEPTH])})
    unit = pa.table({**columns, "unit": np.zeros(n, np.int64), "block": np.arange(n) % 2, "across": np.zeros(n, bool)})
    pairs = lambda batches: [(r["a"], r["b"]) for b in batches for r in b.to_pylist()]
    assert pairs(near_dup._neighbours(sorted_slice, 80)) == []  # within reach there is nothing
    assert pairs(near_dup._block_pairs(unit, 80)) == [(0, n - 1)]


def templates(n, draw):
    """Texts that share most of their words: a template with fields, many not similar enough to each other."""
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for k in range(draw.choice([2, 4, 5, 6])):
            at = draw.randrange(len(words))
            words[at] = f"v{draw.randrange(10 ** 6)}"
        if i % 3 == 0:
            words = words[:draw.randrange(90, 121)]
        rows.append(" ".join(words))
        if i % 10 == 0:  # near to its predecessor, whatever the template's distance
            rows.append(rows[-1] + " " + " ".join(f"x{draw.randrange(10 ** 6)}" for _ in range(draw.randrange(1, 20))))
    return rows


def test_dense_template_equals_all_pairs(spark):
    rows = list(enumerate(templates(4600, random.Random(9))))
    sets = [brute.shingles(t) for _, t in rows]
    count = Counter(x for s in sets for x in s)
    column = {x: k for k, x in enumerate(x for x in count if count[x] > 1)}
    size, wide = np.array([len(s) for s in sets]), np.zeros((len(sets), len(column)), np.float32)
    for i, s in enumerate(sets):
        wide[i, [column[x] for x in s if x in column]] = 1
    both = wide @ wide.T
    a, b = np.nonzero(100 * both >= 85 * (size[:, None] + size[None, :] - both))
    low, before = np.arange(len(sets)), None
    while not np.array_equal(low, before):
        before = low.copy()
        np.minimum.at(low, a, before[b])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, 85).collect()}
    assert found == {i: (int(size[i]), int(low[i])) for i, _ in rows}
    assert len(set(low.tolist())) > 1000


def test_rare_shingles_miss_no_pair(spark, monkeypatch):
    """All regions count as dense: the result is that of all pairs."""
    monkeypatch.setattr(near_dup, "DENSE", 0)
    rows = list(enumerate(brute.ODD + planted()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, 80).collect()}
    assert found == expected(rows, 80)


def test_unlinked_copies_do_not_meet(spark):
    """Copies with edits of their own, none near another: no candidate pairs from their rarest shingles."""
    draw, base = random.Random(1), [f"t{i}" for i in range(120)]
    sets = []
    for i in range(300):
        words = list(base)
        for at in draw.sample(range(0, 120, 10), 6):
            words[at] = f"v{i}x{at}"
        sets.append((i, [hash(x) % 2**62 for x in brute.shingles(" ".join(words))]))
    df = spark.createDataFrame(sets, "rep long, shingles array<long>")
    none = spark.createDataFrame([], "node long, component long")
    assert near_dup._paired(near_dup._rarest(df, none, 80), near_dup._rare_pairs, 80).count() == 0
