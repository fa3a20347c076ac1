"""Repeated passages: windows against a plain tree, planted passages, clean texts left alone."""

import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm import brute
from trustweave.llm import passages as P
from trustweave.llm.shared import Scratch


def tree(v, lo, hi, span, out):
    if hi - lo < span:
        return
    c = lo + min(range(hi - lo), key=lambda i: v[lo + i])
    out.add((c, lo, hi - 1))
    tree(v, lo, c, span, out)
    tree(v, c + 1, hi, span, out)


def test_windows_are_the_cartesian_tree():
    draw = random.Random(3)
    for _ in range(60):
        texts = [[draw.randrange(1, draw.choice([5, 10**9])) for _ in range(draw.randrange(60))] for _ in range(draw.randrange(1, 5))]
        flat, expected = [], set()
        span = draw.choice([1, 2, 3, 7, 16, 17])
        for t in texts:
            found = set()
            tree(t, 0, len(t), span, found)
            expected |= {tuple(x + len(flat) for x in w) for w in found}
            flat += [*t, 0]
        c, l, r = P.compact_windows(np.array(flat, np.uint64), span)
        assert set(zip(c.tolist(), l.tolist(), r.tolist())) == expected


def corpus():
    draw = random.Random(9)
    text = lambda n: ["w%d" % draw.randrange(5000) for _ in range(n)]
    shared = {k: text(n) for k, n in (("a", 60), ("b", 51), ("c", 120), ("short", 30), ("d", 400))}
    holders = {"a": 40, "b": 3, "c": 2, "short": 6, "d": 5}
    rows, planted = [], {}
    for name, n in holders.items():
        for _ in range(n):
            before = text(draw.randrange(5, 300))
            passage = list(shared[name])
            if name == "d":
                for _ in range(4):
                    passage[draw.randrange(len(passage))] = "edited"
            words = before + passage + text(draw.randrange(5, 300))
            i = 100 + len(rows)
            if name != "short":
                planted[i] = (name, len(before), len(before) + len(passage))
            rows.append((i, " ".join(words).capitalize()))
    rows += [(1000 + i, " ".join(text(200))) for i in range(40)]
    copy = " ".join(text(150))
    rows += [(2000 + i, copy) for i in range(30)]
    planted |= {2000 + i: ("copy", 0, 150) for i in range(30)}
    return rows, planted


def test_planted_passages_are_found(spark):
    rows, planted = corpus()
    odd = [(-i - 1, t) for i, t in enumerate(brute.ODD)] + [(None, rows[0][1]), (99, None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string").repartition(6)
    found = P.repeated_passages(df).collect()
    groups = {}
    for i, (name, s, e) in planted.items():
        groups.setdefault(name, []).append(i)
    first = {min(ids) for ids in groups.values()}
    hit = {}
    for r in found:
        assert r.doc_id > r.source_doc_id and planted[r.doc_id][0] == planted[r.source_doc_id][0]
        hit.setdefault(r.doc_id, []).append((r.start, r.end))
    assert set(hit) == set(planted) - first
    for i, spans in hit.items():
        name, s, e = planted[i]
        if name == "d":
            assert all(s - 30 <= a and b <= e + 30 for a, b in spans) and max(b - a for a, b in spans) >= 200
        else:
            assert spans == [(s, e)], (i, name)
    cut = {r.doc_id: r for r in P.without_passages(df.withColumn("n_chars", F.length("text")).withColumn("cuts", F.lit(1))).where("doc_id >= 100").collect()}
    texts = dict(rows)
    assert set(cut) == {i for i in texts if not (2000 < i < 2030)}
    for i, r in cut.items():
        words = texts[i].split()
        if i in hit and planted[i][0] != "d":
            _, s, e = planted[i]
            words = words[:s] + words[e:]
        if i not in hit or planted[i][0] != "d":
            assert (r.text or "").split() == words and r.n_chars == len(r.text)


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.repeated_passages(empty).count() == 0 and P.without_passages(empty).count() == 0
    twice = " ".join(f"x{i}" for i in range(80))
    one = spark.createDataFrame([(1, twice + " " + twice), (1, twice)], "doc_id long, text string")
    assert P.repeated_passages(one).count() == 0


def shingled(words):
    return np.array([hash(tuple(words[i:i + 5])) & (2**63 - 1) for i in range(len(words) - 4)], np.uint64)


def found_in(source, words):
    a, b = shingled(source), shingled(words)
    return sorted(P.passages_of(a, b, [[0, 0, len(a) - 1, 0, len(b) - 1]], 1))


def test_changed_words_in_short_passages():
    text = lambda name, n: [f"{name}{i}" for i in range(n)]
    for n in (51, 55, 60, 70, 80):
        source = text("x", 30) + text("p", n) + text("y", 30)
        for places in [(i,) for i in range(n)] + [(i, j) for i in range(n) for j in range(i + 1, min(n, i + 9))]:
            passage = text("p", n)
            for i in places:
                passage[i] = "changed"
            words = text("v", 20) + passage + text("w", 20)
            hits = [source[i] == w for i, w in zip(range(30, 30 + n), passage)]
            a, b = set(shingled(text("p", n)).tolist()), set(shingled(passage).tolist())
            found = found_in(source, words)
            if len(a & b) / len(a | b) >= 0.8 and all(hits[:5]) and all(hits[-5:]):
                assert found and found[0][1] - found[0][0] >= 50, (n, places)


def test_stretches_with_gaps_in_the_source():
    text = lambda name, n: [f"{name}{i}" for i in range(n)]
    for here, there in ((0, 30), (5, 25), (8, 300)):
        source = text("a", 60) + text("x", there) + text("b", 60)
        words = text("v", 20) + text("a", 60) + text("y", here) + text("b", 60) + text("w", 20)
        assert [f[:4] for f in found_in(source, words)] == [(20, 80, 0, 60), (80 + here, 140 + here, 60 + there, 120 + there)]
    source, words = text("a", 100) + text("x", 60) + text("b", 100), text("a", 100) + text("b", 100)
    assert [f[:4] for f in found_in(source, words)] == [(0, 100, 0, 100), (100, 200, 160, 260)]


def repeated_words(texts):
    """Brute force: words of each document in a 50-word stretch that a smaller document has."""
    first = {}
    for i in sorted(texts):
        for at in range(len(texts[i]) - 49):
            first.setdefault(tuple(texts[i][at:at + 50]), i)
    return {i: {at + k for at in range(len(w) - 49) if first[tuple(w[at:at + 50])] < i for k in range(50)} for i, w in texts.items()}


def test_parts_in_other_documents_hide_no_passage(spark):
    draw = random.Random(4)
    text = lambda n: ["w%d" % draw.randrange(3000) for _ in range(n)]
    texts, i = {}, 0
    for _ in range(60):
        passage = text(draw.randrange(50, 80))
        parts = [passage[at:at + 49] for at in range(0, len(passage), 2)]
        for words in [*[text(30) + p + text(draw.randrange(60)) for p in parts], *[text(draw.randrange(90)) + passage + text(40) for _ in range(3)]]:
            texts[i] = words
            i += 1
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(5)
    covered = {i: set() for i in texts}
    for r in P.repeated_passages(df).collect():
        covered[r.doc_id] |= set(range(r.start, r.end))
        a, b = set(shingled(texts[r.source_doc_id][r.source_start:r.source_end]).tolist()), set(shingled(texts[r.doc_id][r.start:r.end]).tolist())
        assert r.source_doc_id < r.doc_id and abs(len(a & b) / len(a | b) - r.similarity) < 1e-9 and r.similarity >= 0.8
    expected = repeated_words(texts)
    assert sum(map(bool, expected.values())) == 120
    assert all(expected[i] <= covered[i] for i in texts)


def test_given_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL")
    texts = {r.doc_id: brute.words(r.text) for r in docs.select("doc_id", "text").collect()}
    covered = {i: set() for i in texts}
    for r in P.repeated_passages(docs).collect():
        covered[r.doc_id] |= set(range(r.start, r.end))
    expected = repeated_words(texts)
    assert any(expected.values())
    missed = sum(len(w - covered[i]) for i, w in expected.items())
    assert missed == 0


def test_stretches_by_min_hash():
    s = np.random.default_rng(1).integers(1, 99, 200).astype(np.uint64)
    v = (P.mixed((s | np.uint64(1)) * P._FACTORS[0]) | np.uint64(1)).tolist()
    least = [min(v[a:a + P.SPAN]) for a in range(len(v) - P.SPAN + 1)]
    wanted = set(least[::40])
    starts, keys = P.blocks_of(s, np.array(sorted(wanted), np.uint64))
    assert starts.tolist() == [a for a, x in enumerate(least) if x in wanted]
    assert len(set(keys.tolist())) == len({tuple(s[a:a + P.SPAN].tolist()) for a in starts})


def test_documents_are_read_and_shuffled_once_for_all_rounds(spark, tmp_path, monkeypatch):
    rows, _ = corpus()
    at = str(tmp_path / "documents")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(at)
    tables, scans = set(spark.catalog.listTables()), []
    for name in ("keep", "keep_by"):
        def spied(self, df, *a, keep=getattr(Scratch, name)):
            scans.append(any(at in f for f in df.inputFiles()))
            return keep(self, df, *a)
        monkeypatch.setattr(Scratch, name, spied)
    assert P.repeated_passages(spark.read.parquet(at)).count() > 0
    assert sum(scans) == 2  # once for windows, once to deal the texts out
    assert set(spark.catalog.listTables()) == tables


def test_buckets_spare_a_shuffle(spark):
    scratch = Scratch(spark, "buckets", tidy=True)
    texts = scratch.keep_by(spark.range(1000).selectExpr("id AS doc", "repeat('x', 100) AS text"), "doc")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        both = spark.range(500).selectExpr("id * 2 AS doc").join(texts, "doc")
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and both.count() == 500
    finally:
        spark.conf.set(key, before)
    scratch.free(texts)


def test_windows_survive_their_packing():
    least, most = -2**31, 2**31 - 1
    c, l, r = np.array([5, 0, 2**30]), np.array([0, 0, 2**30 - 7]), np.array([50, 0, 2**30 + 9])
    function, many, right, left = np.array([4, 0, 3]), np.array([True, False, True]), np.array([least, most, -1]), np.array([-1, least, 7])
    dense = P.packed_windows(np.array([-1, 2, least]), np.array([7, -8, 2**62]), function, c, l, r, right.astype(np.int32), left.astype(np.int32), many)
    back = P._spread(dense)
    for name, x in zip("hash c l r right left many".split(), (function, c, l, r, right, left, many)):
        assert back.column(name).to_pylist() == x.tolist(), name
