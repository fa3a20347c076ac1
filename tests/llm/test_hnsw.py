"""Nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from trustweave.llm import hnsw


def brute(ids, x, queries, k):
    out = {}
    for i in queries:
        others = ids != ids[i]
        score = x[others] @ x[i]
        order = np.lexsort((ids[others], -score))[:k]
        out[int(ids[i])] = list(zip(ids[others][order].tolist(), score[order].tolist()))
    return out


def results(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(found, expected):
    assert set(found) == set(expected)
    return np.mean([len({v for v, _ in found[q]} & {v for v, _ in expected[q]}) / len(expected[q]) for q in expected])


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    expected = brute(ids, x, np.flatnonzero(ids % 20 == 0), 20)
    for size in (8192, 300):
        found = results(hnsw.search_table(df, F.col("vec_id") % 20 == 0, 20, size))
        assert recall(found, expected) >= 0.97
        for q, hits in found.items():
            exact = {v: s for v, s in zip(ids.tolist(), x @ x[np.flatnonzero(ids == q)[0]])}
            assert all(abs(s - exact[v]) < 1e-12 for v, s in hits)


def test_recall_on_clusters_and_lengths(spark):
    """Tight clusters, copies in thousands, and vectors of very different length."""
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(30, 16))
    x = centres[draw.integers(0, 30, 3000)] + 0.05 * draw.normal(size=(3000, 16))
    x[:1000] = x[0]
    x[2000:] *= draw.uniform(0.1, 5, (1000, 1))
    ids = np.arange(3000)
    expected = brute(ids, x, np.flatnonzero(ids % 20 == 0), 20)
    df = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in zip(ids, x)], "vec_id long, embedding array<double>, score string")
    found = results(hnsw.search_table(df, F.col("vec_id") % 20 == 0, 20, 1500))
    assert recall(found, expected) >= 0.95
    assert found[0] == [(i, s) for i, s in expected[0]] or recall({0: found[0]}, {0: expected[0]}) >= 0.9


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.0, 2.0]), (40, None), (60, []), (80, [0.0, 0.0]), (100, [1.0, None]), (120, [float("nan"), 1.0]),
            (140, [float("inf"), 1.0]), (None, [1.0, 1.0]), (1, [3.0, 1.0]), (2, [3.0, 1.0]), (3, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = results(hnsw.search_table(df, F.col("vec_id") % 20 == 0, 20))
    assert found == {0: [(1, 3.0), (2, 3.0), (20, 0.0)], 20: [(1, 2.0), (2, 2.0), (0, 0.0)]}
    assert hnsw.search_table(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_small_shards_find_everything(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i), 1.0]) for i in range(15)], "vec_id long, embedding array<float>")
    found = results(hnsw.search_table(df, F.col("vec_id") % 20 == 0, 20, 5))
    assert len(found[0]) == 14
