"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest

from trustweave.llm import near_vectors

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(ids, x, labels, cosine=0.98):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (y @ y.T >= cosine) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(near, low[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == low).all():
            return {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(axis=1), low)}
        low = new


def found(df):
    rows = df.collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows if r.vec_id is not None)
    assert len({r.vec_id for r in rows}) == len(rows)
    return {r.vec_id: (r.n_links, r.component_id) for r in rows}


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    expected = brute(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float), np.array([r.label for r in rows]))
    assert found(near_vectors.near_vectors(df)) == expected


@pytest.mark.parametrize("block, small", [(1024, 32), (64, 4)])
def test_dense_groups_chains_and_copies(spark, monkeypatch, block, small):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    draw = np.random.default_rng(block)
    centres = draw.normal(size=(12, 24))
    x = centres[draw.integers(0, 12, 900)] + 0.1 * draw.normal(size=(900, 24))  # cosines around 0.98
    x[:150] = x[0]  # copies
    angle = np.arange(60) * 0.15  # each near the next only
    x[150:210] = 0
    x[150:210, 0], x[150:210, 1] = np.cos(angle), np.sin(angle)
    x[600:] *= draw.uniform(1e-3, 1e3, (300, 1))
    labels = draw.integers(0, 2, 900)
    labels[150:210] = 5
    ids = draw.permutation(5000)[:900]
    df = spark.createDataFrame([(int(i), v.tolist(), int(l)) for i, v, l in zip(ids, x, labels)], SCHEMA)
    got, expected = found(near_vectors.near_vectors(df)), brute(ids, x, labels)
    links = sum(n for n, _ in expected.values())
    assert links > 20_000 and set(got) == set(expected)
    assert all(got[i][0] <= n for i, (n, _) in expected.items())
    assert sum(n for n, _ in got.values()) >= 0.999 * links
    assert np.mean([got[i][1] == c for i, (_, c) in expected.items()]) > 0.99


def test_pairs_at_the_threshold_are_found(spark):
    """2,000 pairs of cosine 0.9801: at most a few of 10,000 may be missed."""
    draw = np.random.default_rng(8)
    u = draw.normal(size=(2000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = draw.normal(size=(2000, 64))
    v -= (v * u).sum(axis=1, keepdims=True) * u
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    w = 0.9801 * u + np.sqrt(1 - 0.9801**2) * v
    rows = [(int(2 * i + k), m[i].tolist(), 1) for i in range(2000) for k, m in enumerate((u, w))]
    got = found(near_vectors.near_vectors(spark.createDataFrame(rows, SCHEMA)))
    assert sum(n == 0 for n, _ in got.values()) <= 4


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.01], 2), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1),
            (8, [float("nan"), 1.0], 1), (9, [float("inf"), 1.0], 1), (10, [1.0, 0.0], None), (11, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1),
            (12, [1.0, 0.0, 0.0], 1), (13, [1e200, 1e198], 1), (14, [1e-200, -0.0], 1), (15, None, None), (15, [3.0, 0.0], 1)]
    got = near_vectors.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    linked = {r.vec_id for r in got if r.component_id == 1}
    assert linked == {1, 2, 13, 14, 15} and {r.n_links for r in got if r.vec_id in linked} == {4}
    assert all(r.n_links == 0 and r.kept for r in got if r.vec_id not in linked) and len(got) == 17


def test_empty_and_alone(spark):
    assert near_vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert found(near_vectors.near_vectors(spark.createDataFrame([(7, [1.0], 0)], SCHEMA))) == {7: (0, 7)}


def test_one_row_per_class_leaves_a_unit(spark):
    draw = np.random.default_rng(2)
    x = 1 + 1e-3 * draw.normal(size=(400, 8))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    rows = near_vectors.prepared(df)
    from pyspark.sql import functions as F
    classes = rows.select(F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("weight"), "label", F.size("embedding").alias("dim"), "embedding")
    hashes, tables = near_vectors.sizes(400, 0.98)
    assert near_vectors.links(near_vectors.hashed(classes, hashes, tables), 0.98).count() <= 400 * tables
    assert set(found(near_vectors.near_vectors(df)).values()) == {(399, 0)}
