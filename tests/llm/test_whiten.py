"""Whitening against a dense eigensolver."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustweave.llm import whiten


def expected(x):
    """Whole numbers of vectors, their covariance's eigenvalues and eigenvectors, falling, and exact deviations."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in row] for row in x], dtype=np.int64)
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    value, axes = np.linalg.eigh(centred.T @ centred / n)
    deviations = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x]
    return centred, value[::-1], axes[:, ::-1], deviations


def held(rows, x, components=8):
    centred, value, axes, deviations = expected(x)
    k = min(components, x.shape[1])
    white = centred @ axes[:, :k] / np.sqrt(value[:k])
    assert len(rows) == len(x) * k
    assert {r.n for r in rows} == {len(x)} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error <= 1e-9
    got = np.full((len(x), k), np.nan)
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == deviations[r.vec_id]
        assert abs(r.explained / (value[r.component - 1] / value.sum()) - 1) < 1e-10
    for c in range(k):
        sign = np.sign(got[:, c] @ white[:, c])
        assert np.abs(sign * got[:, c] - white[:, c]).max() < 1e-7


@pytest.mark.parametrize("dim", [3, 12, 64, 90])
def test_drawn_vectors(spark, dim):
    draw = np.random.default_rng(dim)
    x = (draw.normal(size=(700, dim)) * draw.uniform(0.2, 1, dim)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "vec_id long, embedding array<float>, n string").repartition(4)
    held(whiten.whitened(df).collect(), x)


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    assert [r.vec_id for r in rows] == list(range(len(rows)))
    held(whiten.whitened(df).collect(), np.array([r.embedding for r in rows]))


def test_close_and_equal_eigenvalues(spark):
    draw = np.random.default_rng(3)
    axes = np.linalg.qr(draw.normal(size=(400, 40)))[0]  # orthogonal columns of equal length
    x = axes * 20 * np.r_[np.full(12, 1.0), np.full(28, 0.995)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    value, vectors, residual = whiten.leading(whiten.Table(whiten.prepared(df), 40))
    centred, exact, _, _ = expected(x)
    assert np.abs(value / exact[:8] - 1).max() < 1e-9 and residual <= 1e-9 * value[0]
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (None, [0.0, 1.0]), (2, [2.0, 5.0]), (2, [2.0, 5.0]), (3, None), (4, []), (5, [1.0, None]), (6, [float("nan"), 1.0]),
            (7, [float("inf"), 1.0]), (8, [0.0, 0.0]), (9, [1.0, 2.0, 3.0]), (10, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = whiten.whitened(df).collect()
    pairs = [r for r in out if r.n == 5]
    assert sorted(str(r.vec_id) for r in pairs) == sorted(["1", "None", "2", "2", "8"] * 2) and all(r.identity_error < 1e-9 for r in pairs)
    same = [r for r in out if r.n == 2]  # nothing varies
    assert len(same) == 6 and all((r.whitened, r.explained, r.identity_error, r.deviation) == (None, None, None, 0) for r in same)
    assert whiten.whitened(df.where("vec_id > 100")).count() == 0


def test_line_and_large_entries(spark):
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(6)], "vec_id long, embedding array<double>")
    out = whiten.whitened(line).collect()
    assert {r.component for r in out if r.whitened is not None} == {1} and {r.explained for r in out if r.component > 1} == {0.0}
    assert out[0].identity_error < 1e-9
    large = spark.createDataFrame([(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [3e18, 2.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whiten.whitened(large).collect()} == {None}


def test_no_matrix_beyond_a_block_leaves_a_task(spark):
    """What is shuffled per task is one row per entry of the block."""
    df = spark.range(1000).select(F.col("id").alias("vec_id"), F.array(*[F.rand(i).cast("float") for i in range(20)]).alias("embedding"))
    table = whiten.Table(whiten.prepared(df), 20)
    assert table.times(np.eye(20)[:, :3]).shape == (20, 3)
