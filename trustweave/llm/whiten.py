"""Whitening of vectors along the leading eigenvectors of their covariance.

Components of a vector become whole numbers first (``floor(1024 c) + 100000``), so
their sums are exact.  The leading eigenvectors of the covariance V = XᵀX / n of the
centred numbers X come from subspace iteration with Chebyshev filters.  A pass
over the table gives Xᵀ(XQ) / n for a block Q of ``components + GUARD`` columns: each
task centres its rows, multiplies, and adds up, and only one matrix of the block's
size per task is shuffled.  A filter of degree d is d passes of the three-term
recurrence, scaled against overflow; it damps everything between the lower end of
the spectrum, which a few Lanczos steps estimate first, and the smallest Ritz
value of the block.  After each filter follow QR and a
Rayleigh-Ritz step, whose pass also gives the residuals |Vq - eq|.  The iteration
ends when the residuals of all wanted columns are certified to lie below
``TOLERANCE`` times the largest eigenvalue; an error by angle is that residual over
the gap to the block's first unwanted value.  If residuals stop falling above
``TOLERANCE`` (rounding), the best one counts if it is below ``ACCEPTED``.

The matrix V itself is never formed, and no task or driver holds more than a block.

Defined results: rows whose vector is null, empty, or holds null or non-finite
entries are left out; other rows stay, also without ``vec_id`` and if they repeat,
each once per component; vectors of different length are tables of their own, fewer
dimensions than components give as many as there are dimensions.  Components
along which nothing varies have eigenvalue 0: ``whitened`` is null, ``explained`` 0
(null if nothing varies at all), and they do not count in ``identity_error``.  Equal
eigenvalues: some basis of their space, the same for all rows.  Entries beyond 2^52
count as that; a ``deviation`` beyond a long is null.  An empty table gives an
empty one; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustweave.llm.shared import Scratch

COMPONENTS, GUARD = 8, 24
DEGREE, LANCZOS = 12, 12
TOLERANCE, ACCEPTED, ROUNDS = 1e-13, 1e-9, 60
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: An eigenvalue below this share of the largest one is rounding.
NOTHING = 1e-13


def prepared(table: DataFrame) -> DataFrame:
    """``vec_id, x`` (whole numbers) of the rows that take part."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    near = lambda c: F.greatest(F.least(c.cast("double"), F.lit(2.0**52)), F.lit(-(2.0**52)))
    rows = table.where(F.coalesce(finite & (F.size("embedding") > 0), F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: F.floor(1024 * near(c)).cast("long") + 100_000).alias("x"))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    column = batch.column("x")
    start = column.offsets.to_numpy()
    return column.values.to_numpy()[start[0]:start[-1]].reshape(-1, dim)


class Table:
    """The prepared rows of one length, and passes over them."""

    def __init__(self, rows: DataFrame, dim: int):
        self.dim = dim
        self.rows = rows.where(F.size("x") == dim)
        sums = self.rows.agg(F.count(F.lit(1)), *[F.sum(F.col("x")[i].cast("decimal(38,0)")) for i in range(dim)]).first()
        self.n, self.sums = sums[0], [int(s) for s in sums[1:]]
        self.mean = np.array([s / self.n for s in self.sums])

    def summed(self, shape: tuple[int, ...], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum of ``part`` over batches of centred rows; tasks add up their own."""
        dim, mean = self.dim, self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                if batch.num_rows:
                    total += part(_matrix(batch, dim) - mean)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["at", "value"])

        added = self.rows.select("x").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(int(np.prod(shape)))
        for r in added:
            out[r["at"]] = r["value"]
        return out.reshape(shape)

    def times(self, block: np.ndarray) -> np.ndarray:
        """V times a block."""
        return self.summed(block.shape, lambda x: x.T @ (x @ block)) / self.n


def _filtered(table: Table, block: np.ndarray, product: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of V times ``block``, small on [low, high] and 1 at ``top``; ``product`` is V times ``block``."""
    half, centre = (high - low) / 2, (high + low) / 2
    scale = first = half / (top - centre)
    before, now = block, (product - centre * block) * (scale / half)
    for _ in range(degree - 1):
        new = 1 / (2 / first - scale)
        before, now = now, (table.times(now) - centre * now) * (2 * new / half) - scale * new * before
        scale = new
    return now


def _lower_end(table: Table) -> float:
    """An estimate, from below, of the smallest eigenvalue of V: a Lanczos run's smallest Ritz value less its residual."""
    basis = np.random.default_rng(5).normal(size=(table.dim, 1))
    basis /= np.linalg.norm(basis)
    steps = min(LANCZOS, table.dim)
    diagonal, beside = [], []
    for _ in range(steps):
        new = table.times(basis[:, -1:])
        diagonal.append(float(basis[:, -1] @ new[:, 0]))
        for _ in range(2):  # against all before, twice, for rounding
            new -= basis @ (basis.T @ new)
        beside.append(float(np.linalg.norm(new)))
        if beside[-1] <= 1e-12 * max(diagonal):
            break
        basis = np.column_stack([basis, new / beside[-1]])
    off = beside[:len(diagonal) - 1]
    value, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    return max(0.0, float(value[0] - beside[-1] * abs(vectors[-1, 0])))


def leading(table: Table, components: int = COMPONENTS, guard: int = GUARD) -> tuple[np.ndarray, np.ndarray, float]:
    """Largest eigenvalues of V, falling, their unit eigenvectors as columns, and the largest residual."""
    wanted = min(components, table.dim)
    width = min(table.dim, wanted + guard)
    block = np.linalg.qr(np.random.default_rng(7).normal(size=(table.dim, width)))[0]
    best: tuple[np.ndarray, np.ndarray, float] | None = None
    stalled, low = 0, _lower_end(table) if width < table.dim else 0.0
    for _ in range(ROUNDS):
        product = table.times(block)
        inner = block.T @ product
        value, turn = np.linalg.eigh((inner + inner.T) / 2)
        value, turn = np.maximum(value[::-1], 0), turn[:, ::-1]
        block, product = block @ turn, product @ turn
        residual = float(np.linalg.norm(product - block * value, axis=0)[:wanted].max())
        if best is None or residual < best[2]:
            stalled = 0 if best is None or residual < best[2] / 2 else stalled + 1
            best = value[:wanted], block[:, :wanted], residual
        else:
            stalled += 1
        if residual <= TOLERANCE * value[0] or (stalled >= 2 and best[2] <= ACCEPTED * value[0]):
            return best
        if width == table.dim:  # the block spans everything: the next step only polishes
            block = np.linalg.qr(block)[0]
            continue
        # the damped part reaches up to the block's smallest value, and is no empty interval
        high = max(value[-1], low + value[0] * 1e-6)
        block = np.linalg.qr(_filtered(table, block, product, low, high, max(value[0], 2 * high - low), DEGREE))[0]
    raise ArithmeticError(f"no certified eigenvectors after {ROUNDS} rounds: residual {best[2]} of {best[0][0]}")


def whitened(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    scratch = Scratch(table.sparkSession, "whiten")
    rows = scratch.keep(prepared(table))
    out = None
    for length in sorted(r[0] for r in rows.select(F.size("x")).distinct().collect()):
        part = _whitened(Table(rows, length), components)
        out = part if out is None else out.unionByName(part)
    return rows.sparkSession.createDataFrame([], RESULT) if out is None else out


def _whitened(table: Table, components: int) -> DataFrame:
    value, axes, _ = leading(table, components)
    trace = float(table.summed((table.dim,), lambda x: (x * x).sum(axis=0)).sum()) / table.n
    varies = (value > NOTHING * max(value[0], 0)) & (trace > 0)
    project = np.where(varies, axes / np.sqrt(np.where(varies, value, 1)), 0)
    share = [float(v / trace) if ok else 0.0 if trace > 0 else None for v, ok in zip(value, varies)]
    # covariance of the whitened rows, centred on their own mean
    middle = table.summed((len(value),), lambda x: (x @ project).sum(axis=0)) / table.n

    def squares(x: np.ndarray) -> np.ndarray:
        w = x @ project - middle
        return w.T @ w

    off = table.summed((len(value),) * 2, squares) / table.n - np.eye(len(value))
    error = float(np.abs(off[varies][:, varies]).max()) if varies.any() else None
    n, sums, dim, mean = table.n, table.sums, table.dim, table.mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, dim)
            rows, k = len(x), len(value)
            white = (x - mean) @ project
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, n)), pa.array(np.repeat(np.array(_deviations(x, n, sums), object), k), pa.int64()),
                pa.array(white.ravel(), mask=np.tile(~varies, rows)), pa.array(share * rows, pa.float64()), pa.array([error] * (rows * k), pa.float64()),
            ], [c.split()[0] for c in RESULT.split(", ")])

    return table.rows.select("vec_id", "x").mapInArrow(run, RESULT)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)², exactly."""
    size = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums)))
    if len(sums) * (2 * size) ** 2 < 2**63:
        away = x * n - np.array(sums)
        return (away * away).sum(axis=1).tolist()
    out = []
    for row in x.tolist():
        total = sum((n * c - s) ** 2 for c, s in zip(row, sums))
        out.append(total if total < 2**63 else None)
    return out
