"""Whitening of vectors: leading components of their covariance by contour integration (FEAST).

Spark turns vectors into integers, drops repeats and sums: partial sums and partial
outer products leave each task as a few thousand numbers, whatever its rows, and are
added up by an aggregate. Only the covariance (dimension squared) reaches the driver.

There, inertia counts (signs of the pivots of ``V - s I``) place interval borders so
that every interval holds a few eigenvalues. For each, a quadrature of complex shifted
solves on a circle through the borders applies a filter that keeps the interval's
eigenvectors, and a Rayleigh-Ritz step on the filtered block extracts them; this is
repeated until the residuals are at rounding level. The number found must equal the
difference of the inertia counts, else the block grows and the interval is done anew.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import small_batches
from chronoweave.operators.staging import stage

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
NODES, CROWD, ROUNDS = 8, 8, 60
LARGEST = 2.0**44  # of a scaled entry
_FLAT = 1e-13  # eigenvalues below this share of the largest are rounding


# ---- the covariance's components, on a matrix of dimension squared ----

def inertia(v: np.ndarray, shift: float) -> tuple[int, float]:
    """Eigenvalues above ``shift``, by the signs of pivots of symmetric elimination; and the smallest pivot's size."""
    a = v - shift * np.eye(len(v))
    above, least = 0, math.inf
    scale = np.abs(a).max() or 1.0
    while len(a):
        k = int(np.argmax(np.abs(np.diag(a))))
        if abs(a[k, k]) < 1e-3 * np.abs(a).max():  # no fit single pivot: a block of two, which has one sign of each kind
            i, j = np.unravel_index(int(np.argmax(np.abs(np.triu(a, 1)))), a.shape)
            block = a[np.ix_([i, j], [i, j])]
            values = np.linalg.eigvalsh(block)
            above += int((values > 0).sum())
            least = min(least, float(np.abs(values).min()))
            rest = np.setdiff1d(np.arange(len(a)), [i, j])
            c = a[np.ix_(rest, [i, j])]
            a = a[np.ix_(rest, rest)] - c @ np.linalg.solve(block, c.T)
        else:
            p = a[k, k]
            above += int(p > 0)
            least = min(least, abs(float(p)))
            rest = np.delete(np.arange(len(a)), k)
            c = a[rest, k]
            a = a[np.ix_(rest, rest)] - np.outer(c, c / p)
    return above, least / scale


class Borders:
    """Counts of eigenvalues above places that are no eigenvalues themselves."""

    def __init__(self, v: np.ndarray):
        self.v = v
        self.top = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-9)  # Gershgorin: no eigenvalue above

    def at(self, place: float) -> tuple[float, int]:
        step = 1e-9 * self.top
        for k in range(40):
            above, least = inertia(self.v, place)
            if least > 1e-13:
                break
            place += step * (-1) ** k * (k + 1)
        return place, above

    def intervals(self, want: int) -> list[tuple[float, float, int]]:
        """``(low, high, count)`` from the top down that hold the ``want`` largest eigenvalues, ``CROWD`` at most each unless they coincide."""
        narrow = 1e-10 * self.top
        low, high = -0.01 * self.top, self.top
        under, over = len(self.v), 0
        while under > want + CROWD and high - low > narrow:  # a floor not far below the last one wanted
            mid, above = self.at((low + high) / 2)
            if above >= want:
                low, under = mid, above
            else:
                high, over = mid, above
        out, todo = [], [(low, under, self.top, 0)]
        while todo:
            a, na, b, nb = todo.pop()
            if na == nb:
                continue
            if na - nb <= CROWD or b - a <= narrow:
                out.append((a, b, na - nb))
                continue
            mid, n = self.at((a + b) / 2)
            todo += [(a, na, mid, n), (mid, n, b, nb)]
        return sorted(out, reverse=True)


def filtered(v: np.ndarray, block: np.ndarray, low: float, high: float, nodes: int = NODES) -> np.ndarray:
    """The block's part in the eigenvectors between ``low`` and ``high``: trapezoidal quadrature of shifted solves on the circle through both.

    Nodes come in conjugate pairs, so the upper half is solved and the real part taken.
    """
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(block)
    for k in range(nodes // 2):
        turn = np.exp(1j * np.pi * (2 * k + 1) / nodes)
        out += (2 * radius / nodes) * np.real(turn * np.linalg.solve((centre + radius * turn) * np.eye(len(v)) - v, block.astype(complex)))
    return out


def ritz(v: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz values and vectors of the space that a block spans."""
    q, _ = np.linalg.qr(block)
    q, _ = np.linalg.qr(q)
    small = q.T @ v @ q
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return values, q @ turn


def interval_pairs(v: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs between ``low`` and ``high``."""
    dim, size = len(v), min(len(v), count + count // 2 + 4)
    reach = max(high - low, 1e-9 * np.abs(v).max())
    low, high = (low + high - reach) / 2, (low + high + reach) / 2
    bound = 1e-14 * np.abs(v).max() * dim
    while True:
        block = np.random.default_rng([dim, size]).normal(size=(dim, size))
        best = math.inf
        for _ in range(ROUNDS):
            values, block = ritz(v, filtered(v, block, low, high))
            inside = (values > low) & (values <= high)
            rest = np.linalg.norm(v @ block - block * values, axis=0)[inside].max(initial=0.0)
            if inside.sum() == count and (rest <= bound / dim or (rest <= bound and rest >= best / 2)):
                return values[inside], block[:, inside]
            best = min(best, rest) if inside.sum() == count else math.inf
        if size == dim:
            raise ArithmeticError(f"{count} eigenvalues are between {low} and {high}, {inside.sum()} were found")
        size = min(dim, 2 * size)


def leading_pairs(v: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``want`` positive eigenvalues, falling, and their unit eigenvectors as columns.

    Fewer if the matrix has fewer above rounding level; none of a zero matrix.
    """
    if not len(v) or not np.abs(v).max():
        return np.zeros(0), np.zeros((len(v), 0))
    found = [interval_pairs(v, *i) for i in Borders(v).intervals(min(want, len(v)))]
    values, vectors = ritz(v, np.hstack([x for _, x in found]))  # one basis for all intervals
    order = np.argsort(-values, kind="stable")[:want]
    order = order[values[order] > _FLAT * values.max()]
    return values[order], vectors[:, order]


# ---- sums over rows, on Spark ----

def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_dim(batch: pa.RecordBatch):
    """Row numbers and matrix of each vector length in a batch."""
    sizes = np.diff(batch.column("x").offsets.to_numpy())
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield int(dim), at, _matrix(batch.column("x").take(pa.array(at)))


def _totals(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Vectors and exact sums per entry, by vector length."""

    def partial(batches):
        held: dict[int, list] = {}
        for b in batches:
            for dim, at, x in _by_dim(b):
                mine = held.setdefault(dim, [0, [0] * dim])
                mine[0] += len(at)
                mine[1] = [a + int(s) for a, s in zip(mine[1], x.sum(axis=0))]
        for dim, (n, sums) in held.items():
            yield pa.RecordBatch.from_pydict({"dim": [dim] * dim, "place": list(range(dim)), "n": [n] * dim, "total": [str(s) for s in sums]},
                                             pa.schema([("dim", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("total", pa.string())]))

    rows = fit.mapInArrow(partial, "dim int, place int, n long, total string").groupBy("dim", "place").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # a row per entry
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        out.setdefault(r.dim, (r.n, [0] * r.dim))[1][r.place] = int(r.total)
    return out


class Centre:
    """Exact centring of integer vectors: n x - S without large products."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """``n x - S``, exact: as int64, or as Python integers where that could overflow."""
        y = x - self.base
        if len(y) and float(np.abs(y).max()) * self.n >= 2.0**62:
            y = y.astype(object)
        return y * self.n - self.rest

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x).astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of squares of ``n x - S``; null if it is beyond a long."""
        d = self.scaled(x)
        if d.dtype != object and (not d.size or float(np.abs(d).max()) ** 2 * d.shape[1] < 2.0**62):
            return (d * d).sum(axis=1).tolist()
        return [s if s < 2**63 else None for s in (sum(int(c) ** 2 for c in row) for row in d)]


def _second_moments(fit: DataFrame, centres: dict[int, Centre], axes: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Covariance of the centred vectors projected on ``axes``, divisor n, by vector length."""

    def partial(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, _, x in _by_dim(b):
                if dim in axes:
                    y = centres[dim].centred(x) @ axes[dim]
                    held[dim] = held.get(dim, 0.0) + y.T @ y
        for dim, m in held.items():
            k = len(m)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k * k, dim, np.int32)), pa.array(np.arange(k * k, dtype=np.int32)), pa.array(m.ravel())], ["dim", "place", "part"])

    rows = fit.mapInArrow(partial, "dim int, place int, part double").groupBy("dim", "place").agg(F.sum("part").alias("part")).collect()  # dimension squared
    out = {d: np.zeros((a.shape[1], a.shape[1])) for d, a in axes.items()}
    for r in rows:
        out[r.dim].flat[r.place] = r.part / centres[r.dim].n
    return out


def whitened(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per row and component.

    Rows whose vector is null or holds null or non-finite entries (or entries beyond
    ``LARGEST / SCALE``, which no sum could hold exactly) are left out. Repeated rows
    stay and get equal values; the covariance counts a vector once. Vectors of
    different lengths are whitened apart. Components of no variance do not exist: a
    table of equal vectors, of empty vectors, or an empty table gives no rows. A null
    vec_id stays null. Extra columns are ignored.
    """
    c = F.col(vector).cast("array<double>")
    sound = F.col(vector).isNotNull() & F.forall(c, lambda e: F.coalesce(F.abs(e * SCALE) < LARGEST, F.lit(False)))  # NaN is larger than any number
    rows = small_batches(vectors).where(sound).select(F.col(vec_id).alias("vec_id"), F.transform(c, lambda e: F.floor(e * SCALE).cast("long") + SHIFT).alias("x"))
    rows = stage(rows, "vectors")
    fit = stage(rows.select("x").distinct(), "fit")
    totals = _totals(fit)
    centres = {d: Centre(n, sums) for d, (n, sums) in totals.items()}
    covariance = _second_moments(fit, centres, {d: np.eye(d) for d in totals})
    axes, share = {}, {}
    for d, v in covariance.items():
        values, basis = leading_pairs((v + v.T) / 2, components)
        if len(values):
            axes[d], share[d] = basis / np.sqrt(values), values / np.trace(v)
    error = {d: float(np.abs(w - np.eye(len(w))).max()) for d, w in _second_moments(fit, centres, axes).items()}
    kind = rows.schema["vec_id"].dataType.simpleString()

    def project(batches):
        for b in batches:
            for dim, at, x in _by_dim(b):
                if dim not in axes:
                    continue
                k, m = axes[dim].shape[1], len(at)
                y = centres[dim].centred(x) @ axes[dim]
                ids = b.column("vec_id").take(pa.array(np.repeat(at, k)))
                deviation = pa.array(centres[dim].deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, centres[dim].n)), deviation,
                                                  pa.array(y.ravel()), pa.array(np.tile(share[dim], m)), pa.array(np.full(m * k, error[dim]))],
                                                 ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
