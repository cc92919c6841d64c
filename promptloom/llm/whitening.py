"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

Entries are put on a grid of integers, ``x = floor(1024 * c) + 100000``, so that the sums S of each
dimension and the scatter are exact whatever the order in which tasks finish, and a job that is run
again gives the same bits.  The scatter is taken of ``y = x - round(S / n)`` and moved to the exact
mean by the fraction that is left, at most half a unit, so nothing large is ever subtracted.

The covariance V of d dimensions (d numbers squared, however many rows there are) goes to the
driver.  There ``V = L L'`` by Cholesky with pivoting, which stops at the rank; Jacobi rotations make the
columns of L orthogonal without forming ``L'L``.  What the columns are then long, squared, are the
eigenvalues, their directions the components.  The rotations run in rounds of disjoint pairs of columns.

Jobs over the rows: dimensions and sums, scatter, covariance of the result, the result itself.

Defined results: a null vector, an empty one, and one with a null or non-finite entry are left out, as
are vectors that have not the most frequent number of entries (the smaller one of ties).  Repeated rows
count and come back as often as they stand there, null ids like others.  There are as many components as
the covariance has rank, up to the number asked for: none, and no rows, for an empty table or equal
vectors.  An entry that leaves the grid (``abs(x)`` of 2^40 or more) is an error.  ``deviation`` is null where
the number is no long; ``deviation_exact`` always holds it.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
#: Grid entries stay below this, so that a row's products are exact.
WIDEST = 1 << 40
#: Products of doubles and their sums are exact below this.
EXACT = 1 << 53

#: A column of the factor counts as orthogonal to another below this cosine.
TOLERANCE = 1e-15
SWEEPS = 60

Batches = Iterator[pa.RecordBatch]


@dataclass
class Whitening:
    """``n`` vectors with sums ``sums``, trace of their covariance, components by falling eigenvalue."""

    n: int
    sums: list[int]
    trace: float
    eigenvalues: np.ndarray
    components: np.ndarray

    def __post_init__(self):
        self.nearest = [(2 * s + self.n) // (2 * self.n) for s in self.sums] if self.n else []
        rest = [float(Fraction(s, self.n) - r) for s, r in zip(self.sums, self.nearest, strict=True)] if self.n else []
        self.rest = np.array(rest)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n``: an exact difference of integers first."""
        return (x - np.array(self.nearest, np.int64)).astype(np.float64) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum of ``(n x - S)^2`` of each row, exactly."""
        if not len(x):
            return []
        sums = np.array(self.sums, dtype=object)
        reach = self.n * int(np.abs(x).max()) + max(abs(s) for s in self.sums)
        if reach * reach * x.shape[1] < 1 << 62:
            apart = self.n * x - sums.astype(np.int64)
            return (apart * apart).sum(axis=1).tolist()
        apart = x.astype(object) * self.n - sums
        return [int((row * row).sum()) for row in apart]


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with ``v = L L'`` and as many columns as ``v`` has rank; the largest pivot goes first."""
    d = v.shape[0]
    factor, left = np.zeros((d, d)), np.diag(v).copy()
    floor = d * np.finfo(float).eps * left.max(initial=0.0)
    for k in range(d):
        pivot = int(np.argmax(left))
        if left[pivot] <= floor:
            return factor[:, :k]
        column = (v[:, pivot] - factor[:, :k] @ factor[pivot, :k]) / np.sqrt(left[pivot])
        column[left == 0.0] = 0.0
        factor[:, k] = column
        left = np.maximum(left - column * column, 0.0)
        left[pivot] = 0.0
    return factor


def _rounds(width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of columns once, in rounds of disjoint pairs; an odd number of columns gets an idle one."""
    even = width + width % 2
    ring = list(range(even))
    for _ in range(even - 1):
        pairs = [(a, b) for a, b in zip(ring[: even // 2], reversed(ring[even // 2 :]), strict=True) if max(a, b) < width]
        yield np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (as columns) of ``factor @ factor.T``."""
    a = factor.copy()
    rounds = [r for r in _rounds(a.shape[1]) if r[0].size]
    for _ in range(SWEEPS):
        worst = 0.0
        for p, q in rounds:
            left, right = a[:, p], a[:, q]
            alpha, beta = (left * left).sum(axis=0), (right * right).sum(axis=0)
            gamma = (left * right).sum(axis=0)
            size = np.sqrt(alpha * beta)
            cosine = np.abs(gamma) / np.where(size > 0, size, 1.0)
            worst = max(worst, float(cosine.max()))
            turn = cosine > TOLERANCE
            zeta = (beta - alpha) / (2.0 * np.where(turn, gamma, 1.0))
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = np.where(turn, 1.0 / np.hypot(1.0, t), 1.0)
            s = np.where(turn, c * t, 0.0)
            a[:, p], a[:, q] = c * left - s * right, s * left + c * right
        if worst <= TOLERANCE * max(1, a.shape[0]):
            break
    norms = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return norms[order] ** 2, a[:, order] / norms[order]


def _vectors(df: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """``id, v`` of the vectors that take part, and how many entries they have."""
    v = F.col(vector_column).cast("array<double>")
    rows = df.select(F.col(id_column).alias("id"), v.alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), "d").first()
    dimensions = common.d if common else 0
    return rows.filter(F.size("v") == dimensions), dimensions


def _grid(batch: pa.RecordBatch, d: int) -> np.ndarray:
    entries = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
    x = np.floor(SCALE * entries) + SHIFT
    if x.size and np.abs(x).max() >= WIDEST:
        raise ValueError("an entry is too large for the grid of integers")
    return x.astype(np.int64).reshape(-1, d)


def _sums(d: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            x = _grid(batch, d)
            if len(x):
                # below 2^40 each, so a batch's sums are longs
                yield pa.record_batch([pa.array(range(-1, d), pa.int32()), pa.array([len(x), *x.sum(axis=0).tolist()], pa.int64())], names=["k", "s"])

    return run


def _products(d: int, centre: list[int]) -> Callable[[Batches], Batches]:
    middle = np.array(centre, np.int64)

    def run(batches: Batches) -> Batches:
        upper = np.triu_indices(d)
        total = np.zeros(upper[0].size, dtype=object)
        for batch in batches:
            y = _grid(batch, d) - middle
            reach = int(np.abs(y).max(initial=0))
            step = max(1, EXACT // (reach * reach + 1))
            if reach * reach >= EXACT:
                for row in y.astype(object):
                    total += row[upper[0]] * row[upper[1]]
                continue
            for at in range(0, len(y), step):
                part = y[at : at + step].astype(np.float64)
                total += (part.T @ part)[upper].astype(np.int64)
        products = pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))  # they may be no longs
        yield pa.record_batch([pa.array(range(total.size), pa.int32()), products], names=["k", "p"])

    return run


def _moments(d: int, shipped) -> Callable[[Batches], Batches]:
    """Of each task's whitened rows: number, means, centred products, and products of the means."""

    def run(batches: Batches) -> Batches:
        model: Whitening = shipped.value
        width = model.components.shape[1]
        n, mean, scatter = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            w = model.whitened(_grid(batch, d))
            if not len(w):
                continue
            own = w.mean(axis=0)
            apart, shift = w - own, own - mean
            scatter += apart.T @ apart + np.outer(shift, shift) * (n * len(w) / (n + len(w)))
            mean += shift * (len(w) / (n + len(w)))
            n += len(w)
        values = np.concatenate([n * mean, (scatter + n * np.outer(mean, mean)).ravel()])
        yield pa.record_batch([pa.array(range(values.size), pa.int32()), pa.array(values, pa.float64())], names=["k", "v"])

    return run


def fit(rows: DataFrame, d: int, components: int) -> Whitening:
    """The whitening of ``rows`` (``id, v`` with ``d`` entries each)."""
    if not d:
        return Whitening(0, [], 0.0, np.zeros(0), np.zeros((0, 0)))
    only = rows.select("v")
    found = dict(only.mapInArrow(_sums(d), "k int, s bigint").groupBy("k").agg(F.sum(F.col("s").cast("decimal(38, 0)"))).collect())
    n, sums = int(found[-1]), [int(found[k]) for k in range(d)]
    centre = Whitening(n, sums, 0.0, np.zeros(0), np.zeros((0, 0)))
    scatter = only.mapInArrow(_products(d, centre.nearest), "k int, p decimal(38, 0)").groupBy("k").agg(F.sum("p"))
    upper = np.triu_indices(d)
    v = np.zeros((d, d))
    for k, product in scatter.collect():
        i, j = int(upper[0][k]), int(upper[1][k])
        rest_i, rest_j = (Fraction(sums[m], n) - centre.nearest[m] for m in (i, j))
        v[i, j] = v[j, i] = float(Fraction(int(product), n) - rest_i * rest_j)
    values, directions = one_sided_jacobi(pivoted_cholesky(v))
    return Whitening(n, sums, float(np.trace(v)), values[:components], directions[:, :components])


def whiten(
    df: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 8
) -> DataFrame:
    """A row for each vector and component: id, component (from 1), n, deviation, whitened, explained,
    identity_error, deviation_exact."""
    rows, d = _vectors(df, id_column, vector_column)
    model = fit(rows, d, components)
    width = model.components.shape[1] if d else 0
    shipped = df.sparkSession.sparkContext.broadcast(model)  # d sums and d x components numbers
    error = 0.0
    if width:
        found = rows.select("v").mapInArrow(_moments(d, shipped), "k int, v double").groupBy("k").agg(F.sum("v")).collect()
        moments = np.array([value for _, value in sorted(found)]) / model.n
        means, products = moments[:width], moments[width:].reshape(width, width)
        error = float(np.abs(products - np.outer(means, means) - np.eye(width)).max())
    explained = (model.eigenvalues / model.trace).tolist() if width else []

    def run(batches: Batches) -> Batches:
        model: Whitening = shipped.value
        for batch in batches:
            x = _grid(batch, d) if width else np.zeros((0, d))
            if not len(x):
                continue
            exact = model.deviations(x)
            place = np.repeat(np.arange(len(x)), width)
            longs = pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())
            texts = pa.array([str(e) for e in exact], pa.string())
            many = len(place)
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(place)), pa.array(np.tile(np.arange(1, width + 1), len(x)), pa.int32()),
                    pa.array(np.full(many, model.n)), longs.take(pa.array(place)), pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(explained, len(x))), pa.array(np.full(many, error)), texts.take(pa.array(place)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error", "exact"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(
        run, f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, exact string"
    )
    return made.select(
        F.col("id").alias(id_column), "component", "n", "deviation", "whitened", "explained", "identity_error",
        F.col("exact").cast("decimal(38, 0)").alias("deviation_exact"),
    )
