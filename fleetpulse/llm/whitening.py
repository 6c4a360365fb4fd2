"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Rows become integers (``1024 * c`` rounded down, plus 100,000) and lie in blocks of bounded size.
One step of the bidiagonalisation is two passes over the centred rows X: ``Xv`` with its
products by all earlier left vectors, which takes these out of it, and ``Xᵀu``, which is then
cleared of all earlier right vectors. A left vector has an entry a row, so it is never held: as
all are combinations of X's columns, each is kept as the weights that give a row's entry from
the row. The driver holds only vectors as long as a row, and one partial sum from each of at
most ``AT_ONCE`` tasks; more partials are summed by tasks before.

The small bidiagonal matrix gives singular values and right vectors. Steps go on until the
residuals of the wanted ones vanish. One start vector finds each value once, so further runs,
orthogonal to what is found, go on until none of them gives a value as large as those wanted.

Rows whose vector is null or holds a null or non-finite entry are left out, as are vectors of
another length than the most frequent one (of equally frequent ones, the longest). Entries
saturate at about ±2^45. Repeated rows and null ids are rows as any other. Components without
variance (singular value at most ``FLAT`` of the greatest) are not given, so equal rows, one row
or an empty table give no rows. Deviations beyond a long are null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import columns_as, summed
from fleetpulse.session import stage

#: Entries of a block of rows, and partial sums that the driver adds up.
ENTRIES, AT_ONCE = 2**17, 32
#: Residual of a settled singular vector, and value of one without variance, over the greatest.
SETTLED, FLAT = 1e-15, 1e-9
SCALE, SHIFT = 1024, 100_000
_MOST = 2.0**45
_LOW = 20
_LONG = 2**63 - 1


@dataclass(frozen=True)
class Whitening:
    """Sums over all rows, and components (rows of ``axes``) with their eigenvalues."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean()) @ self.axes.T) / np.sqrt(self.values)


def blocks(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Integer rows in blocks: their ids, and the entries row by row."""
    rows = columns_as(embeddings, vec_id=id_col, vector=vector_col).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("vector").cast("array<double>").alias("vector"),
    )
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = rows.where(F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))
    sizes = whole.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    dims = most.size if most else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = max(1, ENTRIES // max(dims, 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            scaled = np.clip(np.floor(flat * SCALE), -_MOST, _MOST).astype(np.int64) + SHIFT
            held = scaled.reshape(batch.num_rows, dims)
            for start in range(0, batch.num_rows, each):
                part = np.ascontiguousarray(held[start : start + each])
                ids = pa.array([batch.column("vec_id").slice(start, len(part)).to_pylist()], pa.list_(pa.int64()))
                data = pa.array([part.tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, data], ["ids", "x"])

    same = whole.where(F.size("vector") == dims) if dims else whole.where(F.lit(False))
    return same.mapInArrow(run, "ids array<bigint>, x binary")


def _entries(batch: pa.RecordBatch, i: int) -> tuple[list, np.ndarray]:
    ids = batch.column("ids")[i].as_py()
    x = np.frombuffer(batch.column("x")[i].as_buffer(), np.int64)
    return ids, x.reshape(len(ids), -1)


class Rows:
    """Written blocks, and sums over them."""

    def __init__(self, written: DataFrame):
        self._x = written.select("ids", "x")

    def summed(self, partial: Callable[[np.ndarray], np.ndarray], dtype=np.float64) -> np.ndarray | None:
        """The sum of ``partial`` over all blocks."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield partial(_entries(batch, i)[1])

        return summed(self._x, each, dtype, AT_ONCE)


class _Products:
    """Both products of the centred rows, with the earlier left vectors' weights."""

    def __init__(self, rows: Rows, mean: np.ndarray):
        self._rows, self._mean = rows, mean

    def forward(self, v: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Products of ``Xv`` with the left vectors ``X @ weights``."""
        mean = self._mean

        def partial(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return (centred @ weights).T @ (centred @ v)

        return self._rows.summed(partial)

    def backward(self, w: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """For ``u = Xw``: ``Xᵀu``, its squared length, and its products with left vectors."""
        mean, dims = self._mean, len(w)

        def partial(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            u = centred @ w
            return np.concatenate([centred.T @ u, [u @ u], (centred @ weights).T @ u])

        found = self._rows.summed(partial)
        return found[:dims], float(found[dims]), found[dims + 1 :]


def _cleared(vector: np.ndarray, bases: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for basis in bases:
            vector = vector - basis.T @ (basis @ vector)
    return vector


def _fresh(bases: list[np.ndarray], dims: int, seed: int) -> np.ndarray:
    start = _cleared(np.random.default_rng(seed).standard_normal(dims), bases)
    return start / np.linalg.norm(start)


def leading(products: _Products, dims: int, k: int, found: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest singular values of X, and their right vectors (as rows), among the
    directions orthogonal to the rows of ``found``."""
    rights = np.empty((0, dims))
    weights, backs = np.empty((dims, 0)), np.empty((dims, 0))
    alphas: list[float] = []
    betas: list[float] = []
    v, scale = _fresh([found], dims, seed), 0.0
    while True:
        w = v
        if weights.shape[1]:
            w = v - weights @ products.forward(v, weights)
        back, square, left = products.backward(w, weights)
        # What rounding has left of the earlier left vectors.
        w, back, square = w - weights @ left, back - backs @ left, square - float(left @ left)
        alpha = float(np.sqrt(max(square, 0.0)))
        scale = max(scale, alpha)
        if alpha <= 1e-13 * scale or alpha == 0:
            alpha, w, back = 0.0, np.zeros(dims), np.zeros(dims)
        else:
            w, back = w / alpha, back / alpha
        rights = np.vstack([rights, v])
        weights, backs = np.column_stack([weights, w]), np.column_stack([backs, back])
        alphas.append(alpha)
        rest = _cleared(back - alpha * v, [rights, found])
        beta = float(np.linalg.norm(rest))
        if beta <= 1e-13 * scale:
            beta = 0.0
        square_b = np.diag(alphas) + np.diag(betas, 1)
        p, values, q = np.linalg.svd(square_b)
        settled = beta * np.abs(p[-1, :k]) <= SETTLED * max(values[0], 1e-300)
        full = len(rights) + len(found) >= dims
        if full or (len(rights) >= k and beta > 0 and settled.all()):
            return values[:k], (q @ rights)[:k]
        if beta == 0.0:
            seed += 1
            v = _fresh([rights, found], dims, seed)
        else:
            v = rest / beta
        betas.append(beta)


def fit(written: DataFrame, components: int = 8) -> Whitening | None:
    """Components of all rows of ``written`` blocks; None without rows or variance."""
    rows = Rows(written)

    def parts(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], (x >> _LOW).sum(0), (x & (2**_LOW - 1)).sum(0)])

    counted = rows.summed(parts, np.int64)
    if counted is None:
        return None
    n, dims = int(counted[0]), len(counted) // 2
    sums = [(int(high) << _LOW) + int(low) for high, low in zip(counted[1 : dims + 1], counted[dims + 1 :], strict=True)]
    mean = np.array([s / n for s in sums])
    squares = rows.summed(lambda x: np.square(x - mean).sum(0))
    if not squares.any():
        return None
    products, k = _Products(rows, mean), min(components, dims)
    values, axes = leading(products, dims, k, np.empty((0, dims)))
    while len(axes) < dims:  # Another vector of a value as large as the last one wanted?
        more, axis = leading(products, dims, 1, axes, seed=1000 + len(axes))
        if more[0] <= values[-1] * (1 + 1e-12) or more[0] <= FLAT * values[0]:
            break
        order = np.argsort(-np.append(values, more), kind="stable")[:k]
        values, axes = np.append(values, more)[order], np.vstack([axes, axis])[order]
    good = values > FLAT * values[0]
    model = Whitening(n, sums, axes[good], values[good] ** 2 / n, float(squares.sum()) / n)
    centre = rows.summed(lambda x: model.project(x).sum(0)) / n

    def outer(x: np.ndarray) -> np.ndarray:
        z = model.project(x) - centre
        return (z.T @ z).ravel()

    covariance = rows.summed(outer).reshape(len(centre), -1) / n
    error = float(np.abs(covariance - np.eye(len(centre))).max())
    return Whitening(n, sums, model.axes, model.values, model.trace, error)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """``sum((n * x - S) ** 2)`` of each row, exact; None where a long cannot hold it."""
    greatest = max(n * int(np.abs(x).max()), max(map(abs, sums)))
    if greatest < 2**61:
        apart = n * x - np.array(sums, np.int64)
        safe = np.square(apart.astype(np.float64)).sum(1) < 9e18
        exact: list[int | None] = np.square(np.where(safe[:, None], apart, 0)).sum(1).tolist()
        rest = np.flatnonzero(~safe)
    else:
        exact, rest = [None] * len(x), np.arange(len(x))
    for i in rest:
        value = sum((n * int(c) - s) ** 2 for c, s in zip(x[i].tolist(), sums, strict=True))
        exact[i] = value if value <= _LONG else None
    return exact


_SCHEMA = """vec_id long, component int, n long, deviation long, whitened double,
    explained double, identity_error double"""


def whitened(written: DataFrame, model: Whitening | None) -> DataFrame:
    """One row per row of ``written`` and component."""
    if model is None:
        return written.sparkSession.createDataFrame([], _SCHEMA)
    share = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(share)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x = _entries(batch, i)
                size = len(ids) * k
                deviations = _deviations(x, model.n, model.sums)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([v for v in ids for _ in range(k)], pa.int64()),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))),
                        pa.array(np.full(size, model.n)),
                        pa.array([v for v in deviations for _ in range(k)], pa.int64()),
                        pa.array(model.project(x).ravel()),
                        pa.array(np.tile(share, len(ids))),
                        pa.array(np.full(size, model.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return written.mapInArrow(run, _SCHEMA)


def whiten(embeddings: DataFrame, components: int = 8) -> DataFrame:
    """Whitened coordinates of every row on the leading components of all rows."""
    written = stage(blocks(embeddings), "whitening-blocks")
    return whitened(written, fit(written, components))
