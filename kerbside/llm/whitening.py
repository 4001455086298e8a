"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

With X the centred rows, orthonormal short vectors v and long vectors u are built
in turn, ``alpha u = X v - beta u'`` and ``beta v = X'u - alpha v'``, each made
orthogonal to all before it. Then X V = U B with a small upper bidiagonal B, whose
singular value decomposition gives those of X: the components are V times the
right singular vectors, their deviations the singular values over sqrt(n).

A long vector has an entry a row and is never stored: it lies in the column space
of X, so u = X w with a short w that the driver keeps. One pass over the rows for
each step returns X'(X g) together with the products of X g with all earlier u,
which is what the next u, its reorthogonalisation and the next v need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import prepare_workers, shared_folder, stored

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
SEED = 11
ROWS_AT_ONCE = 4096
# A direction with less than this share of the largest singular value has none.
NO_SPREAD = 1e-6
BREAKDOWN = 1e-11

OUT = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, "
    "explained double, identity_error double"
)


def usable(vector: str = "embedding") -> Column:
    """Vectors with entries, all of them finite numbers; never NULL."""
    finite = F.forall(
        vector,
        lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")),
    )
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def whole_numbers(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id`` and ``x``, the entries as long numbers."""
    entry = lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("bigint")
    return vectors.filter(usable(vector)).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(vector, entry).alias("x")
    )


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows; its longs share Arrow's memory."""
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray]]:
    """Arrow batches put together to blocks that are worth a matrix product."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= ROWS_AT_ONCE:
            yield held, np.concatenate([matrix(b.column("x")) for b in held])
            held, rows = [], 0
    if held:
        yield held, np.concatenate([matrix(b.column("x")) for b in held])


def totals(rows: DataFrame) -> tuple[int, np.ndarray]:
    """How many rows there are, and the exact sum of each entry."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = np.asarray(batch.column("x").value_lengths())
            for length in np.unique(lengths).tolist():
                x = matrix(batch.column("x").filter(pa.array(lengths == length)))
                part = np.append(x.sum(axis=0), len(x))
                sums[length] = sums.get(length, 0) + part
        for length, part in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(length + 1, length)), pa.array(np.arange(length + 1)),
                 pa.array(part.astype(np.int64))],
                names=["length", "k", "v"],
            )

    parts = rows.mapInArrow(add, "length bigint, k bigint, v bigint")
    lengths = [r[0] for r in parts.select("length").distinct().limit(2).collect()]
    if len(lengths) > 1:
        raise ValueError("vectors of different lengths cannot be whitened together")
    if not lengths:
        return 0, np.zeros(0, np.int64)
    found = dict(parts.groupBy("k").agg(F.sum("v")).collect())
    return found[lengths[0]], np.array([found[k] for k in range(lengths[0])], np.int64)


class CentredRows:
    """The stored rows as the matrix X: x minus its mean, row by row."""

    def __init__(self, rows: DataFrame, n: int, sums: np.ndarray):
        self.rows, self.n, self.sums = rows, n, sums

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        n, sums = self.n, self.sums
        return lambda x: (x * n - sums) / n

    def _sum(self, of_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum of a vector over all blocks of rows. Its length depends on the
        dimensions alone, and tasks add up theirs before anything moves."""
        centre = self.centre()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for _, x in blocks(batches):
                part = of_block(centre(x))
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(total))), pa.array(total)], names=["k", "v"]
                )

        parts = self.rows.mapInArrow(add, "k bigint, v double").groupBy("k").agg(F.sum("v"))
        return np.array([v for _, v in sorted(map(tuple, parts.collect()))])

    def trace(self) -> float:
        return float(self._sum(lambda c: np.array([(c * c).sum()]))[0])

    def step(self, g: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """X'(X g), the products of X g with each u = X w, and its square."""
        d = len(g)

        def of_block(c: np.ndarray) -> np.ndarray:
            y = c @ g
            return np.concatenate([c.T @ y, (c @ w).T @ y, [y @ y]])

        found = self._sum(of_block)
        return found[:d], found[d:-1], float(found[-1])

    def covariance(self, weights: np.ndarray) -> np.ndarray:
        """The covariance of the rows times ``weights``."""
        m = weights.shape[1]

        def of_block(c: np.ndarray) -> np.ndarray:
            y = c @ weights
            return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])

        found = self._sum(of_block) / self.n
        mean = found[m * m :]
        return found[: m * m].reshape(m, m) - np.outer(mean, mean)


def orthogonal_to(vector: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The part of a vector outside an orthonormal basis; twice is enough."""
    for _ in range(2):
        vector = vector - basis @ (basis.T @ vector)
    return vector


def bidiagonalise(x: CentredRows) -> tuple[np.ndarray, np.ndarray]:
    """V (d x d, orthogonal) and B (upper bidiagonal) with X V = U B.

    All d steps are made, so components that share an eigenvalue are found as
    well; where a Krylov space ends early, a new one is begun outside of it.
    """
    d = len(x.sums)
    random = np.random.default_rng(SEED)
    v, w, z = np.zeros((d, d)), np.zeros((d, d)), np.zeros((d, d))  # z: X'u of each u
    b = np.zeros((d, d))
    largest, beta = 0.0, 0.0
    start = random.standard_normal(d)
    v[:, 0] = start / np.linalg.norm(start)
    for j in range(d):
        g = v[:, j] - (beta * w[:, j - 1] if j else 0)
        product, along, square = x.step(g, w)
        g = g - w @ along
        product = product - z @ along
        alpha = np.sqrt(max(square - along @ along, 0.0))
        largest = max(largest, alpha)
        if alpha > BREAKDOWN * largest:
            b[j, j] = alpha
            w[:, j], z[:, j] = g / alpha, product / alpha
        if j + 1 == d:
            break
        after = orthogonal_to(z[:, j] - alpha * v[:, j], v[:, : j + 1])
        beta = float(np.linalg.norm(after))
        largest = max(largest, beta)
        if b[j, j] == 0 or beta <= BREAKDOWN * largest:
            beta, after = 0.0, orthogonal_to(random.standard_normal(d), v[:, : j + 1])
        v[:, j + 1] = orthogonal_to(after / np.linalg.norm(after), v[:, : j + 1])
        v[:, j + 1] /= np.linalg.norm(v[:, j + 1])
        b[j, j + 1] = beta
    return v, b


def whiten(
    vectors: DataFrame,
    components: int = COMPONENTS,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Rows in whitened coordinates: one row for each vector and component.

    ``whitened`` is the centred vector along the component over its deviation,
    ``explained`` the component's share of all variance, ``deviation`` the exact
    squared distance from the mean times n squared, ``identity_error`` how far
    the covariance of the whitened rows is from the identity.

    Vectors that are NULL or empty, or hold NULL, NaN or infinite entries, are
    left out; vectors of different lengths are refused. NULL ids stay, repeated
    rows count and come out as often as they are there, an empty table and one
    without spread give no rows. Components number at most the dimensions with a
    deviation over a millionth of the largest. Other columns are not looked at.
    A deviation beyond 64 bits raises an error.
    """
    spark = vectors.sparkSession
    prepare_workers(spark)
    rows = stored(whole_numbers(vectors, vec_id, vector), shared_folder(spark), "vectors")
    n, sums = totals(rows)
    if n == 0:
        return spark.createDataFrame([], OUT)
    x = CentredRows(rows, n, sums)
    v, b = bidiagonalise(x)
    _, singular, right = np.linalg.svd(b)
    kept = int(np.count_nonzero(singular[:components] > NO_SPREAD * singular[0]))
    if kept == 0 or singular[0] == 0:
        return spark.createDataFrame([], OUT)
    deviations = singular[:kept] / np.sqrt(n)
    weights = (v @ right[:kept].T) / deviations
    explained = singular[:kept] ** 2 / x.trace()
    error = float(np.abs(x.covariance(weights) - np.eye(kept)).max())
    centre = x.centre()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, numbers in blocks(batches):
            m, far = len(numbers), numbers * n - sums
            if (far.astype(float) ** 2).sum(axis=1).max() > 9.2e18:
                raise OverflowError("a squared deviation does not fit 64 bits")
            ids = pa.chunked_array([b.column("vec_id") for b in held]).combine_chunks()
            each = pa.array(np.repeat(np.arange(m), kept))
            yield pa.RecordBatch.from_arrays([
                ids.take(each),
                pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)),
                pa.array(np.full(m * kept, n)),
                pa.array(np.repeat((far * far).sum(axis=1), kept)),
                pa.array((centre(numbers) @ weights).ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * kept, error)),
            ], names=[part.split()[0] for part in OUT.split(", ")])

    return rows.mapInArrow(project, OUT)
