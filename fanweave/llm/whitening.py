"""Whitening of embeddings by QDWH spectral divide and conquer.

Entries are taken to fixed point (``floor(64 c) + 1000000``), so sums over rows are exact integers
and do not depend on their order. The covariance is that of the distinct vectors (the fit list); it
is gathered as sums of products of entries less their floored mean, one small matrix per task, added
up by Spark, and only that matrix of dimension x dimension reaches the driver.

There it is taken apart: the polar factor U of the covariance less a shift, found by the QDWH
iteration, gives the projector (U + I) / 2 on the eigenvectors above the shift. Bases of its range
and of its kernel cut the matrix into two blocks, and each is taken apart in turn until it is one
number or a multiple of the identity. The leading components, over the roots of their eigenvalues,
are broadcast, and every vector is whitened where it lies.

Defined results: a vector that is null or empty, or holds null, non-finite or overlong entries
(``|64 c|`` of 2^52 or more, which fixed point cannot hold), is dropped, and so is one whose length
is not the most frequent one (of equally frequent lengths the greater counts). Repeated rows give
repeated results. Directions without variance (eigenvalue within rounding of zero) are no
components; fewer than two distinct vectors have none, and the result is empty. Components of equal
eigenvalues are one of their possible bases. A deviation that no long holds is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanweave.llm.common import materialize

SCALE = 64
OFFSET = 1_000_000
LARGEST = 1 << 52                  # of an entry in fixed point
COMPONENTS = 16
EPS = np.finfo(np.float64).eps
ROWS = 4096                        # vectors that a task looks at together


# --- the spectral decomposition -------------------------------------------------------------------

def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square matrix by QR-based dynamically weighted Halley
    iteration."""
    n = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(max(low, EPS), 1.0)
    for _ in range(40):
        d = np.cbrt(4 * (1 - low ** 2) / low ** 4)
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low ** 2) / (low ** 2 * root))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.concatenate([np.sqrt(wc) * x, np.eye(n)]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        moved = np.linalg.norm(new - x)
        x, low = new, min(low * (wa + wb * low ** 2) / (1 + wc * low ** 2), 1.0)
        if abs(1 - low) < 10 * EPS and moved < np.sqrt(n) * np.cbrt(EPS):
            break
    return x


def _split(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below the shift, or None if the
    shift does not part them cleanly."""
    n = len(a)
    u = polar_factor(a - shift * np.eye(n))
    above = (u + u.T) / 4 + np.eye(n) / 2
    rank = int(round(np.trace(above)))
    if not 0 < rank < n:
        return None
    start = np.random.default_rng(0).standard_normal((n, n))
    q, _ = np.linalg.qr(np.concatenate([above @ start[:, :rank], start[:, rank:]
                                        - above @ start[:, rank:]], axis=1))
    upper, lower = q[:, :rank], q[:, rank:]
    upper, _ = np.linalg.qr(above @ upper)
    lower, _ = np.linalg.qr(lower - upper @ (upper.T @ lower))
    if np.linalg.norm(lower.T @ a @ upper) > 100 * n * EPS * np.linalg.norm(a):
        return None
    return upper, lower


def eigenvectors(a: np.ndarray, scale: float | None = None) -> np.ndarray:
    """Eigenvectors of a symmetric matrix as columns, in no particular order."""
    n = len(a)
    scale = np.linalg.norm(a) if scale is None else scale
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n))
    if n == 1 or spread <= n * EPS * max(scale, 1e-300):
        return np.eye(n)
    # The mean of the eigenvalues always has some on either side; the steps aside are for an
    # eigenvalue that lies on it.
    shifts = [float(np.median(np.diag(a))), mean]
    shifts += [mean + s * k * spread / (50 * n) for k in range(1, 25) for s in (1, -1)]
    for shift in shifts:
        found = _split(a, shift)
        if found:
            break
    else:
        raise ArithmeticError("the polar decompositions do not part the spectrum")
    halves = []
    for basis in found:
        block = basis.T @ a @ basis
        halves.append(basis @ eigenvectors((block + block.T) / 2, scale))
    return np.concatenate(halves, axis=1)


def components(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) by falling eigenvalue, those without variance left
    out."""
    if not cov.any():
        return np.zeros(0), np.zeros((len(cov), 0))
    v = eigenvectors(cov)
    v, _ = np.linalg.qr(v)
    value = np.einsum("ij,ij->j", v, cov @ v)
    order = np.argsort(-value, kind="stable")
    order = order[value[order] > 10 * len(cov) * EPS * value.max()]
    return value[order], v[:, order]


# --- sums over the fit list -----------------------------------------------------------------------

def fixed_point(vectors: DataFrame, column: str) -> DataFrame:
    """``vectors`` without the rows to drop, and with ``x``, the entries in fixed point."""
    scaled = F.transform(column, lambda c: c.cast("double") * SCALE)
    held = vectors.withColumn("__fw_v", scaled).where(
        (F.size("__fw_v") > 0) & F.forall("__fw_v", lambda c: F.coalesce(
            F.abs(c) < float(LARGEST), F.lit(False))))
    sizes = held.groupBy(F.size("__fw_v").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    most = sizes.orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    size = most[0]["n"] if most else 0
    x = F.transform("__fw_v", lambda c: F.floor(c).cast("long") + OFFSET)
    return held.where(F.size("__fw_v") == size).withColumn("x", x).drop("__fw_v")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for b in _slices(batches):
        part = _matrix(b.column("x")).sum(0).astype(object)      # within 2^53 x 4,096
        total, n = part if total is None else total + part, n + b.num_rows
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(total)), pa.int32()), _decimals(total), pa.array([n] * len(total))],
            names=["i", "total", "n"])


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """(n, S): the number of vectors and the sum of each dimension."""
    rows = fit.mapInArrow(_sum_rows, "i int, total decimal(38,0), n long").groupBy("i").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("i").collect()
    return (rows[0]["n"] if rows else 0), [int(r["total"]) for r in rows]


def _products(mean: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, centre = None, np.array(mean, np.int64)
        for b in _slices(batches):
            y = _matrix(b.column("x")) - centre
            most = int(np.abs(y).max())
            if most * most * len(y) < 1 << 53:                   # exact in floating point
                y = y.astype(np.float64)
                part = (y.T @ y).astype(np.int64).astype(object)
            else:
                y = y.astype(object)
                part = y.T @ y
            total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                 _decimals(total[i, j])], names=["i", "j", "total"])
    return run


def covariance(fit: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """The covariance of the fit list, each entry a rounded exact fraction."""
    mean = [s // n for s in total]
    rest = [s - n * m for s, m in zip(total, mean)]
    rows = fit.mapInArrow(_products(mean), "i int, j int, total decimal(38,0)").groupBy(
        "i", "j").agg(F.sum("total").alias("total")).collect()
    cov = np.zeros((len(total), len(total)))
    for r in rows:
        i, j = r["i"], r["j"]
        cov[i, j] = cov[j, i] = (n * int(r["total"]) - rest[i] * rest[j]) / (n * n)
    return cov


# --- whitening ------------------------------------------------------------------------------------

class Whitening:
    """n and S of the fit list, its components over the roots of their eigenvalues, and the share
    of the variance that each explains."""

    def __init__(self, n: int, total: list[int], cov: np.ndarray, keep: int = COMPONENTS):
        value, vector = components(cov)
        value, vector = value[:keep], vector[:, :keep]
        self.n, self.total = n, total
        self.scaled = vector / np.sqrt(value)
        self.explained = value / np.trace(cov) if len(value) else value

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        most = max(map(abs, self.total), default=0)
        if len(x) and int(np.abs(x).max()) * self.n + most < 1 << 62:
            return x * self.n - np.array(self.total, np.int64)
        return x.astype(object) * self.n - np.array(self.total, object)

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """(whitened, sums of squared deviations) of vectors in fixed point."""
        off = self.deviations(x)
        as_float = off.astype(np.float64)
        if (as_float ** 2).sum(1).max(initial=0.0) < 2.0 ** 62:
            squares = (off * off).sum(1).tolist()
        else:
            squares = (off.astype(object) ** 2).sum(1).tolist()
            if max(squares) >= 1 << 63:
                raise OverflowError("a sum of squared deviations that no long holds")
        return as_float / self.n @ self.scaled, squares


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity."""
    shared = fit.sparkSession.sparkContext.broadcast(model)
    k = model.scaled.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in _slices(batches):
            w, _ = shared.value.apply(_matrix(b.column("x")))
            total += np.concatenate([w.T @ w, w.sum(0)[None]])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)),
             pa.array(total.ravel())], names=["i", "j", "total"])

    rows = fit.mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(
        F.sum("total").alias("total")).collect()
    total = np.zeros((k + 1, k))
    for r in rows:
        total[r["i"], r["j"]] = r["total"] / model.n
    cov = total[:k] - np.outer(total[k], total[k])       # the means are those of rounding alone
    return float(np.abs(cov - np.eye(k)).max(initial=0.0))


def fit_whitening(x_rows: DataFrame, keep: int = COMPONENTS) -> tuple[Whitening | None, float]:
    """(model, identity error) of vectors ``x``; no model where nothing varies."""
    fit = materialize(x_rows.select("x").distinct(), "whitening-fit")
    n, total = sums(fit)
    if n < 2:
        return None, 0.0
    model = Whitening(n, total, covariance(fit, n, total), keep)
    return model, identity_error(fit, model)


def whiten(vectors: DataFrame, column: str = "embedding", id_col: str = "vec_id",
           keep: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each kept
    vector and component."""
    rows = fixed_point(vectors.select(id_col, column), column).select(
        F.col(id_col).cast("long").alias("vec_id"), "x")
    schema = ("vec_id long, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    model, error = fit_whitening(rows, keep)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        k = own.scaled.shape[1]
        for b in _slices(batches):
            w, squares = own.apply(_matrix(b.column("x")))
            m = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, own.n)),
                 pa.array(np.repeat(np.array(squares, np.int64), k)), pa.array(w.ravel()),
                 pa.array(np.tile(own.explained, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained",
                       "identity_error"])

    return rows.mapInArrow(run, schema)
