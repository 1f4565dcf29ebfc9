"""Whitening of embeddings by shifted CholeskyQR: no covariance matrix is ever decomposed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import matrix
from .workspace import bounded_batches

#: Entries become floor(SCALE * c) + OFFSET, within +-LARGEST of the offset.
SCALE, OFFSET, LARGEST = 64, 1_000_000, 1 << 40
COMPONENTS = 32
#: Gram passes at most; three are enough for any full-rank table in double precision.
PASSES = 4
#: Directions whose spread is below this share of the largest one's count as without variance.
RANK_SHARE = 1e-12
_EPS = np.finfo(float).eps
_ROWS = 2048


def _integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values), -LARGEST, LARGEST).astype(np.int64) + OFFSET


class Centre:
    """Number of rows and per-dimension sums; rows are centred exactly before they become doubles."""

    def __init__(self, n: int, sums: np.ndarray):
        self.n, self.sums = n, sums
        self.whole = sums // n if n else sums
        self.rest = (sums - self.whole * n) / max(n, 1)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n*x - S)^2, exact; null beyond the range of a long."""
        large = (np.abs(x - self.whole) + 1.0).max(initial=0) * self.n
        if large * large * max(x.shape[1], 1) < 2**62:
            d = self.n * (x - self.whole) - (self.sums - self.whole * self.n)
            return (d * d).sum(axis=1).tolist()
        d = self.n * x.astype(object) - self.sums.astype(object)
        return [v if v < 2**63 else None for v in (int((row * row).sum()) for row in d)]


def fit_centre(vectors: DataFrame) -> Centre:
    """One pass: counts and sums by dimension.  Entries that shorter vectors lack count as 0."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, count, total = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            rows, lengths, values = matrix(batch.column(1))
            grow = values.shape[1] - len(count)
            if grow > 0:
                count, total = np.pad(count, (0, grow)), np.pad(total, (0, grow))
            n += len(rows)
            present = np.arange(values.shape[1]) < lengths[:, None]
            count[: values.shape[1]] += present.sum(axis=0)
            total[: values.shape[1]] += np.where(present, _integers(values), 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(count)), pa.int32()), pa.array([n, *count.tolist()], pa.int64()), pa.array([0, *total.tolist()], pa.int64())], ["dim", "n", "s"])

    found = {r["dim"]: (r["n"], r["s"]) for r in vectors.mapInArrow(partial, "dim int, n long, s long").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}
    n = found.pop(-1, (0, 0))[0]
    return Centre(n, np.array([found[d][1] + (n - found[d][0]) * OFFSET for d in sorted(found)], np.int64))


def gram(vectors: DataFrame, width: int, transform: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of outer products of the transformed rows.  Tasks send one triangle each, summed by cell."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for k in range(0, batch.num_rows, _ROWS):
                q = transform(_integers(matrix(batch.column(1).slice(k, _ROWS), width)[2]))
                total = q.T @ q if total is None else total + q.T @ q
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "g"])

    cells = vectors.mapInArrow(partial, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect()
    size = 1 + max((c["i"] for c in cells), default=-1)
    out = np.zeros((size, size))
    for c in cells:
        out[c["i"], c["j"]] = out[c["j"], c["i"]] = c["g"]
    return out


def solve_rows(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Rows q with q r = y, for an upper triangular r, by forward substitution."""
    q = np.empty_like(y)
    for j in range(len(r)):
        q[:, j] = (y[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def triangular_factors(n: int, d: int, gram_of: Callable[[list[np.ndarray]], np.ndarray]) -> list[np.ndarray]:
    """R factors, first to last, after which the rows are orthonormal: Y = Q R_k ... R_1.

    ``gram_of(factors)`` is a pass over the rows divided by the factors so far.  The first factor is shifted, so that it
    exists whatever the condition of the rows; so is a later one where a direction has no variance.  The last factor of
    a table without full rank is a symmetric root."""
    factors: list[np.ndarray] = []
    for k in range(PASSES + 1):
        g = gram_of(factors)
        if not len(g) or not np.trace(g) > 0:
            return [np.zeros((d, d))]
        if k and np.abs(g - np.eye(d)).max() < 100 * d * _EPS:
            break
        shift = 11 * (n * d + d * (d + 1)) * _EPS / 2 * np.trace(g)
        if k == PASSES:
            w, v = np.linalg.eigh(g)
            factors.append((v * np.sqrt(np.maximum(w, 0))) @ v.T)
            break
        try:
            lower = np.linalg.cholesky(g + (0 if k else shift) * np.eye(d))
        except np.linalg.LinAlgError:
            lower = np.linalg.cholesky(g + shift * np.eye(d))
        factors.append(lower.T)
    return factors


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of all rows whose vector is there and wholly finite.

    Centred rows are orthogonalised by repeated Gram passes and triangular solves; the product of the R factors has the
    rows' singular values and directions, which its SVD gives without squaring their condition.  Returns a row for each
    vector and component: vec_id, component (from 1, by falling variance), n, deviation, whitened, explained,
    identity_error.  Each direction's largest entry is positive.

    Only sums by dimension and matrices of d x d cells reach the driver.  Null and repeated ids are carried along, repeated
    vectors count as often as they come; shorter vectors are filled up with zeros; entries are held to +-2^40 after
    scaling.  A component without variance has a null ``whitened`` and takes no part in ``identity_error``.  An empty table
    gives no rows; other columns are ignored."""
    bounded_batches(table.sparkSession)
    vectors = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    centre = fit_centre(vectors)
    n, d = centre.n, len(centre.sums)

    def divided(factors: list[np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
        def transform(x: np.ndarray) -> np.ndarray:
            q = centre.rows(x)
            for r in factors:
                q = solve_rows(q, r)
            return q

        return transform

    top = min(components, d)
    factors = triangular_factors(n, d, lambda found: gram(vectors, d, divided(list(found)))) if n and d else [np.zeros((d, d))]
    product = factors[0]
    for r in factors[1:]:
        product = r @ product
    _, spread, axes = np.linalg.svd(product)
    axes = axes[:top] * np.sign(axes[np.arange(top), np.abs(axes[:top]).argmax(axis=1)])[:, None] if top else axes[:0]
    variance = spread**2 / max(n, 1)
    with_variance = spread[:top] > RANK_SHARE * spread.max(initial=0)
    project = (axes[with_variance] / np.sqrt(variance[:top][with_variance])[:, None]).T if top else np.zeros((d, 0))
    explained = variance[:top] / variance.sum() if with_variance.any() else np.zeros(top)
    error = float(np.abs(gram(vectors, d, lambda x: centre.rows(x) @ project) / n - np.eye(project.shape[1])).max(initial=0)) if with_variance.any() else 0.0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, _ROWS):
                part = batch.slice(k, _ROWS)
                own, _, values = matrix(part.column(1), d)
                x = _integers(values)
                z = np.full((len(own), top), np.nan)
                z[:, with_variance] = centre.rows(x) @ project
                each = np.repeat(np.arange(len(own)), top)
                columns = [
                    part.column(0).take(pa.array(own)).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, top + 1), len(own)), pa.int32()),
                    pa.array(np.full(len(each), n), pa.int64()),
                    pa.array(centre.deviation(x), pa.int64()).take(pa.array(each)),
                    pa.array(z.ravel(), mask=np.isnan(z.ravel())),
                    pa.array(np.tile(explained, len(own)), pa.float64()),
                    pa.array(np.full(len(each), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(rows, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
