"""Embedding whitening by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance V of the fit list, and every row projected on them
and scaled to unit variance.  V itself is never formed: a pass gives V Q for a thin matrix Q,
as the sum over partitions of X^T (X Q) with X centred first.

1. Entries become whole numbers x = floor(256 c).  The fit list has each different x vector
   once; its size n and sums S are exact.
2. A few Lanczos passes from one vector bound the spectrum from below.
3. A block Q of COMPONENTS + GUARD columns goes through a Chebyshev polynomial of V, by the
   three-term recurrence, one pass a degree.  The polynomial stays within 1 on the unwanted
   part of the spectrum, from the lower bound to the block's smallest Ritz value, and grows
   fast above it.
4. QR of the block, one more pass, and Rayleigh-Ritz give the Ritz pairs and their residuals
   |V q - e q|.  The rounds go on until these are at rounding level (TOLERANCE times the
   largest eigenvalue), or until two rounds no longer make them smaller.
The driver holds matrices of (dimensions x block) only, whatever the number of rows.

Defined cases: rows whose vector is null or empty, or holds null, NaN or infinite entries, are
dropped, and so are those whose length is not the commonest (of equally common ones the
greatest); rows with a null vec_id are kept; equal rows are whitened each, fitted once;
components whose eigenvalue is zero (1e-12 of the trace or less) can't be scaled and give no
rows, so a table of one different vector, or none, gives none; a deviation beyond a long is
null; entries beyond 2 ** 53 / 256 have no exact x (the double's whole part, at most a long);
columns but vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from territoria.llm.common import written

COMPONENTS = 4
GUARD = 12
SCALE = 256
TOLERANCE = 2e-14
LANCZOS = 10
GROWTH = 1e7  # of the wanted part over the unwanted in one round: more would drown the guard columns in rounding
DEGREES = (4, 24)


def usable(vector: Column) -> Column:
    wrong = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(wrong, F.lit(False))


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, x (array of long) of the rows that remain."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    rows = embeddings.select("vec_id", v.alias("v")).where(usable(F.col("v")))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class FitList:
    """The different x vectors as a table, with n, S and passes over them."""

    def __init__(self, x: DataFrame, dims: int):
        self.dims = dims
        self.rows = written(x.distinct(), "fit")
        sums = self.rows.select(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims)]).first()
        self.n = sums["n"]
        self.sums = [int(sums[f"s{d}"] or 0) for d in range(dims)]
        self.mean = np.array([s / self.n if self.n else 0.0 for s in self.sums])

    def total(self, part: Callable[[np.ndarray], np.ndarray], rows: int, cols: int) -> np.ndarray:
        """Sum over the table of part(centred rows), a matrix of the given shape; added up by row of it in Spark."""
        dims, mean = self.dims, self.mean
        schema = pa.schema([("i", pa.int32()), ("v", pa.list_(pa.float64()))])

        def run(batches):
            acc = np.zeros((rows, cols))
            for b in batches:
                acc += part(_matrix(b.column(0), dims).astype(np.float64) - mean)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), pa.array(list(acc), pa.list_(pa.float64()))], schema=schema)

        parts = self.rows.select("x").mapInArrow(run, "i int, v array<double>")
        got = parts.groupBy("i").agg(*[F.sum(F.col("v")[j]).alias(f"c{j}") for j in range(cols)]).collect()  # `rows` rows
        out = np.zeros((rows, cols))
        for r in got:
            out[r["i"]] = [r[f"c{j}"] for j in range(cols)]
        return out

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q, in one pass."""
        return self.total(lambda x: x.T @ (x @ q), *q.shape) / self.n

    def trace(self) -> float:
        return float(self.total(lambda x: np.array([[np.einsum("ij,ij->", x, x)]]), 1, 1)[0, 0]) / self.n


def lower_bound(times: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int) -> float:
    """A bound of the spectrum from below: the least Ritz value of a few Lanczos steps less its residual, zero at least."""
    q, basis, alpha, beta = start / np.linalg.norm(start), [], [], []
    for _ in range(min(steps, len(start))):
        basis.append(q)
        w = times(q[:, None])[:, 0]
        alpha.append(float(q @ w))
        for b in (*basis, *basis):
            w = w - b * (b @ w)
        norm = float(np.linalg.norm(w))
        if norm <= 1e-12 * max(abs(a) for a in alpha):
            return 0.0 if len(basis) < len(start) else max(0.0, _ritz(alpha, beta)[0][0])
        beta.append(norm)
        q = w / norm
    values, vectors = _ritz(alpha, beta[:-1])
    return max(0.0, float(values[0] - beta[-1] * np.abs(vectors[-1]).max()))


def _ritz(alpha: list[float], beta: list[float]):
    return np.linalg.eigh(np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1))


def chebyshev(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, degree: int, low: float, cut: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial that is small on [low, cut], of V times q, scaled to be near 1 at top."""
    half, middle = (cut - low) / 2, (cut + low) / 2
    scale = half / (top - middle)
    first = scale
    before, now = q, (times(q) - middle * q) * (scale / half)
    for _ in range(2, degree + 1):
        following = 1 / (2 / first - scale)
        before, now = now, (times(now) - middle * now) * (2 * following / half) - (scale * following) * before
        scale = following
    return now


def degree_for(wanted: float, low: float, cut: float) -> int:
    """Degree at which the smallest wanted value outgrows the unwanted part by GROWTH."""
    t = (wanted - (cut + low) / 2) / ((cut - low) / 2)
    steps = np.log(2 * GROWTH) / np.arccosh(t) if t > 1 else DEGREES[1]
    return int(min(max(np.ceil(steps), DEGREES[0]), DEGREES[1]))


def leading_components(fit: FitList, count: int = COMPONENTS, guard: int = GUARD, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, unit eigenvectors as columns, trace of V)."""
    trace, width = fit.trace(), min(fit.dims, count + guard)
    if trace == 0:
        return np.empty(0), np.empty((fit.dims, 0)), 0.0
    rng = np.random.default_rng(seed)

    def ritz(block: np.ndarray):
        q, _ = np.linalg.qr(block)
        vq = fit.times(q)
        value, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        return q, value, np.linalg.norm(vq - q * value, axis=0)

    low = lower_bound(fit.times, rng.standard_normal(fit.dims), LANCZOS) if width < fit.dims else 0.0
    q, value, residual = ritz(rng.standard_normal((fit.dims, width)))
    worst, stalled = residual[:count].max(), 0
    while worst > TOLERANCE * value[0] and stalled < 2:
        cut = float(value[-1])
        if width == fit.dims or cut <= low:
            block = q  # the block is the whole space, or the rest of the spectrum is one value
        else:
            block = chebyshev(fit.times, q, degree_for(float(value[min(count, width) - 1]), low, cut), low, cut, float(value[0]))
        q, value, residual = ritz(block)
        now = residual[:count].max()
        # Only rounding is left once a round gains nothing; before, each one gains a large factor.
        stalled = stalled + 1 if now > worst / 2 and now < 1e-10 * value[0] else 0
        worst = min(worst, now)
    kept = [i for i in range(min(count, width)) if value[i] > 1e-12 * trace]
    return value[kept], q[:, kept], trace


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each remaining row and component."""
    x = whole_vectors(embeddings)
    common = x.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return embeddings.sparkSession.createDataFrame([], _OUT)
    dims = common["d"]
    x = x.where(F.size("x") == dims)
    fit = FitList(x.select("x"), dims)
    value, vectors, trace = leading_components(fit, count)
    k, n, sums, mean = len(value), fit.n, fit.sums, fit.mean
    turn = vectors / np.sqrt(value) if k else vectors
    error = float(np.abs(fit.total(lambda c: (c @ turn).T @ (c @ turn), k, k) / n - np.eye(k)).max()) if k else 0.0
    explained = (value / trace).tolist() if k else []
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def deviations(m: np.ndarray) -> list:
        top = n * int(np.abs(m.astype(np.float64)).max(initial=0)) + max(map(abs, sums)) + n
        if dims * top * top < 1 << 62:
            return ((n * m - np.array(sums, np.int64)) ** 2).sum(1).tolist()
        exact = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in m]
        return [e if e < 1 << 63 else None for e in exact]

    def run(batches):
        for b in batches:
            m = _matrix(b.column(1), dims)
            if not k or not len(m):
                continue
            white = (m.astype(np.float64) - mean) @ turn
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(m)), k)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))), pa.array(np.full(len(m) * k, n)),
                pa.array(deviations(m), pa.int64()).take(pa.array(np.repeat(np.arange(len(m)), k))), pa.array(white.ravel()),
                pa.array(np.tile(explained, len(m))), pa.array(np.full(len(m) * k, error))], schema=schema)

    return x.select(F.col("vec_id").cast("long"), "x").mapInArrow(run, _OUT)
