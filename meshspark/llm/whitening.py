"""Whitening of embeddings by their leading principal components, found by LOBPCG.

1. Entries become whole numbers, x = floor(STEP * c) + SHIFT.  The fit list is each different x once; its
   sums S are exact, and every row is centred as (n * x - S) / n, from whole numbers, before anything is
   multiplied.
2. LOBPCG (locally optimal block preconditioned conjugate gradients, without a preconditioner): a product
   of the covariance with a block of directions is one pass over the fit list, in which each task adds up
   its rows' Xc^T (Xc B) and Spark adds the tasks' sums.  Rayleigh-Ritz runs on the span of the iterate, the
   residuals and the previous directions, kept orthonormal; the iterate's product follows by linearity, the
   other two blocks' is taken anew.  Blocks are as wide as the dimension and the guard vectors ask for, never as the data are
   long, so what the driver holds is bounded by the length of a vector times the width of a block.
3. Residuals are certified: when they look small the product of the iterate itself is taken anew and
   ||V u - e u|| / e_1 of the fresh product must be at most `tolerance`; else the iteration goes on from it.
   The greatest of them is given as `residual`.
4. Rows are projected and divided by sqrt(e).  `identity_error` comes from one more pass over the fit list,
   with the whitened vectors' own means and products.

Rows whose vector is null or holds null or non-finite entries are dropped; so are those of another length
than most vectors have (of equally frequent lengths the longer counts).  Repeated vectors weigh once in the
fit and give rows each; null ids stay.  Components without variance (an eigenvalue below 1e-12 of the greatest) are
left out, so equal vectors alone, or one row, give no rows, as does an empty table.  Equal eigenvalues have
any orthonormal basis, the same for all rows.  A deviation that no long holds is null.  An entry whose x no
long can hold counts as non-finite.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise

STEP, SHIFT = 64, 1_000_000
COMPONENTS, GUARD, TOLERANCE, MOST_TURNS = 16, 8, 1e-13, 500
LONG = 1 << 63
NO_VARIANCE = 1e-12


def whole_numbers(vectors: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Vectors without null or non-finite entries, by length: [(their rows, x as int64 matrix)]; and all lengths."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    off = vectors.offsets.to_numpy()
    entries = vectors.values.slice(off[0], off[-1] - off[0]).cast(pa.float64())
    off = off - off[0]
    sizes = np.diff(off)
    flat = entries.to_numpy(zero_copy_only=False)  # nulls are nan
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(flat * STEP) + SHIFT
    bad = np.append(0, np.cumsum(~(np.abs(x) < float(LONG) - SHIFT)))
    good = np.asarray(vectors.is_valid()) & (bad[off[1:]] == bad[off[:-1]])
    out = []
    for size in np.unique(sizes[good]):
        rows = np.flatnonzero(good & (sizes == size))
        got = x[off[rows][:, None] + np.arange(size)] if size else np.zeros((len(rows), 0))
        out.append((rows, got.astype(np.int64)))
    return sizes, out


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n in double precision, from n * x - S."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < LONG:
        return (n * x - sums.astype(np.int64)) / n
    return ((n * x.astype(object) - sums) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n * x - S)^2 for each row, exact; null where it is beyond a long."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < LONG:
        d = n * x - sums.astype(np.int64)
        if float(np.abs(d).max(initial=0)) ** 2 * max(1, x.shape[1]) < LONG / 2:
            return pa.array((d * d).sum(1), pa.int64())
    d = n * x.astype(object) - sums
    return pa.array([v if v < LONG else None for v in ((row * row).sum() for row in d)], pa.int64())


class Fit:
    """The fit list as a table of packed vectors, and sums over it."""

    def __init__(self, packed: DataFrame):
        self.packed = packed
        self.dim, self.n, self.sums = 0, 0, np.zeros(0, object)

    def added(self, of: Callable[[np.ndarray], np.ndarray], exact: bool = False) -> np.ndarray:
        """Sum of of(x) over blocks of rows x: one number per entry comes from each task, the rest is Spark's."""
        kind = "decimal(38,0)" if exact else "double"
        dim = self.dim

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                x = np.frombuffer(b"".join(b.column(0).to_pylist()), "<i8").reshape(-1, dim)
                for i in range(0, len(x), 8192):
                    got = of(x[i : i + 8192])
                    total = got if total is None else total + got
            if total is not None:
                values = pa.array([int(v) for v in total], pa.decimal128(38)) if exact else pa.array(total, pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), values], names=["k", "v"])

        summed = self.packed.mapInArrow(task, f"k long, v {kind}").groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")
        return summed["v"].to_numpy()

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block of columns: one pass."""
        n, sums = self.n, self.sums

        def of(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return (c.T @ (c @ block)).ravel()

        return self.added(of).reshape(block.shape) / n


def fit_list(vectors: DataFrame, col: str) -> Fit:
    """Each different x of the most frequent length, with n and S."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, x in whole_numbers(b.column(0))[1]:
                raw = x.astype("<i8").tobytes()
                off = np.arange(len(x) + 1, dtype=np.int64) * x.shape[1] * 8
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([column, pa.array(np.full(len(x), x.shape[1], np.int32))], names=["x", "dim"])

    rows = vectors.select(F.col(col).cast("array<double>").alias("v")).mapInArrow(pack, "x binary, dim int")
    counted = materialise(rows.groupBy("x", "dim").agg(F.count("*").alias("rows")), "fit")
    lengths = counted.groupBy("dim").agg(F.sum("rows").alias("rows"), F.count("*").alias("n")).orderBy(F.desc("rows"), F.desc("dim")).first()
    fit = Fit(counted.where(F.col("dim") == (lengths["dim"] if lengths else 0)).select("x"))
    if lengths and lengths["dim"]:
        fit.dim, fit.n = lengths["dim"], lengths["n"]
        fit.sums = fit.added(lambda x: x.astype(object).sum(0) if int(np.abs(x).max(initial=0)) * len(x) >= LONG else x.sum(0).astype(object), exact=True)
        fit.sums = np.array([int(v) for v in fit.sums], object)
    return fit


def _symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


def _basis(s: np.ndarray, without: np.ndarray | None = None) -> np.ndarray:
    """Orthonormal columns that span those of s, without the span of other orthonormal columns."""
    for _ in range(2):  # twice is enough
        if without is not None:
            s = s - without @ (without.T @ s)
        size = np.linalg.norm(s, axis=0)
        s = s[:, size > 0] / size[size > 0]
        u, w, _ = np.linalg.svd(s, full_matrices=False)
        s = u[:, w > 1e-10 * max(w[:1], default=1.0)]
    return s


def _ritz(x: np.ndarray, ax: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, falling, and vectors of the span of x (orthonormal), with their images."""
    e, c = np.linalg.eigh(_symmetric(x.T @ ax))
    c = c[:, ::-1]
    return e[::-1], x @ c, ax @ c


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, guard: int = GUARD, tolerance: float = TOLERANCE, most: int = MOST_TURNS, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(eigenvalues falling, eigenvectors as columns, greatest certified residual over e_1, products taken).

    `wanted` leading pairs of a symmetric operator without negative eigenvalues.  Residuals are those of a
    product of the returned vectors themselves.  Where rounding keeps them above `tolerance` (no progress for
    8 turns), 1e4 * tolerance is taken; RuntimeError if that isn't reached in `most` turns.
    """
    wanted = min(wanted, dim)
    x, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, min(dim, wanted + guard))))
    e, x, ax = _ritz(x, product(x))
    p, taken, best, stuck = x[:, :0], 1, np.inf, 0
    for _ in range(most):
        r = ax - x * e
        found = np.linalg.norm(r[:, :wanted], axis=0).max() / max(e[0], np.finfo(float).tiny)
        best, stuck = min(best, found), 0 if found < best / 2 else stuck + 1
        allowed = tolerance if stuck < 8 else 1e4 * tolerance
        if found <= allowed or e[0] <= 0:
            x, _ = np.linalg.qr(x)
            e, x, ax = _ritz(x, product(x))
            p, taken = x[:, :0], taken + 1
            r = ax - x * e
            fresh = np.linalg.norm(r[:, :wanted], axis=0).max() / max(e[0], np.finfo(float).tiny)
            if fresh <= 4 * allowed or e[0] <= 0:
                return e[:wanted], x[:, :wanted], float(fresh), taken
        # Residuals and previous directions, orthonormal to the iterate and among themselves: one product.
        d = _basis(np.hstack([_basis(r), p]) if p.shape[1] else r, x)
        ad, taken, m = product(d), taken + 1, x.shape[1]
        q, aq = np.hstack([x, d]), np.hstack([ax, ad])
        w, y = np.linalg.eigh(_symmetric(q.T @ aq))
        y = y[:, ::-1][:, :m]
        p, x, ax, e = d @ y[m:], q @ y, aq @ y, w[::-1][:m]
    raise RuntimeError(f"residual {best} after {most} turns")


def _identity_error(fit: Fit, weights: np.ndarray) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity."""
    n, sums, k = fit.n, fit.sums, weights.shape[1]
    mean = fit.added(lambda x: (centred(x, n, sums) @ weights).sum(0)) / n

    def of(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, sums) @ weights - mean
        return (w.T @ w).ravel()

    return float(np.abs(fit.added(of).reshape(k, k) / n - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", tolerance: float = TOLERANCE) -> DataFrame:
    """One row per kept vector and component: id_col, component, n, deviation, whitened, explained, identity_error, residual."""
    spark = vectors.sparkSession
    kind = vectors.select(F.col(id_col)).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    fit = fit_list(vectors, vector_col)
    n, sums, dim = fit.n, fit.sums, fit.dim
    if not n or not dim:
        return spark.createDataFrame([], schema)
    trace = float(fit.added(lambda x: np.array([(centred(x, n, sums) ** 2).sum()]))[0]) / n
    if trace == 0:
        return spark.createDataFrame([], schema)
    e, u, residual, _ = lobpcg(fit.product, dim, components, tolerance=tolerance)
    some = e > NO_VARIANCE * e[0]
    weights, explained = u[:, some] / np.sqrt(e[some]), e[some] / trace
    error, k = _identity_error(fit, weights), int(some.sum())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in whole_numbers(b.column(1))[1]:
                if x.shape[1] != dim:
                    continue
                for i in range(0, len(x), 4096):
                    part, chosen = x[i : i + 4096], rows[i : i + 4096]
                    m = len(part)
                    white = centred(part, n, sums) @ weights
                    again = pa.array(np.repeat(np.arange(m), k))
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0).take(pa.array(np.repeat(chosen, k))),
                            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                            pa.array(np.full(m * k, n)),
                            deviations(part, n, sums).take(again),
                            pa.array(white.ravel()),
                            pa.array(np.tile(explained, m)),
                            pa.array(np.full(m * k, error)),
                            pa.array(np.full(m * k, residual)),
                        ],
                        names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"],
                    )

    return vectors.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(project, schema)
