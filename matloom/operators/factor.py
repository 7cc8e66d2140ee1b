"""Factorizations and solvers.

Tall matrices: every task factors its own rows (QR), the p x p factors are merged in a tree of ``FANOUT``, and at most
FANOUT of them reach the driver. What remains of any size is a projection of row blocks by a broadcast p x p matrix.
Matrices that are square already (Gram, covariance) are collected, up to ``LARGEST`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.matrix import Matrix
from matloom.operators.aggregates import col_stats
from matloom.operators.elementwise import scale
from matloom.operators.products import crossprod
from matloom.plans.durable import durable

FANOUT, LARGEST = 16, 4096
#: Rows up to which a few eigenvalues are taken from the whole matrix.
COLLECTED = 1000


def _positive(q: np.ndarray | None, r: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """Signs chosen so that the diagonal of R isn't negative."""
    signs = np.where(np.diag(r) < 0, -1.0, 1.0)
    return (None if q is None else q[:, : len(signs)] * signs), r * signs[:, None]


def _canonical(vectors: np.ndarray) -> np.ndarray:
    """Signs chosen so that each column's largest entry is positive."""
    at = np.abs(vectors).argmax(0)
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def r_factor(m: Matrix) -> np.ndarray:
    """R of a thin QR of a matrix with any number of rows."""
    p = m.ncol

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, p))
        for frame in frames:
            if len(frame):
                r = np.linalg.qr(np.vstack([r, np.stack(frame["vec"].to_list())]), mode="r")
        if len(r):
            yield pd.DataFrame({"r": [r.tobytes()]})

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        stacked = np.vstack([np.frombuffer(x).reshape(-1, p) for x in frame["r"]])
        return pd.DataFrame({"part": [frame["part"].iloc[0] // FANOUT], "r": [np.linalg.qr(stacked, mode="r").tobytes()]})

    factors = durable(m.to_rows().df.select("vec").mapInPandas(local, "r binary").withColumn("part", F.spark_partition_id().cast("long")), "factors")
    while factors.count() > FANOUT:
        factors = durable(factors.withColumn("group", F.floor(F.col("part") / FANOUT)).groupBy("group").applyInPandas(merged, "part long, r binary"), "factors")
    found = [np.frombuffer(bytes(x["r"])).reshape(-1, p) for x in factors.orderBy("part").collect()]
    if not found:
        return np.zeros((0, p))
    return _positive(None, np.linalg.qr(np.vstack(found), mode="r"))[1]


def project(m: Matrix, right: np.ndarray, *, left: bool = False) -> Matrix:
    """``m @ right`` for a small matrix, block by block (``left``: ``right @ m``, by columns)."""
    if left:
        return project(m.t(), right.T).t()
    held = m.df.sparkSession.sparkContext.broadcast(np.asarray(right, float))

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"i": frame["i"], "vec": list(np.stack(frame["vec"].to_list()) @ held.value)})

    return Matrix(m.to_rows().df.select("i", "vec").mapInPandas(multiply, "i long, vec array<double>"), m.nrow, right.shape[1], "rows", m.row_labels)


def qr(m: Matrix, *, thin: bool = False, method: str = "auto") -> tuple[Matrix, np.ndarray]:
    """Q (a Matrix) and R with a diagonal that isn't negative.

    ``tsqr`` (chosen for many more rows than columns) never holds Q: it is X R^-1, made orthogonal by a second
    factorization; columns that depend on each other go to the other method. ``householder`` keeps Q as a tree of
    reflectors (``operators.reflectors``, which also applies Q without forming it, and pivots columns); only it can give a
    full Q (m x m)."""
    from matloom.operators.reflectors import reflectors

    if method == "auto":
        method = "tsqr" if thin and m.nrow > 5 * m.ncol and m.nrow > 1000 else "householder"
    if method == "tsqr":
        if m.nrow < m.ncol:
            raise ValueError("tsqr needs as many rows as columns")
        if not thin:
            raise ValueError("tsqr gives a thin Q only")
        r1 = r_factor(m)
        if np.abs(np.diag(r1)).min() > 1e-12 * max(np.abs(np.diag(r1)).max(), 1e-300):
            q1 = project(m, np.linalg.inv(r1))
            r2 = r_factor(q1)
            return project(q1, np.linalg.inv(r2)), r2 @ r1
    elif method != "householder":
        raise ValueError(f"unknown method {method!r}")
    found = reflectors(m)
    if thin:
        return found.thin(), found.r
    return found.full(), np.vstack([found.r, np.zeros((m.nrow - len(found.r), m.ncol))])


@dataclass
class Svd:
    d: np.ndarray
    u: Matrix
    v: Matrix


def svd(m: Matrix, nu: int | None = None, nv: int | None = None, *, center: bool = True, scaled: bool = True, method: str = "auto", k: int = 2, q: int = 1, threshold: float = 0.0) -> Svd:
    """Singular values (descending) and vectors of the matrix, centred and scaled by default.

    ``full``: one R factor of the whole. ``blocks``: hierarchical, k ** q blocks whose factors are merged level by level,
    singular values of ``threshold`` or less dropped. A matrix with more columns than rows is factored by its transpose."""
    x = scale(m, center, scaled)
    wide = x.ncol > x.nrow
    tall = x.t().to_rows() if wide else x.to_rows()
    if method == "auto":
        method = "full"
    if method == "full":
        r = r_factor(tall)
    elif method == "blocks":
        r = _merged_blocks(tall, k, q, threshold)
    else:
        raise ValueError(f"unknown method {method!r}")
    _, d, vt = np.linalg.svd(r, full_matrices=False)
    v = _canonical(vt.T)
    rank = int((d > max(threshold, 1e-13 * (d[0] if len(d) else 0))).sum())
    inverse = np.concatenate([1 / d[:rank], np.zeros(len(d) - rank)])
    left = project(tall, v * inverse)
    right = Matrix.from_numpy(m.df.sparkSession, v)
    u, v_ = (right, left) if wide else (left, right)
    from matloom.operators.subset import subset

    nu, nv = min(m.dim) if nu is None else nu, min(m.dim) if nv is None else nv
    most = max(nu, nv)
    return Svd(d[:most], subset(u, None, slice(0, nu)), subset(v_, None, slice(0, nv)))


def _merged_blocks(tall: Matrix, k: int, q: int, threshold: float) -> np.ndarray:
    """D Vt of the rows, from k ** q row blocks merged k by k."""
    blocks, p = k**q, tall.ncol
    if blocks > tall.nrow:
        raise ValueError("more blocks than rows")

    def reduced(rows: np.ndarray) -> np.ndarray:
        _, d, vt = np.linalg.svd(rows if rows.shape[0] <= p else np.linalg.qr(rows, mode="r"), full_matrices=False)
        kept = max(min(2, len(d)), int((d > threshold).sum()))
        return d[:kept, None] * vt[:kept]

    length = -(-tall.nrow // blocks)
    level = tall.df.withColumn("block", F.floor(F.col("i") / length))

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for frame in frames:
            for block, part in frame.groupby("block"):
                rows = np.stack(part["vec"].to_list())
                held[block] = reduced(np.vstack([held[block], rows]) if block in held else rows)
        yield pd.DataFrame({"block": list(held), "f": [f.tobytes() for f in held.values()]})

    factors = level.select("block", "vec").mapInPandas(first, "block long, f binary")

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "f": [reduced(np.vstack([np.frombuffer(f).reshape(-1, p) for f in frame["f"]])).tobytes()]})

    factors = factors.groupBy("block").applyInPandas(merge, "block long, f binary")
    for _ in range(q):
        factors = factors.withColumn("block", F.floor(F.col("block") / k)).groupBy("block").applyInPandas(merge, "block long, f binary")
    found = [np.frombuffer(bytes(r["f"])).reshape(-1, p) for r in factors.orderBy("block").collect()]  # one factor but for rounding of block counts
    return reduced(np.vstack(found))


def gram_svd(m: Matrix, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest singular values and right vectors by the Gram matrix (squares the condition number)."""
    values, vectors = np.linalg.eigh(_collected(crossprod(m)))
    order = np.argsort(-values)[:k]
    return np.sqrt(np.maximum(values[order], 0)), _canonical(vectors[:, order])


@dataclass
class Pca:
    sdev: np.ndarray
    eigenvalues: np.ndarray
    variance: np.ndarray  # percent
    cumulative: np.ndarray
    loadings: np.ndarray  # V
    var_coord: np.ndarray  # V diag(d)
    var_cos2: np.ndarray
    center: np.ndarray
    ind_coord: Matrix  # sqrt(n) U diag(d)
    components: Matrix  # sqrt(n) U
    ind_dist: DataFrame  # i, v
    ind_cos2: Matrix
    ind_contrib: Matrix

    def __repr__(self) -> str:
        return "\n".join(f"{k + 1}: sd {s:.6g}, {v:.2f} %, {c:.2f} % in all" for k, (s, v, c) in enumerate(zip(self.sdev, self.variance, self.cumulative)))


def pca(m: Matrix, *, center: bool = True, scaled: bool = False, rank: int | None = None) -> Pca:
    """Principal components with coordinates of variables and individuals.

    Centred (and scaled) columns are multiplied by 1 / sqrt(n - 1); without both, the raw matrix is factored."""
    n = m.nrow
    x = scale(m, center, scaled, typify=True) if center or scaled else m
    x = x.to_rows()
    r = r_factor(x)
    _, d, vt = np.linalg.svd(r, full_matrices=False)
    kept = len(d) if rank is None else min(rank, len(d))
    v = _canonical(vt.T)[:, :kept]
    lam = d * d
    share = 100 * lam / lam.sum() if lam.sum() else np.zeros_like(lam)
    coord = v * d[:kept]
    root = float(np.sqrt(n))
    with np.errstate(divide="ignore"):
        inverse = np.where(d[:kept] > 0, 1 / d[:kept], 0.0)
    ind = project(x, v * root)
    stats = {r_["j"]: r_ for r_ in col_stats(m, ["mean", "sd"]).collect()}
    mean = np.array([stats[j]["mean"] for j in range(m.ncol)])
    sd = np.array([stats[j]["sd"] for j in range(m.ncol)]) * np.sqrt((n - 1) / n)
    with np.errstate(divide="ignore"):
        weights = np.where(sd > 0, 1 / sd, 0.0)
    z = F.aggregate(F.zip_with("vec", F.zip_with(F.array(*map(F.lit, mean.tolist())), F.array(*map(F.lit, weights.tolist())), lambda a, b: F.struct(a.alias("m"), b.alias("w"))), lambda a, b: (a - b["m"]) * b["w"]), F.lit(0.0), lambda t, a: t + a * a)
    distance = m.to_rows().df.select("i", F.sqrt(z).alias("v"))
    squares = ind.df.join(distance, "i").select("i", F.transform("vec", lambda a: F.try_divide(a * a, F.col("v") * F.col("v"))).alias("vec"))
    scale_by = F.array(*[F.lit(float(100 / (n * x_))) if x_ > 0 else F.lit(0.0) for x_ in lam[:kept]])
    contrib = ind.df.select("i", F.zip_with("vec", scale_by, lambda a, s: a * a * s).alias("vec"))
    of = lambda df: Matrix(df, n, kept, "rows", m.row_labels)
    return Pca(d[:kept], lam[:kept], share[:kept], np.cumsum(share)[:kept], v, coord, coord**2, mean, ind, project(x, v * inverse * root), distance, of(squares), of(contrib))


def _collected(m: Matrix) -> np.ndarray:
    if m.nrow != m.ncol:
        raise ValueError("square matrices only")
    if m.nrow > LARGEST:
        raise ValueError(f"more than {LARGEST} rows; operators.blocks has factors and solutions, operators.krylov eigenvalues of larger ones")
    return m.to_numpy(force=True)


@dataclass
class Eigen:
    values: np.ndarray
    vectors: np.ndarray | Matrix | None


def eigen(m: Matrix, k: int = 0, which: str = "LM", *, vectors: bool = True, tol: float = 1e-10, max_iter: int = 1000) -> Eigen:
    """Eigenvalues, decreasing, of a square matrix; k of them by ``which``: LM, SM, LA, SA, LR, SR, LI, SI.

    Symmetry is found out. Values of a matrix that isn't symmetric may be complex. k of more than ``COLLECTED`` rows are
    iterated by products alone (``krylov.eigs``), to ``tol`` in at most ``max_iter`` restarts; all eigenvalues of a symmetric
    one of more than ``LARGEST`` rows come from ``jacobi.eigen_blocks``, whose vectors are a Matrix. Smaller matrices are
    exact on the driver."""
    keys = {"LM": lambda x: -np.abs(x), "SM": np.abs, "LA": lambda x: -x.real, "SA": lambda x: x.real, "LR": lambda x: -x.real, "SR": lambda x: x.real, "LI": lambda x: -np.abs(x.imag), "SI": lambda x: np.abs(x.imag)}
    if which not in keys:
        raise ValueError(f"unknown selection {which!r}")
    if 0 < k < m.nrow and m.nrow > COLLECTED:
        from matloom.operators.krylov import eigs

        return eigs(m, k, which, tol=tol, max_iter=max_iter, vectors=vectors)
    if m.nrow == m.ncol and m.nrow > LARGEST:
        from matloom.operators.jacobi import eigen_blocks
        from matloom.operators.krylov import is_symmetric

        if is_symmetric(m):
            return eigen_blocks(m, vectors=vectors, tol=tol)
    a = _collected(m)
    symmetric = np.allclose(a, a.T, rtol=1e-12, atol=1e-12 * max(1.0, np.abs(a).max(initial=0)))
    values, found = np.linalg.eigh(a) if symmetric else np.linalg.eig(a)
    order = np.argsort(-values.real, kind="stable")
    if 0 < k < len(values):
        order = np.argsort(keys[which](values), kind="stable")[:k]
        order = order[np.argsort(-values[order].real, kind="stable")]
    values, found = values[order], found[:, order]
    if symmetric:
        found = _canonical(found)
    return Eigen(values, found if vectors else None)


def power_iteration(m: Matrix, *, tol: float = 1e-10, max_iter: int = 200, seed: int = 1) -> tuple[float, np.ndarray]:
    """The dominant eigenvalue of a symmetric matrix of any number of rows, by distributed products with a vector."""
    v = np.random.default_rng(seed).standard_normal(m.ncol)
    v /= np.linalg.norm(v)
    value = 0.0
    rows = m.to_rows()
    rows = Matrix(durable(rows.df, "rows"), *m.dim, "rows")
    for _ in range(max_iter):
        w = project(rows, v[:, None]).to_numpy(force=True)[:, 0]
        new, size = float(v @ w), np.linalg.norm(w)
        if size == 0:
            return 0.0, v
        v = w / size
        if abs(new - value) <= tol * max(1.0, abs(new)):
            return new, v
        value = new
    return value, v


def chol(m: Matrix, *, lower: bool = False, full: bool = False) -> np.ndarray:
    """The upper factor U with A = t(U) U (``lower``: its transpose; ``full``: the triangle mirrored)."""
    try:
        found = np.linalg.cholesky(_collected(m)).T
    except np.linalg.LinAlgError:
        raise np.linalg.LinAlgError("the matrix may not be positive definite") from None
    if full:
        return found + found.T - np.diag(np.diag(found))
    return found.T if lower else found


def inverse(m: Matrix) -> np.ndarray:
    """Of a symmetric positive definite matrix, by its Cholesky factor."""
    u = np.linalg.inv(chol(m))
    return u @ u.T


def solve(a: Matrix, b: Matrix) -> np.ndarray:
    """X with A X = B for a square A. Larger ones and more right-hand sides than the driver holds: ``blocks.solve_general``."""
    if a.nrow != b.nrow:
        raise ValueError("non-conformable")
    return np.linalg.solve(_collected(a), b.to_numpy())


def pseudoinverse(m: Matrix) -> Matrix:
    """V diag(1 / d) t(U); singular values of 1e-9 or less count as zero. The result has the matrix's rows as columns."""
    wide = m.ncol > m.nrow
    tall = m.t().to_rows() if wide else m.to_rows()
    _, d, vt = np.linalg.svd(r_factor(tall), full_matrices=False)
    weights = np.where(d > 1e-9, 1 / np.where(d > 1e-9, d, 1.0), 0.0)
    # X = U D Vt, so X+ = V D^-2 Vt t(X): a projection of rows, transposed
    found = project(tall, (vt.T * weights**2) @ vt)
    return found if wide else found.t()


def pseudoinverse_product(m: Matrix, b: Matrix) -> Matrix:
    """The pseudoinverse times a matrix with the same rows, without the pseudoinverse: V D^-2 t(V) (t(X) B)."""
    if m.nrow != b.nrow:
        raise ValueError("non-conformable")
    if m.ncol > m.nrow:
        return pseudoinverse(m) @ b
    _, d, vt = np.linalg.svd(r_factor(m.to_rows()), full_matrices=False)
    weights = np.where(d > 1e-9, 1 / np.where(d > 1e-9, d, 1.0), 0.0)
    return project(crossprod(m, None if b is m else b), (vt.T * weights**2) @ vt, left=True)


def ols(x: Matrix, y: Matrix, *, intercept: bool = True) -> np.ndarray:
    """Least-squares coefficients (the intercept first) by R of (1, X, y)."""
    from matloom.operators.restructure import cbind

    return ols_of(cbind(x, y), y.ncol, intercept=intercept)


def ols_of(m: Matrix, responses: int = 1, *, intercept: bool = True) -> np.ndarray:
    """The same where X and y (the last ``responses`` columns) are columns of one matrix: no join, rows in any order."""
    both, p = m.to_rows(), m.ncol - responses + int(intercept)
    if intercept:
        both = Matrix(both.df.select("i", F.concat(F.array(F.lit(1.0)), "vec").alias("vec")), both.nrow, both.ncol + 1, "rows")
    r = r_factor(both)
    return np.linalg.lstsq(r[:p, :p], r[:p, p:], rcond=None)[0]


def cca(x: Matrix, y: Matrix) -> np.ndarray:
    """Canonical correlations of the columns of two centred matrices with the same rows."""
    from matloom.operators.restructure import cbind

    r = r_factor(cbind(scale(x, True, False), scale(y, True, False)))
    p = x.ncol
    # X = Q1 R11, Y = Q1 R12 + Q2 R22: an orthonormal basis of Y in the basis of Q
    qy = np.linalg.qr(r[:, p:])[0]
    return np.clip(np.linalg.svd(qy[:p], compute_uv=False), 0, 1)[: min(p, y.ncol)]
