"""A few eigenvalues or singular values of matrices that nobody collects: everything goes by products with the matrix.

``eigs``: a Krylov basis (Lanczos if the matrix is symmetric, else Arnoldi) with full orthogonalisation, restarted thickly
with the wanted Ritz vectors until the residuals of all of them are below the tolerance. The driver holds the basis, n
numbers for each of ``ncv`` vectors; a product is one pass over the rows of the matrix with the vector broadcast.

``truncated_svd``: a block Krylov space of t(X) X from a random band of k + ``oversample`` columns. The matrix meets bands
only; they stay distributed, are made orthonormal against all earlier ones and by R factors, and the singular values come
from R of X V. No Gram matrix is formed, so small singular values keep their digits, and both sides may be large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from matloom.matrix import Matrix
from matloom.operators.factor import Eigen, Svd, _canonical, project, r_factor
from matloom.operators.products import crossprod, matmul
from matloom.plans.durable import durable

#: Numbers of the basis that the driver holds at most.
MOST_HELD = 200_000_000

# Names of the selections, with the order in which each prefers eigenvalues.
WANTED: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "LM": lambda x: -np.abs(x), "SM": lambda x: np.abs(x), "LA": lambda x: -x.real, "SA": lambda x: x.real,
    "LR": lambda x: -x.real, "SR": lambda x: x.real, "LI": lambda x: -np.abs(x.imag), "SI": lambda x: np.abs(x.imag),
}


class NotConverged(ArithmeticError):
    """Fewer eigenvalues than asked for met the tolerance."""


def _product(m: Matrix) -> Callable[[np.ndarray], np.ndarray]:
    """``A @ v`` for vectors on the driver; the matrix's rows are written once, as cells for the ``coo`` layout."""
    spark = m.df.sparkSession
    cells = m.layout == "coo"
    held = durable((m.df if cells else m.to_rows().df.select("i", "vec")), "matrix")

    def apply(v: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(v)

        def of_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    yield pd.DataFrame({"i": frame["i"], "v": np.stack(frame["vec"].to_list()) @ sent.value})

        def of_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    yield pd.DataFrame({"i": frame["i"], "v": frame["v"].to_numpy() * sent.value[frame["j"].to_numpy()]}).groupby("i", as_index=False).sum()

        made = held.mapInPandas(of_cells if cells else of_rows, "i long, v double")
        table = (made.groupBy("i").agg(F.sum("v").alias("v")) if cells else made).toPandas()  # a number for each row
        out = np.zeros(m.nrow)
        out[table["i"].to_numpy(int)] = table["v"].to_numpy(float)
        sent.unpersist()
        return out

    return lambda v: apply(v.real.copy()) + 1j * apply(v.imag.copy()) if np.iscomplexobj(v) else apply(v)


def is_symmetric(m: Matrix) -> bool:
    """To rounding, by a join of the cells with those of the transposed matrix."""
    cells = m.to_coo().df.where("v <> 0")
    other = cells.select(F.col("j").cast("long").alias("i"), F.col("i").cast("int").alias("j"), F.col("v").alias("w"))
    gap = F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("w", F.lit(0.0)))
    row = cells.join(other, ["i", "j"], "full").agg(F.max(gap).alias("gap"), F.max(F.abs("v")).alias("most")).first()
    return (row["gap"] or 0.0) <= 1e-12 * max(1.0, row["most"] or 0.0)


def eigs(m: Matrix, k: int, which: str = "LM", *, ncv: int | None = None, tol: float = 1e-10, max_iter: int = 300, symmetric: bool | None = None, vectors: bool = True, seed: int = 1) -> Eigen:
    """k eigenvalues, decreasing by real part, of a square matrix by ``which``: LM, SM, LA, SA, LR, SR, LI, SI.

    ``ncv``: vectors of the basis; ``tol``: residuals relative to the eigenvalue; ``max_iter``: restarts, after which
    ``NotConverged`` is raised. Values of a matrix that isn't symmetric may be complex; of a complex pair that k would cut
    in two, both are kept while iterating and k returned."""
    if m.nrow != m.ncol:
        raise ValueError("square matrices only")
    size = basis_size(m.nrow, k, which, ncv)
    symmetric = is_symmetric(m) if symmetric is None else symmetric
    return iterate(_product(m), m.nrow, k, which, size, symmetric=symmetric, tol=tol, max_iter=max_iter, vectors=vectors, seed=seed)


def basis_size(n: int, k: int, which: str, ncv: int | None = None) -> int:
    """Vectors of the basis; what was asked for is checked."""
    if which not in WANTED:
        raise ValueError(f"unknown selection {which!r}")
    if not 1 <= k <= n:
        raise ValueError("1 to n eigenvalues")
    size = min(n, max(2 * k + 2, k + 20) if ncv is None else ncv)
    if size < min(n, k + 1):
        raise ValueError("ncv exceeds k at least by one")
    if n * size > MOST_HELD:
        raise MemoryError(f"a basis of {n} x {size} numbers; use fewer vectors")
    return size


def iterate(multiply: Callable[[np.ndarray], np.ndarray], n: int, k: int, which: str, size: int, *, symmetric: bool, tol: float = 1e-10, max_iter: int = 300, vectors: bool = True, seed: int = 1) -> Eigen:
    """The restarted iteration with any product ``A @ v``, a basis of ``size`` vectors of n numbers."""
    kind, draw = float if symmetric else complex, np.random.default_rng(seed)

    def orthogonal(w: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros(basis.shape[1], kind)
        for _ in range(2):  # twice is enough
            part = basis.conj().T @ w
            w, total = w - basis @ part, total + part
        return w, total

    def fresh(basis: np.ndarray) -> np.ndarray:
        w = orthogonal(draw.standard_normal(n).astype(kind), basis)[0]
        return w / np.linalg.norm(w)

    basis = np.zeros((n, size), kind)
    basis[:, 0] = fresh(basis[:, :0])
    small, done, scale = np.zeros((size, size), kind), 0, 0.0
    row = np.zeros(0, kind)  # how the kept vectors meet the next one
    for _ in range(max_iter):
        following = None
        for at in range(done, size):
            v = basis[:, at]
            w = multiply(v if symmetric or np.abs(v.imag).max() > 0 else v.real).astype(kind)
            scale = max(scale, float(np.linalg.norm(w)))
            w, column = orthogonal(w, basis[:, : at + 1])
            small[: at + 1, at] = column
            beta = float(np.linalg.norm(w))
            if beta <= 1e-13 * scale:  # an invariant subspace: go on anywhere else
                beta, w = 0.0, fresh(basis[:, : at + 1]) if at + 1 < n else np.zeros(n, kind)
            else:
                w = w / beta
            if at + 1 < size:
                basis[:, at + 1], small[at + 1, at] = w, beta
            following, last = w, beta
        if symmetric:
            values, found = np.linalg.eigh((small + small.conj().T) / 2)
        else:
            values, found = np.linalg.eig(small)
        order = np.argsort(WANTED[which](values), kind="stable")
        residual = last * np.abs(found[-1])
        best = order[:k]
        if size == n or (residual[best] <= tol * np.maximum(np.abs(values[best]), 2.3e-16 ** (2 / 3) * max(scale, 1e-300))).all():
            break
        # thick restart: an orthonormal basis of the best Ritz vectors, and the next vector
        keep = min(size - 1, k + max(1, (size - k) // 2))
        if not symmetric and keep < size - 1 and abs(values[order[keep - 1]].imag) > 0 and abs(values[order[keep - 1]] - values[order[keep]].conj()) < 1e-9 * max(1.0, abs(values[order[keep]])):
            keep += 1
        turn = np.linalg.qr(found[:, order[:keep]])[0]
        basis[:, :keep] = basis @ turn
        inner, row = turn.conj().T @ small @ turn, last * turn[-1]
        small[:] = 0
        small[:keep, :keep] = inner
        basis[:, keep], small[keep, :keep] = following, row
        done = keep
    else:
        raise NotConverged(f"{int((residual[best] <= tol * np.abs(values[best])).sum())} of {k} eigenvalues after {max_iter} restarts")
    best = best[np.argsort(-values[best].real, kind="stable")]
    values = values[best]
    if not symmetric and np.abs(values.imag).max() <= 1e-10 * max(1e-300, np.abs(values).max()):
        values = values.real
    if not vectors:
        return Eigen(values, None)
    found = basis @ found[:, best]
    if not np.iscomplexobj(values) and np.iscomplexobj(found):
        at = np.abs(found).argmax(0)
        found = found * np.exp(-1j * np.angle(found[at, np.arange(len(at))]))
        found = found.real
    found = found / np.linalg.norm(found, axis=0)
    return Eigen(values, _canonical(found) if not np.iscomplexobj(found) else found)


def _orthonormal(band: Matrix) -> Matrix:
    """An orthonormal basis of the columns, by R factors; directions that depend on others get no column."""
    _, d, vt = np.linalg.svd(r_factor(band))
    kept = int((d > 1e-13 * max(d.max(initial=0), 1e-300)).sum())
    q = Matrix(durable(project(band, vt[:kept].T / d[:kept]).df, "band"), band.nrow, kept, "rows")
    return Matrix(durable(project(q, np.linalg.inv(r_factor(q))).df, "band"), band.nrow, kept, "rows")


def _beside(a: Matrix, b: Matrix, f, ncol: int) -> Matrix:
    """``f`` of the same rows of two bands."""
    both = a.df.select("i", F.col("vec").alias("x")).join(b.df.select("i", F.col("vec").alias("y")), "i")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"i": frame["i"], "vec": list(f(np.stack(frame["x"].to_list()), np.stack(frame["y"].to_list())))})

    return Matrix(durable(both.mapInPandas(run, "i long, vec array<double>"), "band"), a.nrow, ncol, "rows")


def _normal(spark, nrow: int, ncol: int, seed: int) -> Matrix:
    """Normal numbers that depend on the place alone."""
    u = lambda k, j: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), F.col("id"), j), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    vec = F.transform(F.sequence(F.lit(0), F.lit(ncol - 1)), lambda j: F.sqrt(-2 * F.log(u(1, j))) * F.cos(2 * np.pi * u(2, j)))
    return Matrix(spark.range(nrow).select(F.col("id").alias("i"), vec.alias("vec")), nrow, ncol, "rows")


def truncated_svd(m: Matrix, k: int, *, oversample: int = 10, tol: float = 1e-10, max_steps: int = 12, seed: int = 1) -> Svd:
    """The k largest singular values (fewer if the rank is lower) and both sides' vectors. A step adds a band; the last one
    is that which changes none of the k values by more than ``tol`` of the largest, or the ``max_steps``-th."""
    if not 1 <= k <= min(m.dim):
        raise ValueError("1 to min(dim) singular values")
    width = min(min(m.dim), k + oversample)
    x = Matrix(durable(m.df, "matrix"), *m.dim, m.layout, m.row_labels, m.col_labels)
    times = lambda band, transposed: matmul(x, band, transpose_a=transposed).to_rows()
    new = basis = _orthonormal(times(_normal(m.df.sparkSession, m.nrow, width, seed), True))
    before = None
    for step in range(max_steps):
        _, d, vt = np.linalg.svd(r_factor(times(basis, False)), full_matrices=False)
        steady = before is not None and len(before) >= min(k, len(d)) and np.abs(d[:k] - before[: len(d[:k])]).max() <= tol * d[0]
        if steady or step == max_steps - 1 or basis.ncol >= min(m.dim) or not d.max(initial=0):
            break
        before = d[:k]
        band = times(times(new, False), True)
        scale = np.linalg.norm(r_factor(band))
        for _ in range(2):  # twice is enough
            shared = crossprod(basis, band).to_numpy()
            band = _beside(basis, band, lambda v, w, c=shared: w - v @ c, band.ncol)
        if np.linalg.norm(r_factor(band)) <= 1e-12 * scale:  # nothing outside of the space
            break
        new = _orthonormal(band)
        basis = _beside(basis, new, lambda v, w: np.hstack([v, w]), basis.ncol + new.ncol)
    k = min(k, int((d > 1e-13 * d.max(initial=0)).sum()))
    right = Matrix(durable(project(basis, vt[:k].T).df, "band"), m.ncol, k, "rows")
    return Svd(d[:k], project(times(right, False), np.diag(1 / d[:k])), right)

