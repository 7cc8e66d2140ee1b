"""Cell by cell: arithmetic of matrices, broadcast vectors, normalisation, diagonals."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matloom.matrix import Matrix, same_shape, small
from matloom.operators.aggregates import col_stats, row_stats

NAMES = {"add": "+", "subtract": "-", "multiply": "*", "divide": "/", "power": "pow", "^": "pow"}


def divide(a: Column, b: Column) -> Column:
    """IEEE division: x / 0 is infinite, 0 / 0 is not a number."""
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def apply_op(a: Column, b: Column, op: str) -> Column:
    op = NAMES.get(op, op)
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "/":
        return divide(a, b)
    if op == "pow":
        return F.pow(a, b)
    raise ValueError(f"not supported: {op}")


def binary(a: Matrix, b, op: str, *, swapped: bool = False) -> Matrix:
    """``a op b`` of two matrices of one shape; a matrix of one row or column is broadcast along the other axis.

    Two matrices in the wide or rows layout join once by row; cells stored one by one join by (i, j)."""
    if not isinstance(b, Matrix):
        raise TypeError("both operands must be matrices; see diag_scale and scalar_product")
    if a.dim != b.dim and 1 in b.dim:
        return _broadcast(a, b, op)
    if a.dim != b.dim and 1 in a.dim:
        return _broadcast(b, a, op, swapped=True)
    same_shape(a, b)
    if a.layout == b.layout == "wide":
        joined = a.df.join(b.df.select("i", *[F.col(c).alias(f"r_{c}") for c in b.names]), "i")
        return Matrix(joined.select("i", *[apply_op(F.col(c), F.col(f"r_{c}"), op).alias(c) for c in a.names]), *a.dim, "wide", a.row_labels, a.col_labels)
    if "coo" not in (a.layout, b.layout):
        joined = a.to_rows().df.join(b.to_rows().df.withColumnRenamed("vec", "right"), "i")
        return Matrix(joined.select("i", F.zip_with("vec", "right", lambda x, y: apply_op(x, y, op)).alias("vec")), *a.dim, "rows", a.row_labels, a.col_labels)
    left, right = a.to_coo().df, b.to_coo().df.withColumnRenamed("v", "w")
    zero = F.lit(0.0)
    joined = left.join(right, ["i", "j"], "full").select("i", "j", apply_op(F.coalesce("v", zero), F.coalesce("w", zero), op).alias("v"))
    if NAMES.get(op, op) in ("/", "pow"):  # cells that neither has aren't zero in the result
        return Matrix(joined, *a.dim, "coo", a.row_labels, a.col_labels).every_cell(float("nan") if NAMES.get(op, op) == "/" else 1.0)
    return Matrix(joined, *a.dim, "coo", a.row_labels, a.col_labels)


def _as_vector(v: Matrix) -> DataFrame:
    """``k, w`` of a matrix of one row or column."""
    coo = v.to_coo().df
    return coo.select((F.col("j").cast("long") if v.nrow == 1 else F.col("i")).alias("k"), F.col("v").alias("w"))


def _broadcast(a: Matrix, v: Matrix, op: str, *, swapped: bool = False) -> Matrix:
    size = len(v)
    if size == a.ncol and (v.nrow == 1 or a.ncol != a.nrow or size != a.nrow):
        margin = 2
    elif size == a.nrow:
        margin = 1
    else:
        raise ValueError(f"non-conformable: {a.dim} and {v.dim}")
    return sweep(a, _as_vector(v), margin, op, swapped=swapped)


def sweep(m: Matrix, stats: DataFrame | Matrix, margin: int = 2, fun: str = "*", *, swapped: bool = False, finish=None) -> Matrix:
    """``x fun s`` with one statistic for each column (``margin`` 2) or row (1). ``stats``: ``k, w`` (or j/i and v).

    Statistics of columns are as many as the matrix is wide and join to its rows as one small row; those of rows join by
    row, and the optimizer decides how. Of the ``coo`` layout products and quotients keep absent cells absent, except where
    a statistic makes zero something else (0 / 0, 0 * Inf); the other operations store every cell. ``finish``: a function of
    columns that each value passes through, once for all cells that a statistic makes of zero."""
    op = NAMES.get(fun, fun)
    if isinstance(stats, Matrix):
        if len(stats) != (m.ncol if margin == 2 else m.nrow):
            raise ValueError("statistics and margin differ in length")
        stats = _as_vector(stats)
    else:
        stats = stats.toDF("k", "w")
    finish = finish or (lambda v: v)
    f = (lambda x, s: finish(apply_op(s, x, op))) if swapped else (lambda x, s: finish(apply_op(x, s, op)))
    if margin not in (1, 2):
        raise ValueError("margin is 1 or 2")
    if m.layout == "coo":
        return _sweep_cells(m, stats, margin, f, op == "*" or op == "/" and not swapped)
    if margin == 1:
        keyed = stats.withColumnRenamed("k", "i")
        if m.layout == "wide":
            return replace(m, df=m.df.join(keyed, "i").select("i", *[f(F.col(c), F.col("w")).alias(c) for c in m.names]))
        return replace(m, df=m.df.join(keyed, "i").select("i", F.transform("vec", lambda x: f(x, F.col("w"))).alias("vec")))
    every = m.df.sparkSession.range(m.ncol).select(F.col("id").alias("k")).join(stats.select(F.col("k").cast("long").alias("k"), "w"), "k", "left")
    row = every.agg(F.sort_array(F.collect_list(F.struct("k", "w")))["w"].alias("s"))  # ncol entries
    crossed = m.df.join(F.broadcast(row))  # one row
    if m.layout == "wide":
        return replace(m, df=crossed.select("i", *[f(F.col(c), F.get("s", j)).alias(c) for j, c in enumerate(m.names)]))
    return replace(m, df=crossed.select("i", F.zip_with("vec", "s", f).alias("vec")))


def _sweep_cells(m: Matrix, stats: DataFrame, margin: int, f, sparse: bool) -> Matrix:
    """Cell by cell; ``sparse``: zeros stay zeros but for statistics that are zero or not finite."""
    axis, other, size = ("j", "i", m.nrow) if margin == 2 else ("i", "j", m.ncol)
    keyed = small(stats.select(F.col("k").cast("int" if margin == 2 else "long").alias(axis), "w"), m.ncol if margin == 2 else m.nrow)
    done = (m.df if sparse else m.df.withColumn("v", F.coalesce("v", F.lit(0.0)))).join(keyed, axis).select("i", "j", f(F.col("v"), F.col("w")).alias("v"))
    if not sparse:
        return replace(m, df=done).every_cell(keyed.select(axis, f(F.lit(0.0), F.col("w"))), axis)
    odd = keyed.where(F.isnan(f(F.lit(0.0), F.col("w"))))  # few or none
    whole = odd.join(m.df.sparkSession.range(size).select(F.col("id").cast("int" if margin == 1 else "long").alias(other))).join(m.df, ["i", "j"], "left_anti")
    return replace(m, df=done.unionByName(whole.select("i", "j", f(F.lit(0.0), F.col("w")).alias("v"))))


def scale(m: Matrix, center: bool = True, scaled: bool = True, by_rows: bool = False, *, typify: bool = False) -> Matrix:
    """Centred and divided by the standard deviation (n - 1); by the root mean square if not centred.

    ``typify`` multiplies by 1 / sqrt(n - 1) as well and always divides by the centred deviation."""
    if not center and not scaled:
        return m
    size, axis = (m.ncol, "i") if by_rows else (m.nrow, "j")
    stats = (row_stats if by_rows else col_stats)(m, ["mean", "sd"])
    mean, deviation = F.col("mean"), F.col("sd")
    if not center and not typify:
        deviation = F.sqrt((deviation * deviation * F.lit(size - 1.0) + F.lit(float(size)) * mean * mean) / F.lit(size - 1.0))
    if typify:
        deviation = deviation * F.lit((size - 1.0) ** 0.5)
    margin = 1 if by_rows else 2
    out = m.to_rows() if m.layout == "coo" else m
    if center:
        out = sweep(out, stats.select(axis, mean.alias("v")), margin, "-")
    if scaled:
        out = sweep(out, stats.select(axis, deviation.alias("v")), margin, "/")
    elif typify:
        out = out.map_values(lambda x: x / F.lit((size - 1.0) ** 0.5))
    return out


def scalar_product(m: Matrix, w: float) -> Matrix:
    return m.map_values(lambda x: x * F.lit(float(w)))


# ---- diagonals


def diag(m: Matrix) -> DataFrame:
    """``k, v`` of the main diagonal."""
    n = min(m.dim)
    if m.layout == "coo":
        every = m.df.sparkSession.range(n).withColumnRenamed("id", "k")
        return every.join(m.df.where("i = j").select(F.col("i").alias("k"), "v"), "k", "left").select("k", F.coalesce("v", F.lit(0.0)).alias("v"))
    return m.to_rows().df.where(F.col("i") < n).select(F.col("i").alias("k"), F.get("vec", F.col("i").cast("int")).alias("v"))


def set_diag(m: Matrix, values: list[float] | DataFrame) -> Matrix:
    """With another diagonal; as many values as it has."""
    n = min(m.dim)
    if not isinstance(values, DataFrame):
        if len(values) != n:
            raise ValueError(f"{len(values)} values for a diagonal of {n}")
        values = m.df.sparkSession.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k long, w double")
    values = values.toDF("k", "w")
    rows = m.to_rows()
    joined = rows.df.join(values.withColumnRenamed("k", "i"), "i", "left")
    vec = F.when(F.col("w").isNull(), F.col("vec")).otherwise(F.transform("vec", lambda x, j: F.when(j == F.col("i"), F.col("w")).otherwise(x)))
    return replace(rows, df=joined.select("i", vec.alias("vec")))


def _diagonal(x: Matrix | DataFrame) -> DataFrame:
    if isinstance(x, DataFrame):
        return x.toDF("k", "v")
    if 1 in x.dim and x.nrow != x.ncol:
        return _as_vector(x).toDF("k", "v")
    if x.nrow != x.ncol:
        raise ValueError("square matrices or vectors only")
    return diag(x)


def diag_op(x: Matrix | DataFrame, y: Matrix | DataFrame, op: str = "+", *, as_matrix: bool = False):
    """``diag(x) op diag(y)`` as ``k, v``, vectors taken as they are; ``as_matrix``: x with that diagonal."""
    joined = _diagonal(x).join(_diagonal(y).toDF("k", "w"), "k").select("k", apply_op(F.col("v"), F.col("w"), op).alias("v"))
    return set_diag(x, joined) if as_matrix else joined


def diag_scale(x: Matrix | DataFrame, scalar: float, op: str = "*", *, as_matrix: bool = False):
    """``diag(x) op scalar`` as ``k, v``."""
    done = _diagonal(x).select("k", apply_op(F.col("v"), F.lit(float(scalar)), op).alias("v"))
    return set_diag(x, done) if as_matrix else done


def diagonal_matrix(values: DataFrame, n: int) -> Matrix:
    """A square matrix with ``k, v`` on its diagonal."""
    return Matrix.from_coo(values.toDF("k", "v").select(F.col("k").alias("i"), F.col("k").alias("j"), "v"), n, n)


def vector_op(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Two vectors ``k, v``, element by element."""
    return a.toDF("k", "v").join(b.toDF("k", "w"), "k").select("k", apply_op(F.col("v"), F.col("w"), op).alias("v"))
