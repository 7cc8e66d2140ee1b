"""Statistics of columns, of rows and of all cells, each as one aggregation with partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matloom.matrix import Matrix

STATS = ("sum", "mean", "min", "max", "var", "sd")


def _nan(c: Column) -> Column:
    return F.coalesce(c, F.lit(float("nan")))


def _stat(value: Column, stat: str, na_rm: bool = False) -> Column:
    """An aggregate of dense values; ``na_rm`` passes over NaN. Fewer than two values have variance NaN."""
    if stat not in STATS:
        raise ValueError(f"unknown statistic {stat!r}")
    v = F.when(~F.isnan(value), value) if na_rm else value
    return {"sum": lambda: F.coalesce(F.sum(v), F.lit(0.0)), "mean": lambda: _nan(F.avg(v)), "min": lambda: F.min(v), "max": lambda: F.max(v), "var": lambda: _nan(F.var_samp(v)), "sd": lambda: _nan(F.stddev_samp(v))}[stat]()


def _sparse(stat: str, cells: int, na_rm: bool = False) -> Column:
    """The aggregate of the stored cells ``v`` of a group of ``cells`` cells, the others zero; ``na_rm`` takes NaN cells
    out of the group."""
    if stat not in STATS:
        raise ValueError(f"unknown statistic {stat!r}")
    v, size = F.col("v"), F.lit(cells).cast("double")
    if na_rm:
        v, size = F.when(~F.isnan("v"), F.col("v")), size - F.count(F.when(F.isnan("v"), 1))
    n, total = F.count(v), F.coalesce(F.sum(v), F.lit(0.0))
    if stat == "sum":
        return total
    mean_all = _nan(F.try_divide(total, size))
    if stat == "mean":
        return mean_all
    if stat in ("min", "max"):
        zero = F.when(n < size, F.lit(0.0))
        return F.least(F.min(v), zero) if stat == "min" else F.greatest(F.max(v), zero)
    # squares about the stored cells' own mean, then shifted: no cancellation of large sums
    about = F.coalesce(F.var_pop(v), F.lit(0.0)) * n
    own_mean = F.coalesce(F.avg(v), F.lit(0.0))
    squares = about + n * (own_mean - mean_all) * (own_mean - mean_all) + (size - n) * mean_all * mean_all
    var = F.when(size < 2, F.lit(float("nan"))).otherwise(F.try_divide(squares, size - 1))
    return F.sqrt(var) if stat == "sd" else var


def col_stats(m: Matrix, stats: list[str], *, na_rm: bool = False) -> DataFrame:
    """``j`` and a column for each statistic, of every column of the matrix, in one pass."""
    if m.layout == "wide":
        row = m.df.agg(*[_stat(F.col(c), s, na_rm).alias(f"{s}_{c}") for c in m.names for s in stats])
        return row.select(F.inline(F.array(*[F.struct(F.lit(j).alias("j"), *[F.col(f"{s}_c{j}").alias(s) for s in stats]) for j in range(m.ncol)])))
    if m.layout == "rows":
        return m.to_coo().df.groupBy("j").agg(*[_stat(F.col("v"), s, na_rm).alias(s) for s in stats])
    every = m.df.sparkSession.range(m.ncol).select(F.col("id").cast("int").alias("j"))
    return every.join(m.df, "j", "left").groupBy("j").agg(*[_sparse(s, m.nrow, na_rm).alias(s) for s in stats])


def row_stats(m: Matrix, stats: list[str], *, na_rm: bool = False) -> DataFrame:
    """``i`` and a column for each statistic of every row; without any shuffle unless cells are stored one by one."""
    if m.layout == "coo":
        every = m.df.sparkSession.range(m.nrow).withColumnRenamed("id", "i")
        return every.join(m.df, "i", "left").groupBy("i").agg(*[_sparse(s, m.ncol, na_rm).alias(s) for s in stats])
    vec = F.col("vec")
    if na_rm:
        vec = F.filter(vec, lambda x: ~F.isnan(x))
    n = F.size(vec).cast("double")
    total = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x)
    mean = F.try_divide(total, n)
    var = F.when(n < 2, F.lit(float("nan"))).otherwise(F.try_divide(F.aggregate(vec, F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))), n - 1))
    made = {"sum": total, "mean": _nan(mean), "min": F.array_min(vec), "max": F.array_max(vec), "var": var, "sd": F.sqrt(var)}
    if set(stats) - set(made):
        raise ValueError(f"unknown statistic in {stats}")
    return m.to_rows().df.withColumn("_mean", mean).select("i", *[made[s].alias(s) for s in stats])


def total_stats(m: Matrix, stats: list[str], *, na_rm: bool = False) -> DataFrame:
    """One row: statistics over all cells (variance with N - 1)."""
    if m.layout == "coo":
        return m.df.agg(*[_sparse(s, len(m), na_rm).alias(s) for s in stats])
    return m.to_coo().df.agg(*[_stat(F.col("v"), s, na_rm).alias(s) for s in stats])


def _value(frame: DataFrame, stat: str) -> float:
    return float(frame.first()[stat])


def summary(m: Matrix, what: str, *others, **options) -> float:
    """``sum``, ``min`` or ``max`` of one matrix; others of the group aren't supported."""
    if what not in ("sum", "min", "max"):
        raise ValueError(f"{what} is not supported")
    if others:
        raise ValueError("exactly one matrix")
    return _value(total_stats(m, [what], **options), what)


def _of_columns(stat: str):
    def f(m: Matrix, **options) -> DataFrame:
        return col_stats(m, [stat], **options).select("j", F.col(stat).alias("v"))

    f.__doc__ = f"The {stat} of each column: ``j, v``."
    return f


def _of_rows(stat: str):
    def f(m: Matrix, **options) -> DataFrame:
        return row_stats(m, [stat], **options).select("i", F.col(stat).alias("v"))

    f.__doc__ = f"The {stat} of each row: ``i, v``."
    return f


col_sums, col_means, col_mins, col_maxs, col_vars, col_sds = map(_of_columns, STATS)
row_sums, row_means, row_mins, row_maxs, row_vars, row_sds = map(_of_rows, STATS)


def mean(m: Matrix, **options) -> float:
    return _value(total_stats(m, ["mean"], **options), "mean")


def var(m: Matrix, **options) -> float:
    """Of all cells; not a covariance matrix."""
    return _value(total_stats(m, ["var"], **options), "var")


def sd(m: Matrix, **options) -> float:
    return _value(total_stats(m, ["sd"], **options), "sd")
