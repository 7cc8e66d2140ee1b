"""Quality control of genotypes coded 0, 1, 2, with 3 for missing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matloom.matrix import Matrix, small
from matloom.plans.durable import durable
from matloom.plans.index import with_position


@dataclass
class Filtered:
    matrix: Matrix
    removed: int


def _missing(v: Column, missing: str) -> Column:
    if missing == "code":
        return v == 3
    if missing == "nan":
        return F.isnan(v)
    raise ValueError("missing is code or nan")


def _features(m: Matrix, by_cols: bool, counts: dict[str, Column]) -> DataFrame:
    """Counts of each feature's stored cells by name (0 where it has none), and ``n``, the number of all its cells.

    Features are as many as the matrix is wide (or tall); their counts take one pass with partial sums."""
    axis, features, n = ("j", m.ncol, m.nrow) if by_cols else ("i", m.nrow, m.ncol)
    counted = m.to_coo().df.groupBy(axis).agg(*[c.alias(k) for k, c in counts.items()])
    every = m.df.sparkSession.range(features).select(F.col("id").cast("int" if by_cols else "long").alias(axis))
    return every.join(counted, axis, "left").na.fill(0, list(counts)).withColumn("n", F.lit(float(n)))


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1)).cast("double")


def _other() -> Column:
    """Absent cells are of code 0, so those of code 0 are counted as the ones that aren't of another."""
    return _count(F.col("v") != 0)


def _keep(m: Matrix, by_cols: bool, drop: Column, counts: dict[str, Column]) -> Filtered:
    """Without the features (columns or rows) where ``drop`` holds; the others are numbered anew, in order."""
    axis = "j" if by_cols else "i"
    cells = m.to_coo().df
    flags = durable(_features(m, by_cols, counts).select(axis, drop.alias("gone")), "flags")
    kept = with_position(flags.where(~F.col("gone")).select(axis), [axis], "_new")
    n_kept = kept.count()
    df = cells.join(small(kept, n_kept), axis).drop(axis).withColumn(axis, F.col("_new").cast("int" if by_cols else "long"))
    shape = (m.nrow, n_kept) if by_cols else (n_kept, m.ncol)
    return Filtered(Matrix(df.select("i", "j", "v"), *shape, "coo"), (m.ncol if by_cols else m.nrow) - n_kept)


def filter_low_coverage(m: Matrix, pcent: float = 0.05, by_cols: bool = True, *, missing: str = "code") -> Filtered:
    """Removes features whose share of missing cells is ``pcent`` or more."""
    if not 0 <= pcent <= 1:
        raise ValueError("a share from 0 to 1")
    return _keep(m, by_cols, F.col("missing") / F.col("n") >= pcent, {"missing": _count(_missing(F.col("v"), missing))})


def allele_frequency(n0: Column, n1: Column, n: Column) -> Column:
    """Minor allele frequency; all cells count, missing ones too."""
    f = n0 / n + n1 / (2 * n)
    return F.when(f > 0.5, 1 - f).otherwise(f)


def filter_maf(m: Matrix, threshold: float = 0.05, by_cols: bool = False) -> Filtered:
    """Removes features whose minor allele frequency is ``threshold`` or less."""
    return _keep(m, by_cols, allele_frequency(F.col("n") - F.col("other"), F.col("n1"), F.col("n")) <= threshold, {"other": _other(), "n1": _count(F.col("v") == 1)})


def impute(m: Matrix, by_cols: bool = True, *, strategy: str = "random", seed: int = 1) -> Matrix:
    """Missing cells from their feature's observed codes: drawn by frequency (``random``, the same draw for the same
    seed and cell wherever it runs), the most frequent one (``mode``, the least of equals) or their ``mean``.
    A feature without any observed code keeps its missing cells. NaN is refused when the result is computed."""
    axis = "j" if by_cols else "i"
    v = F.when(F.isnan("v"), F.raise_error(F.lit("NaN in genotypes"))).otherwise(F.col("v"))
    cells = m.to_coo().df.withColumn("v", v)
    stats = _features(m, by_cols, {"other": _other(), "n1": _count(F.col("v") == 1), "n2": _count(F.col("v") == 2)}).withColumn("n0", F.col("n") - F.col("other"))
    seen = F.col("n0") + F.col("n1") + F.col("n2")
    if strategy == "random":
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("i"), F.col("j")), 11).cast("double") / F.lit(float(1 << 53)) * seen
        new = F.when(u < F.col("n0"), 0.0).when(u < F.col("n0") + F.col("n1"), 1.0).otherwise(2.0)
    elif strategy == "mode":
        new = F.when((F.col("n0") >= F.col("n1")) & (F.col("n0") >= F.col("n2")), 0.0).when(F.col("n1") >= F.col("n2"), 1.0).otherwise(2.0)
    elif strategy == "mean":
        new = F.try_divide(F.col("n1") + 2 * F.col("n2"), seen)
    else:
        raise ValueError("strategy is random, mode or mean")
    df = cells.join(small(stats, m.ncol if by_cols else m.nrow), axis).select("i", "j", F.when((F.col("v") == 3) & (seen > 0), new).otherwise(F.col("v")).alias("v"))
    return Matrix(df, *m.dim, "coo", m.row_labels, m.col_labels)


def code_counts(m: Matrix, by_cols: bool = True) -> DataFrame:
    """``feature, v, n``: how often each code occurs."""
    axis = F.col("j" if by_cols else "i").cast("long").alias("feature")
    others = m.to_coo().df.where("v <> 0").groupBy(axis, "v").agg(F.count(F.lit(1)).alias("n"))
    zeros = _features(m, by_cols, {"other": _other()}).select(axis, F.lit(0.0).alias("v"), (F.col("n") - F.col("other")).cast("long").alias("n")).where("n > 0")
    return zeros.unionByName(others)
