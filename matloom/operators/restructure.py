"""Binding, splitting, reducing and reordering whole matrices."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.matrix import Matrix, numbered_together, same_shape, small, union_all


def cbind(*matrices: Matrix) -> Matrix:
    """Side by side; equal numbers of rows. Rows join once; cells stored one by one only get other column numbers. Names of
    columns are kept if all have some."""
    if len({m.nrow for m in matrices}) != 1:
        raise ValueError("non-conformable: numbers of rows differ")
    for m in matrices[1:]:
        numbered_together(matrices[0], m)
    width = sum(m.ncol for m in matrices)
    starts = [sum(m.ncol for m in matrices[:k]) for k in range(len(matrices))]
    titles = None if any(m.col_labels is None for m in matrices) else union_all([m.col_labels.withColumn("idx", F.col("idx") + at) for m, at in zip(matrices, starts)])
    if all(m.layout != "coo" for m in matrices):
        joined = fold(lambda a, b: a.join(b, "i"), [m.to_rows().df.withColumnRenamed("vec", f"v{k}") for k, m in enumerate(matrices)])
        return Matrix(joined.select("i", F.concat(*[f"v{k}" for k in range(len(matrices))]).alias("vec")), matrices[0].nrow, width, "rows", matrices[0].row_labels, titles)
    frames = [m.to_coo().df.withColumn("j", (F.col("j") + at).cast("int")) for m, at in zip(matrices, starts)]
    return Matrix(union_all(frames), matrices[0].nrow, width, "coo", matrices[0].row_labels, titles)


def rbind(*matrices: Matrix) -> Matrix:
    """One below the other; equal numbers of columns. No data move."""
    if len({m.ncol for m in matrices}) != 1:
        raise ValueError("non-conformable: numbers of columns differ")
    layout = matrices[0].layout if len({m.layout for m in matrices}) == 1 else "rows"
    frames, before = [], 0
    for m in matrices:
        df = m.df if m.layout == layout else m.to_rows().df
        frames.append(df.withColumn("i", F.col("i") + before))
        before += m.nrow
    return Matrix(union_all(frames), before, matrices[0].ncol, layout, None, matrices[0].col_labels)


def bind_list(matrices: list[Matrix], how: str) -> Matrix:
    """``bindCols`` or ``bindRows``; shorter ones are filled with zeros to the largest size."""
    if how not in ("bindCols", "bindRows"):
        raise ValueError(f"unknown way {how!r}")
    n, p = max(m.nrow for m in matrices), max(m.ncol for m in matrices)
    cells = [Matrix(m.to_coo().df, n if how == "bindCols" else m.nrow, m.ncol if how == "bindCols" else p, "coo") for m in matrices]
    return cbind(*cells) if how == "bindCols" else rbind(*cells)


def block_length(size: int, n_blocks: int | None, block_size: int | None) -> int:
    if (n_blocks is None) == (block_size is None):
        raise ValueError("give either n_blocks or block_size")
    length = block_size if n_blocks is None else -(-size // n_blocks)
    if length < 1:
        raise ValueError("blocks have at least one row")
    return length


def with_blocks(m: Matrix, *, n_blocks: int | None = None, block_size: int | None = None, by_cols: bool = False) -> DataFrame:
    """The cells with their ``block`` and positions within it: one table, to be written partitioned by block."""
    length = block_length(m.ncol if by_cols else m.nrow, n_blocks, block_size)
    axis = "j" if by_cols else "i"
    df = m.to_coo().df.withColumn("block", F.floor(F.col(axis) / length).cast("int"))
    return df.withColumn(axis, (F.col(axis) % length).cast("int" if by_cols else "long"))


def split(m: Matrix, *, n_blocks: int | None = None, block_size: int | None = None, by_cols: bool = False) -> list[Matrix]:
    """Consecutive blocks; the last may be smaller, and there may be fewer than ``n_blocks``."""
    from matloom.operators.subset import subset

    size = m.ncol if by_cols else m.nrow
    length = block_length(size, n_blocks, block_size)
    parts = [slice(at, min(at + length, size)) for at in range(0, size, length)]
    return [subset(m, None, s) if by_cols else subset(m, s, None) for s in parts]


def reduce(matrices: list[Matrix], op: str = "+", *, pad: bool = False) -> Matrix:
    """The sum of all, or the first minus all others; ``pad`` fills smaller ones with zeros."""
    if op not in ("+", "-"):
        raise ValueError("+ or - only")
    if not pad:
        for m in matrices[1:]:
            same_shape(matrices[0], m)
    signed = [m.to_coo().df.withColumn("v", F.col("v") * (1.0 if op == "+" or not k else -1.0)) for k, m in enumerate(matrices)]
    total = union_all(signed).groupBy("i", "j").agg(F.sum("v").alias("v"))
    return Matrix(total, max(m.nrow for m in matrices), max(m.ncol for m in matrices), "coo")


def permute(m: Matrix, order: DataFrame | list[int], *, by_cols: bool = False) -> Matrix:
    """Rows (columns) in a new order: position k of the result is ``order[k]``, a list or a table ``pos, old``."""
    n = m.ncol if by_cols else m.nrow
    if not isinstance(order, DataFrame):
        if sorted(order) != list(range(n)):
            raise ValueError("not a permutation")
        order = m.df.sparkSession.createDataFrame([(k, int(x)) for k, x in enumerate(order)], "pos long, old long")
    order = order.toDF("_pos", "_old")
    if by_cols:
        df = m.to_coo().df.join(small(order, m.ncol), F.col("j") == F.col("_old")).select("i", F.col("_pos").cast("int").alias("j"), "v")
        return Matrix(df, *m.dim, "coo", m.row_labels)
    df = m.df.join(order, F.col("i") == F.col("_old")).withColumn("i", F.col("_pos")).drop("_pos", "_old")
    return Matrix(df, *m.dim, m.layout, None, m.col_labels)


def fill_triangle(m: Matrix, source: str = "lower") -> Matrix:
    """A symmetric matrix from its ``lower`` or ``upper`` triangle."""
    if m.nrow != m.ncol:
        raise ValueError("square matrices only")
    if source not in ("lower", "upper"):
        raise ValueError("lower or upper")
    kept = m.to_coo().df.where("i >= j" if source == "lower" else "i <= j")
    mirrored = kept.where("i <> j").select(F.col("j").cast("long").alias("i"), F.col("i").cast("int").alias("j"), "v")
    return Matrix(kept.unionByName(mirrored), *m.dim, "coo")
