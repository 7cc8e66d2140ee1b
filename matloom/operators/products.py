"""Products: a join on the inner dimension and a sum, or its equivalents that move less.

* a small right factor (``SMALL`` cells at most) is broadcast and multiplies row blocks in numpy, unless the product has more
  than ``ORDERED`` cells in rows of more than ``LONG``: written, long rows take more bytes than blocks
* ``crossprod`` of up to ``WIDE`` columns is one aggregation of column products, of up to a million products one Gram matrix
  per task, of more one tile for each pair of column tiles, the symmetric half alone
* two large factors are cut into square blocks; a block goes to all cells of the grid (output block, part of the inner
  index) that need it. A cell adds up its products in numpy, and the parts' sums meet in a tree: so neither an inner index
  nor an output block gathers a task's worth of rows, and few output blocks with a long inner index use all tasks. In a
  product of more than ``ORDERED`` cells equal rows of the left and equal columns of the right are neighbours, so that
  neighbouring cells repeat their values, and written ones take a fraction of their bytes where rows are repeated
* sparse factors meet as tiles of neighbouring inner indexes, whose compressed rows are multiplied in tasks, or, where tiles
  would be nearly empty, join cell by cell; a tile or an inner index with many cells on both sides is cut into parts
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.functions.options import TASK_CELLS, resolve, work_tasks
from matloom.matrix import Matrix, numbered_together, small
from matloom.operators.elementwise import sweep
from matloom.plans.durable import durable
from matloom.plans.index import with_position

SMALL, WIDE, SIDE = 1_000_000, 48, 512
#: Products of blocks that one task adds up at most, and partial sums that one task of the tree reads.
LONGEST, FANIN = 64, 16
#: Cells of left blocks that a task holds while right ones pass by, and fields that a task has of them at least.
HELD_CELLS, FIELDS = 1 << 22, 4
#: Pairs of cells of one inner index that one task joins.
MOST_PAIRS = 1 << 24
#: Pairs of cells, and cells of one side, in one part of a tile of inner indexes; pairs of a tile from which tiles pay.
TILE_PAIRS, TILE_CELLS, TILE_PAYS = 1 << 22, 1 << 19, 1 << 14
#: Rows and columns of a block of a sparse product; cells that are read and pairs that are multiplied, about, for a part of one.
GRID, GRID_CELLS, GRID_PAIRS = 2048, 1 << 23, 1 << 27
#: Products of a block from which its sums are kept in an array of all its cells.
FULL = 1 << 16
#: Products of cells that are held at once.
AT_ONCE = 1 << 20
#: Cells of a product of blocks from which equal rows and columns of its factors become neighbours.
ORDERED = 1 << 22
#: Columns of a product from which a row is long.
LONG = 1 << 11


def _check(a: int, b: int) -> None:
    if a != b:
        raise ValueError(f"non-conformable: inner dimensions {a} and {b}")


def matmul(a: Matrix, b: Matrix, *, transpose_a: bool = False, transpose_b: bool = False, strategy: str = "auto", side: int | None = None, splits: int | None = None, rounded: bool = False) -> Matrix:
    """``a @ b``; transposed factors only swap indices. ``strategy``: auto, broadcast, block (of ``side`` rows) or cells.

    ``splits``: in how many parts the inner index of a product of blocks is cut; by itself as many as keep tasks busy.
    ``rounded``: the caller rounds the cells of a product of blocks, so that values repeat. A task then makes fewer cells and begins
    with some in the order of their values: Parquet writes numbers of values instead of values if they repeat from the start."""
    if transpose_a and not transpose_b and strategy == "auto" and a.layout != "coo" and b.layout != "coo":
        return crossprod(a, b)
    _check(a.nrow if transpose_a else a.ncol, b.ncol if transpose_b else b.nrow)
    if strategy == "auto":
        height, width = a.ncol if transpose_a else a.nrow, b.nrow if transpose_b else b.ncol
        strategy = "broadcast" if len(b) <= SMALL and (width <= LONG or height * width <= ORDERED) else "block"
    if strategy == "block":
        return _by_blocks(a, b, resolve("block_size", side, SIDE), transpose_a, transpose_b, splits, rounded)
    a, b = a.t() if transpose_a else a, b.t() if transpose_b else b
    return _by_broadcast(a, b) if strategy == "broadcast" else multiply_sparse(a, b)


def _by_broadcast(a: Matrix, b: Matrix) -> Matrix:
    held = a.df.sparkSession.sparkContext.broadcast(b.to_numpy(force=True))  # SMALL cells at most when chosen by itself

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        right = held.value
        rows = max(1, AT_ONCE // max(1, *right.shape))
        for frame in frames:
            for at in range(0, len(frame), rows):
                part = frame.iloc[at : at + rows]
                yield pd.DataFrame({"i": part["i"], "vec": list(np.stack(part["vec"].to_list()) @ right)})

    rows = a.to_rows().df
    if a.nrow * b.ncol > TASK_CELLS:  # bytes of the left factor say little about the work
        rows = rows.repartition(work_tasks(rows.sparkSession, a.nrow * b.ncol), "i")
    return Matrix(rows.mapInPandas(multiply, "i long, vec array<double>"), a.nrow, b.ncol, "rows", a.row_labels, b.col_labels)


def to_blocks(m: Matrix, side: int = SIDE, transpose: bool = False) -> DataFrame:
    """``bi, bj, nr, nc, data``: blocks of at most side * side cells, row-major, of the matrix or its transposed one.

    A task gathers one block at a time: rows are cut into pieces of ``side`` values before they move."""
    height, width = m.dim

    def told(bi: int, bj: int, block: np.ndarray) -> pd.DataFrame:
        row = (bj, bi, *block.T.shape, np.ascontiguousarray(block.T).tobytes()) if transpose else (bi, bj, *block.shape, np.ascontiguousarray(block).tobytes())
        return pd.DataFrame([row], columns=["bi", "bj", "nr", "nc", "data"])

    def empty(bi: int, bj: int) -> np.ndarray:
        return np.zeros((min(side, height - bi * side), min(side, width - bj * side)))

    def of_pieces(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        bi, bj = map(int, key)
        block = empty(bi, bj)
        block[frame["i"].to_numpy() - bi * side] = np.stack(frame["piece"].to_list())
        return told(bi, bj, block)

    def of_cells(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        bi, bj = map(int, key)
        block = empty(bi, bj)
        block[frame["i"] - bi * side, frame["j"] - bj * side] = frame["v"]
        return told(bi, bj, block)

    schema, row = "bi long, bj long, nr int, nc int, data binary", F.floor(F.col("i") / side).alias("bi")
    if m.layout == "coo":
        return m.df.select(row, F.floor(F.col("j") / side).alias("bj"), "i", "j", "v").groupBy("bi", "bj").applyInPandas(of_cells, schema)
    places = F.sequence(F.lit(0), F.lit((width - 1) // side))
    pieces = m.to_rows().df.select("i", row, F.posexplode(F.transform(places, lambda k: F.slice("vec", k * side + 1, side))).alias("bj", "piece"))
    return pieces.groupBy("bi", "bj").applyInPandas(of_pieces, schema)


def _by_blocks(a: Matrix, b: Matrix, side: int = SIDE, transpose_a: bool = False, transpose_b: bool = False, splits: int | None = None, rounded: bool = False) -> Matrix:
    height, width = a.ncol if transpose_a else a.nrow, b.nrow if transpose_b else b.ncol
    labels = a.col_labels if transpose_a else a.row_labels, b.row_labels if transpose_b else b.col_labels
    inner = a.nrow if transpose_a else a.ncol
    if height * width <= ORDERED:
        cells = multiply_blocks(to_blocks(a, side, transpose_a), to_blocks(b, side, transpose_b), height, width, side, inner, splits)
    else:
        left, n = _alike_blocks(a, side, transpose_a, True)
        right, p = _alike_blocks(b, side, transpose_b, False)
        cells = multiply_blocks(left, right, n, p, side, inner, splits, named=True, rounded=rounded)
    return Matrix(cells, height, width, "coo", *labels)


def _alike(m: Matrix, by: str) -> DataFrame | None:
    """``own, place``: the rows (``by`` i) or columns (j) that have cells, placed so that equal ones are neighbours; None for
    columns of stored rows, which stay as they are. The hashes only order: nothing is taken for equal by them."""
    if m.layout == "coo":
        other = "j" if by == "i" else "i"
        inside = m.df.where((F.col(by) >= 0) & (F.col(by) < (m.nrow if by == "i" else m.ncol)))
        hashes = inside.groupBy(F.col(by).cast("long").alias("own")).agg(F.bit_xor(F.when(F.col("v") != 0, F.xxhash64(F.col(other).cast("long"), "v"))).alias("h"))
    elif by == "i":
        hashes = m.to_rows().df.select(F.col("i").alias("own"), F.xxhash64("vec").alias("h"))
    else:
        return None
    return with_position(hashes, ["h", "own"], "place").select("own", "place")


def _alike_blocks(m: Matrix, side: int, transpose: bool, left: bool) -> tuple[DataFrame, int]:
    """``to_blocks`` of a left or right factor with its rows or columns in the order of ``_alike``, and how many there are.
    Their numbers are one more column of each left block, one more row of each right one."""
    by, outer = "i" if left != transpose else "j", "bi" if left else "bj"
    order, n = _alike(m, by), m.nrow if by == "i" else m.ncol
    if order is None:
        blocks = to_blocks(m, side, transpose).withColumn("own", F.sequence(F.col(outer) * side, F.least(F.col(outer) * side + side, F.lit(n)) - 1))
    else:
        n = order.count()
        places = small(order, n).withColumnRenamed("own", by)
        placed = m.df.join(places, by) if m.layout == "coo" else m.to_rows().df.join(places, by)
        placed = placed.withColumn(by, F.col("place")).drop("place")
        moved = Matrix(placed, n if by == "i" else m.nrow, m.ncol if by == "i" else n, "coo" if m.layout == "coo" else "rows")
        numbers = order.groupBy(F.floor(F.col("place") / side).alias(outer)).agg(F.sort_array(F.collect_list(F.struct("place", "own"))).alias("s")).select(outer, F.col("s.own").alias("own"))
        blocks = to_blocks(moved, side, transpose).join(small(numbers, n), outer)

    def named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for bi, bj, nr, nc, data, own in frame.itertuples(index=False):
                block, own = np.frombuffer(data).reshape(nr, nc), np.asarray(own, float)
                block = np.column_stack([block, own]) if left else np.vstack([block, own])
                yield pd.DataFrame([(bi, bj, *block.shape, block.tobytes())], columns=["bi", "bj", "nr", "nc", "data"])

    return blocks.select("bi", "bj", "nr", "nc", "data", "own").mapInPandas(named, "bi long, bj long, nr int, nc int, data binary"), n


def _count(n: int, side: int) -> int:
    return max(1, -(-n // side))


def tasks_of(spark) -> int:
    return work_tasks(spark, 0)


def chosen_splits(spark, outputs: int, inner: int) -> int:
    """Parts of an inner index of ``inner`` blocks, so that all tasks work and none adds up more than ``LONGEST`` products."""
    return max(1, min(inner, max(-(-tasks_of(spark) // outputs), -(-inner // LONGEST))))


def field_side(spark, rows: int, columns: int, side: int, inner: int, splits: int) -> int:
    """How many blocks wide and high a field of the grid is that one task computes: with a short inner index a block meets
    many others, and to send it to each of them apart would move far more than the factors. A field has ``TASK_CELLS``
    cells at most, its left blocks ``HELD_CELLS``, and there are ``FIELDS`` times as many fields as tasks."""
    held = HELD_CELLS // (-(-_count(inner, side) // splits) * side * max(1, min(side, inner)))
    spread = rows * columns * splits // (FIELDS * work_tasks(spark, rows * columns * side * side))
    return max(1, min(held, math.isqrt(TASK_CELLS) // side, math.isqrt(max(0, spread))))


def pairs_of_blocks(a: DataFrame, b: DataFrame, rows: int, columns: int, kernel, splits: int, *, field: int = 1, upper: bool = False, finish=None, schema: str | None = None, tasks: int = 0, start=None) -> DataFrame:
    """``bi, bj, planes, nr, nc, data``: for each cell of a grid of ``rows`` x ``columns`` the sum over the inner index k
    of ``kernel(a[bi, k], b[k, bj])``, arrays of planes x nr x nc; cells without a pair are absent. ``upper``: bi <= bj alone.
    ``finish(bi, bj, sum)``, if given, makes columns of ``schema`` of each sum in the task that has it; ``start``: of a task's first frame of them.

    The inner index is dealt to ``splits`` parts; their sums are added ``FANIN`` at a time, level by level. A task computes
    fields of ``field`` x ``field`` cells; with more than one it holds the left blocks of a field's part."""
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(-(-n // field) - 1).cast("long"))
    of = lambda c: F.floor(F.col(c) / field)
    across = F.sequence(of("bi"), F.lit(-(-columns // field) - 1).cast("long")) if upper else every(columns)
    down = F.sequence(F.lit(0).cast("long"), F.least(of("bj"), F.lit(-(-rows // field) - 1).cast("long"))) if upper else every(rows)
    left = a.select(of("bi").alias("fi"), F.explode(across).alias("fj"), F.col("bi").alias("at"), F.col("bj").alias("k"), F.lit(0).alias("right"), "nr", "nc", "data")
    right = b.select(F.explode(down).alias("fi"), of("bj").alias("fj"), F.col("bj").alias("at"), F.col("bi").alias("k"), F.lit(1).alias("right"), "nr", "nc", "data")
    last = splits == 1

    def told(sums: Iterator[tuple], finish=None) -> Iterator[pd.DataFrame]:
        """Many small sums make one frame."""
        held, size, first = [], 0, start if finish else None
        for bi, bj, part, total in sums:
            held.append((bi, bj, part, *total.shape, total.tobytes()) if finish is None else finish(bi, bj, total))
            size += total.size
            if size >= AT_ONCE:
                yield (first or (lambda frame: frame))(_one_frame(held, finish))
                held, size, first = [], 0, None
        if held:
            yield (first or (lambda frame: frame))(_one_frame(held, finish))

    def by_k(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """Fields of one cell, sorted by k: one pair of blocks in memory at a time."""
        key, total, first, at = None, None, None, -1
        for frame in frames:
            for bi, bj, part, _, k, is_right, nr, nc, data in frame.itertuples(index=False):
                if (bi, bj, part) != key:
                    if total is not None:
                        yield *key, total
                    key, total, at = (bi, bj, part), None, -1
                block = np.frombuffer(data).reshape(nr, nc)
                if not is_right:
                    first, at = block, k
                elif k == at:  # a block without a partner is one of zeros
                    product = kernel(first, block)
                    total = product if total is None else total + product
        if total is not None:
            yield *key, total

    def by_column(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """Wider fields, left blocks first: they are held, and the right ones come column by column."""
        key, held, at, column = None, {}, None, {}

        def sums() -> Iterator[tuple]:
            for bi, own in held.items():
                if upper and bi > at:
                    continue
                total = None
                for k in sorted(own.keys() & column.keys()):
                    product = kernel(own[k], column[k])
                    total = product if total is None else total + product
                if total is not None:
                    yield bi, at, key[2], total

        for frame in frames:
            for fi, fj, part, here, k, is_right, nr, nc, data in frame.itertuples(index=False):
                if column and ((fi, fj, part) != key or here != at):
                    yield from sums()
                    column = {}
                if (fi, fj, part) != key:
                    key, held = (fi, fj, part), {}
                block = np.frombuffer(data).reshape(nr, nc)
                if is_right:
                    at = here
                    column[k] = block
                else:
                    held.setdefault(here, {})[k] = block
        if column:
            yield from sums()

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from told(by_k(frames) if field == 1 else by_column(frames), finish if last else None)

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        key, total = None, None
        for frame in frames:
            for bi, bj, part, planes, nr, nc, data in frame.itertuples(index=False):
                one = np.frombuffer(data).reshape(planes, nr, nc)
                if (bi, bj, part) != key:
                    if total is not None:
                        yield *key, total
                    key, total = (bi, bj, part), one
                else:
                    total = total + one
        if total is not None:
            yield *key, total

    names, key = ["fi", "fj", "part", "at", "k", "right", "nr", "nc", "data"], ["bi", "bj", "part"]
    summed = "bi long, bj long, part long, planes int, nr int, nc int, data binary"
    both = left.withColumn("part", F.col("k") % splits).select(names).union(right.withColumn("part", F.col("k") % splits).select(names))
    parts = max(tasks, tasks_of(a.sparkSession))  # a fixed number, as bytes say little about the work
    order = ["k", "right"] if field == 1 else ["right", "at", "k"]
    sums = both.repartition(parts, "fi", "fj", "part").sortWithinPartitions("fi", "fj", "part", *order).mapInPandas(multiply, schema if finish and last else summed)
    while splits > 1:
        splits = -(-splits // FANIN)
        done = finish if splits == 1 else None
        sums = sums.withColumn("part", F.col("part") % splits).repartition(parts, *key).sortWithinPartitions(*key).mapInPandas(lambda frames, done=done: told(added(frames), done), schema if done else summed)
    return sums if finish else sums.drop("part")


def _one_frame(held: list, finish) -> pd.DataFrame:
    if finish is None:
        return pd.DataFrame(held, columns=["bi", "bj", "part", "planes", "nr", "nc", "data"])
    return pd.DataFrame({c: np.concatenate([one[c] for one in held]) if len(held) > 1 else held[0][c] for c in held[0]})


def multiply_blocks(a: DataFrame, b: DataFrame, height: int, width: int, side: int, inner: int | None = None, splits: int | None = None, named: bool = False, rounded: bool = False) -> DataFrame:
    """``i, j, v``: the product, of ``height`` x ``width``, of two tables of blocks; absent blocks are zeros. ``named``: blocks
    have the numbers of their rows or columns (``_alike_blocks``). ``rounded``: see ``matmul``."""
    rows, columns, spark = _count(height, side), _count(width, side), a.sparkSession
    splits = splits or (1 if inner is None else chosen_splits(spark, rows * columns, _count(inner, side)))
    field = 1 if inner is None else field_side(spark, rows, columns, side, inner, splits)
    return _cells_of_pairs(a, b, rows, columns, side, splits, field, named=named, rounded=rounded)


def _cells_of_pairs(a: DataFrame, b: DataFrame, rows: int, columns: int, side: int, splits: int, field: int, upper: bool = False, named: bool = False, rounded: bool = False) -> DataFrame:
    """``i, j, v`` of the product of two tables of blocks. ``upper``: of the cells of the symmetric one, whose lower triangle is mirrored.
    ``named``: the numbers of rows and columns come with the blocks."""

    def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if not named:
            return (x @ y)[None]
        total = np.ones((1, len(x) + 1, y.shape[1] + 1))
        total[0, :-1, :-1], total[0, :-1, -1], total[0, -1, :-1] = x[:, :-1] @ y[:-1], x[:, -1], y[-1]
        return total  # numbers add up as products do, and the corner counts them

    def cells(bi: int, bj: int, total: np.ndarray) -> dict[str, np.ndarray]:
        if named:
            of_rows, of_columns = (np.rint(n / total[0, -1, -1]).astype(np.int64) for n in (total[0, :-1, -1], total[0, -1, :-1]))
            total = total[:, :-1, :-1]
        nr, nc = total.shape[1:]
        if not named:
            of_rows, of_columns = np.arange(nr) + bi * side, np.arange(nc) + bj * side
        i, j, v = np.repeat(of_rows, nc), np.tile(of_columns, nr), total[0].ravel()
        if upper and bi < bj:
            i, j, v = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([v, v])
        return {"i": i, "j": j.astype(np.int32), "v": v}

    tasks = work_tasks(a.sparkSession, rows * columns * side * side * (FIELDS if rounded else 1))
    found = pairs_of_blocks(a, b, rows, columns, product, splits, field=field, upper=upper, finish=cells, schema="i long, j int, v double", tasks=tasks, start=(lambda frame: frame.sort_values("v")) if rounded else None)
    return found.withColumn("v", F.coalesce("v", F.lit(float("nan"))))  # NaN leaves pandas as null


def block_cells(blocks: DataFrame, side: int) -> DataFrame:
    """``i, j, v`` of the first plane of each block."""

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for bi, bj, planes, nr, nc, data in frame.itertuples(index=False):
                r, c = np.indices((nr, nc))
                yield pd.DataFrame({"i": r.ravel() + bi * side, "j": (c.ravel() + bj * side).astype(np.int32), "v": np.frombuffer(data).reshape(planes, nr, nc)[0].ravel()})

    return blocks.select("bi", "bj", "planes", "nr", "nc", "data").mapInPandas(cells, "i long, j int, v double").withColumn("v", F.coalesce("v", F.lit(float("nan"))))  # NaN leaves pandas as null


def multiply_sparse(a: Matrix, b: Matrix, *, strategy: str = "auto", side: int = SIDE, most: int | None = None) -> Matrix:
    """The product by stored cells alone, zeros are filtered in the scan. ``strategy``:

    ``tiles``: the cells of ``side`` neighbouring inner indexes form a tile; ``cells``: cells join on the inner index;
    ``auto``: tiles where they hold ``TILE_PAYS`` pairs on the average. Where the factors' cells, sent packed to every block of
    the result that they reach, are fewer than twice the products, blocks add up their products in tasks
    and only sums leave them (``_by_grid``: tiles, and cells of which an inner index has more than ``most`` pairs). Otherwise
    a tile with more than ``most`` (``TILE_PAIRS``) pairs of cells or ``TILE_CELLS`` cells is dealt by rows of the left and
    columns of the right and sends one sum for each cell that it reaches, and an index of cells with more than ``most``
    (``MOST_PAIRS``) pairs is cut.

    Cells of both sides are counted for each inner index, once; no tile or index sits in one task, however heavy."""
    _check(a.ncol, b.nrow)
    if strategy not in ("auto", "tiles", "cells"):
        raise ValueError(f"unknown strategy {strategy!r}")
    left = a.to_coo().df.where("v <> 0").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("k"), "v")
    right = b.to_coo().df.where("v <> 0").select(F.col("i").cast("long").alias("k"), F.col("j").cast("int").alias("j"), F.col("v").alias("w"))
    if strategy != "cells":
        tiles = durable(_tiles(left, right, side, most or TILE_PAIRS), "tiles")
        found, pairs, of_left = tiles.agg(F.count(F.lit(1)), F.sum("pairs"), F.sum("a")).first()
        if strategy == "tiles" or found and pairs >= TILE_PAYS * found:
            summed = _by_grid(left, right, side, pairs or 0, of_left or 0, a.nrow, b.ncol)
            if summed is not None:
                return Matrix(summed, a.nrow, b.ncol, "coo", a.row_labels, b.col_labels)
            return Matrix(_by_tiles(left, right, tiles, found, side), a.nrow, b.ncol, "coo", a.row_labels, b.col_labels)
    cells = left.join(right, "k")
    heavy = durable(_heavy(left, right, most or MOST_PAIRS), "heavy")
    found = heavy.count()
    if found:
        pairs, of_left = heavy.agg(F.sum("pairs"), F.sum("a")).first()
        summed = _by_grid(left, right, side, pairs, int(of_left), a.nrow, b.ncol)
        if summed is not None:
            return Matrix(summed, a.nrow, b.ncol, "coo", a.row_labels, b.col_labels)
        mine, other = _copies(left, right, small(heavy.drop("a", "pairs"), found), "k", "left")
        cells = mine.join(other, ["k", "x", "y"])
    sums = cells.groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return Matrix(sums, a.nrow, b.ncol, "coo", a.row_labels, b.col_labels)


def _packed(cells: DataFrame, side: int, band: int, right: int) -> DataFrame:
    """``t, band, right, n, k, at, v``: cells ``k, at, v`` packed by tile of inner indexes and band of rows or columns, sorted by k:
    arrays of places in the tile and in the band, and values by planes of bytes, which compress where values are alike."""
    kind = lambda size: np.uint16 if size <= 1 << 16 else np.int64
    of_k, of_at = kind(side), kind(band)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            k, at, v = frame["k"].to_numpy(), frame["at"].to_numpy(), frame["v"].to_numpy(float)
            t, b = k // side, at // band
            cuts = [0, *(np.flatnonzero((t[1:] != t[:-1]) | (b[1:] != b[:-1])) + 1), len(frame)] if len(frame) else []
            rows = []
            for first, last in zip(cuts, cuts[1:]):
                own = slice(first, last)
                rows.append((t[first], b[first], right, last - first, (k[own] - t[first] * side).astype(of_k).tobytes(), (at[own] - b[first] * band).astype(of_at).tobytes(), np.ascontiguousarray(v[own]).view(np.uint8).reshape(-1, 8).T.tobytes()))
            if rows:
                yield pd.DataFrame(rows, columns=["t", "band", "right", "n", "k", "at", "v"])

    key = [F.floor(F.col("k") / side), F.floor(F.col("at") / band)]
    dealt = cells.repartition(tasks_of(cells.sparkSession), *key).sortWithinPartitions(*key, "k")
    return dealt.mapInPandas(pack, "t long, band long, right int, n int, k binary, at binary, v binary")


def _by_grid(left: DataFrame, right: DataFrame, side: int, pairs: float, cells: int, height: int, width: int) -> DataFrame | None:
    """``i, j, v``: a task has a band of rows of the left and a field of columns of the right factor. It holds the band's cells
    (``GRID_CELLS`` about) while the field's pass by, some columns after the others, and adds up their products in an array of
    ``GRID`` x ``GRID`` cells (``cells``: of the left, about), so that only sums leave it. Cells move packed, and to tasks alone that have inner indexes near
    theirs on the other side; None if more than twice as many would move as there are products."""
    spark = left.sparkSession
    wanted = FIELDS * spark.sparkContext.defaultParallelism // 2
    rows = max(1, min(-(-height // max(-(-cells // GRID_CELLS), math.isqrt(wanted - 1) + 1)), GRID * min(GRID, 32)))
    bands = max(1, -(-height // rows))
    fields = max(-(-wanted // bands), math.ceil(pairs / GRID_PAIRS / bands), 1)
    columns = max(1, min(GRID * GRID // rows, -(-width // fields)))
    wide = max(1, -(-width // columns) // fields)  # pieces of columns in a field
    mine = _packed(left.select("k", F.col("i").alias("at"), "v"), side, rows, 0)
    other = _packed(right.select("k", F.col("j").cast("long").alias("at"), F.col("w").alias("v")), side, columns, 1)
    packed = durable(mine.union(other), "packed")
    mine = packed.where("right = 0").withColumnRenamed("band", "x").withColumn("piece", F.lit(0).cast("long"))
    other = packed.where("right = 1").withColumn("y", F.floor(F.col("band") / wide)).withColumnRenamed("band", "piece")
    met = durable(mine.groupBy("t", "x").agg(F.sum("n").alias("a")).join(other.groupBy("t", "y").agg(F.sum("n").alias("b")), "t"), "met")
    held, made = F.sum("a"), F.sum(F.col("a").cast("double") * F.col("b") / side)
    blocks = met.groupBy("x", "y").agg(F.greatest(F.lit(1), F.ceil(held / GRID_CELLS), F.ceil(made / GRID_PAIRS)).cast("int").alias("parts"), F.count(F.lit(1)).alias("n"), F.sum(F.col("a") + F.col("b")).alias("sent"))
    found, most, sent, groups = blocks.agg(F.sum("n"), F.max("parts"), F.sum("sent"), F.sum("parts")).first()
    if (sent or 0) > 2 * pairs:
        return None
    dealt = small(durable(met.join(blocks.select("x", "y", "parts"), ["x", "y"]).select("t", "x", "y", F.pmod(F.hash("t"), "parts").alias("part")), "dealt"), found or 0)
    kind = lambda size: np.uint16 if size <= 1 << 16 else np.int64

    def joined(kept: list[tuple], of_at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inner index, place and value of packed rows, sorted by the first."""
        k = np.concatenate([np.frombuffer(c, kind(side)).astype(np.int64) + t * side for t, c, _, _ in kept])
        at = np.concatenate([np.frombuffer(c, of_at).astype(np.int64) for _, _, c, _ in kept])
        v = np.concatenate([np.frombuffer(c, np.uint8).reshape(8, -1).T.copy().view(np.float64).ravel() for _, _, _, c in kept])
        if (k[1:] < k[:-1]).any():  # a tile may come in several rows
            order = np.argsort(k, kind="stable")
            k, at, v = k[order], at[order], v[order]
        return k, at, v

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full, seen = None, None
        key, piece, band, x, kept = None, None, [], None, []

        def sums() -> Iterator[pd.DataFrame]:
            nonlocal x, full, seen
            if not band or not kept:
                return
            if x is None:
                x = joined(band, kind(rows))
            k, column, w = joined(kept, kind(columns))
            first, last = (np.searchsorted(x[0], k, at) for at in ("left", "right"))
            fine = last > first
            first, length, column, w = first[fine], (last - first)[fine], column[fine], w[fine]
            ends, at = np.cumsum(length), 0
            few = not len(ends) or ends[-1] < min(FULL, AT_ONCE)
            if full is None and not few:
                full, seen = np.zeros(rows * columns), np.zeros(rows * columns, bool)
            while at < len(length):
                upto = max(at + 1, int(np.searchsorted(ends, ends[at] - length[at] + AT_ONCE, "right")))
                n = length[at:upto]
                own = np.arange(n.sum()) + np.repeat(first[at:upto] - (np.cumsum(n) - n), n)
                place = x[1][own] * columns + np.repeat(column[at:upto], n)
                product = x[2][own] * np.repeat(w[at:upto], n)
                at = upto
                if few:  # at once
                    reached, where = np.unique(place, return_inverse=True)
                    total = np.bincount(where, product, len(reached))
                else:
                    np.add.at(full, place, product)
                    seen[place] = True
            if not few:
                reached = np.flatnonzero(seen)
                total = full[reached]
                full[reached], seen[reached] = 0.0, False
            elif not len(length):
                return
            for at in range(0, len(reached), AT_ONCE):
                p = reached[at : at + AT_ONCE]
                yield pd.DataFrame({"i": p // columns + key[0] * rows, "j": (p % columns + piece * columns).astype(np.int32), "v": total[at : at + AT_ONCE]})

        for frame in frames:
            for bx, by, part, is_right, here, t, k, at, v in frame.itertuples(index=False):
                if kept and ((bx, by, part) != key or here != piece):
                    yield from sums()
                    kept.clear()
                if (bx, by, part) != key:
                    key, x = (bx, by, part), None
                    band.clear()
                if is_right:
                    piece = here
                    kept.append((t, k, at, v))
                else:
                    band.append((t, k, at, v))
        yield from sums()

    names, key = ["x", "y", "part", "right", "piece", "t", "k", "at", "v"], ["x", "y", "part"]
    both = mine.join(dealt, ["t", "x"]).select(names).union(other.join(dealt, ["t", "y"]).select(names))
    both = both.repartition(max(tasks_of(spark), FIELDS * (groups or 1)), *key).sortWithinPartitions(*key, "right", "piece", "t")  # more than there are keys, so that few meet
    # NaN leaves pandas as null
    found = both.mapInPandas(add, "i long, j int, v double").withColumn("v", F.coalesce("v", F.lit(float("nan"))))
    return found if (most or 1) == 1 else found.groupBy("i", "j").agg(F.sum("v").alias("v"))


def _copies(left: DataFrame, right: DataFrame, sizes: DataFrame, key: str, how: str) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt to ``nx`` parts over rows of the left (x) and ``ny`` over columns of the right (y), and copied to
    the parts of the other side; a key without sizes has one part."""
    one = lambda name: F.coalesce(name, F.lit(1))
    every = lambda name: F.explode(F.sequence(F.lit(0), one(name) - 1))
    mine = left.join(sizes, key, how).select(*left.columns, F.pmod(F.hash("i"), one("nx")).alias("x"), every("ny").alias("y"))
    other = right.join(sizes, key, how).select(*right.columns, F.pmod(F.hash("j"), one("ny")).alias("y"), every("nx").alias("x"))
    return mine, other


def _tiles(left: DataFrame, right: DataFrame, side: int, most: int) -> DataFrame:
    """``t, a, pairs, nx, ny``: the left cells and pairs of cells of each tile that has any, and into how many parts its sides are cut."""
    count = lambda df, name: df.groupBy("k").agg(F.count(F.lit(1)).alias(name))
    both = count(left, "a").join(count(right, "b"), "k", "full").select("k", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    tiles = both.groupBy(F.floor(F.col("k") / side).alias("t")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a").cast("double") * F.col("b")).alias("pairs")).where("pairs > 0")
    parts = F.greatest(F.lit(1.0), F.col("pairs") / most)
    nx = F.greatest(F.lit(1), F.ceil(F.col("a") / TILE_CELLS), F.ceil(F.sqrt(parts * F.col("a") / F.col("b")))).cast("int")
    ny = F.greatest(F.lit(1), F.ceil(F.col("b") / TILE_CELLS), F.ceil(parts / F.col("nx"))).cast("int")
    # a side needn't be cut into more parts than the product asks for
    return tiles.select("t", "a", "b", "pairs", F.least(nx, F.greatest(F.ceil(parts), F.ceil(F.col("a") / TILE_CELLS))).cast("int").alias("nx")).select("t", "a", "pairs", "nx", ny.alias("ny"))


def _by_tiles(left: DataFrame, right: DataFrame, tiles: DataFrame, found: int, side: int) -> DataFrame:
    """``i, j, v``: sums of all products, one for each part of a tile first."""

    def multiply(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        y = y.sort_values("k", kind="stable")
        inner = y["k"].to_numpy()
        first, last = (np.searchsorted(inner, x["k"].to_numpy(), at) for at in ("left", "right"))
        rows, i = np.unique(x["i"].to_numpy(), return_inverse=True)
        columns, j = np.unique(y["j"].to_numpy(), return_inverse=True)
        order = np.argsort(i, kind="stable")
        order = order[(last > first)[order]]
        first, length, i, v, w = first[order], (last - first)[order], i[order], x["v"].to_numpy(float)[order], y["w"].to_numpy(float)
        keys, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
        ends = np.cumsum(length)
        at = 0
        while at < len(length):
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] - length[at] + AT_ONCE, "right")))
            n = length[at:upto]
            of = np.repeat(np.arange(at, upto), n)
            place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]
            key, where = np.unique(i[of] * len(columns) + j[place], return_inverse=True)
            keys.append(key)
            sums.append(np.bincount(where, v[of] * w[place], len(key)))
            at = upto
        key = np.concatenate(keys)
        return pd.DataFrame({"i": rows[key // len(columns)] if len(columns) else key, "j": columns[key % len(columns)] if len(columns) else key, "v": np.concatenate(sums)})

    tile = F.floor(F.col("k") / side).alias("t")
    mine, other = _copies(left.select("*", tile), right.select("*", tile), small(tiles.select("t", "nx", "ny"), found), "t", "inner")
    of = ("t", "x", "y")
    sums = mine.groupBy(*of).cogroup(other.groupBy(*of)).applyInPandas(multiply, "i long, j int, v double")
    # NaN leaves pandas as null
    return sums.groupBy("i", "j").agg(F.sum(F.coalesce("v", F.lit(float("nan")))).alias("v"))


def _heavy(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """``k, nx, ny, a, pairs``: into how many parts both sides of a k are cut, of those with more than ``most`` pairs."""
    count = lambda df, name: df.groupBy("k").agg(F.count(F.lit(1)).cast("double").alias(name))
    pairs = count(left, "a").join(count(right, "b"), "k").where(F.col("a") * F.col("b") > most)
    root = F.lit(float(most) ** 0.5)
    # sides of a part: a square where both are long, else all of the shorter side
    short = F.least("a", "b", root)
    long_ = F.lit(float(most)) / short
    part = lambda mine, other: F.greatest(F.lit(1), F.ceil(F.col(mine) / F.when(F.col(mine) >= F.col(other), long_).otherwise(short)).cast("int"))
    return pairs.select("k", part("a", "b").alias("nx"), part("b", "a").alias("ny"), "a", (F.col("a") * F.col("b")).alias("pairs"))


def gram_in_tasks(df: DataFrame, left: str, right: str, p: int, q: int, weight: str | None = None) -> DataFrame:
    """``j, l, v``: the sum over rows of outer products of two vector columns; each task sends one p x q matrix."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p, q))
        for frame in frames:
            if len(frame):
                x, y = np.stack(frame["x"].to_list()), np.stack(frame["y"].to_list())
                total += (x * frame["w"].to_numpy()[:, None]).T @ y
        j, other = np.indices(total.shape)
        yield pd.DataFrame({"j": j.ravel(), "l": other.ravel(), "v": total.ravel()})

    rows = df.select(F.col(left).alias("x"), F.col(right).alias("y"), (F.col(weight) if weight else F.lit(1.0)).alias("w"))
    # NaN leaves pandas as null
    return rows.mapInPandas(partial, "j int, l int, v double").groupBy("j", "l").agg(F.sum(F.coalesce("v", F.lit(float("nan")))).alias("v"))


def crossprod(x: Matrix, y: Matrix | None = None, *, weights: DataFrame | None = None, tile: int | None = None) -> Matrix:
    """``t(x) @ y`` (y: x itself), with row weights ``k, w`` between them if given.

    Of x with itself only the upper triangle is computed, then mirrored. ``tile`` forces tiles of so many columns."""
    other = x if y is None else y
    if x.nrow != other.nrow:
        raise ValueError(f"non-conformable: {x.nrow} and {other.nrow} rows")
    numbered_together(x, other)
    if y is None and x.layout == "wide" and x.ncol <= WIDE and tile is None:
        df, w = (x.df, None) if weights is None else (x.df.join(weights.toDF("i", "w"), "i"), F.col("w"))
        pairs = [(j, k) for j in range(x.ncol) for k in range(j, x.ncol)]
        product = lambda j, k: F.col(f"c{j}") * F.col(f"c{k}") if w is None else w * F.col(f"c{j}") * F.col(f"c{k}")
        # a null cell counts as NaN
        row = df.agg(*[F.sum(F.coalesce(product(j, k), F.lit(float("nan")))).alias(f"s{j}_{k}") for j, k in pairs])
        cells = [F.struct(F.lit(j).cast("long").alias("i"), F.lit(k).alias("j"), F.col(f"s{min(j, k)}_{max(j, k)}").alias("v")) for j in range(x.ncol) for k in range(x.ncol)]
        return Matrix(row.select(F.inline(F.array(*cells))), x.ncol, x.ncol, "coo", x.col_labels, x.col_labels)
    if tile is None and "coo" in (x.layout, other.layout) and weights is None:
        return multiply_sparse(x.t(), other)
    if tile is not None or x.ncol * other.ncol > SMALL:
        return _crossprod_of_tiles(x, y, weights, resolve("block_size", tile, SIDE))
    rows = x.to_rows().df
    both = rows.withColumn("right", F.col("vec")) if y is None else rows.join(y.to_rows().df.withColumnRenamed("vec", "right"), "i")
    both = both if weights is None else both.join(weights.toDF("i", "w"), "i")
    found = gram_in_tasks(both, "vec", "right", x.ncol, other.ncol, "w" if weights is not None else None)
    return Matrix(found.select(F.col("j").cast("long").alias("i"), F.col("l").alias("j"), "v"), x.ncol, other.ncol, "coo", x.col_labels, other.col_labels)


def _crossprod_of_tiles(x: Matrix, y: Matrix | None, weights: DataFrame | None, tile: int) -> Matrix:
    """By pairs of column tiles; no task holds more than three tiles."""
    other = x if y is None else y
    right = other if weights is None else sweep(other, weights, 1, "*")
    a, b = to_blocks(x, tile, True), to_blocks(right, tile)
    rows, columns = _count(x.ncol, tile), _count(other.ncol, tile)
    outputs = rows * (rows + 1) // 2 if y is None else rows * columns
    spark = x.df.sparkSession
    splits = chosen_splits(spark, outputs, _count(x.nrow, tile))
    cells = _cells_of_pairs(a, b, rows, columns, tile, splits, field_side(spark, rows, columns, tile, x.nrow, splits), y is None)
    return Matrix(cells, x.ncol, other.ncol, "coo", x.col_labels, other.col_labels)


def tcrossprod(x: Matrix, y: Matrix | None = None) -> Matrix:
    """``x @ t(y)`` (y: x itself): broadcast if t(y) is small, else blocks."""
    other = x if y is None else y
    if x.ncol != other.ncol:
        raise ValueError(f"non-conformable: {x.ncol} and {other.ncol} columns")
    return matmul(x, other, transpose_b=True, strategy="cells" if "coo" in (x.layout, other.layout) else "auto")


def weighted_product(x: Matrix, weights: DataFrame, op: str) -> Matrix:
    """``XtwX`` = t(X) diag(w) X, ``XwXt`` = X diag(w) t(X), ``Xw`` = X diag(w), ``wX`` = diag(w) X. ``weights``: ``k, w``."""
    kind = op.lower()
    if kind == "xtwx":
        return crossprod(x, weights=weights)
    if kind == "xwxt":
        return matmul(sweep(x, weights, 2, "*"), x, transpose_b=True)
    if kind == "xw":
        return sweep(x, weights, 2, "*")
    if kind == "wx":
        return sweep(x, weights, 1, "*")
    raise ValueError(f"unknown product {op!r}")
