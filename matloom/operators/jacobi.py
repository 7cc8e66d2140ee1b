"""All eigenvalues and vectors of a symmetric matrix that no machine holds: two-sided Jacobi rotations of blocks.

The matrix is a table of square blocks, of which those on and above the diagonal are kept. A round pairs all block indices
(a round robin: as many rounds as it takes let every two meet once, which is a sweep). The blocks where a pair meets itself
are diagonalized in a task each; a join gives every four blocks of two pairs the rotations of both, and a round's table
replaces the one before. Rotations leave the sum of squares as it is and move it to the diagonal, quadratically at last.
Tasks hold four blocks and two rotations; the driver gets the eigenvalues, n numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matloom.functions.options import resolve
from matloom.matrix import Matrix, small
from matloom.operators.factor import Eigen
from matloom.operators.products import to_blocks
from matloom.plans.durable import Steps

SIDE = 256
#: Cells of all rotations of a round up to which they are broadcast.
MOST_SENT = 4_000_000
#: Sweeps after which a matrix that hasn't converged is refused.
SWEEPS = 40

#: ``kind`` 0: the matrix, 1: the vectors (bi: rows, bj: columns); ``off``: squares of what a block has off the diagonal
BLOCK = "kind int, bi long, bj long, nr int, nc int, data binary, off double"


def _partner(b: Column, turn: int, players: int) -> Column:
    """Whom a block index meets in a round, of an even number of players: the last one stays, the others go round."""
    ring = players - 1
    fixed = turn * (players // 2) % ring  # meets the last one
    return F.when(b == ring, F.lit(fixed)).when(b == fixed, F.lit(ring)).otherwise(F.pmod(F.lit(turn) - b, F.lit(ring))).cast("long")


def _off(kind: int, bi: int, bj: int, block: np.ndarray) -> float:
    if kind:
        return 0.0
    return float((block**2).sum() - (np.diag(block) ** 2).sum()) if bi == bj else 2 * float((block**2).sum())


def _told(rows: list[tuple]) -> pd.DataFrame:
    made = [(kind, bi, bj, *block.shape, np.ascontiguousarray(block).tobytes(), _off(kind, bi, bj, block)) for kind, bi, bj, block in rows]
    return pd.DataFrame(made, columns=["kind", "bi", "bj", "nr", "nc", "data", "off"])


def _sizes(first: int, second: int, n: int, side: int) -> list[tuple[int, int]]:
    """The block indices of a pair that exist, each with its rows."""
    return [(b, min(side, n - b * side)) for b in sorted((first, second)) if b * side < n]


def _placed(cells: list, rows: list[tuple[int, int]], columns: list[tuple[int, int]], mirrored: bool) -> np.ndarray:
    """Blocks ``bi, bj, nr, nc, data`` at their places; absent ones are zeros, those below the diagonal their mirror images."""
    up, left = (dict(zip([b for b, _ in side], np.concatenate([[0], np.cumsum([x for _, x in side])]).astype(int))) for side in (rows, columns))
    out = np.zeros((sum(x for _, x in rows), sum(x for _, x in columns)))
    for c in cells:
        block = np.frombuffer(c["data"]).reshape(c["nr"], c["nc"])
        if c["bi"] in up and c["bj"] in left:
            out[up[c["bi"]] : up[c["bi"]] + c["nr"], left[c["bj"]] : left[c["bj"]] + c["nc"]] = block
        if mirrored and c["bi"] != c["bj"] and c["bj"] in up and c["bi"] in left:
            out[up[c["bj"]] : up[c["bj"]] + c["nc"], left[c["bi"]] : left[c["bi"]] + c["nr"]] = block.T
    return out


def eigen_blocks(m: Matrix, *, vectors: bool = True, side: int | None = None, tol: float = 1e-10) -> Eigen:
    """Eigenvalues, decreasing, and vectors (a Matrix, its columns in their order; the largest entry of each is positive)
    of a symmetric matrix of any number of rows; its cells above the diagonal are read.

    ``tol``: what is left off the diagonal, relative to the Frobenius norm. Absent cells are zeros."""
    if m.nrow != m.ncol:
        raise ValueError("square matrices only")
    n, spark = m.nrow, m.df.sparkSession
    side = resolve("block_size", side, SIDE)
    if side < 1:
        raise ValueError("blocks have at least one row")
    count = -(-n // side)
    players = max(2, count + count % 2)

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for bi, bj, nr, nc, data in frame.itertuples(index=False):
                block = np.frombuffer(data).reshape(nr, nc)
                rows.append((0, bi, bj, np.triu(block) + np.triu(block, 1).T if bi == bj else block))
            yield _told(rows)

    def units(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield _told([(1, b, b, np.eye(min(side, n - b * side))) for b in frame["id"]])

    given = to_blocks(m, side).where("bi <= bj").select("bi", "bj", "nr", "nc", "data").mapInPandas(first, BLOCK)
    if vectors:
        given = given.unionByName(spark.range(count).mapInPandas(units, BLOCK))
    step, turns = Steps(spark, "jacobi"), Steps(spark, "rotations")
    table = step.put(given)

    def whole() -> tuple[float, float]:
        """Squares of all cells and of those off the diagonal."""
        row = table.where("kind = 0").mapInPandas(squares, "whole double, off double").agg(F.sum("whole"), F.sum("off")).first()
        return row[0] or 0.0, row[1] or 0.0

    def squares(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            size = [float((np.frombuffer(d) ** 2).sum()) * (1 if a == b else 2) for a, b, d in zip(frame["bi"], frame["bj"], frame["data"])]
            # a NaN would reach Spark as null, which a sum leaves out
            yield pd.DataFrame({"whole": [x if np.isfinite(x) else np.inf for x in size], "off": frame["off"]})

    total, off = whole()
    if not np.isfinite(total):
        raise ValueError("cells are missing or infinite")

    def rotation(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for u, other, cells in frame.itertuples(index=False):
                sizes = _sizes(u, other, n, side)
                a = _placed(cells, sizes, sizes, True)
                rows.append((u, np.ascontiguousarray(np.linalg.eigh(a)[1][:, ::-1]).tobytes()))
            yield pd.DataFrame(rows, columns=["u", "turn"])

    def turned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for kind, u, u2, v, v2, cells, left, right in frame.itertuples(index=False):
                across = _sizes(v, v2, n, side)
                down = [(u, min(side, n - u * side))] if kind else _sizes(u, u2, n, side)
                width, height = (sum(x for _, x in side_) for side_ in (across, down))
                a = _placed(cells, down, across, not kind) @ np.frombuffer(right).reshape(width, width)
                a = a if kind else np.frombuffer(left).reshape(height, height).T @ a
                if not kind and u == v:
                    a = np.diag(np.diag(a))  # diagonal but for rounding
                top = 0
                for bi, nr in down:
                    start = 0
                    for bj, nc in across:
                        block = a[top : top + nr, start : start + nc]
                        if kind or bi <= bj:
                            rows.append((kind, bi, bj, block))
                        elif u != v:
                            rows.append((kind, bj, bi, block.T))
                        start += nc
                    top += nr
            yield _told(rows)

    for _ in range(SWEEPS):
        if off <= (tol**2) * total:
            break
        for turn in range(players - 1):
            pair = lambda b: F.least(b, _partner(b, turn, players))
            met = table.withColumns({"pi": F.when(F.col("kind") == 1, F.col("bi")).otherwise(pair(F.col("bi"))), "pj": pair(F.col("bj"))})
            # four blocks at most, and of the matrix only those of u <= v
            key = {"u": F.when(F.col("kind") == 1, F.col("pi")).otherwise(F.least("pi", "pj")), "v": F.when(F.col("kind") == 1, F.col("pj")).otherwise(F.greatest("pi", "pj"))}
            cell = F.struct("bi", "bj", "nr", "nc", "data")
            own = met.where((F.col("kind") == 0) & (F.col("pi") == F.col("pj"))).groupBy(F.col("pi").alias("u")).agg(F.collect_list(cell).alias("cells"))
            own = own.select("u", _partner(F.col("u"), turn, players).alias("other"), "cells")
            # a pair without cells has no row: its rotation is the identity
            found = own.mapInPandas(rotation, "u long, turn binary")
            every = spark.range(count).select(pair(F.col("id")).alias("u")).distinct()
            rotations = turns.put(_with_units(every, found, n, side, turn, players))
            rotations = F.broadcast(rotations) if 2 * side * n <= MOST_SENT else rotations
            groups = met.withColumns(key).groupBy("kind", "u", "v").agg(F.collect_list(cell).alias("cells"))
            both = groups.join(rotations.select("u", F.col("turn").alias("left")), "u", "left").join(rotations.select(F.col("u").alias("v"), F.col("turn").alias("right")), "v")
            both = both.select("kind", "u", _partner(F.col("u"), turn, players).alias("u2"), "v", _partner(F.col("v"), turn, players).alias("v2"), "cells", F.when(F.col("kind") == 0, F.col("left")).alias("left"), "right")
            table = step.put(both.mapInPandas(turned, BLOCK))
        off = table.where("kind = 0").agg(F.sum("off")).first()[0] or 0.0
    else:
        if off > (tol**2) * total:
            raise np.linalg.LinAlgError(f"not converged after {SWEEPS} sweeps")

    def diagonal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for bi, nr, nc, data in zip(frame["bi"], frame["nr"], frame["nc"], frame["data"]):
                yield pd.DataFrame({"j": bi * side + np.arange(nr), "v": np.diag(np.frombuffer(data).reshape(nr, nc))})

    values = np.zeros(n)
    held = table.where("kind = 0 AND bi = bj").mapInPandas(diagonal, "j long, v double").toPandas()
    values[held["j"].to_numpy(int)] = held["v"].to_numpy()
    order = np.argsort(-values, kind="stable")
    turns.end()
    if not vectors:
        step.end()
        return Eigen(values[order], None)
    return Eigen(values[order], _vectors(table, order, n, side))


def _with_units(every: DataFrame, found: DataFrame, n: int, side: int, turn: int, players: int) -> DataFrame:
    """A rotation for every pair: the identity where a pair has no cells of its own."""

    def filled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held = [np.eye(sum(x for _, x in _sizes(u, other, n, side))).tobytes() if t is None else t for u, other, t in frame.itertuples(index=False)]
            yield pd.DataFrame({"u": frame["u"], "turn": held})

    both = every.join(found, "u", "left").select("u", _partner(F.col("u"), turn, players).alias("other"), "turn")
    return both.mapInPandas(filled, "u long, turn binary")


def _vectors(table: DataFrame, order: np.ndarray, n: int, side: int) -> Matrix:
    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for bi, bj, nr, nc, data in frame.itertuples(index=False):
                r, c = np.indices((nr, nc))
                yield pd.DataFrame({"i": r.ravel() + bi * side, "j": c.ravel() + bj * side, "v": np.frombuffer(data)})

    found = table.where("kind = 1").select("bi", "bj", "nr", "nc", "data").mapInPandas(cells, "i long, j long, v double")
    # the sign by the first of the largest entries, as rounding would choose among equal ones
    sign = found.groupBy("j").agg(F.max_by("v", F.struct(F.round(F.abs("v"), 9), -F.col("i"))).alias("top"))
    place = table.sparkSession.createDataFrame(pd.DataFrame({"j": order, "at": np.arange(n, dtype=np.int32)}), "j long, at int")
    signed = found.join(small(sign.join(small(place, n), "j"), n), "j")
    return Matrix.from_coo(signed.select("i", F.col("at").alias("j"), F.when(F.col("top") < 0, -F.col("v")).otherwise(F.col("v")).alias("v")), n, n)
