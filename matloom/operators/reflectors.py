"""QR whose Q is kept as a table of Householder reflectors and never formed.

Rows are cut into leaves of ``height`` consecutive ones. A leaf's reflectors leave its R factor in its first rows; the first
rows of ``FANOUT`` neighbours are factored again, level by level, until one R is left in rows 0 .. p-1. Each node of the tree
is a row of the table: I - V T t(V) with V of at most ``FANOUT`` x p rows. t(Q) X goes up the tree, Q X down; a level moves
only the rows it changes, and a node holds the same few rows however many the matrix has. Columns may depend on each other;
column pivoting, on the last R alone, is one more node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matloom.matrix import Matrix
from matloom.plans.durable import durable

#: Nodes whose R factors meet in one of the next level.
FANOUT = 8
#: Cells of a leaf, unless twice the number of columns asks for more rows.
LEAF = 1 << 20
#: Cells up to which one leaf may hold a matrix with more columns than rows.
SMALL = 4_000_000

NODE = "level int, node long, rows int, v binary, t binary, r binary"


def _reflected(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """V, T and R with (I - V T t(V)) (R over zeros) = a."""
    k = min(a.shape)
    h, tau = np.linalg.qr(a, mode="raw")
    v = np.tril(h.T[:, :k], -1)
    v[np.arange(k), np.arange(k)] = 1.0
    v[:, tau == 0] = 0.0  # the identity
    inner = np.triu(v.T @ v, 1) + np.diag(np.where(tau == 0, 1.0, 1 / np.where(tau == 0, 1.0, tau)))
    return v, np.linalg.inv(inner), np.triu(h.T[:k])


def _pivoted(r: np.ndarray) -> tuple[np.ndarray, int]:
    """The order of columns in which the largest remainder comes first, and the rank."""
    rest, order, rank = r.copy(), np.arange(r.shape[1]), 0
    least = 1e-12 * max(np.linalg.norm(r, axis=0).max(initial=0), 1e-300)
    for k in range(min(r.shape)):
        norms = np.linalg.norm(rest[:, k:], axis=0)
        at = k + int(norms.argmax())
        if norms[at - k] <= least:
            break
        rest[:, [k, at]], order[[k, at]] = rest[:, [at, k]], order[[at, k]]
        unit = rest[:, k] / np.linalg.norm(rest[:, k])
        for _ in range(2):  # once more, as differences cancel
            rest[:, k + 1 :] -= np.outer(unit, unit @ rest[:, k + 1 :])
        rank += 1
    return order, rank


@dataclass(frozen=True)
class Reflectors:
    """``X[:, pivot] = Q (R over zeros)`` with a square orthogonal Q of ``nrow`` rows."""

    nodes: DataFrame
    nrow: int
    ncol: int
    height: int
    levels: int
    #: R's rows, its diagonal not negative
    r: np.ndarray
    signs: np.ndarray
    pivot: np.ndarray
    rank: int

    def _span(self, level: int) -> int:
        return self.height * FANOUT**level

    def _moves(self, level: int) -> Column:
        """Rows that nodes of a level change."""
        return F.lit(True) if not level else F.col("i") % self._span(level - 1) < self.ncol

    def _at(self, level: int, rows: DataFrame, width: int, transposed: bool) -> DataFrame:
        """The rows that a level's nodes change, changed; rows that are absent are zeros."""
        span, lower, p, n = self._span(level), self._span(level - 1) if level else 0, self.ncol, self.nrow

        def apply(key: tuple, mine: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            node = int(key[0])
            start, stop = node * span, min(n, (node + 1) * span)
            i = np.arange(start, stop) if not lower else np.concatenate([np.arange(s, min(s + p, stop)) for s in range(start, stop, lower)])
            x = np.zeros((len(i), width))
            if len(found):
                x[np.searchsorted(i, found["i"].to_numpy())] = np.stack(found["vec"].to_list())
            if len(mine):
                v = np.frombuffer(mine["v"].iloc[0]).reshape(len(i), -1)
                t = np.frombuffer(mine["t"].iloc[0]).reshape(v.shape[1], v.shape[1])
                x -= v @ ((t.T if transposed else t) @ (v.T @ x))
            return pd.DataFrame({"i": i, "vec": list(x)})

        nodes = self.nodes.where(F.col("level") == level).select("node", "v", "t").groupBy("node")
        placed = rows.select(F.floor(F.col("i") / span).alias("node"), "i", "vec").groupBy("node")
        return nodes.cogroup(placed).applyInPandas(apply, "i long, vec array<double>")

    def _signed(self, df: DataFrame) -> DataFrame:
        if (self.signs > 0).all():
            return df
        signs = F.array(*[F.lit(float(s)) for s in self.signs])
        sign = F.coalesce(F.get(signs, F.when(F.col("i") < len(self.signs), F.col("i")).otherwise(-1).cast("int")), F.lit(1.0))
        return df.select("i", F.transform("vec", lambda a: a * sign).alias("vec"))

    def _rows(self, x: Matrix) -> DataFrame:
        if x.nrow != self.nrow:
            raise ValueError(f"non-conformable: {self.nrow} and {x.nrow} rows")
        return x.to_rows().df.select("i", "vec")

    def t_times(self, x: Matrix) -> Matrix:
        """t(Q) X; its first rows are the coordinates in the column space."""
        moving, done = self._rows(x), []
        for level in range(self.levels):
            out = durable(self._at(level, moving, x.ncol, True), "up")
            if level + 1 < self.levels:
                up = self._moves(level + 1)
                done.append(out.where(~up))
                out = out.where(up)
            moving = out
        for rows in done:
            moving = moving.unionByName(rows)
        return Matrix(self._signed(moving), self.nrow, x.ncol, "rows", None, x.col_labels)

    def times(self, x: Matrix) -> Matrix:
        """Q X."""
        return Matrix(self._down(self._rows(x), x.ncol), self.nrow, x.ncol, "rows", None, x.col_labels)

    def _down(self, rows: DataFrame, width: int) -> DataFrame:
        given = self._signed(rows)
        out = None
        for level in reversed(range(self.levels)):
            mine = given.where(self._moves(level))
            if out is not None:  # the level above has changed some of them
                mine = mine.where(~self._moves(level + 1)).unionByName(out)
            out = self._at(level, mine, width, False)
            if level:
                out = durable(out, "down")
        return out

    def thin(self) -> Matrix:
        """The first min(nrow, ncol) columns of Q."""
        k = min(self.nrow, self.ncol)
        unit = self.nodes.sparkSession.range(k).select(F.col("id").alias("i"), F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: (j == F.col("id")).cast("double")).alias("vec"))
        return Matrix(self._down(unit, k), self.nrow, k, "rows")

    def full(self) -> Matrix:
        """All of Q as a matrix, for few rows: it has nrow x nrow cells, each stored."""
        n = self.nrow
        if n * n > SMALL:
            raise ValueError("a full Q of so many rows is kept as reflectors: use times and t_times")
        unit = self.nodes.sparkSession.range(n).select(F.col("id").alias("i"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: (j == F.col("id")).cast("double")).alias("vec"))
        return Matrix(self._down(unit, n), n, n, "rows")


def reflectors(m: Matrix, *, pivoted: bool = False, height: int | None = None) -> Reflectors:
    """Factor a matrix with any number of rows; of a matrix with more columns than rows, up to ``SMALL`` cells.

    ``pivoted``: columns in the order of their largest remainders, so that R's diagonal decreases and shows the rank.
    ``height`` forces leaves of so many rows (as many as columns at least). Rows of zeros may be absent."""
    n, p, spark = m.nrow, m.ncol, m.df.sparkSession
    if not n or not p:
        raise ValueError("a matrix has at least one row and one column")
    if n < p and n * p > SMALL:
        raise ValueError("more columns than rows: factor its first columns, and multiply the others by t(Q)")
    height = max(p, height or max(2 * p, LEAF // p))

    def factored(level: int, span: int, lower: int):
        def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            node = int(key[0])
            start, stop = node * span, min(n, (node + 1) * span)
            if lower:
                a = np.vstack([np.frombuffer(r).reshape(-1, p) for r in frame.sort_values("child")["r"]])
            else:
                a = np.zeros((stop - start, p))
                a[frame["i"].to_numpy() - start] = np.stack(frame["vec"].to_list())
            v, t, r = _reflected(a)
            return pd.DataFrame([(level, node, len(a), v.tobytes(), t.tobytes(), np.ascontiguousarray(r).tobytes())], columns=["level", "node", "rows", "v", "t", "r"])

        return one

    rows = m.to_rows().df.select(F.floor(F.col("i") / height).alias("node"), "i", "vec")
    level, span = 0, height
    nodes = made = durable(rows.groupBy("node").applyInPandas(factored(0, span, 0), NODE), "reflectors")
    while span < n:
        level, lower, span = level + 1, span, span * FANOUT
        up = made.select(F.floor(F.col("node") / FANOUT).alias("node"), F.col("node").alias("child"), "r")
        made = durable(up.groupBy("node").applyInPandas(factored(level, span, lower), NODE), "reflectors")
        nodes = nodes.unionByName(made)
    r = np.frombuffer(bytes(made.select("r").first()["r"])).reshape(-1, p)
    order, rank = _pivoted(r)
    if pivoted:
        # one more node, on the first rows alone: its span is that of a level above
        v, t, r = _reflected(np.ascontiguousarray(r[:, order]))
        level += 1
        top = spark.createDataFrame([(level, 0, len(v), v.tobytes(), t.tobytes(), b"")], NODE)
        nodes = nodes.unionByName(top)
    signs = np.where(np.diag(r) < 0, -1.0, 1.0)
    return Reflectors(nodes, n, p, height, level + 1, r * signs[:, None], signs, order if pivoted else np.arange(p), rank)
