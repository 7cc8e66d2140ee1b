"""Selecting and replacing cells."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matloom.matrix import Matrix


#: Runs that become an expression; more are looked up in tasks.
MOST_RUNS = 32


@dataclass(frozen=True)
class Run:
    """Positions start, start + step, .. before stop; ``others``: those between them instead."""

    start: int
    stop: int
    step: int = 1
    others: bool = False

    def __len__(self) -> int:
        marked = -(-(self.stop - self.start) // self.step)
        return self.stop - self.start - marked if self.others else marked

    def complement(self) -> "Run | None":
        return None if self.step == 1 else replace(self, others=not self.others)

    def has(self, i: Column) -> Column:
        inside = (i >= self.start) & (i < self.stop)
        if self.step == 1:
            return inside
        on = (i - self.start) % self.step == 0
        return inside & (~on if self.others else on)

    def place(self, i: Column) -> Column:
        """How many of the run come before a position of it."""
        turn = F.floor((i - self.start) / self.step).cast("long") if self.step > 1 else i - self.start
        return i - self.start - turn - 1 if self.others else turn


@dataclass(frozen=True)
class Rows:
    """Positions below n as ascending runs that don't overlap, in memory by the number of runs. Within ``period`` rows, if
    given, that recycle over all n; ``descending`` reverses the order."""

    runs: tuple[Run, ...]
    n: int
    period: int | None = None
    descending: bool = False

    @staticmethod
    def of(index, n: int) -> "Rows | None":
        """From what ``subset`` takes; None for lists that aren't strictly ascending (order and duplicates count)."""
        if index is None:
            index = slice(None)
        if isinstance(index, (slice, range)):
            if isinstance(index, range) and len(index) and (min(index) < 0 or max(index) >= n):
                raise IndexError(f"position out of 0..{n - 1}")
            r = range(n)[index] if isinstance(index, slice) else index
            up = r if r.step > 0 else r[::-1]
            return Rows((Run(up[0], up[-1] + 1, up.step if len(up) > 1 else 1),) if len(up) else (), n, None, r.step < 0 and len(r) > 1)
        if isinstance(index, (int, np.integer)):
            index = [index]
        if isinstance(index, tuple) and len(index) == 2 and isinstance(index[0], str) and index[0] == "not":
            gone = index[1]
            found = Rows.of(gone, n)
            if found is None:
                found = Rows.of(np.unique(np.asarray(list(gone), dtype=np.int64)), n)
            return found.complement()
        values = np.asarray(index)
        if values.dtype == bool and len(values):
            found = Rows._ascending(np.flatnonzero(values[:n]), n)
            return found if len(values) >= n else replace(found, period=len(values))
        values = values.astype(np.int64)
        if len(values) and (values.min() < 0 or values.max() >= n):
            raise IndexError(f"position out of 0..{n - 1}")
        return Rows._ascending(values, n) if (np.diff(values) > 0).all() else None

    @staticmethod
    def _ascending(values: np.ndarray, n: int) -> "Rows":
        if len(values) > 2 and len(set(np.diff(values).tolist())) == 1:  # one stepped run
            return Rows((Run(int(values[0]), int(values[-1]) + 1, int(values[1] - values[0])),), n)
        cuts = np.flatnonzero(np.diff(values) != 1) + 1
        return Rows(tuple(Run(int(part[0]), int(part[-1]) + 1) for part in np.split(values, cuts) if len(part)), n)

    def complement(self) -> "Rows":
        """All other positions, ascending."""
        end, at, found = self.period or self.n, 0, []
        for run in self.runs:
            if run.start > at:
                found.append(Run(at, run.start))
            other = run.complement()
            if other is not None and len(other):
                found.append(other)
            at = run.stop
        if at < end:
            found.append(Run(at, end))
        return Rows(tuple(found), self.n, self.period)

    def _within(self, end: int) -> int:
        """How many are before position ``end`` of a period."""
        return sum(len(replace(run, stop=min(run.stop, end))) for run in self.runs if run.start < end)

    def __len__(self) -> int:
        if not self.period:
            return sum(map(len, self.runs))
        return self.n // self.period * sum(map(len, self.runs)) + self._within(self.n % self.period)

    @property
    def whole(self) -> bool:
        return len(self) == self.n and not self.descending

    def select(self, df: DataFrame, i: str = "i") -> DataFrame:
        """The rows whose number is one of these, renumbered. Bounds, and each of a few runs, reach the scan as ranges."""
        if self.whole:
            return df
        if not self.runs:
            return df.where(F.lit(False))
        at = F.col(i) if not self.period else F.col(i) % self.period
        if not self.period:
            df = df.where((F.col(i) >= self.runs[0].start) & (F.col(i) < self.runs[-1].stop))
        if len(self.runs) <= MOST_RUNS:
            kept, place, before = F.lit(False), None, 0
            for run in self.runs:
                kept = kept | run.has(at)
                here = run.place(at) + before
                place = here if place is None else F.when(at >= run.start, here).otherwise(place)
                before += len(run)
            df = df.where(kept)
        else:
            df = df.withColumn("_place", _looked_up(self.runs)(at)).where("_place >= 0")
            place = F.col("_place")
        if self.period:
            place = place + F.floor(F.col(i) / self.period).cast("long") * sum(map(len, self.runs))
        if self.descending:
            place = F.lit(len(self) - 1) - place
        return df.withColumn(i, place.cast("long")).drop("_place")

    def has(self, i: Column) -> Column:
        at = i % self.period if self.period else i
        if len(self.runs) > MOST_RUNS:
            return _looked_up(self.runs)(at) >= 0
        return reduce(Column.__or__, [run.has(at) for run in self.runs], F.lit(False))


def _looked_up(runs: tuple[Run, ...]):
    """A function of positions: the place among all runs, -1 outside."""
    start, stop, step, others = (np.array([getattr(r, x) for r in runs]) for x in ("start", "stop", "step", "others"))
    before = np.concatenate([[0], np.cumsum([len(r) for r in runs])])[:-1]

    @F.pandas_udf("long")
    def place(i: pd.Series) -> pd.Series:
        at = i.to_numpy()
        k = np.maximum(np.searchsorted(start, at, side="right") - 1, 0)
        d = at - start[k]
        turn, rest = d // step[k], d % step[k]
        inside = (d >= 0) & (at < stop[k]) & ((rest == 0) != others[k])
        return pd.Series(np.where(inside, before[k] + np.where(others[k], d - turn - 1, turn), -1))

    return place


def positions(index, n: int) -> list[int] | range:
    """0-based positions of columns, or of rows that a list holds anyway: None or ``:`` is all; booleans are recycled; a
    tuple ("not", positions) excludes."""
    if index is None:
        return range(n)
    if isinstance(index, slice):
        return range(n)[index]
    if isinstance(index, (int, np.integer)):
        index = [index]
    if isinstance(index, tuple) and len(index) == 2 and isinstance(index[0], str) and index[0] == "not":
        gone = set(positions(index[1], n))
        return [k for k in range(n) if k not in gone]
    values = list(index) if not isinstance(index, range) else index
    if len(values) and isinstance(values[0], (bool, np.bool_)):
        return [k for k in range(n) if values[k % len(values)]]
    if len(values) and (min(values) < 0 or max(values) >= n):
        raise IndexError(f"position out of 0..{n - 1}")
    return values


def subset(m: Matrix, rows=None, cols=None) -> Matrix:
    """``m[rows, cols]``; order and duplicates are kept. Rows that ascend or descend (runs, steps, exclusions, recycled
    booleans) are expressions of the row number, whose ranges reach the scan; a list in another order, which the caller
    holds, joins as a table of positions. Columns are projected."""
    i, j = Rows.of(rows, m.nrow), positions(cols, m.ncol)
    m = m.to_rows() if m.layout == "coo" else m
    named = m.row_labels
    if i is not None:
        df, count = i.select(m.df), len(i)
        named = None if named is None else i.select(named, "idx")
    else:
        wanted = positions(rows, m.nrow)
        at, count = m.df.sparkSession.createDataFrame([(k, int(x)) for k, x in enumerate(wanted)], "_pos long, i long"), len(wanted)
        df = m.df.join(at, "i").drop("i").withColumnRenamed("_pos", "i")
        named = None if named is None else named.join(at, F.col("idx") == F.col("i")).select(F.col("_pos").alias("idx"), "name")
    if m.layout == "wide":
        df = df.select("i", *[F.col(f"c{x}").alias(f"c{k}") for k, x in enumerate(j)])
    elif not (isinstance(j, range) and len(j) == m.ncol and j.step == 1):
        df = df.select("i", F.array(*[F.get("vec", int(x)) for x in j]).cast("array<double>").alias("vec"))
    titles = m.col_labels
    if titles is not None and not (isinstance(j, range) and len(j) == m.ncol and j.step == 1):
        order = titles.sparkSession.createDataFrame([(k, int(x)) for k, x in enumerate(j)], "_pos long, idx long")
        titles = titles.join(order, "idx").select(F.col("_pos").alias("idx"), "name")
    return Matrix(df, count, len(j), m.layout, named, titles)


def select_rows(m: Matrix, index: DataFrame) -> Matrix:
    """Rows by a table ``pos, i`` of any size."""
    return replace(m, df=m.df.join(index.toDF("_pos", "i"), "i").drop("i").withColumnRenamed("_pos", "i"), nrow=index.count(), row_labels=None)


def assign(m: Matrix, rows, cols, value) -> Matrix:
    """A matrix with ``m[rows, cols] = value``: a scalar, an array of that shape, or a vector recycled down the columns.

    A scalar is an expression of the row number, however many rows it covers; an array, which the caller holds, a table."""
    a = np.asarray(value, float)
    flat = a.ravel(order="F")
    if not len(flat):
        raise ValueError("no values")
    wide = m.to_wide() if m.layout == "coo" and m.ncol <= 256 else m
    runs = Rows.of(rows, m.nrow) if len(flat) == 1 and a.ndim < 2 and wide.layout != "coo" else None
    if runs is not None:
        inside, chosen, scalar = runs.has(F.col("i")), set(positions(cols, m.ncol)), F.lit(float(flat[0]))
        if wide.layout == "wide":
            return replace(wide, df=wide.df.select("i", *[F.when(inside, scalar).otherwise(F.col(c)).alias(c) if k in chosen else F.col(c) for k, c in enumerate(wide.names)]))
        target = F.array(*[F.lit(k) for k in sorted(chosen)]).cast("array<int>")
        every = len(chosen) == m.ncol
        vec = F.transform("vec", lambda v, k: scalar if every else F.when(F.array_contains(target, k), scalar).otherwise(v))
        return replace(wide, df=wide.df.select("i", F.when(inside, vec).otherwise(F.col("vec")).alias("vec")))
    return assign_cells(m, patch_of(m, rows, cols, value))


def patch_of(m: Matrix, rows, cols, value) -> DataFrame:
    """``i, j, w, at``: the cells of ``m[rows, cols] = value``, numbered in the order they are assigned."""
    i, j = positions(rows, m.nrow), positions(cols, m.ncol)
    a = np.asarray(value, float)
    if a.ndim == 2 and a.shape != (len(i), len(j)):
        raise ValueError(f"{a.shape} values for {(len(i), len(j))} cells")
    flat = a.ravel(order="F")
    if not len(flat):
        raise ValueError("no values")
    n = len(i) * len(j)
    cells = pd.DataFrame({"i": np.tile(np.asarray(i, np.int64), len(j)), "j": np.repeat(np.asarray(j, np.int32), len(i)), "w": np.resize(flat, n), "at": np.arange(n)})
    return m.df.sparkSession.createDataFrame(cells, "i long, j int, w double, at long")


def last_cells(patch: DataFrame, *order: str) -> DataFrame:
    """``i, j, w``, one of each cell: the last by ``order``, then the largest value."""
    return patch.groupBy("i", "j").agg(F.max_by("w", F.struct(*order, "w")).alias("w"))


def assign_cells(m: Matrix, patch: DataFrame) -> Matrix:
    """A matrix with the cells ``i, j, w`` of ``patch`` (any size) replaced. Of several values for one cell the one with the
    largest ``at`` counts, if there is such a column, then the largest. Cells outside of the matrix are left out; without a
    value a cell becomes NaN. Stored rows aren't cut into cells: a row meets its own replacements, ncol at most, as a map."""
    order = ["at"] if "at" in patch.columns else []
    inside = F.col("i").between(0, m.nrow - 1) & F.col("j").between(0, m.ncol - 1)
    held = patch.select(F.col("i").cast("long").alias("i"), F.col("j").cast("int").alias("j"), F.coalesce(F.col("w").cast("double"), F.lit(float("nan"))).alias("w"), *order)
    cells = last_cells(held.where(inside), *order)
    if m.layout == "coo":
        return replace(m, df=m.df.join(cells, ["i", "j"], "full").select("i", "j", F.coalesce("w", "v").alias("v")))
    by_row = cells.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "w"))).alias("_new"))
    new = lambda k, old: F.coalesce(F.try_element_at(F.col("_new"), k), old)
    joined = m.df.join(by_row, "i", "left")
    if m.layout == "wide":
        return replace(m, df=joined.select("i", *[new(F.lit(k), F.col(c)).alias(c) for k, c in enumerate(m.names)]))
    return replace(m, df=joined.select("i", F.when(F.col("_new").isNull(), F.col("vec")).otherwise(F.transform("vec", lambda v, k: new(k, v))).alias("vec")))
