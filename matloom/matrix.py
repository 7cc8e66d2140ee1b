"""A matrix as a DataFrame: a lazy, immutable handle with its shape and layout.

Layouts (rows and columns count from 0):

* ``wide``  ``i, c0 .. c{p-1}``: up to a few hundred columns; aggregates run in whole-stage code
* ``rows``  ``i, vec array<double>``: tall matrices with many columns; numpy kernels over row blocks
* ``coo``   ``i, j, v``: generic; absent cells are zeros
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matloom.functions.options import may_collect, work_tasks
from matloom.plans.index import with_position

#: Cells of dense rows, or of a tile of cells, that a task holds at once; rows of a tile at least; runs of tiles for each task.
AT_ONCE, TILE_ROWS, RUNS = 1 << 20, 512, 4


@dataclass(frozen=True)
class Matrix:
    df: DataFrame
    nrow: int
    ncol: int
    layout: str
    #: ``idx, name`` tables of labels
    row_labels: DataFrame | None = None
    col_labels: DataFrame | None = None
    #: who numbered the rows: "key" or, without one, a name of this handle's own; None isn't known
    numbered: str | None = None

    # ---- construction

    @staticmethod
    def from_columns(df: DataFrame, columns: list[str], key: str | None = None, *, dense: bool = True, nrow: int | None = None) -> "Matrix":
        """From numeric columns. ``key`` orders the rows (``dense``: positions by it; else it is the row number itself).
        Without a key, rows get numbers in no particular order, for operators that don't need any; such a matrix isn't
        joined with another one."""
        values = [F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)]
        if key is None:
            wide = df.select(F.monotonically_increasing_id().alias("i"), *values)
        elif dense:
            wide = with_position(df.select(F.col(key).alias("_key"), *values), ["_key"]).select("i", *[f"c{k}" for k in range(len(columns))])
        else:
            wide = df.select(F.col(key).cast("long").alias("i"), *values)
        return Matrix(wide, df.count() if nrow is None else nrow, len(columns), "wide", numbered=uuid.uuid4().hex if key is None else "key")

    @staticmethod
    def from_vectors(df: DataFrame, vector: str, key: str, *, dense: bool = True) -> "Matrix":
        vectors = df.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("vec"))
        size = vectors.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.min(F.size("vec"))).first()
        if size[0] and size[1] != size[2]:
            raise ValueError("vectors differ in length")
        rows = with_position(vectors, ["_key"]).select("i", "vec") if dense else vectors.select(F.col("_key").cast("long").alias("i"), "vec")
        return Matrix(rows, size[0], size[1] or 0, "rows", numbered="key")

    @staticmethod
    def from_coo(df: DataFrame, nrow: int, ncol: int) -> "Matrix":
        return Matrix(df.select(F.col("i").cast("long").alias("i"), F.col("j").cast("int").alias("j"), F.col("v").cast("double").alias("v")), nrow, ncol, "coo")

    @staticmethod
    def from_numpy(spark: SparkSession, values) -> "Matrix":
        """A small matrix that the driver holds; a vector is one column."""
        a = np.asarray(values, float)
        a = a.reshape(-1, 1) if a.ndim == 1 else a
        rows = [(k, r.tolist()) for k, r in enumerate(a)]
        return Matrix(spark.createDataFrame(rows, "i long, vec array<double>"), *a.shape, "rows")

    @staticmethod
    def create(spark: SparkSession, nrow: int, ncol: int, data=0.0, dtype: str = "double") -> "Matrix":
        """Filled with ``data``, recycled down the columns; ``dtype`` is double, real, numeric, integer, int or logical."""
        if nrow < 1 or ncol < 1:
            raise ValueError("a matrix has at least one row and one column")
        if dtype not in ("double", "real", "numeric", "integer", "int", "logical"):
            raise ValueError(f"unknown type {dtype!r}")
        values = np.atleast_1d(np.asarray(data, float)).ravel(order="F")
        cycle = F.array(*[F.lit(float(x)) for x in values])
        value = (lambda c: c.cast("int").cast("double")) if dtype in ("integer", "int") else (lambda c: (c != 0).cast("double")) if dtype == "logical" else (lambda c: c)
        vec = F.transform(F.sequence(F.lit(0), F.lit(ncol - 1)), lambda j: value(F.get(cycle, ((j.cast("long") * nrow + F.col("i")) % len(values)).cast("int"))))
        return Matrix(spark.range(nrow).select(F.col("id").alias("i")).withColumn("vec", vec), nrow, ncol, "rows")

    # ---- layouts

    @property
    def names(self) -> list[str]:
        return [f"c{j}" for j in range(self.ncol)]

    def to_coo(self) -> "Matrix":
        if self.layout == "coo":
            return self
        vec = F.array(*self.names) if self.layout == "wide" else F.col("vec")
        return replace(self, df=self.df.select("i", F.posexplode(vec).alias("j", "v")), layout="coo")

    def to_rows(self) -> "Matrix":
        if self.layout == "rows":
            return self
        if self.layout == "wide":
            return replace(self, df=self.df.select("i", F.array(*self.names).alias("vec")), layout="rows")
        ncol, spark = self.ncol, self.df.sparkSession
        cell = F.struct(F.col("j").cast("int").alias("j"), F.coalesce("v", F.lit(0.0)).alias("v")).alias("c")
        every = spark.range(self.nrow).select(F.col("id").alias("i"))
        own = self.df.where((F.col("i") >= 0) & (F.col("i") < self.nrow) & (F.col("j") >= 0) & (F.col("j") < ncol)).select(F.col("i").cast("long").alias("i"), cell)
        both = own.unionByName(every.select("i", F.lit(None).cast("struct<j:int,v:double>").alias("c")))
        # tasks by the number of cells, as bytes of stored ones say little about the rows; a row has ncol cells at most
        dealt = both.repartition(work_tasks(spark, len(self)), "i") if len(self) > AT_ONCE else both
        held = dealt.groupBy("i").agg(F.collect_list("c").alias("c")).select("i", F.col("c.j").alias("j"), F.col("c.v").alias("v"))

        def filled(batches):
            for batch in batches:
                at = 0
                while at < batch.num_rows:
                    part = batch.slice(at, max(1, AT_ONCE // max(1, ncol)))
                    at += part.num_rows
                    j, v = part.column("j").flatten().to_numpy(zero_copy_only=False), part.column("v").flatten().to_numpy(zero_copy_only=False)
                    place = np.repeat(np.arange(part.num_rows), part.column("j").value_lengths().to_numpy(zero_copy_only=False)) * ncol + j
                    if len(np.unique(place)) < len(place):
                        raise ValueError("a cell is stored twice")
                    flat = np.zeros(part.num_rows * ncol)
                    flat[place] = v
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * np.int32(ncol)), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([part.column("i"), vec], ["i", "vec"])

        return replace(self, df=held.mapInArrow(filled, "i long, vec array<double>"), layout="rows")

    def every_cell(self, fill: DataFrame | float = 0.0, axis: str = "j") -> "Matrix":
        """In the ``coo`` layout with all cells stored, for operators that don't map zero to zero. ``fill``: what absent cells
        hold, one number or ``k, w`` for each column k (``axis`` i: row k); columns that aren't in it are left out.

        Only stored cells and fills move; a task makes tiles of cells, neighbouring ones after each other, and leaves each
        column by column: i repeats itself, j and most values stay, so that written cells take a fraction of a byte."""
        if self.layout != "coo":
            return self.to_coo()
        spark, (nrow, ncol) = self.df.sparkSession, self.dim
        if not len(self):
            return replace(self, df=self.df.where(F.lit(False)))
        tasks = work_tasks(spark, RUNS * len(self))  # a cell takes longer to write than to compute
        rows = min(nrow, TILE_ROWS * max(1, min(AT_ONCE, len(self) // (RUNS * tasks)) // ncol // TILE_ROWS))  # i repeats in whole bytes
        columns = min(ncol, max(1, AT_ONCE // rows))
        across, tiles = -(-ncol // columns), -(-nrow // rows) * -(-ncol // columns)
        per, size, extent = max(1, tiles // (RUNS * tasks)), columns if axis == "j" else rows, ncol if axis == "j" else nrow
        of = lambda c, n: F.floor(F.col(c) / n)
        nothing = F.lit(None)
        grid = spark.range(tiles).select(F.col("id").alias("t"))
        if isinstance(fill, DataFrame):
            inside = fill.toDF("k", "w").where((F.col("k") >= 0) & (F.col("k") < extent)).select(of("k", size).alias("b"), F.struct((F.col("k") % size).cast("int").alias("k"), "w").alias("s"))
            lines = inside.groupBy("b").agg(F.sort_array(F.collect_list("s")).alias("s")).select("b", F.col("s.k").alias("k"), F.col("s.w").alias("w"))
            whole = (F.size("k") == F.least(F.lit(size), extent - F.col("b") * size)) & (F.size(F.array_distinct("k")) == F.size("k"))
            lines = lines.select("b", F.when(~whole, F.col("k")).alias("k"), "w")
            grid = grid.withColumn("b", F.col("t") % across if axis == "j" else of("t", across)).join(small(lines, extent), "b")
            value = F.col("v")
        else:
            grid = grid.select("t", F.lit(None).cast("array<int>").alias("k"), F.lit(None).cast("array<double>").alias("w"))
            value = F.coalesce("v", F.lit(0.0))
        cells = self.df.where((F.col("i") >= 0) & (F.col("i") < nrow) & (F.col("j") >= 0) & (F.col("j") < ncol))
        cells = cells.select((of("i", rows) * across + of("j", columns)).alias("t"), F.col("i").cast("long").alias("i"), F.col("j").cast("int").alias("j"), value.alias("v"), nothing.cast("array<int>").alias("k"), nothing.cast("array<double>").alias("w"))
        both = cells.unionByName(grid.select("t", nothing.cast("long").alias("i"), nothing.cast("int").alias("j"), nothing.cast("double").alias("v"), "k", "w"))
        constant = None if isinstance(fill, DataFrame) else float(fill)

        def filled(key: tuple, table: pa.Table) -> pa.Table:
            bi, bj = divmod(key[1].as_py(), across)
            top, left = bi * rows, bj * columns
            shown = {"i": np.arange(min(rows, nrow - top)), "j": np.arange(min(columns, ncol - left))}
            is_cell = pc.is_valid(table["i"])
            head, own = table.filter(pc.invert(is_cell)), table.filter(is_cell)
            at = {"i": own["i"].to_numpy() - top, "j": own["j"].to_numpy() - left}
            if constant is None:
                known, w = (head[c][0].values if head.num_rows and head[c][0].is_valid else None for c in ("k", "w"))
                place = np.full(len(shown[axis]), -1)
                if w is None or known is not None:  # some lines have no statistic, or all
                    shown[axis] = np.zeros(0, int) if w is None else known.to_numpy().astype(int)
                if len(shown[axis]) > len(np.unique(shown[axis])):
                    raise ValueError("a statistic is given twice")
                place[shown[axis]] = np.arange(len(shown[axis]))
                at[axis] = place[at[axis]]
            height, width = len(shown["i"]), len(shown["j"])
            keep = at[axis] >= 0
            cell = (at["j"] * height + at["i"])[keep]
            if len(np.unique(cell)) < len(cell):
                raise ValueError("a cell is stored twice")

            def spread(c: np.ndarray) -> np.ndarray:
                return np.repeat(c, height) if axis == "j" else np.tile(c, width)

            v, null = own["v"], None
            if constant is not None:
                flat = np.full(height * width, constant)
            elif not height * width:
                flat = np.zeros(0)
            else:
                flat = spread(w.to_numpy(zero_copy_only=False))
                if w.null_count or v.null_count:
                    null = spread(w.is_null().to_numpy(zero_copy_only=False))
                    null[cell] = v.is_null().to_numpy()[keep]
            flat[cell] = v.to_numpy()[keep]
            return pa.table({"i": np.tile(shown["i"] + top, width), "j": np.repeat(shown["j"] + left, height).astype(np.int32), "v": pa.array(flat, pa.float64(), mask=null)})

        dealt = both.withColumn("run", of("t", per)).select("run", "t", "i", "j", "v", "k", "w").repartition(tasks, "run")
        return replace(self, df=dealt.groupBy("run", "t").applyInArrow(filled, "i long, j int, v double"))

    def to_wide(self) -> "Matrix":
        if self.layout == "wide":
            return self
        rows = self.to_rows()
        return replace(self, df=rows.df.select("i", *[F.get("vec", j).alias(f"c{j}") for j in range(self.ncol)]), layout="wide")

    def t(self) -> "Matrix":
        """Transposed, in the ``coo`` layout: rows and columns swap names, no data move."""
        df = self.to_coo().df.select(F.col("j").cast("long").alias("i"), F.col("i").cast("int").alias("j"), "v")
        return Matrix(df, self.ncol, self.nrow, "coo", self.col_labels, self.row_labels)

    def map_values(self, f) -> "Matrix":
        """Apply a function of columns to each stored cell."""
        if self.layout == "coo":
            df = self.df.select("i", "j", f(F.col("v")).alias("v"))
        elif self.layout == "wide":
            df = self.df.select("i", *[f(F.col(c)).alias(c) for c in self.names])
        else:
            df = self.df.select("i", F.transform("vec", f).alias("vec"))
        return replace(self, df=df)

    # ---- shape and conversion

    @property
    def dim(self) -> tuple[int, int]:
        return self.nrow, self.ncol

    def __len__(self) -> int:
        return self.nrow * self.ncol

    def object_size(self, unit: str = "bytes") -> float:
        return self.nrow * self.ncol * 8 / 1024 ** ["bytes", "KB", "MB", "GB"].index(unit)

    def to_numpy(self, *, force: bool = False, max_size_mb: float | None = None) -> np.ndarray:
        """Collect, as far as ``options.may_collect`` lets."""
        may_collect(self.object_size("MB"), force=force, max_size_mb=max_size_mb)
        out = np.zeros((self.nrow, self.ncol))
        if self.layout == "coo":
            table = self.df.toPandas()
            out[table["i"].to_numpy(int), table["j"].to_numpy(int)] = table["v"].to_numpy(float)
        else:
            table = self.to_rows().df.toPandas()
            if len(table):
                out[table["i"].to_numpy(int)] = np.stack(table["vec"].to_list())
        return out

    def to_pandas(self, **options):
        import pandas as pd

        names = {side: {r["idx"]: r["name"] for r in labels.collect()} if labels is not None else {} for side, labels in (("row", self.row_labels), ("col", self.col_labels))}
        return pd.DataFrame(self.to_numpy(**options), index=[names["row"].get(k, k) for k in range(self.nrow)], columns=[names["col"].get(k, f"c{k}") for k in range(self.ncol)])

    def with_labels(self, rows: list[str] | DataFrame | None = None, cols: list[str] | DataFrame | None = None) -> "Matrix":
        """Names of rows and columns; names of another number than the dimension are dropped."""

        def table(names, n: int) -> DataFrame | None:
            if names is None:
                return None
            if isinstance(names, DataFrame):
                return names if names.count() == n else None
            return self.df.sparkSession.createDataFrame(list(enumerate(map(str, names))), "idx long, name string") if len(names) == n else None

        return replace(self, row_labels=table(rows, self.nrow), col_labels=table(cols, self.ncol))

    def __repr__(self) -> str:
        return f"Matrix {self.nrow} x {self.ncol} ({self.layout}, {self.object_size('MB'):.1f} MB)"

    info = __repr__

    # ---- operators

    def _binary(self, other, op: str, swapped: bool = False) -> "Matrix":
        from matloom.operators import elementwise

        return elementwise.binary(self, other, op, swapped=swapped)

    def __add__(self, other):
        return self._binary(other, "+")

    def __sub__(self, other):
        return self._binary(other, "-")

    def __mul__(self, other):
        return self._binary(other, "*")

    def __truediv__(self, other):
        return self._binary(other, "/")

    def __pow__(self, other):
        raise TypeError("not supported: ^")

    __mod__ = __lt__ = __gt__ = __le__ = __ge__ = __pow__

    def __matmul__(self, other):
        from matloom.operators.products import matmul

        return matmul(self, other)

    def __getitem__(self, at):
        from matloom.operators.subset import subset

        return subset(self, *at)


def same_shape(a: Matrix, b: Matrix) -> None:
    if a.dim != b.dim:
        raise ValueError(f"non-conformable: {a.dim} and {b.dim}")
    numbered_together(a, b)


def numbered_together(a: Matrix, b: Matrix) -> None:
    """Refuse to join rows of a matrix without a key with those of another one."""
    if None not in (a.numbered, b.numbered) and a.numbered != b.numbered:
        raise ValueError("rows without a key have no order: give from_columns a key to join them with another matrix")


def chain(matrices: list[Matrix]) -> Matrix:
    """The product of several matrices, in the order that needs the fewest multiplications."""
    n = len(matrices)
    sizes = [m.nrow for m in matrices] + [matrices[-1].ncol]
    cost = [[0] * n for _ in range(n)]
    cut = [[0] * n for _ in range(n)]
    for width in range(1, n):
        for a in range(n - width):
            b = a + width
            cost[a][b], cut[a][b] = min((cost[a][k] + cost[k + 1][b] + sizes[a] * sizes[k + 1] * sizes[b + 1], k) for k in range(a, b))

    def build(a: int, b: int) -> Matrix:
        return matrices[a] if a == b else build(a, cut[a][b]) @ build(cut[a][b] + 1, b)

    return build(0, n - 1)


#: Rows up to which a table whose size is known is broadcast.
SMALL_ROWS = 1_000_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it has few rows; else the optimizer decides how it joins."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
