"""Factors, inverses and solutions of matrices that the driver can't hold: Cholesky for symmetric positive definite ones, LU
with tournament pivoting for any others.

Cholesky: the matrix is a table of square blocks (``products.to_blocks``), of which the lower triangle is read. A step finishes one
column (Cholesky) or one row (inverse of the factor) of blocks from the finished ones by a join on the inner index and a
sum in numpy, and appends it to a table in the shared folder, so that lineage never exceeds one step and a lost executor
costs one step at most. Neighbouring columns with few blocks (of band matrices, say) are one step. One block of ``side`` x ``side`` cells reaches the driver at a time.
Of a matrix of cells the cells alone are kept: a step makes the blocks of its columns, and these are smaller where larger ones would be nearly empty.

LU: rows keep their numbers and never move. A step takes one column of blocks; tasks choose ``side`` pivot rows among their
own by partial pivoting, and the chosen ones of several tasks play again in a tree, until ``side`` rows are left. They leave
the blocks and, eliminated, become a row of the upper factor; the other blocks are updated and written as the next step's
table. Right-hand sides are further columns, so only a back substitution is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matloom.matrix import Matrix
from matloom.operators.products import SIDE, block_cells, multiply_blocks, to_blocks
from matloom.plans.durable import Steps, durable, shared_folder

BLOCK = "bi long, bj long, nr int, nc int, data binary"
#: Cells of a row of blocks up to which it is broadcast to its join.
MOST_SENT = 4_000_000
#: Cells of neighbouring columns of blocks, fill-in included, that one step of Cholesky finishes in a task.
PANEL = 1 << 23
#: The smallest side of blocks of a sparse matrix, blocks whose numbers the driver holds, and the share of cells from which smaller blocks pay.
LEAST_SIDE, MOST_BLOCKS, PAYS = 16, 1 << 20, 0.75
#: Cells of finished blocks that leave a task at once.
AT_ONCE = 1 << 20
INDEFINITE = "the matrix may not be positive definite"
#: Sets of candidate rows that meet in one task of a tournament.
FANIN = 16


def _block(data: bytes, nr: int, nc: int) -> np.ndarray:
    return np.frombuffer(data).reshape(nr, nc)


def _told(bi: int, bj: int, block: np.ndarray) -> tuple:
    return bi, bj, *block.shape, np.ascontiguousarray(block).tobytes()


class _Grid:
    """A table of finished blocks that steps append to."""

    def __init__(self, like: DataFrame, name: str, side: int | None = None) -> None:
        self.spark, self.side = like.sparkSession, side
        self.path = f"{shared_folder(self.spark)}/matloom/{name}-{uuid.uuid4().hex}"
        self.started = False

    def append(self, blocks: DataFrame) -> None:
        blocks.write.mode("append").parquet(self.path)
        self.started = True

    def read(self) -> DataFrame:
        return self.spark.read.schema(BLOCK).parquet(self.path) if self.started else self.spark.createDataFrame([], BLOCK)

    def one(self, bi: int, bj: int) -> np.ndarray:
        row = self.read().where((F.col("bi") == bi) & (F.col("bj") == bj)).first()
        return _block(bytes(row["data"]), row["nr"], row["nc"])


def _sums(pairs: DataFrame, key: str, transposed: bool) -> DataFrame:
    """``key, nr, nc, data``: the sum of ``left @ right`` (``left @ t(right)``) over the rows of a key, one pair in memory
    at a time: rows arrive sorted by their key."""

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, None
        told = lambda: pd.DataFrame([(at, *total.shape, total.tobytes())], columns=[key, "nr", "nc", "data"])
        for frame in frames:
            for here, nr, nc, data, nr2, nc2, other in frame.itertuples(index=False):
                right = _block(other, nr2, nc2)
                product = _block(data, nr, nc) @ (right.T if transposed else right)
                if at is not None and here != at:
                    yield told()
                    total = None
                at, total = here, product if total is None else total + product
        if at is not None:
            yield told()

    parts = max(1, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pairs.select(key, "nr", "nc", "data", "nr2", "nc2", "other").repartition(parts, key).sortWithinPartitions(key)
    return dealt.mapInPandas(added, f"{key} long, nr int, nc int, data binary")


def _sent(df: DataFrame, cells: int) -> DataFrame:
    return F.broadcast(df) if cells <= MOST_SENT else df


def _counts(stored: Iterable[tuple[int, int]], n: int) -> Iterator[int]:
    """The number of blocks of each column on and below the diagonal, with those that elimination fills in."""
    below: dict[int, set[int]] = {}
    for bi, bj in stored:
        if bi > bj:
            below.setdefault(bj, set()).add(bi)
    for j in range(n):
        own = below.pop(j, ())
        yield 1 + len(own)
        if own:
            parent = min(own)
            own.discard(parent)
            if own:
                below.setdefault(parent, set()).update(own)


def _panels(stored: Iterable[tuple[int, int]], n: int, most: int) -> list[tuple[int, int]]:
    """Ranges of neighbouring columns that have ``most`` blocks at most, with the blocks that elimination fills in."""
    panels, first, size = [], 0, 0
    for j, own in enumerate(_counts(stored, n)):
        if j > first and size + own > most:
            panels.append((first, j))
            first, size = j, 0
        size += own
    return [*panels, (first, n)] if n else []


def _pairs(blocks: np.ndarray) -> Iterator[tuple[int, int]]:
    return zip(blocks[:, 0].tolist(), blocks[:, 1].tolist())


def _fitting_side(cells: DataFrame, n: int) -> int:
    """``SIDE`` for the factor of a matrix of cells ``i, j``, or less where its blocks, those that elimination fills in among them,
    take more than one panel and blocks of half the side hold far fewer cells (``PAYS``)."""
    sides = [SIDE]
    while sides[-1] // 2 >= LEAST_SIDE:
        sides.append(sides[-1] // 2)
    of = lambda c, side: F.floor(F.col(c) / side)
    found = cells.agg(*[F.approx_count_distinct(F.xxhash64(of("i", s), of("j", s))) for s in sides]).first()
    sides = [s for s, blocks in zip(sides, found) if blocks <= MOST_BLOCKS] or sides[:1]
    fine = cells.select(of("i", sides[-1]).alias("bi"), of("j", sides[-1]).alias("bj")).distinct().toPandas().to_numpy(np.int64)
    best, least = sides[0], None
    for side in sides:
        coarse, held = np.unique(fine // (side // sides[-1]), axis=0), 0
        for own in _counts(_pairs(coarse), -(-n // side)):
            held += own * side * side
            if least is not None and held > PAYS * least:
                return best
        best, least = side, held
        if held <= PANEL:
            break
    return best


def _factor(m: Matrix, side: int | None) -> _Grid:
    """The lower factor's blocks on and below the diagonal. ``side``: None chooses one that fits the cells."""
    if m.nrow != m.ncol:
        raise ValueError("square matrices only")
    if side is not None and side < 1:
        raise ValueError("blocks have at least one row")
    size, sparse, within = m.nrow, m.layout == "coo", lambda c, first, last: (F.col(c) >= first * side) & (F.col(c) < last * side)
    if sparse:  # cells take far less than blocks, which are made when their columns are finished
        lower = m.df.where((F.col("j") >= 0) & (F.col("i") >= F.col("j")) & (F.col("i") < size)).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v")
        given = durable(lower.repartitionByRange("j", "i"), "given")
        side = side or (SIDE if size <= SIDE else _fitting_side(given, size))
    else:
        side = side or SIDE
        given = durable(to_blocks(m, side).where("bi >= bj"), "given")
    done = _Grid(given, "factor", side)

    def remaining(j: int, corner: bool) -> DataFrame:
        """Blocks of column j (its ``corner`` alone) less what the finished columns explain."""
        rows = F.col("bi") == j if corner else F.col("bi") >= j
        if sparse:
            own = given.where(within("j", j, j + 1) & (within("i", j, j + 1) if corner else F.lit(True)))
            own = to_blocks(Matrix(own, size, size, "coo"), side)
        else:
            own = given.where((F.col("bj") == j) & rows)
        if not j:
            return own
        row = done.read().where(F.col("bi") == j).select("bj", F.col("nr").alias("nr2"), F.col("nc").alias("nc2"), F.col("data").alias("other"))
        pairs = done.read().where(rows).join(_sent(row, side * side * j), "bj")
        sums = _sums(pairs, "bi", True).select("bi", F.col("nr").alias("nr2"), F.col("nc").alias("nc2"), F.col("data").alias("gone"))

        def less(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                made = [_told(bi, bj, (0.0 if data is None else _block(data, nr, nc)) - (0.0 if gone is None else _block(gone, nr, nc))) for bi, bj, nr, nc, data, gone in frame.itertuples(index=False)]
                yield pd.DataFrame(made, columns=["bi", "bj", "nr", "nc", "data"])

        # a block that the matrix doesn't store is one of zeros: what is left of it is fill-in; one without finished partners stays
        both = own.join(sums, "bi", "full").select("bi", F.lit(j).cast("long").alias("bj"), F.coalesce("nr", "nr2").alias("nr"), F.coalesce("nc", "nc2").alias("nc"), "data", "gone")
        return both.mapInPandas(less, BLOCK)

    n = -(-m.nrow // side)

    def of_panel(first: int, last: int) -> DataFrame:
        """Blocks of columns ``first`` to ``last`` less what the finished columns explain, finished in one task."""
        if sparse:  # a cell is a row without a block
            none = F.lit(0)
            both = given.where(within("j", first, last)).select(F.col("i").alias("bi"), F.col("j").alias("bj"), none.alias("nr"), none.alias("nc"), F.lit(None).cast("binary").alias("data"), "v")
        else:
            both = given.where((F.col("bj") >= first) & (F.col("bj") < last)).select("bi", "bj", "nr", "nc", "data", F.lit(0.0).alias("v"))
        if first:
            left = done.read().where(F.col("bi") >= first).withColumnRenamed("bj", "k")
            right = done.read().where((F.col("bi") >= first) & (F.col("bi") < last)).select(F.col("bj").alias("k"), F.col("bi").alias("at"), F.col("nr").alias("nr2"), F.col("nc").alias("nc2"), F.col("data").alias("other"))
            pairs = left.join(right, "k").where("bi >= at").withColumn("key", F.col("bi") * n + F.col("at"))
            gone = _sums(pairs, "key", True).select(F.floor(F.col("key") / n).alias("bi"), (F.col("key") % n).alias("bj"), "nr", "nc", "data", F.lit(0.0).alias("v"))
            both = both.withColumn("gone", F.lit(False)).unionByName(gone.withColumn("gone", F.lit(True)))
        else:
            both = both.withColumn("gone", F.lit(False))

        def finished(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[tuple[int, int], np.ndarray] = {}
            less: dict[tuple[int, int], np.ndarray] = {}
            for frame in frames:
                is_cell = frame["nr"].to_numpy() == 0
                own = frame[is_cell]
                i, j, v = own["bi"].to_numpy(np.int64), own["bj"].to_numpy(np.int64), own["v"].to_numpy(float)
                order = np.lexsort((i // side, j // side))
                i, j, v = i[order], j[order], v[order]
                for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i // side) | np.diff(j // side)) + 1) if len(i) else []:
                    bi, bj = int(i[part[0]]) // side, int(j[part[0]]) // side
                    if (bi, bj) not in held:
                        held[bi, bj] = np.zeros((min(side, size - bi * side), min(side, size - bj * side)))
                    held[bi, bj][i[part] - bi * side, j[part] - bj * side] = v[part]
                for bi, bj, nr, nc, data, gone in frame.loc[~is_cell, ["bi", "bj", "nr", "nc", "data", "gone"]].itertuples(index=False):
                    (less if gone else held)[bi, bj] = _block(data, nr, nc)
            for at, gone in less.items():
                held[at] = held[at] - gone if at in held else -gone
            out: list[tuple] = []
            below: dict[int, set[int]] = {}
            for bi, bj in held:
                if bi > bj:
                    below.setdefault(bj, set()).add(bi)
            for j in range(first, last):
                try:
                    corner = np.linalg.cholesky(held[j, j])
                except (KeyError, np.linalg.LinAlgError):
                    raise ValueError(INDEFINITE) from None
                inverse = np.linalg.inv(corner).T
                rows = sorted(below.pop(j, ()))
                held[j, j] = corner
                for bi in rows:
                    held[bi, j] = held[bi, j] @ inverse
                for at in rows:
                    for bi in rows:
                        if at < last and bi >= at:
                            gone = held[bi, j] @ held[at, j].T
                            held[bi, at] = held[bi, at] - gone if (bi, at) in held else -gone
                            if bi > at:
                                below.setdefault(at, set()).add(bi)
                out += [_told(bi, j, held.pop((bi, j))) for bi in [j, *rows]]
                if len(out) * side * side >= AT_ONCE or j == last - 1:
                    yield pd.DataFrame(out, columns=["bi", "bj", "nr", "nc", "data"])
                    out = []

        return both.repartition(1).mapInPandas(finished, BLOCK)  # PANEL cells at most

    numbers = given.select(F.floor(F.col("i") / side).alias("bi"), F.floor(F.col("j") / side).alias("bj")).distinct() if sparse else given.select("bi", "bj")
    stored = numbers.toPandas().to_numpy(np.int64).reshape(-1, 2)
    if (stored[:, 0] == stored[:, 1]).sum() < n:  # a matrix of cells with a block of zeros on its diagonal
        raise np.linalg.LinAlgError(INDEFINITE)
    for j, last in _panels(_pairs(stored), n, PANEL // (side * side)):
        if last > j + 1:
            try:
                done.append(of_panel(j, last))
            except Exception as problem:
                if INDEFINITE in str(problem):
                    raise np.linalg.LinAlgError(INDEFINITE) from None
                raise
            continue
        row = remaining(j, True).first()
        if row is None:
            raise np.linalg.LinAlgError(INDEFINITE)
        try:
            corner = np.linalg.cholesky(_block(bytes(row["data"]), row["nr"], row["nc"]))
        except np.linalg.LinAlgError:
            raise np.linalg.LinAlgError(INDEFINITE) from None
        held = done.spark.sparkContext.broadcast((corner, np.linalg.inv(corner).T))

        def scaled(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            corner, right = held.value
            for frame in frames:
                yield pd.DataFrame([_told(bi, bj, corner if bi == bj else _block(data, nr, nc) @ right) for bi, bj, nr, nc, data in frame.itertuples(index=False)], columns=["bi", "bj", "nr", "nc", "data"])

        done.append(remaining(j, False).select("bi", "bj", "nr", "nc", "data").mapInPandas(scaled, BLOCK))
    return done


def _factor_inverse(m: Matrix, side: int) -> _Grid:
    """The inverse of the lower factor, row of blocks by row of blocks."""
    lower = _factor(m, side)
    done = _Grid(lower.read(), "factor-inverse")
    for i in range(-(-m.nrow // side)):
        corner = np.linalg.inv(lower.one(i, i))
        own = done.spark.createDataFrame([tuple(map(int, (i, i, *corner.shape))) + (bytearray(corner.tobytes()),)], BLOCK)
        if i:
            row = lower.read().where((F.col("bi") == i) & (F.col("bj") < i)).select(F.col("bj").alias("k"), "nr", "nc", "data")
            above = done.read().select(F.col("bi").alias("k"), "bj", F.col("nr").alias("nr2"), F.col("nc").alias("nc2"), F.col("data").alias("other"))
            held = done.spark.sparkContext.broadcast(-corner)

            def scaled(frames: Iterator[pd.DataFrame], held=held, i=i) -> Iterator[pd.DataFrame]:
                for frame in frames:
                    yield pd.DataFrame([_told(i, bj, held.value @ _block(data, nr, nc)) for bj, nr, nc, data in frame.itertuples(index=False)], columns=["bi", "bj", "nr", "nc", "data"])

            own = own.union(_sums(above.join(_sent(row, side * side * i), "k"), "bj", False).mapInPandas(scaled, BLOCK))
        done.append(own)
    return done


def _turned(blocks: DataFrame) -> DataFrame:
    """The transposed matrix's blocks."""

    def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([_told(bj, bi, _block(data, nr, nc).T) for bi, bj, nr, nc, data in frame.itertuples(index=False)], columns=["bi", "bj", "nr", "nc", "data"])

    return blocks.select("bi", "bj", "nr", "nc", "data").mapInPandas(turn, BLOCK)


def chol_blocks(m: Matrix, *, lower: bool = False, side: int | None = None) -> Matrix:
    """The upper factor U with A = t(U) U (``lower``: its transpose), as cells; those of the other triangle are absent.
    ``side`` of the blocks: by itself ``SIDE``, less for matrices of few cells."""
    found = _factor(m, side)
    blocks, side = found.read(), found.side

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def told() -> pd.DataFrame:
            i, j, v = (np.concatenate(c) for c in zip(*held))
            return pd.DataFrame({"i": i, "j": j.astype(np.int32), "v": v} if lower else {"i": j, "j": i.astype(np.int32), "v": v})

        for frame in frames:
            for bi, bj, nr, nc, data in frame.itertuples(index=False):
                block = _block(data, nr, nc)
                i, j = np.nonzero(np.tril(block) if bi == bj else block)  # absent cells are zeros
                held.append((i + bi * side, j + bj * side, block[i, j]))
                size += len(i)
                if size >= AT_ONCE or len(held) >= AT_ONCE >> 8:
                    yield told()
                    held, size = [], 0
        if held:
            yield told()

    return Matrix(blocks.mapInPandas(cells, "i long, j int, v double"), *m.dim, "coo", m.row_labels, m.col_labels)


def inverse_blocks(m: Matrix, *, side: int = SIDE) -> Matrix:
    """The inverse: t(M) M for the inverse M of the lower factor."""
    blocks = _factor_inverse(m, side).read()
    return Matrix(multiply_blocks(_turned(blocks), blocks, *m.dim, side, m.nrow), *m.dim, "coo", m.col_labels, m.row_labels)


def solve_blocks(a: Matrix, b: Matrix, *, side: int = SIDE) -> Matrix:
    """X with A X = B for any number of right-hand sides: t(M) (M B) for the inverse M of the lower factor."""
    if a.nrow != b.nrow:
        raise ValueError("non-conformable")
    blocks = _factor_inverse(a, side).read()
    half = Matrix(multiply_blocks(blocks, to_blocks(b, side), *b.dim, side, a.nrow), *b.dim, "coo")
    found = multiply_blocks(_turned(blocks), to_blocks(half, side), *b.dim, side, a.nrow)
    return Matrix(found, *b.dim, "coo", a.col_labels, b.col_labels)


# ---- LU with tournament pivoting


def _chosen(rows: np.ndarray) -> np.ndarray:
    """The pivots, in order, that partial pivoting takes: as many as there are columns, if there are rows."""
    left, order = rows.copy(), np.arange(len(rows))
    k = min(rows.shape)
    for at in range(k):
        best = at + int(np.abs(left[at:, at]).argmax())
        if best != at:
            left[[at, best]], order[[at, best]] = left[[best, at]], order[[best, at]]
        if left[at, at] != 0:
            left[at + 1 :, at:] -= np.outer(left[at + 1 :, at] / left[at, at], left[at, at:])
    return order[:k]


def _eliminated(square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit lower and upper factor of rows that are in pivot order."""
    upper, lower = square.copy(), np.eye(len(square))
    for at in range(len(square)):
        if upper[at, at] != 0:
            lower[at + 1 :, at] = upper[at + 1 :, at] / upper[at, at]
            upper[at + 1 :] -= np.outer(lower[at + 1 :, at], upper[at])
    return lower, np.triu(upper)


LU = "r long, c long, ids binary, nr int, nc int, data binary"


def _tournament(panel: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pivot rows, in order, and the rows."""
    schema = "part long, ids binary, data binary"

    def play(ids: np.ndarray, rows: np.ndarray) -> tuple[bytes, bytes]:
        won = _chosen(rows)
        return ids[won].tobytes(), np.ascontiguousarray(rows[won]).tobytes()

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for frame in frames:
            for ids, data in zip(frame["ids"], frame["data"]):
                held.append((np.frombuffer(ids, np.int64), np.frombuffer(data).reshape(-1, width)))
                if sum(len(x) for x, _ in held) > 4 * width:
                    a, b = play(np.concatenate([x for x, _ in held]), np.vstack([x for _, x in held]))
                    held = [(np.frombuffer(a, np.int64), np.frombuffer(b).reshape(-1, width))]
        if held:
            yield pd.DataFrame([(0, *play(np.concatenate([x for x, _ in held]), np.vstack([x for _, x in held])))], columns=["part", "ids", "data"])

    def merged(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ids, rows = np.concatenate([np.frombuffer(x, np.int64) for x in frame["ids"]]), np.vstack([np.frombuffer(x).reshape(-1, width) for x in frame["data"]])
        return pd.DataFrame([(int(key[0]), *play(ids, rows))], columns=["part", "ids", "data"])

    sets = durable(panel.select("ids", "data").mapInPandas(local, schema), "candidates")
    while (n := sets.count()) > FANIN:
        sets = durable(sets.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(-(-n // (FANIN // 2))))).groupBy("part").applyInPandas(merged, schema), "candidates")
    last = sorted((bytes(r["ids"]), bytes(r["data"])) for r in sets.collect())  # FANIN sets of rows at most
    ids, rows = np.concatenate([np.frombuffer(x, np.int64) for x, _ in last]), np.vstack([np.frombuffer(x).reshape(-1, width) for _, x in last])
    won = _chosen(rows)
    return ids[won], rows[won]


def _every_block(m: Matrix, side: int, first: int) -> DataFrame:
    """All blocks of a matrix as rows ``LU``, absent ones zero; columns of blocks count from ``first``."""
    rows, columns = -(-m.nrow // side), -(-m.ncol // side)
    spark, (height, width) = m.df.sparkSession, m.dim
    grid = spark.range(rows).select(F.col("id").alias("bi"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))).alias("bj"))

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for bi, bj, data in frame.itertuples(index=False):
                nr, nc = min(side, height - bi * side), min(side, width - bj * side)
                made.append((bi, bj + first, np.arange(bi * side, bi * side + nr).tobytes(), nr, nc, data or bytes(8 * nr * nc)))
            yield pd.DataFrame(made, columns=["r", "c", "ids", "nr", "nc", "data"])

    return grid.join(to_blocks(m, side).select("bi", "bj", "data"), ["bi", "bj"], "left").mapInPandas(told, LU)


def _row_of_upper(held, j: int, width: int):
    """The function that gathers pivot rows of one column of blocks and eliminates them among themselves."""

    def assembled(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        nc = int(frame["nc"].iloc[0])
        whole = np.zeros((width, nc))
        for ids, data in zip(frame["ids"], frame["data"]):
            whole[np.frombuffer(ids, np.int64)] = np.frombuffer(data).reshape(-1, nc)
        return pd.DataFrame([_told(j, int(key[0]), held.value[1] @ whole)], columns=["bi", "bj", "nr", "nc", "data"])

    return assembled


def solve_general(a: Matrix, b: Matrix, *, side: int = SIDE) -> Matrix:
    """X with A X = B for any square matrix that isn't singular, symmetric or not, and any number of right-hand sides."""
    if a.nrow != a.ncol:
        raise ValueError("square matrices only")
    if a.nrow != b.nrow:
        raise ValueError("non-conformable")
    spark, n = a.df.sparkSession, -(-a.nrow // side)
    steps = Steps(spark, "lu")
    state = steps.put(_every_block(a, side, 0).unionByName(_every_block(b, side, n)))
    upper, inverses, largest = _Grid(state, "upper"), [], 0.0
    for j in range(n):
        width = min(side, a.nrow - j * side)
        ids, rows = _tournament(state.where(F.col("c") == j), width)
        lower, own = _eliminated(rows)
        diagonal = np.abs(np.diag(own))
        largest = max(largest, np.abs(rows).max(initial=0))
        if len(ids) < width or diagonal.min() <= 1e-14 * largest:
            raise np.linalg.LinAlgError("the matrix is singular")
        inverses.append(np.linalg.inv(own))
        held = spark.sparkContext.broadcast((dict(zip(ids.tolist(), range(width))), np.linalg.inv(lower), inverses[-1]))
        rest = state.where(F.col("c") > j)

        def pivots(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            places = held.value[0]
            for frame in frames:
                made = []
                for c, ids, nr, nc, data in frame.itertuples(index=False):
                    at = [(k, places[x]) for k, x in enumerate(np.frombuffer(ids, np.int64).tolist()) if x in places]
                    if at:
                        made.append((c, np.array([p for _, p in at]).tobytes(), nc, _block(data, nr, nc)[[k for k, _ in at]].tobytes()))
                yield pd.DataFrame(made, columns=["c", "ids", "nc", "data"])

        upper.append(rest.select("c", "ids", "nr", "nc", "data").mapInPandas(pivots, "c long, ids binary, nc int, data binary").groupBy("c").applyInPandas(_row_of_upper(held, j, width), BLOCK))
        if j == n - 1:
            break

        def factors(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for frame in frames:
                made = []
                for r, ids, nr, nc, data in frame.itertuples(index=False):
                    stay = [x not in held.value[0] for x in np.frombuffer(ids, np.int64).tolist()]
                    made.append((r, (_block(data, nr, nc)[stay] @ held.value[2]).tobytes()))
                yield pd.DataFrame(made, columns=["r", "factor"])

        def updated(frames: Iterator[pd.DataFrame], held=held, width=width) -> Iterator[pd.DataFrame]:
            for frame in frames:
                made = []
                for r, c, ids, nr, nc, data, factor, row in frame.itertuples(index=False):
                    numbers = np.frombuffer(ids, np.int64)
                    stay = np.array([x not in held.value[0] for x in numbers.tolist()], bool)
                    left = _block(data, nr, nc)[stay] - _block(factor, -1, width) @ _block(row, width, nc)
                    if len(left):
                        made.append((r, c, numbers[stay].tobytes(), *left.shape, left.tobytes()))
                yield pd.DataFrame(made, columns=["r", "c", "ids", "nr", "nc", "data"])

        column = state.where(F.col("c") == j).select("r", "ids", "nr", "nc", "data").mapInPandas(factors, "r long, factor binary")
        row = upper.read().where(F.col("bi") == j).select(F.col("bj").alias("c"), F.col("data").alias("row"))
        joined = rest.join(_sent(column, a.nrow * width), "r").join(_sent(row, width * (a.ncol + b.ncol)), "c")
        state = steps.put(joined.select("r", "c", "ids", "nr", "nc", "data", "factor", "row").mapInPandas(updated, LU))
    steps.end()

    found = _Grid(state, "solution")
    for j in reversed(range(n)):
        own = upper.read().where((F.col("bi") == j) & (F.col("bj") >= n)).select((F.col("bj") - n).alias("bj"), "nr", "nc", "data")
        if j < n - 1:
            row = upper.read().where((F.col("bi") == j) & (F.col("bj") < n)).select(F.col("bj").alias("k"), "nr", "nc", "data")
            below = found.read().select(F.col("bi").alias("k"), "bj", F.col("nr").alias("nr2"), F.col("nc").alias("nc2"), F.col("data").alias("other"))
            own = own.join(_sums(below.join(_sent(row, side * a.ncol), "k"), "bj", False).select("bj", F.col("data").alias("gone")), "bj", "left")
        else:
            own = own.withColumn("gone", F.lit(None).cast("binary"))
        held = spark.sparkContext.broadcast(inverses[j])

        def solved(frames: Iterator[pd.DataFrame], held=held, j=j) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.DataFrame([_told(j, bj, held.value @ (_block(data, nr, nc) - (0.0 if gone is None else _block(gone, nr, nc)))) for bj, nr, nc, data, gone in frame.itertuples(index=False)], columns=["bi", "bj", "nr", "nc", "data"])

        found.append(own.select("bj", "nr", "nc", "data", "gone").mapInPandas(solved, BLOCK))
    cells = block_cells(found.read().withColumn("planes", F.lit(1)), side)
    return Matrix(cells, a.ncol, b.ncol, "coo", a.col_labels, b.col_labels)


def inverse_general(a: Matrix, *, side: int = SIDE) -> Matrix:
    """Of any square matrix that isn't singular."""
    one = a.df.sparkSession.range(a.nrow).select(F.col("id").alias("i"), F.col("id").cast("int").alias("j"), F.lit(1.0).alias("v"))
    return solve_general(a, Matrix(one, *a.dim, "coo", a.row_labels, a.col_labels), side=side)
