"""Vector code compression: product quantisation whose codebooks are fitted over all rows by Lloyd's rounds with heaps.

Vectors become integers, floor(1024 x), and are cut into equal parts; each part position has a codebook. A row of the
job's table is a partition of at most ``BLOCK`` vectors with its state: for each entry a heap of the vector parts assigned
to it, keyed by their slack, lower bound minus upper bound, plus the drift that the entry had seen when the part was
scanned. The upper bound is the distance to the own entry, the lower one that to the second nearest. An entry's drift
grows in each round by how far it moved and how far any other entry of its codebook moved. A round pops only parts whose
key the cumulative drift has reached, rescans them against all entries in exact integer arithmetic (distances that float64
holds exactly as well), and pushes them to the heap of their nearest entry; the others can't have another nearest entry,
nor a tie. Tasks send changes of integer sums and counts, so means are exact as well.

Each round writes the table anew in the shared folder and deletes the one before: two copies at most, and a lost executor
costs one round of its partitions. The driver holds codebooks, drifts and sums, whatever the number of rows.

Defined cases: rows whose vector is null or empty or holds null or non-finite components are dropped; rows without an id
are coded but begin no codebook; repeated ids are coded one by one (as beginnings by vector, ascending); fewer vectors
than entries give so many entries; vectors of different lengths, or of a length that can't be cut evenly, and components
whose squared distances exceed 63 bits are errors; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.llm.common import Tables

PARTS, ENTRIES, ROUNDS, SCALE, BLOCK = 4, 256, 4, 1024, 4096
SCHEMA = "ids array<long>, labels array<long>, data binary, sizes binary, at binary, keys binary, entry int, n long, sums array<long>"


@dataclass
class Codebooks:
    #: integers, part x entry x place
    entries: np.ndarray
    #: part x entry
    drift: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _largest(width: int, bits: int) -> int:
    """Components below this have squared distances below 2 ** bits."""
    return int(np.sqrt(2.0**bits / (4 * width)))


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its nearest entry (ties: the lower index), and how much farther the second nearest one is."""
    n, width = parts.shape
    best, slack = np.zeros(n, np.int64), np.full(n, np.inf)
    small = max(np.abs(parts).max(initial=0), np.abs(entries).max(initial=0)) < _largest(width, 52)
    step = 4096 if small else 256
    for low in range(0, n, step):
        x = parts[low : low + step]
        if small:  # every term is an integer that a float64 holds
            x, c = x.astype(float), entries.astype(float)
            d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
        else:
            d = ((x[:, None].astype(np.int64) - entries[None]) ** 2).sum(2)
        at = d.argmin(1)
        first = np.sqrt(d[np.arange(len(x)), at].astype(float))
        best[low : low + step] = at
        if d.shape[1] > 1:
            d = d.astype(float)
            d[np.arange(len(x)), at] = np.inf
            slack[low : low + step] = np.sqrt(d.min(1)) - first
    return best, slack


class Heaps:
    """One heap of (key, row) for each entry of one part position, of one partition."""

    def __init__(self, sizes: np.ndarray, at: np.ndarray, keys: np.ndarray) -> None:
        self.sizes, self.at, self.keys = sizes, at, keys

    @staticmethod
    def of(best: np.ndarray, keys: np.ndarray, entries: int) -> "Heaps":
        order = np.lexsort((keys, best))  # ascending runs are heaps
        return Heaps(np.bincount(best, minlength=entries), order, keys[order])

    def assigned(self) -> np.ndarray:
        out = np.zeros(len(self.at), np.int64)
        out[self.at] = np.repeat(np.arange(len(self.sizes)), self.sizes)
        return out

    def advance(self, parts: np.ndarray, entries: np.ndarray, drift: np.ndarray, margin: float) -> tuple["Heaps", np.ndarray, np.ndarray, np.ndarray]:
        """Heaps after a move of the entries, and the rows rescanned with their old and new entries."""
        ends = np.cumsum(self.sizes)
        starts = ends - self.sizes
        held = np.flatnonzero(self.sizes)
        reached = held[self.keys[starts[held]] <= drift[held] + margin]
        opened: dict[int, list[tuple[float, int]]] = {}

        def opened_at(e: int) -> list[tuple[float, int]]:
            if e not in opened:
                opened[e] = list(zip(self.keys[starts[e] : ends[e]].tolist(), self.at[starts[e] : ends[e]].tolist()))
            return opened[e]

        popped, old = [], []
        for e in reached.tolist():
            heap, limit = opened_at(e), float(drift[e]) + margin
            while heap and heap[0][0] <= limit:
                popped.append(heapq.heappop(heap)[1])
                old.append(e)
        rows, old_ = np.array(popped, np.int64), np.array(old, np.int64)
        best, slack = nearest(parts[rows], entries)
        for row, e, key in zip(popped, best.tolist(), (slack + drift[best]).tolist()):
            heapq.heappush(opened_at(e), (key, row))
        if not opened:
            return self, rows, old_, best
        pieces_at, pieces_key, sizes, done = [], [], self.sizes.copy(), 0
        for e in sorted(opened):
            pieces_at += [self.at[done : starts[e]], np.array([r for _, r in opened[e]], np.int64)]
            pieces_key += [self.keys[done : starts[e]], np.array([k for k, _ in opened[e]], float)]
            sizes[e], done = len(opened[e]), ends[e]
        return Heaps(sizes, np.concatenate([*pieces_at, self.at[done:]]), np.concatenate([*pieces_key, self.keys[done:]])), rows, old_, best


def _blocks(df: DataFrame, id_col: str, vector_col: str, label_col: str, dim: int, scale: int, parts: int) -> DataFrame:
    """The kept vectors as partitions of integers."""
    largest = _largest(dim // parts, 62)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, pa.Array, np.ndarray]] = []

        def told() -> pa.RecordBatch:
            data = np.concatenate([x for _, _, x in held])
            held_as = np.int16 if np.abs(data).max() < 1 << 15 else np.int32
            ids, labels = (pa.concat_arrays([h[k] for h in held]) for k in (0, 1))
            row = {"ids": [ids.to_pylist()], "labels": [labels.to_pylist()], "data": [data.astype(held_as).tobytes()]}
            return _rows(row)

        for batch in batches:
            lengths = pc.list_value_length(batch.column("v"))
            batch = batch.filter(pc.fill_null(pc.greater(lengths, 0), False))
            if not batch.num_rows:
                continue
            lengths, values = pc.list_value_length(batch.column("v")).to_numpy(), batch.column("v").flatten().to_numpy(zero_copy_only=False)
            fine = np.logical_and.reduceat(np.isfinite(values), np.cumsum(lengths) - lengths)
            if (lengths[fine] != dim).any():
                raise ValueError("vectors differ in length")
            if not fine.any():
                continue
            whole = np.floor(values[np.repeat(fine, lengths)].reshape(-1, dim) * scale)
            if np.abs(whole).max() >= largest:
                raise ArithmeticError("components are too large for distances of 63 bits")
            batch, whole = batch.filter(pa.array(fine)), whole.astype(np.int32)
            done = 0
            while done < len(whole):
                piece = whole[done : done + BLOCK - sum(len(h[2]) for h in held)]
                held.append((batch.column("id").slice(done, len(piece)), batch.column("label").slice(done, len(piece)), piece))
                done += len(piece)
                if sum(len(h[2]) for h in held) == BLOCK:
                    yield told()
                    held = []
        if held:
            yield told()

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(cut, SCHEMA)


_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("data", pa.binary()), ("sizes", pa.binary()), ("at", pa.binary()), ("keys", pa.binary()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def _rows(columns: dict[str, list | pa.Array]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    given = [columns.get(f.name, [None] * n) for f in _ARROW]
    return pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(given, _ARROW)], names=_ARROW.names)


def _data(batch: pa.RecordBatch, row: int, dim: int) -> tuple[np.ndarray, int]:
    raw, n = batch.column("data")[row].as_buffer(), len(batch.column("ids")[row])
    return np.frombuffer(raw, np.int16 if raw.size == 2 * n * dim else np.int32).reshape(n, dim), n


def _margin(x: np.ndarray, entries: np.ndarray) -> float:
    """More than what rounding of square roots and sums can add up to."""
    return 1e-12 * (1.0 + max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))) * float(np.sqrt(entries.shape[2]))


def _round(table: DataFrame, books: Codebooks) -> DataFrame:
    """Each partition with its heaps after this round's assignment, then the changes of sums that the task has seen."""
    parts, k, width = books.entries.shape
    held = table.sparkSession.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, drift = held.value.entries, held.value.drift
        sums, counts = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                x, n = _data(batch, row, parts * width)
                margin, state = _margin(x, entries), []
                known = batch.column("sizes")[row].is_valid
                if known:
                    sizes = np.frombuffer(batch.column("sizes")[row].as_buffer(), np.int32).reshape(parts, k).astype(np.int64)
                    at = np.frombuffer(batch.column("at")[row].as_buffer(), np.int16).reshape(parts, n).astype(np.int64)
                    keys = np.frombuffer(batch.column("keys")[row].as_buffer()).reshape(parts, n)
                for q in range(parts):
                    part = x[:, q * width : (q + 1) * width]
                    if known:
                        heaps, rows, old, best = Heaps(sizes[q], at[q], keys[q]).advance(part, entries[q], drift[q], margin)
                        moved = old != best
                        rows, old, best = rows[moved], old[moved], best[moved]
                        np.subtract.at(sums, q * k + old, part[rows].astype(np.int64))
                        np.subtract.at(counts, q * k + old, 1)
                    else:
                        best, slack = nearest(part, entries[q])
                        heaps, rows = Heaps.of(best, slack + drift[q][best], k), np.arange(n)
                    np.add.at(sums, q * k + best, part[rows].astype(np.int64))
                    np.add.at(counts, q * k + best, 1)
                    state.append(heaps)
                told = {name: [np.concatenate([getattr(h, name) for h in state]).astype(kind).tobytes()] for name, kind in (("sizes", np.int32), ("at", np.int16), ("keys", float))}
                yield _rows({name: batch.column(name).slice(row, 1) for name in ("ids", "labels", "data")} | told)
        changed = np.flatnonzero((counts != 0) | sums.any(1))
        yield _rows({"entry": changed.tolist(), "n": counts[changed].tolist(), "sums": sums[changed].tolist()})

    return table.select("ids", "labels", "data", "sizes", "at", "keys").mapInArrow(assign, SCHEMA)


def _coded(table: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id, label, code, error`` of each vector: the last assignment, by the heaps."""
    parts, k, width = books.entries.shape
    held = table.sparkSession.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, drift = held.value.entries, held.value.drift
        for batch in batches:
            for row in range(batch.num_rows):
                x, n = _data(batch, row, parts * width)
                margin, best, error = _margin(x, entries), np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
                sizes = np.frombuffer(batch.column("sizes")[row].as_buffer(), np.int32).reshape(parts, k).astype(np.int64)
                at = np.frombuffer(batch.column("at")[row].as_buffer(), np.int16).reshape(parts, n).astype(np.int64)
                keys = np.frombuffer(batch.column("keys")[row].as_buffer()).reshape(parts, n)
                for q in range(parts):
                    part = x[:, q * width : (q + 1) * width]
                    own = Heaps(sizes[q], at[q], keys[q]).advance(part, entries[q], drift[q], margin)[0].assigned()
                    best[:, q] = own
                    error += ((part - entries[q][own]) ** 2).sum(1)
                text = best.tobytes().hex()
                codes = [text[a : a + 2 * parts] for a in range(0, len(text), 2 * parts)]
                yield pa.record_batch([batch.column("ids")[row].values, batch.column("labels")[row].values, pa.array(codes), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return table.select("ids", "labels", "data", "sizes", "at", "keys").mapInArrow(code, "vec_id long, label long, code string, error long")


def _drifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How far each entry moved, and the farthest any other one of its codebook did."""
    moved = np.sqrt(((after - before).astype(float) ** 2).sum(2))
    if moved.shape[1] == 1:
        return moved
    order = np.sort(moved, 1)
    others = np.where(np.arange(moved.shape[1]) == moved.argmax(1)[:, None], order[:, -2:-1], order[:, -1:])
    return moved + others


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of each kept vector."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part: 1 to 256 entries")
    spark, vector = df.sparkSession, F.col(vector_col)
    fine = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ordered = [F.col(id_col).alias("id"), vector.cast("array<double>").alias("v")]
    first = df.where(fine & F.col(id_col).isNotNull()).select(ordered).orderBy("id", "v").limit(entries).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    dim = len(first[0]["v"])
    if dim % parts or any(len(r["v"]) != dim for r in first):
        raise ValueError(f"vectors differ in length or can't be cut into {parts} equal parts")
    begin = np.floor(np.array([r["v"] for r in first]) * scale)
    if np.abs(begin).max() >= _largest(dim // parts, 62):
        raise ArithmeticError("components are too large for distances of 63 bits")
    centres = begin.astype(np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2)
    books = Codebooks(centres, np.zeros(centres.shape[:2]))
    sums, counts = np.zeros((centres.shape[0] * centres.shape[1], centres.shape[2]), np.int64), np.zeros(centres.shape[0] * centres.shape[1], np.int64)

    tables = Tables(spark, "codes")
    table, last = tables.write(_blocks(df, id_col, vector_col, label_col, dim, scale, parts), "blocks"), "blocks"
    for k in range(rounds):
        told = tables.write(_round(table.where("entry is null"), books), f"round-{k}")
        tables.delete(last)
        table, last = told, f"round-{k}"
        changes = told.where("entry is not null").groupBy("entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", j)).alias(f"s{j}") for j in range(centres.shape[2])])
        for r in changes.collect():  # a row for each entry
            counts[r["entry"]] += r["n"]
            sums[r["entry"]] += np.array(r[2:], np.int64)
        means = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], books.entries.reshape(sums.shape)).reshape(centres.shape)
        books = Codebooks(means, books.drift + _drifts(books.entries, means))
    coded = tables.write(_coded(table.where("entry is null"), books), "coded")
    tables.delete(last)
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, coded["label"].eqNullSafe(by_label["of"])).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """SQL for DuckDB: Lloyd's rounds, each part against every entry."""
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"a{k} AS MATERIALIZED (SELECT r, part, arg_min(e, (d, e)) AS e, CAST(min(d) AS BIGINT) AS d FROM (SELECT r, p.part, e, list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v) AS d FROM p JOIN c{k} c ON p.part = c.part) GROUP BY r, part)"
        )
        if k < rounds:
            steps.append(
                f"m{k} AS (SELECT part, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY pos) AS v FROM (SELECT p.part, a.e, pos, CAST(sum(p.v[pos]) AS BIGINT) AS s, count(*) AS n FROM p JOIN a{k} a ON p.r = a.r AND p.part = a.part CROSS JOIN (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM p))) AS pos) GROUP BY p.part, a.e, pos) GROUP BY part, e), "
                f"c{k + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m ON m.part = c.part AND m.e = c.e)"
            )
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v FROM embeddings
              WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) AS t(part)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS e, v FROM p WHERE r <= {entries}),
{", ".join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, e, pos)) FROM (SELECT part, e, unnest(v) AS x, unnest(range(len(v))) AS pos FROM c{rounds})) AS codebooks_sha256
FROM coded JOIN kept USING (r)
"""
