"""Packing: documents' tokens into sequences of a fixed window, by non-negative least squares over length patterns.

Method: each document's ids (and its end id) are cut into whole windows and one remainder. The remainders' lengths
are counted; combinations of up to three lengths that fill a window are listed, and their repeat counts solve a
non-negative least-squares problem against the histogram. Counts are rounded down and the residual pieces are packed
greedily, longest first. Histogram and plan are bounded by the window, never by the input: only they meet on the
driver. A piece then finds its sequence by its rank among the pieces of its length.

Defined cases: a null or empty text is one piece of one token, the end id; a null or repeated doc_id is packed like
any other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matloom.llm.common import durable, texts_for_python
from matloom.llm.token_cache import default_path, id_bytes

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Lengths are binned upwards by so many tokens when combinations are listed.
GRAIN = 8


def pieces_of(df: DataFrame, id_col: str, text_col: str, *, window: int, end_id: int, tokenizer: str) -> DataFrame:
    """Whole windows and a remainder of each document."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, ids in zip(frame["doc_id"].tolist(), id_bytes(tokenizer, frame["text"].tolist())):
                ids += end
                total = len(ids) // 4
                rows += [(doc_id, at, min(window, total - at), zlib.crc32(ids[4 * at : 4 * (at + window)]), total) for at in range(0, total, window)]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return texts_for_python(df).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(cut, PIECES)


def combinations(bins: np.ndarray, filled: int) -> np.ndarray:
    """Rows of up to three of ``bins`` (0: none) that add up to ``filled``, in ascending order."""
    there = np.zeros(filled + 1, bool)
    there[bins] = True
    found = [(0, 0, filled)] if there[filled] else []
    found += [(0, a, filled - a) for a in bins if 2 * a <= filled and there[filled - a]]
    for a in bins:
        second = bins[(bins >= a) & (2 * bins <= filled - a)]
        found += [(a, b, filled - a - b) for b in second if there[filled - a - b]]
    return np.array(found, int).reshape(-1, 3)


def nonnegative_least_squares(slots: np.ndarray, h: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |a x - h|, by an active set of columns. A column of ``a`` counts the rows that a row of
    ``slots`` names (-1: none); only active columns, never more than rows, are written out."""

    def columns(at: np.ndarray) -> np.ndarray:
        a = np.zeros((len(h) + 1, len(at)))
        np.add.at(a, (slots[at], np.arange(len(at))[:, None]), 1)
        return a[:-1]

    x, active = np.zeros(len(slots)), np.zeros(len(slots), bool)
    left = np.append(h, 0.0)
    least = 1e-9 * (1 + np.abs(h).max(initial=0))
    for _ in range(3 * len(h) + 10):
        gain = left[slots].sum(1)
        gain[active] = -np.inf
        enters = int(np.argmax(gain)) if len(gain) else 0
        if not len(gain) or gain[enters] <= least:
            break
        active[enters] = True
        while True:
            at = np.flatnonzero(active)
            best = np.linalg.lstsq(columns(at), h, rcond=None)[0]
            if (best > 1e-12).all():
                x[:] = 0
                x[at] = best
                break
            low = best <= 1e-12
            step = np.min(x[at][low] / np.maximum(x[at][low] - best[low], 1e-300))
            x[at] += step * (best - x[at])
            gone = at[(x[at] <= 1e-12) & low]
            if not len(gone):
                gone = at[low]
            x[gone], active[gone] = 0, False
        at = np.flatnonzero(active)
        left[:-1] = h - columns(at) @ x[at]
    return x


def plan_patterns(histogram: dict[int, int], window: int, grain: int = GRAIN) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, uses), ...], repeats) that hold every piece of ``histogram`` exactly once."""
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    patterns: list[tuple[list[tuple[int, int]], int]] = []
    if left[window]:
        patterns.append(([(window, 1)], int(left[window])))
        left[window] = 0
    bins = np.add.reduceat(left[1:], np.arange(0, window, grain))
    per = window // grain  # lengths beyond the last whole bin are left to the residual
    listed = combinations(np.flatnonzero(bins[:per]) + 1, per) if per else np.zeros((0, 3), int)
    if len(listed):
        used = np.unique(listed[listed > 0])
        row = np.full(per + 1, -1)
        row[used] = np.arange(len(used))
        repeats = np.floor(nonnegative_least_squares(row[listed], bins[used - 1].astype(float)) + 1e-6).astype(np.int64)
        for k in np.argsort(-repeats, kind="stable"):
            slots, todo = [int(b) for b in listed[k] if b > 0], int(repeats[k])
            while todo > 0:
                chosen: dict[int, int] = {}
                for b in slots:
                    inside = range((b - 1) * grain + 1, b * grain + 1)
                    length = next((m for m in reversed(inside) if left[m] > chosen.get(m, 0)), None)
                    if length is None:
                        todo = 0
                        break
                    chosen[length] = chosen.get(length, 0) + 1
                if not todo:
                    break
                times = min([todo, *(int(left[m]) // u for m, u in chosen.items())])
                for m, u in chosen.items():
                    left[m] -= times * u
                patterns.append((sorted(chosen.items(), reverse=True), times))
                todo -= times
    while left.any():  # the residual: longest first, then the longest that still fits
        room, chosen, length = window, {}, window
        while True:
            at = np.flatnonzero(left[1 : min(room, length) + 1]) + 1
            if not len(at):
                break
            length = int(at[-1])
            chosen[length] = min(room // length, int(left[length]))
            room -= length * chosen[length]
            length -= 1
        times = min(int(left[m]) // u for m, u in chosen.items())
        for m, u in chosen.items():
            left[m] -= times * u
        patterns.append((list(chosen.items()), times))
    return patterns


def plan_rows(patterns: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, ...]]:
    """(length, first rank, number of ranks, first sequence, uses in a sequence, first offset, tokens of the sequence)."""
    rows, ranks, sequence = [], {}, 0
    for slots, times in patterns:
        offset, total = 0, sum(m * u for m, u in slots)
        for length, uses in slots:
            first = ranks.get(length, 0)
            rows.append((length, first, first + uses * times, sequence, uses, offset, total))
            ranks[length] = first + uses * times
            offset += length * uses
        sequence += times
    return rows


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """``rank`` of each piece among those of its length, from 0. A length may hold any share of the rows, so
    rows are numbered in hashed parts of at most some hundred thousand, which are then shifted by what is before them."""
    parts = max(256, total // 200_000)
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    numbered = pieces.withColumn("own", F.row_number().over(own) - 1)
    return numbered.join(shifts, ["length", "part"]).withColumn("rank", F.col("own") + F.col("shift")).drop("own", "shift", "part")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 2048, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padded_to`` per piece."""
    spark = df.sparkSession
    pieces = durable(pieces_of(df, id_col, text_col, window=window, end_id=end_id, tokenizer=tokenizer or default_path("byte_bpe_50k.json")), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `window` rows
    rows = plan_rows(plan_patterns(histogram, window))
    columns = "length long, first long, upto long, sequence long, uses long, at long, sequence_tokens long"
    plan = spark.createDataFrame(rows, columns)  # bounded by the window: a few rows for each length
    found = ranked(pieces, sum(histogram.values())).join(F.broadcast(plan), "length").where("rank >= first and rank < upto")
    within = F.col("rank") - F.col("first")
    power = F.col("sequence_tokens").bitwiseAND(F.col("sequence_tokens") - 1) == 0
    return found.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(within / F.col("uses"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.col("length") * (within % F.col("uses"))).cast("long").alias("offset"),
        "sequence_tokens",
        F.when(power, F.col("sequence_tokens")).otherwise(F.lit(window)).cast("long").alias("padded_to"),
    )
