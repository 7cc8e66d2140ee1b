"""Codes against Lloyd's rounds in plain integers, the SQL, and heaps against full scans."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from matloom.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, n long"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = [[v[q * width : (q + 1) * width] for q in range(parts)] for _, v, _ in kept]
    first = sorted((k for k in range(len(kept)) if kept[k][0] is not None), key=lambda k: kept[k][:2])[:entries]
    books = [[cut[k][q] for k in first] for q in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(books[q])), key=lambda e: (far(v[q], books[q][e]), e)) for q in range(parts)] for v in cut]
    for _ in range(rounds):
        at = assign()
        for q in range(parts):
            for e in range(len(books[q])):
                own = [v[q] for v, a in zip(cut, at) if a[q] == e]
                if own:
                    books[q][e] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    error = [sum(far(v[q], books[q][a[q]]) for q in range(parts)) for v, a in zip(cut, at)]
    by = {}
    for (_, _, label), e in zip(kept, error):
        by[label] = by.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for e in a), e, by[label], sha) for (i, _, label), a, e in zip(kept, at, error)), key=str)


def check(spark, rows, **options):
    got = vector_codes.vector_codes(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3), **options)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows], **options)


def test_against_plain_integers(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 37)
    draw = random.Random(3)
    rows = [(k, [draw.choice((-1, 1, 0)) * draw.randrange(9) / 1024 + draw.random() / 4096 for _ in range(8)], draw.choice((None, 1, 2))) for k in range(300)]
    check(spark, rows, entries=16)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25, 1.0, 2.0], None), (2, None, 1), (3, [nan, 0.0, 0.0, 0.0], 1), (4, [inf, 0.0, 0.0, 0.0], 1), (5, [None, 0.0, 0.0, 0.0], 1), (6, [], 1), (7, [-0.0001, 0.0, 0.0, 0.0], 2), (7, [-0.0001, 0.0, 0.0, 0.0], 2), (7, [-3.0, 0.0, 0.0, 0.0], None), (None, [9.0, 9.0, 9.0, 9.0], 2)]
    check(spark, rows)
    check(spark, rows, entries=1)


def test_large_components_stay_exact(spark):
    check(spark, [(k, [k * 20000.0 + 0.001, -k * 1000.0, 5.0, 200000.0 + k], k % 2) for k in range(40)], entries=8)


def test_nothing_is_kept(spark):
    for rows in ([], [(1, None, 1, "x", 1), (2, [float("nan")] * 4, 1, "x", 1)]):
        assert vector_codes.vector_codes(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_ragged_vectors_and_huge_components_are_errors(spark):
    with pytest.raises(ValueError, match="length"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1.0] * 4, 1, "x", 1), (2, [1.0] * 8, 1, "x", 1)], SCHEMA))
    with pytest.raises(ArithmeticError):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1e30] * 4, 1, "x", 1)], SCHEMA))


def test_heaps_pop_few_and_miss_none():
    draw = np.random.default_rng(5)
    x, c = draw.integers(-500, 500, (4000, 16)), draw.integers(-500, 500, (64, 16))
    best, slack = vector_codes.nearest(x, c)
    heaps, drift, popped = vector_codes.Heaps.of(best, slack, 64), np.zeros((1, 64)), []
    for size in (40, 10, 3, 1, 0):
        moved = c + draw.integers(-size, size + 1, c.shape)
        drift, c = drift + vector_codes._drifts(c[None], moved[None]), moved
        heaps, rows, old, new = heaps.advance(x, c, drift[0], 1e-6)
        popped.append(len(rows))
        assert (heaps.assigned() == vector_codes.nearest(x, c)[0]).all() and heaps.sizes.sum() == 4000
    assert popped[-1] == 0 < popped[-2] < popped[0]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_sql(spark, sf):
    path = f"/root/testdata/sf{sf}/embeddings.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    got = vector_codes.vector_codes(spark.read.parquet(path))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({vector_codes.oracle()})").fetchall())
