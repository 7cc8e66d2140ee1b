"""Results that are far larger than what they are made of: fields of blocks, rows in pieces, p values in their tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matloom.functions import options, student
from matloom.matrix import Matrix
from matloom.operators import batch, blocks, correlation, elementwise, products


def cells(spark, a):
    return Matrix.from_coo(spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*a.nonzero())], "i long, j int, v double"), *a.shape)


def test_closed_p_values_are_those_of_the_continued_fraction():
    r = np.concatenate([np.linspace(-1, 1, 101), [np.nan, 0.9999999]])
    for n in (2, 3, 4, 7, 8, 50, 102, 103):
        found, wanted = student.correlation_p_values(r, float(n)), student.correlation_p_values(r, np.full(len(r), float(n)))
        np.testing.assert_allclose(found, wanted, rtol=1e-8, atol=1e-13)
    assert student.closed_p_values(np.array([0.5]), 5)[0] == pytest.approx(0.25317, abs=1e-5)


@pytest.mark.parametrize("field", [1, 2, 3])
@pytest.mark.parametrize("splits", [1, 2])
def test_fields_of_blocks(spark, field, splits, monkeypatch):
    monkeypatch.setattr(products, "field_side", lambda *_: field)
    monkeypatch.setattr(correlation, "field_side", lambda *_: field)
    draw = np.random.default_rng(4)
    x, y = draw.standard_normal((23, 5)), draw.standard_normal((17, 5))
    x[3], x[11:15] = 0, 0  # absent cells, and a block without any
    found = products.matmul(cells(spark, x), cells(spark, y), transpose_b=True, strategy="block", side=4, splits=splits)
    assert found.df.groupBy("i", "j").count().where("count > 1").isEmpty()
    np.testing.assert_allclose(found.to_numpy(), x @ y.T, atol=1e-12)
    wide = draw.standard_normal((9, 22))
    m = Matrix.from_numpy(spark, wide)
    gram = products.crossprod(m, tile=4)
    assert gram.df.count() == 22 * 22
    np.testing.assert_allclose(gram.to_numpy(), wide.T @ wide, atol=1e-12)
    r = correlation.cor(m, tile=4)
    assert r.cells.count() == 22 * 22
    np.testing.assert_allclose(r.matrix().to_numpy(), np.corrcoef(wide.T), atol=1e-12)


def test_blocks_with_a_short_inner_index_are_not_sent_to_each_other(spark):
    # 500 x 500 blocks of 24 rows: one by one, each block would be sent 500 times
    field = products.field_side(spark, 4000, 4000, 24, 64, 1)
    assert field * 24 > 4000 and field * 24 <= 1 << 13
    assert products.field_side(spark, 40, 40, 512, 1_000_000, 31) == 1  # a long one: a task holds one pair of blocks
    sent = products.work_tasks(spark, 1 << 40)
    assert sent >= 1 << 14


def test_broadcast_products_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(products, "AT_ONCE", 40)
    x = np.arange(60, dtype=float).reshape(20, 3)
    found = products.matmul(Matrix.from_numpy(spark, x), Matrix.from_numpy(spark, x.T.copy()), strategy="broadcast")
    np.testing.assert_allclose(found.to_numpy(), x @ x.T)


def test_absent_cells_are_filled_without_a_shuffled_grid(spark):
    a = np.zeros((7, 50))
    a[2, 3], a[2, 49], a[6, 0], a[0, 1] = 1.5, np.nan, -2, 4
    m = cells(spark, a)
    np.testing.assert_array_equal(m.to_rows().to_numpy(), a)
    every = m.every_cell()
    assert every.df.count() == 350
    np.testing.assert_array_equal(every.to_numpy(), a)
    plan = every.df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    stats = spark.createDataFrame([(k, float(k)) for k in range(50)], "k long, w double")
    np.testing.assert_allclose(elementwise.sweep(m, stats, 2, "-").to_numpy(), a - np.arange(50.0))
    np.testing.assert_allclose(elementwise.sweep(m.to_rows(), stats, 2, "-").to_numpy(), a - np.arange(50.0))
    outside = Matrix(m.df.union(m.df.sparkSession.createDataFrame([(3, -1, 1.0), (3, 50, 1.0), (-1, 2, 1.0), (7, 2, 1.0)], m.df.schema)), 7, 50, "coo")
    np.testing.assert_array_equal(outside.every_cell().to_numpy(), a)  # cells outside of the shape are no cells, as in the grid
    twice = Matrix(m.df.union(m.df.where(F.col("i") == 6)), 7, 50, "coo")
    with pytest.raises(Exception, match="stored twice"):
        twice.to_rows().to_numpy()


def test_cells_that_a_statistic_makes_of_zero_are_written_in_runs(spark, tmp_path):
    rng = np.random.default_rng(8)
    a = rng.integers(1, 50, (600, 5000)) * (rng.random((600, 5000)) < 0.0005).astype(float)
    m, stats = cells(spark, a), spark.createDataFrame([(k, k / 7) for k in range(5000)], "k long, w double")
    found = elementwise.sweep(m, stats, 2, "-", finish=lambda v: F.round(v, 3))
    found.df.write.parquet(str(tmp_path / "cells"))
    np.testing.assert_allclose(Matrix(spark.read.parquet(str(tmp_path / "cells")), *a.shape, "coo").to_numpy(), np.round(a - np.arange(5000) / 7, 3), atol=1e-9)
    assert sum(f.stat().st_size for f in (tmp_path / "cells").glob("*.parquet")) < 0.5 * a.size  # bytes


@pytest.mark.parametrize("margin", [1, 2])
@pytest.mark.parametrize("at_once,rows", [(1 << 20, 512), (12, 3), (1, 1)])
def test_tiles_of_filled_cells(spark, margin, at_once, rows, monkeypatch):
    from matloom import matrix

    monkeypatch.setattr(matrix, "AT_ONCE", at_once)
    monkeypatch.setattr(matrix, "TILE_ROWS", rows)
    a = np.zeros((7, 11))
    a[2, 3], a[2, 10], a[6, 0], a[0, 1], a[5, 5] = 1.5, np.nan, -2, 4, 7
    m, n = cells(spark, a), a.shape[margin - 1] if margin == 1 else 11
    np.testing.assert_array_equal(m.every_cell().to_numpy(), a)
    w = {k: float(k) for k in range(n) if k not in (0, 4)} | {3: None, 2: np.nan}  # no statistic, null and NaN
    found = elementwise.sweep(m, spark.createDataFrame(list(w.items()) + [(-1, 1.0), (n, 1.0)], "k long, w double"), margin, "-")
    got = {(r["i"], r["j"]): r["v"] for r in found.df.collect()}
    wanted = {(i, j): w[(i, j)[margin - 1]] for i in range(7) for j in range(11) if (i, j)[margin - 1] in w}
    assert found.df.count() == len(got) and got.keys() == wanted.keys()
    for (i, j), s in wanted.items():
        assert got[i, j] is None if s is None else got[i, j] == pytest.approx(a[i, j] - s, nan_ok=True)
    two = Matrix(m.df.union(m.df.where(F.col("i") == 6)), 7, 11, "coo")
    with pytest.raises(Exception, match="stored twice"):
        two.every_cell().to_numpy()
    with pytest.raises(Exception, match="given twice"):
        elementwise.sweep(m, spark.createDataFrame([(1, 1.0), (1, 2.0)], "k long, w double"), margin, "+").df.collect()
    for op, none in (("/", np.nan), ("pow", 1.0)):
        ratio = elementwise.binary(m, cells(spark, a * 2), op)
        assert ratio.df.count() == 77
        np.testing.assert_allclose(ratio.to_numpy()[a == 0], none)


@pytest.mark.parametrize("strategy,most", [("tiles", 30), ("cells", 9), ("auto", None)])
@pytest.mark.parametrize("parts", [1, 3])
def test_sparse_products_add_up_in_blocks_of_the_result(spark, strategy, most, parts, monkeypatch):
    for name, value in (("GRID", 8), ("FULL", 40), ("AT_ONCE", 25), ("TILE_PAYS", 1), ("GRID_CELLS", 1 << 23 if parts == 1 else 60)):
        monkeypatch.setattr(products, name, value)
    rng = np.random.default_rng(3)
    x, y = (rng.integers(-3, 4, (23, 31)) * (rng.random((23, 31)) < 0.6)).astype(float), (rng.integers(-3, 4, (31, 17)) * (rng.random((31, 17)) < 0.6)).astype(float)
    x[:, 7], x[3, 2] = 2.0, np.nan
    called = []
    grid = products._by_grid
    monkeypatch.setattr(products, "_by_grid", lambda *a: called.append(grid(*a)) or called[-1])
    found = products.multiply_sparse(cells(spark, x), cells(spark, y), strategy=strategy, side=4, most=most)
    assert len(called) == 1 and called[0] is not None  # products don't leave their tasks one by one
    assert found.df.groupBy("i", "j").count().where("count > 1").isEmpty()
    with np.errstate(invalid="ignore"):
        wanted = np.array([[sum(x[i, k] * y[k, j] for k in range(31) if x[i, k] != 0 and y[k, j] != 0) for j in range(17)] for i in range(23)])
    np.testing.assert_allclose(found.to_numpy(), wanted)
    reached = ((x != 0).astype(int) @ (y != 0).astype(int)) > 0
    assert found.df.count() == reached.sum()


def test_products_of_datasets_in_fields(spark, monkeypatch):
    for name, value in (("HELD", 12), ("AT_ONCE", 10)):
        monkeypatch.setattr(batch, name, value)
    draw = np.random.default_rng(5)
    x = {"a": draw.standard_normal((23, 4)), "b": draw.standard_normal((3, 4))}
    found = batch.apply_function({k: Matrix.from_numpy(spark, v) for k, v in x.items()}, "tCrossProd")
    got = {k: np.zeros((len(v), len(v))) for k, v in x.items()}
    for r in found.collect():
        got[r["dataset"]][r["i"], r["j"]] += r["v"]
    for k, v in x.items():
        np.testing.assert_allclose(got[k], v @ v.T, atol=1e-12)
    monkeypatch.setattr(options, "TASK_CELLS", 50)  # tasks follow the cells that are made, not the bytes that are read
    many = batch.apply_function({k: Matrix.from_numpy(spark, v) for k, v in x.items()}, "tCrossProd")
    assert many.rdd.getNumPartitions() >= 538 // 50


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_rows_come_to_projections_without_their_factors(spark, few, monkeypatch):
    monkeypatch.setattr(batch, "SMALL", few)
    monkeypatch.setattr(batch, "PART", 8)
    draw = np.random.default_rng(6)
    x = {f"d{k}": draw.standard_normal((n, p)) for k, (n, p) in enumerate([(50, 3), (9, 4), (30, 1), (40, 12)])}
    rows = spark.createDataFrame([(k, i, r.tolist(), len(a)) for k, a in x.items() for i, r in enumerate(a)], "dataset string, i long, vec array<double>, nrow long")
    upper = {k: np.linalg.qr(a, mode="r") for k, a in x.items() if k != "d2"}  # rows of a dataset without a factor stay out
    factors = spark.createDataFrame([(k, r.shape[1], bytearray(r.tobytes())) for k, r in upper.items()], "dataset string, p int, r binary")
    sent = []
    frames = type(rows).mapInPandas
    monkeypatch.setattr(type(rows), "mapInPandas", lambda df, f, schema: sent.append(df) or frames(df, f, schema))
    found = {(r["dataset"], r["i"]): r["vec"] for r in batch._projected(rows, factors).collect()}
    assert found.keys() == {(k, i) for k in upper for i in range(len(x[k]))}
    for (k, i), vec in found.items():
        np.testing.assert_allclose(np.array(vec) @ upper[k], x[k][i], atol=1e-12)
    copies = sent[0].where("r is not null").count() if "r" in sent[0].columns else 0
    assert copies == (0 if few else 7 + 2 + 4)  # one for each 8 rows, or 12 of 12 columns, instead of one for each row
    monkeypatch.undo()


def test_cholesky_of_a_band_takes_few_steps(spark, monkeypatch):
    assert blocks._panels({(k, k) for k in range(40)} | {(k + 1, k) for k in range(39)}, 40, 8) == [(k, k + 4) for k in range(0, 40, 4)]
    full = {(i, j) for i in range(5) for j in range(i + 1)}
    assert blocks._panels(full, 5, 4) == [(0, 1), (1, 2), (2, 3), (3, 5)]
    steps = []
    append = blocks._Grid.append
    monkeypatch.setattr(blocks._Grid, "append", lambda self, df: (steps.append(1), append(self, df))[1])
    a = np.diag(np.arange(40) % 3 + 4.0) + np.eye(40, k=1) + np.eye(40, k=-1)
    a[30, 2] = a[2, 30] = 0.5  # fills in
    for most in (6, 10, 1000):
        monkeypatch.setattr(blocks, "PANEL", most * 16)
        steps.clear()
        u = blocks.chol_blocks(cells(spark, a), side=4)
        np.testing.assert_allclose(u.to_numpy(), np.linalg.cholesky(a).T, atol=1e-12)
        assert u.df.where("v = 0").isEmpty() and len(steps) <= {6: 6, 10: 3, 1000: 1}[most]
    a[25, 25] = -4
    with pytest.raises(np.linalg.LinAlgError):
        blocks.chol_blocks(cells(spark, a), side=4)


@pytest.mark.parametrize("field, splits", [(1, 3), (3, 1)])
def test_rows_and_columns_of_blocks_keep_their_numbers(spark, field, splits, monkeypatch):
    monkeypatch.setattr(products, "field_side", lambda *_: field)
    monkeypatch.setattr(products, "ORDERED", 0, raising=False)
    draw = np.random.default_rng(5)
    x, y = draw.integers(0, 2, (23, 10)).astype(float), draw.standard_normal((3, 10))[draw.integers(0, 3, 18)]
    x[3], x[20], y[7], y[9, 2] = 0, 0, 0, np.nan  # rows without cells
    for left, right in ((cells(spark, x), cells(spark, y)), (Matrix.from_numpy(spark, x), Matrix.from_numpy(spark, y))):
        found = products.matmul(left, right, transpose_b=True, strategy="block", side=4, splits=splits)
        assert found.df.groupBy("i", "j").count().where("count > 1").isEmpty()
        np.testing.assert_allclose(np.nan_to_num(found.to_numpy()[:, np.arange(18) != 9]), (x @ y.T)[:, np.arange(18) != 9], atol=1e-12)
        assert np.isnan(found.to_numpy()[0, 9])
    for left, right in ((cells(spark, x.T), cells(spark, x.T)), (Matrix.from_numpy(spark, x.T), Matrix.from_numpy(spark, x.T))):
        found = products.matmul(left, right, transpose_a=True, strategy="block", side=4, splits=splits)
        np.testing.assert_allclose(found.to_numpy(), x @ x.T)


def test_repeated_rows_take_few_written_bytes(spark, tmp_path):
    # 300 rows, seven times each, in no order: a cell for each pair
    draw = np.random.default_rng(6)
    x = draw.integers(1, 4000, (300, 7)).astype(float)[draw.permutation(2100) % 300]
    m = cells(spark, x)
    products.matmul(m, m.t(), strategy="block").df.write.parquet(str(tmp_path / "out"))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == 2100 * 2100
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 2100 * 2100
    wanted = x @ x.T
    got = np.zeros_like(wanted)
    table = written.toPandas()
    got[table["i"], table["j"]] = table["v"]
    np.testing.assert_array_equal(got, wanted)


def test_cholesky_of_few_cells_keeps_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PANEL", 1 << 14, raising=False)
    n, draw = 1500, np.random.default_rng(7)
    a = np.diag(draw.uniform(4, 6, n)) + np.eye(n, k=1) + np.eye(n, k=-1)
    a[1200, 3] = a[3, 1200] = 0.5  # fills in
    finished = []
    read = blocks._Grid.read
    monkeypatch.setattr(blocks._Grid, "read", lambda self: finished.append(read(self)) or finished[-1])
    u = blocks.chol_blocks(cells(spark, a))
    np.testing.assert_allclose(u.to_numpy(), np.linalg.cholesky(a).T, atol=1e-12)
    held = finished[-1].selectExpr("sum(cast(nr as long) * nc)").first()[0]
    assert held < 100 * n  # blocks of 512 rows had more than 700 cells for each row
    every = spark.range(1 << 20).selectExpr("id div 1024 as i", "cast(id % 1024 as int) as j")
    for whole in (every, every.where("i = j or i = 0 or j = 0")):  # smaller blocks hold as many cells, those of the second one by fill-in
        assert blocks._fitting_side(whole, 1024) == 512
    bad = a.copy()
    bad[700, 700] = -4
    with pytest.raises(np.linalg.LinAlgError):
        blocks.chol_blocks(cells(spark, bad))


@pytest.mark.parametrize("ties", ["ordinal", "average"])
@pytest.mark.parametrize("tile", [None, 4])
def test_ranks_of_absent_cells_are_not_sent(spark, ties, tile, monkeypatch):
    monkeypatch.setattr(correlation, "RANK_ROWS", 10, raising=False)
    draw = np.random.default_rng(9)
    a = draw.integers(-3, 4, (47, 11)) * (draw.random((47, 11)) < 0.2).astype(float)
    a[:, 6], a[25:35, 1:5], a[:, 9] = 0, 0, draw.integers(1, 5, 47)  # a column and pieces without cells, one without zeros
    sent = []
    write = correlation.with_position
    monkeypatch.setattr(correlation, "with_position", lambda df, *rest: sent.append(df.count()) or write(df, *rest))
    outside = spark.createDataFrame([(-1, 2, 5.0), (47, 2, 5.0), (3, -1, 5.0), (3, 11, 5.0)], "i long, j int, v double")
    m = Matrix(cells(spark, a).df.union(outside), *a.shape, "coo")
    found = correlation.cor(m, method="spearman", ties=ties, tile=tile)
    order = np.argsort(np.argsort(a, axis=0, kind="stable"), axis=0) + 1.0
    if ties == "average":
        order = np.array([[order[a[:, j] == a[i, j], j].mean() for j in range(11)] for i in range(47)])
    with np.errstate(invalid="ignore"):
        wanted = np.corrcoef(order.T)
    if ties == "average":
        wanted[6], wanted[:, 6] = 0, 0  # no variance
        wanted[6, 6] = 1
    assert found.cells.count() == 121 and found.cells.where("n <> 47 or r is null").isEmpty()
    np.testing.assert_allclose(found.matrix().to_numpy(), wanted, atol=1e-12)
    p, q = (correlation.cor(c, method="spearman", ties=ties, tile=tile).p_values().to_numpy() for c in (m, Matrix.from_numpy(spark, a)))
    np.testing.assert_allclose(p, q, atol=1e-9)
    assert sent[0] == (a != 0).sum()  # zeros were sorted as well


@pytest.mark.parametrize("weighted", [False, True])
def test_long_rows_of_products_are_written_as_blocks(spark, tmp_path, weighted):
    draw = np.random.default_rng(6)
    x = draw.integers(1, 4000, (300, 7)).astype(float)[draw.permutation(2100) % 300]
    m = Matrix.from_numpy(spark, x)
    weights = spark.createDataFrame([(k, k + 1.0) for k in range(7)], "k long, w double")
    (products.weighted_product(m, weights, "XwXt") if weighted else products.tcrossprod(m)).to_coo().df.write.parquet(str(tmp_path / "out"))
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 2100 * 2100
    table = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert len(table) == 2100 * 2100
    got = np.zeros((2100, 2100))
    got[table["i"], table["j"]] = table["v"]
    np.testing.assert_array_equal(got, (x * np.arange(1, 8)) @ x.T if weighted else x @ x.T)


def test_cells_of_sparse_factors_move_packed_instead_of_their_products(spark, monkeypatch):
    for name, value in (("GRID", 8), ("FULL", 40), ("AT_ONCE", 25), ("TILE_PAYS", 1)):
        monkeypatch.setattr(products, name, value)
    draw = np.random.default_rng(3)
    x = np.zeros((60, 200))
    for k in range(200):  # every tile of inner indexes reaches every block of the result
        x[draw.permutation(60)[:4], k] = draw.integers(1, 9, 4)
    made = []
    grid = products._by_grid
    monkeypatch.setattr(products, "_by_grid", lambda *a: made.append(grid(*a)) or made[-1])
    found = products.multiply_sparse(cells(spark, x), cells(spark, x.T), strategy="tiles", side=4)
    assert made[0] is not None and found.df.groupBy("i", "j").count().where("count > 1").isEmpty()
    np.testing.assert_array_equal(found.to_numpy(), x @ x.T)
    assert found.df.count() == ((x @ x.T) > 0).sum()


def test_rounded_products_are_written_as_numbers_of_values(spark, tmp_path):
    x = np.random.default_rng(2).standard_normal((2200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    m = Matrix.from_numpy(spark, x)
    found = products.matmul(m, m, transpose_b=True, strategy="block", side=24, rounded=True)
    found.df.withColumn("v", F.round("v", 4)).coalesce(1).write.parquet(str(tmp_path / "out"))
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 4.5 * 2200 * 2200  # bytes; more than 7 in the order of blocks
    table = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert len(table) == 2200 * 2200 and not table.duplicated(["i", "j"]).any()
    got = np.zeros((2200, 2200))
    got[table["i"], table["j"]] = table["v"]
    np.testing.assert_allclose(got, x @ x.T, atol=0.51e-4)


def test_rounded_products_of_datasets_are_written_as_numbers_of_values(spark, tmp_path):
    x = np.random.default_rng(2).standard_normal((2200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    cells = Matrix.from_numpy(spark, x).to_coo().df.select(F.lit("a").alias("dataset"), F.lit(0).alias("side"), "i", "j", "v")
    found = batch.apply_to_groups(cells, "tCrossProd", rounded=True)
    found.withColumn("v", F.round("v", 4)).coalesce(1).write.parquet(str(tmp_path / "out"))
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 5 * 2200 * 2200  # bytes; more than 7 otherwise
    table = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert len(table) == 2200 * 2200 and not table.duplicated(["i", "j"]).any()
    got = np.zeros((2200, 2200))
    got[table["i"], table["j"]] = table["v"]
    np.testing.assert_allclose(got, x @ x.T, atol=0.51e-4)
