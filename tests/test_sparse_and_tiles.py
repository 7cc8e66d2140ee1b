"""Cells that ``coo`` doesn't store are zeros, whatever the operator; tiles, splits and block factors against numpy."""

import numpy as np
import pytest

from matloom.matrix import Matrix
from matloom.operators import aggregates as ag
from matloom.operators import batch, blocks, correlation, elementwise, genotype, products


def sparse(spark, a):
    """Only cells that aren't zero."""
    cells = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero((a != 0) | np.isnan(a)))]
    return Matrix.from_coo(spark.createDataFrame(cells, "i long, j int, v double"), *a.shape)


@pytest.fixture(scope="module")
def a():
    draw = np.random.default_rng(4)
    found = draw.integers(-3, 4, (9, 5)).astype(float) * (draw.random((9, 5)) < 0.4)
    found[:, 2], found[4] = 0, 0
    return found


def column(spark, values):
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k long, w double")


def both(spark, a, f):
    """What f gives for the stored and for the dense form."""
    return [f(m) for m in (sparse(spark, a), Matrix.from_numpy(spark, a))]


@pytest.mark.parametrize("op", ["+", "-", "*", "/", "pow"])
@pytest.mark.parametrize("margin", [1, 2])
def test_sweep_and_vectors(spark, a, op, margin):
    stats = np.array([2.0, 1.0, 3.0, 0.0, 2.0] if margin == 2 else [2.0, 1, 3, 0, 2, 1, 1, 2, 4])
    for swapped in (False, True):
        got, wanted = both(spark, a, lambda m: elementwise.sweep(m, column(spark, stats), margin, op, swapped=swapped).to_numpy())
        np.testing.assert_allclose(got, wanted)
    vector = Matrix.from_numpy(spark, stats if margin == 1 else stats[None])
    if op != "pow":
        got, wanted = both(spark, a, lambda m: elementwise.binary(m, vector, op).to_numpy())
        np.testing.assert_allclose(got, wanted)


def test_zero_times_infinity(spark, a):
    got, wanted = both(spark, a, lambda m: elementwise.sweep(m, column(spark, [1.0, np.inf, 1.0, np.nan, 1.0]), 2, "*").to_numpy())
    np.testing.assert_allclose(got, wanted)


def test_products_keep_absent_cells_absent(spark, a):
    assert elementwise.sweep(sparse(spark, a), column(spark, [2.0] * 5), 2, "*").df.count() == np.count_nonzero(a)


def rows_of(frame):
    return sorted((tuple(-1e99 if x is None else 1e99 if isinstance(x, float) and np.isnan(x) else round(x, 9) for x in r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("na_rm", [False, True])
def test_aggregates(spark, a, na_rm):
    b = a.copy()
    if na_rm:
        b[0, 0], b[3, 2], b[8, :] = np.nan, np.nan, np.nan
    for f in (ag.col_stats, ag.row_stats, ag.total_stats):
        got, wanted = both(spark, b, lambda m: rows_of(f(m, list(ag.STATS), na_rm=na_rm)))
        assert got == wanted
    for by_rows in (False, True):
        got, wanted = both(spark, a, lambda m: elementwise.scale(m, by_rows=by_rows).to_numpy())
        np.testing.assert_allclose(got, wanted)


@pytest.mark.parametrize("ties", ["ordinal", "average"])
def test_ranks_and_correlations(spark, a, ties):
    got, wanted = both(spark, a, lambda m: correlation.ranks(m, ties).to_numpy())
    np.testing.assert_allclose(got, wanted)
    for method in ("pearson", "spearman"):
        got, wanted = both(spark, a, lambda m: correlation.cor(m, method=method, ties=ties).matrix().to_numpy())
        np.testing.assert_allclose(got, wanted)


def test_genotypes(spark):
    draw = np.random.default_rng(8)
    g = draw.choice([0, 1, 2, 3], (30, 7), p=[0.6, 0.2, 0.1, 0.1]).astype(float)
    g[:, 3], g[:, 5] = 0, 3
    for by_cols in (True, False):
        x = g if by_cols else g.T
        for f in (lambda m: genotype.filter_low_coverage(m, 0.12, by_cols), lambda m: genotype.filter_maf(m, 0.2, by_cols)):
            got, wanted = both(spark, x, lambda m: (lambda r: (r.removed, r.matrix.to_numpy().tolist()))(f(m)))
            assert got == wanted and got[0] > 0
        for strategy in ("mode", "mean", "random"):
            got, wanted = both(spark, x, lambda m: genotype.impute(m, by_cols, strategy=strategy).to_numpy())
            np.testing.assert_allclose(got, wanted)
        got, wanted = both(spark, x, lambda m: sorted(map(tuple, genotype.code_counts(m, by_cols).collect())))
        assert got == wanted


def test_products(spark, a):
    got, wanted = both(spark, a, lambda m: products.crossprod(m).to_numpy())
    np.testing.assert_allclose(got, wanted)
    got, wanted = both(spark, a, lambda m: products.tcrossprod(m).to_numpy())
    np.testing.assert_allclose(got, wanted)


@pytest.mark.parametrize("func", ["sdmean", "normalize", "CrossProd", "tCrossProd", "QR"])
def test_batch(spark, a, func):
    got, wanted = both(spark, a, lambda m: rows_of(batch.apply_function({"one": m}, func).select("result", "i", "j", "v").where("v <> 0 and not isnan(v)").selectExpr("length(result)", "i", "j", "v")))
    assert got == wanted and got


def shapes():
    draw = np.random.default_rng(2)
    arrow = np.diag(np.full(12, 20.0))
    arrow[0], arrow[:, 0] = 1.0, 1.0
    arrow[0, 0] = 20
    tri = np.diag(np.full(12, 4.0)) + np.diag(np.ones(11), 1) + np.diag(np.ones(11), -1)
    diagonal = np.zeros((12, 12))
    for k in (0, 4, 8):
        b = draw.standard_normal((4, 4))
        diagonal[k : k + 4, k : k + 4] = b @ b.T + np.eye(4)
    return {"arrow": arrow, "tri": tri, "diagonal": diagonal}


@pytest.mark.parametrize("kind", ["arrow", "tri", "diagonal"])
def test_block_factors_of_sparse_matrices(spark, kind):
    x = shapes()[kind]
    m = sparse(spark, x)
    u = blocks.chol_blocks(m, side=4).to_numpy()
    np.testing.assert_allclose(u.T @ u, x, atol=1e-12)
    np.testing.assert_allclose(blocks.inverse_blocks(m, side=4).to_numpy() @ x, np.eye(12), atol=1e-10)
    b = np.arange(24.0).reshape(12, 2)
    np.testing.assert_allclose(x @ blocks.solve_blocks(m, Matrix.from_numpy(spark, b), side=4).to_numpy(), b, atol=1e-9)


def test_a_sparse_matrix_that_is_not_positive_definite(spark):
    x = shapes()["tri"]
    x[5, 5] = -4
    with pytest.raises(np.linalg.LinAlgError):
        blocks.chol_blocks(sparse(spark, x), side=4)


@pytest.mark.parametrize("splits", [1, 3, 40])
def test_products_with_a_split_inner_index(spark, splits, monkeypatch):
    monkeypatch.setattr(products, "FANIN", 3)
    draw = np.random.default_rng(1)
    x, y = draw.standard_normal((5, 203)), draw.standard_normal((203, 6))
    got = products.matmul(Matrix.from_numpy(spark, x), Matrix.from_numpy(spark, y), strategy="block", side=4, splits=splits)
    np.testing.assert_allclose(got.to_numpy(), x @ y, atol=1e-12)
    got = products.matmul(Matrix.from_numpy(spark, x.T), Matrix.from_numpy(spark, y.T), strategy="block", side=4, splits=splits, transpose_a=True, transpose_b=True)
    np.testing.assert_allclose(got.to_numpy(), x @ y, atol=1e-12)


def test_a_long_inner_index_uses_many_tasks(spark):
    import pyspark.sql.functions as F

    left = Matrix(spark.range(30).select(F.col("id").alias("i"), F.transform(F.sequence(F.lit(0), F.lit(35_999)), lambda k: ((k * 7 + F.col("id")) % 11).cast("double")).alias("vec")), 30, 36_000, "rows")
    found = products.matmul(left, left, transpose_b=True, strategy="block")
    x = np.array([[(k * 7 + i) % 11 for k in range(36_000)] for i in range(30)], float)
    np.testing.assert_allclose(found.to_numpy(), x @ x.T)
    assert products.chosen_splits(spark, 1, 71) >= 8


@pytest.mark.parametrize("use", ["everything", "pairwise.complete.obs"])
def test_tiles(spark, use):
    draw = np.random.default_rng(3)
    x, y = draw.standard_normal((40, 11)) + 1e4, draw.standard_normal((40, 5))
    x[:, 4] = 3.0
    if use != "everything":
        x[draw.random(x.shape) < 0.2] = np.nan
    m, o = Matrix.from_numpy(spark, x), Matrix.from_numpy(spark, y)
    for other in (None, o):
        got, wanted = (sorted(tuple(r) for r in correlation.cor(m, other, use=use, tile=t).cells.select("j", "l", "r", "n", "p").collect()) for t in (4, None))
        np.testing.assert_allclose(np.array(got, float), np.array(wanted, float), atol=1e-9)
    if use == "everything":
        w = column(spark, range(40))
        np.testing.assert_allclose(products.crossprod(m, tile=4).to_numpy(), x.T @ x)
        np.testing.assert_allclose(products.crossprod(m, o, tile=4).to_numpy(), x.T @ y)
        np.testing.assert_allclose(products.crossprod(m, weights=w, tile=4).to_numpy(), x.T @ np.diag(np.arange(40.0)) @ x)


def groups(spark, arrays, seconds=None):
    made = [{k: Matrix.from_numpy(spark, x) for k, x in g.items()} for g in (arrays, seconds or {})]
    return lambda func: batch.apply_function(made[0], func, made[1] or None)


def dense(frame, result, shape):
    out = np.zeros(shape)
    for r in frame.where(f"result = '{result}'").collect():
        out[r["i"], r["j"]] = r["v"]
    return out


@pytest.mark.parametrize("held", [8, 1 << 22])
def test_qr_of_many_datasets(spark, held, monkeypatch):
    monkeypatch.setattr(batch, "HELD", held)
    monkeypatch.setattr(batch, "FANOUT", 2)
    draw = np.random.default_rng(6)
    x = {"large": draw.standard_normal((90, 4)), "two": draw.standard_normal((5, 4)), "wide": draw.standard_normal((2, 3)), "dependent": np.ones((6, 2)), "zero": np.zeros((3, 2))}
    found = groups(spark, x)("QR").cache()
    for k, a in x.items():
        n = min(a.shape)
        q, r = dense(found, f"QR_{k}.Q", (len(a), n)), dense(found, f"QR_{k}.R", (n, a.shape[1]))
        np.testing.assert_allclose(q @ r, a, atol=1e-12)
        np.testing.assert_allclose(q.T @ q, np.eye(n), atol=1e-12)
        assert (np.diag(r) >= 0).all() and np.allclose(np.tril(r, -1), 0)


def test_products_of_many_datasets(spark, monkeypatch):
    draw = np.random.default_rng(7)
    x = {"a": draw.standard_normal((7, 3)), "b": draw.standard_normal((2, 5))}
    y = {"c": draw.standard_normal((7, 2)), "d": draw.standard_normal((2, 4))}
    z = {"c": draw.standard_normal((6, 3)), "d": draw.standard_normal((3, 5))}
    w = {"c": draw.standard_normal((3, 6)), "d": draw.standard_normal((5, 2))}
    for func, second, wanted in (("CrossProd_double", y, lambda p, q: p.T @ q), ("tCrossProd_double", z, lambda p, q: p @ q.T), ("blockmult", w, lambda p, q: p @ q), ("tCrossProd", None, lambda p, q: p @ p.T)):
        found = groups(spark, x, second)(func).cache()
        for k, o in zip(x, second or x):
            a = wanted(x[k], (second or x)[o])
            np.testing.assert_allclose(dense(found, f"{func}_{k}", a.shape), a, atol=1e-12)


def test_square_datasets_large_and_small(spark, monkeypatch):
    monkeypatch.setattr(batch, "LARGEST", 5)
    draw = np.random.default_rng(8)
    x = {k: (lambda g: g @ g.T + np.eye(n))(draw.standard_normal((n, n))) for k, n in (("a", 3), ("b", 7))}
    y = {"c": draw.standard_normal((3, 2)), "d": draw.standard_normal((7, 2))}
    for func, second, wanted in (("invChol", None, lambda p, q: np.linalg.inv(p)), ("descChol", None, lambda p, q: np.linalg.cholesky(p).T), ("solve", y, np.linalg.solve)):
        found = groups(spark, x, second)(func).cache()
        for k, o in zip(x, second or x):
            a = wanted(x[k], (second or x)[o])
            np.testing.assert_allclose(dense(found, f"{func}_{k}", a.shape), a, atol=1e-9)


def test_options_act(spark, a):
    from matloom.functions import options

    m = Matrix.from_numpy(spark, a)
    try:
        options.set_options(block_size=2, threads=3, compression="gzip")
        np.testing.assert_allclose(products.matmul(m, m, transpose_b=True, strategy="block").to_numpy(), a @ a.T)
        assert products.tasks_of(spark) == 3
        options.set_options(parallel=False)
        assert products.tasks_of(spark) == 1
    finally:
        options.set_options(block_size=None, threads=None, compression=None, parallel=None)


def test_sizes_that_may_be_collected(spark):
    from matloom.functions import options

    assert options.memory_thresholds(16 * 1024) == {"silent": 2500, "warning": 4900, "force": 8200, "blocked": 13100}
    m = Matrix.create(spark, 400, 400)  # 1.22 MB
    with pytest.warns(ResourceWarning, match="collected$"):
        m.to_numpy(max_size_mb=1)
    with pytest.warns(ResourceWarning, match="takes long"):
        m.to_numpy(max_size_mb=0.5)
    with pytest.raises(MemoryError, match="force=True"):
        m.to_numpy(max_size_mb=0.2)
    assert m.to_numpy(max_size_mb=0.2, force=True).shape == (400, 400)
    with pytest.raises(MemoryError, match="subset"):
        m.to_numpy(max_size_mb=0.1, force=True)


@pytest.mark.parametrize("shape", ["random", "hot inner index", "hot row", "one side empty"])
@pytest.mark.parametrize("side,most", [(4, 30), (512, None)])
def test_sparse_products_by_tiles(spark, shape, side, most):
    rng = np.random.default_rng(3)
    x, y = (rng.integers(-3, 4, (23, 31)) * (rng.random((23, 31)) < 0.2)).astype(float), (rng.integers(-3, 4, (31, 17)) * (rng.random((31, 17)) < 0.2)).astype(float)
    if shape == "hot inner index":
        x[:, 7], y[7] = 2.0, rng.standard_normal(17)
    elif shape == "hot row":
        x[5], y[:, 2] = 1.5, 1.0
    elif shape == "one side empty":
        y[:] = 0
    cells = lambda a: Matrix.from_coo(spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*a.nonzero())], "i long, j int, v double"), *a.shape)
    found = products.multiply_sparse(cells(x), cells(y), strategy="tiles", side=side, most=most)
    assert found.df.groupBy("i", "j").count().where("count > 1").count() == 0
    assert np.allclose(found.to_numpy(), x @ y)


def test_tiles_of_heavy_indexes_are_cut(spark):
    left = spark.range(3000).selectExpr("id AS i", "7L AS k", "1.0D AS v")
    right = spark.range(50).selectExpr("7L AS k", "CAST(id AS INT) AS j", "1.0D AS w")
    (row,) = products._tiles(left, right, 512, 10_000).collect()
    assert row["pairs"] == 150_000 and row["nx"] * row["ny"] >= 15 and row["nx"] <= 15


@pytest.mark.parametrize("missing", [False, True])
def test_correlation_of_wide_columns_is_that_of_rows(spark, missing):
    rng = np.random.default_rng(8)
    a = np.column_stack([rng.standard_normal(40) + 1e6, rng.standard_normal(40), np.full(40, 3.0), rng.standard_normal(40)])
    rows = [tuple([i, *map(float, r)]) for i, r in enumerate(a)]
    if missing:
        rows[4] = (*rows[4][:2], None, *rows[4][3:])
        rows[9] = (*rows[9][:4], float("nan"))
    frame = spark.createDataFrame(rows, "key long, a double, b double, c double, d double")
    wide = Matrix.from_columns(frame, ["a", "b", "c", "d"], "key")
    told = lambda m: np.array([tuple(r) for r in correlation.cor(m).cells.orderBy("j", "l").select("r", "n", "p").collect()], float)
    found, expected = told(wide), told(wide.to_rows())
    assert np.allclose(found, expected, atol=1e-9, equal_nan=True)
    tiled = np.array([tuple(r) for r in correlation.cor(wide, tile=2).cells.orderBy("j", "l").select("r", "n", "p").collect()], float)
    assert np.allclose(found, tiled, atol=1e-9, equal_nan=True)
    gram = np.array([[v for (v,) in products.crossprod(m).df.orderBy("i", "j").select("v").collect()] for m in (wide, wide.to_rows())], float)
    assert np.allclose(*gram, equal_nan=True) and np.isnan(gram).any() == missing
    if not missing:
        assert np.isclose(found[1, 0], np.corrcoef(a[:, 0], a[:, 1])[0, 1]) and found[2, 0] == 0


def test_products_keep_missing_values(spark):
    a = np.arange(24, dtype=float).reshape(6, 4) + 1
    a[2, 1] = np.nan
    m = Matrix.from_columns(spark.createDataFrame([tuple([i, *map(float, r)]) for i, r in enumerate(a)], "key long, a double, b double, c double, d double"), ["a", "b", "c", "d"], "key")
    right = np.arange(12, dtype=float).reshape(4, 3)
    for strategy in ("broadcast", "block", "cells"):
        found = products.matmul(m.to_rows(), Matrix.from_numpy(spark, right), strategy=strategy, side=2)
        assert np.allclose(found.to_numpy(), a @ right, equal_nan=True), strategy
