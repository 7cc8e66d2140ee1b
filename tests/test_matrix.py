"""Edge cases and properties against numpy."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from matloom.functions import options
from matloom.functions.student import correlation_p_values, incomplete_beta
from matloom.matrix import Matrix, chain
from matloom.operators import aggregates as ag
from matloom.operators import batch, blocks, correlation, elementwise, factor, genotype, products, restructure, subset

few = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
matrices = arrays(float, st.tuples(st.integers(2, 6), st.integers(1, 5)), elements=st.integers(-20, 20).map(float))


def of(spark, a):
    return Matrix.from_numpy(spark, a)


def values(frame, key):
    return np.array([r[1] for r in sorted((tuple(r) for r in frame.select(key, "v").collect()))])


@given(a=matrices)
@few
def test_aggregates(spark, a):
    for m in (of(spark, a), of(spark, a).to_coo(), of(spark, a).to_wide()):
        for f, expected, key in ((ag.col_sums, a.sum(0), "j"), (ag.col_vars, a.var(0, ddof=1), "j"), (ag.row_means, a.mean(1), "i"), (ag.row_mins, a.min(1), "i")):
            np.testing.assert_allclose(values(f(m), key), expected, atol=1e-9)


def test_one_row_and_one_cell(spark):
    one = of(spark, [[3.0]])
    assert ag.mean(one) == 3 and np.isnan(ag.sd(one)) and np.isnan(values(ag.col_vars(one), "j")[0]) and np.isnan(values(ag.row_sds(one), "i")[0])
    assert ag.summary(one, "max") == 3
    with pytest.raises(ValueError):
        ag.summary(one, "prod")


def test_absent_cells_are_zero(spark):
    a = np.array([[0, 5.0, 0], [-1, 0, 0], [0, 2, 0]])
    df = spark.createDataFrame([(0, 1, 5.0), (1, 0, -1.0), (2, 1, 2.0)], "i long, j int, v double")
    m = Matrix.from_coo(df, 3, 3)
    for stat in ag.STATS:
        expected = {"sum": a.sum, "mean": a.mean, "min": a.min, "max": a.max, "var": lambda x: a.var(x, ddof=1), "sd": lambda x: a.std(x, ddof=1)}[stat]
        got = {r["j"]: r[stat] for r in ag.col_stats(m, [stat]).collect()}
        np.testing.assert_allclose([got[j] for j in range(3)], expected(0), atol=1e-12)
        got = {r["i"]: r[stat] for r in ag.row_stats(m, [stat]).collect()}
        np.testing.assert_allclose([got[j] for j in range(3)], expected(1), atol=1e-12)
    np.testing.assert_allclose(m.to_numpy(), a)
    np.testing.assert_allclose(m.to_rows().to_numpy(), a)


def test_nan_goes_through_and_can_be_passed_over(spark):
    m = of(spark, [[1.0, float("nan")], [3.0, 4.0]])
    assert np.isnan(values(ag.col_sums(m), "j")[1]) and values(ag.col_sums(m, na_rm=True), "j")[1] == 4


def test_shapes_are_checked(spark):
    a, b = of(spark, np.ones((2, 3))), of(spark, np.ones((4, 5)))
    for f in (lambda: a + b, lambda: a @ b, lambda: restructure.cbind(a, b), lambda: restructure.rbind(a, b), lambda: products.crossprod(a, b), lambda: products.tcrossprod(a, b), lambda: restructure.reduce([a, b])):
        with pytest.raises(ValueError):
            f()
    with pytest.raises(TypeError):
        a**2
    with pytest.raises(TypeError):
        a + 1


def test_division_follows_ieee(spark):
    got = (of(spark, [[1.0, 0.0, -2.0, 6.0]]) / of(spark, [[0.0, 0.0, 0.0, 3.0]])).to_numpy()[0]
    assert got[0] == np.inf and np.isnan(got[1]) and got[2] == -np.inf and got[3] == 2


def test_vectors_keep_the_order_of_operands(spark):
    a, v = np.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]), np.array([[10.0, 20.0]])
    np.testing.assert_allclose((of(spark, a) - of(spark, v)).to_numpy(), a - v)
    np.testing.assert_allclose((of(spark, v) - of(spark, a)).to_numpy(), v - a)
    np.testing.assert_allclose((of(spark, a) * of(spark, v[0][:1].repeat(3))).to_numpy(), a * 10)


@given(a=matrices)
@few
def test_products(spark, a):
    m = of(spark, a)
    for x in (m, m.to_wide(), m.to_coo()):
        np.testing.assert_allclose(products.crossprod(x).to_numpy(), a.T @ a, atol=1e-9)
        np.testing.assert_allclose(products.tcrossprod(x).to_numpy(), a @ a.T, atol=1e-9)
    np.testing.assert_allclose(products.matmul(m, m, transpose_b=True, strategy="block").to_numpy(), a @ a.T, atol=1e-9)
    np.testing.assert_allclose((m @ m.t()).t().to_numpy(), (a @ a.T).T, atol=1e-9)


def test_blocks_of_several(spark, monkeypatch):
    a, b = np.random.default_rng(1).normal(size=(11, 9)), np.random.default_rng(2).normal(size=(9, 7))
    got = products._by_blocks(of(spark, a), of(spark, b), side=4).to_numpy()
    np.testing.assert_allclose(got, a @ b, atol=1e-12)
    np.testing.assert_allclose(chain([of(spark, a), of(spark, b), of(spark, b.T)]).to_numpy(), a @ b @ b.T, atol=1e-10)


def test_subset_and_assign(spark):
    a = np.arange(20.0).reshape(5, 4)
    m = of(spark, a).with_labels(list("abcde"), list("wxyz"))
    np.testing.assert_allclose(m[[3, 3, 0], [2, 0]].to_numpy(), a[[3, 3, 0]][:, [2, 0]])
    np.testing.assert_allclose(m[("not", [0, 1]), :].to_numpy(), a[2:])
    assert sorted((r["idx"], r["name"]) for r in m[[3, 0], :].row_labels.collect()) == [(0, "d"), (1, "a")]
    assert m[[], :].dim == (0, 4)
    with pytest.raises(IndexError):
        m[[9], :]
    b = a.copy()
    b[1:3, [0, 2]] = [[1, 2], [3, 4]]
    np.testing.assert_allclose(subset.assign(m, slice(1, 3), [0, 2], [[1, 2], [3, 4]]).to_numpy(), b)
    assert m.with_labels(["too", "few"]).row_labels is None


@given(a=matrices)
@few
def test_split_and_bind_again(spark, a):
    m = of(spark, a)
    np.testing.assert_allclose(restructure.rbind(*restructure.split(m, n_blocks=2)).to_numpy(), a)
    np.testing.assert_allclose(restructure.cbind(*restructure.split(m, block_size=2, by_cols=True)).to_numpy(), a)


def test_bind_unequal(spark):
    got = restructure.bind_list([of(spark, np.ones((2, 2))), of(spark, np.ones((3, 1)))], "bindCols").to_numpy()
    np.testing.assert_allclose(got, [[1, 1, 1], [1, 1, 1], [0, 0, 1]])


def test_correlation_edges(spark):
    a = np.array([[1.0, 2.0, 7.0], [2.0, 4.1, 7.0], [3.0, 5.9, 7.0], [4.0, 8.2, 7.0]])
    r = correlation.cor(of(spark, a)).matrix().to_numpy()
    assert r[2, 2] == 1 and r[0, 2] == 0 and abs(r[0, 1] - np.corrcoef(a.T)[0, 1]) < 1e-9
    cross = correlation.cor(of(spark, a), of(spark, a)).matrix().to_numpy()
    assert np.isnan(cross[2, 0]) and abs(cross[0, 1] - r[0, 1]) < 1e-12
    a[0, 0] = np.inf
    pair = correlation.cor(of(spark, a), use="complete.obs").matrix().to_numpy()
    assert abs(pair[0, 1] - np.corrcoef(a[1:, :2].T)[0, 1]) < 1e-9
    with pytest.raises(ValueError):
        correlation.cor(of(spark, a), use="all")


def test_ties(spark):
    a = np.array([[2.0], [1.0], [2.0], [2.0]])
    np.testing.assert_allclose(correlation.ranks(of(spark, a)).to_numpy()[:, 0], [2, 1, 3, 4])
    np.testing.assert_allclose(correlation.ranks(of(spark, a), "average").to_numpy()[:, 0], [3, 1, 3, 3])


def test_student():
    assert abs(incomplete_beta(2.0, 3.0, 0.4) - 0.5248) < 1e-10
    # t = 2.228, 10 degrees: the 97.5 % point
    r = 2.2281388519649385 / np.sqrt(2.2281388519649385**2 + 10)
    assert abs(correlation_p_values(r, 12) - 0.05) < 1e-9
    assert abs(correlation_p_values(1.959963985 / np.sqrt(1.959963985**2 + 200), 202) - 0.05) < 1e-8
    assert np.isnan(correlation_p_values(0.5, 2)) and np.isnan(correlation_p_values(1.0, 9))


def test_factorizations(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(60, 5)) @ np.diag([5, 4, 3, 2, 1])
    m = of(spark, a)
    for method in ("tsqr", "householder"):
        q, r = factor.qr(m, thin=True, method=method)
        np.testing.assert_allclose(q.to_numpy() @ r, a, atol=1e-10)
        np.testing.assert_allclose(q.to_numpy().T @ q.to_numpy(), np.eye(5), atol=1e-12)
        assert (np.diag(r) >= 0).all()
    q, r = factor.qr(m)
    assert q.dim == (60, 60) and r.shape == (60, 5)
    s = factor.svd(m, center=False, scaled=False)
    np.testing.assert_allclose(s.u.to_numpy() @ np.diag(s.d) @ s.v.to_numpy().T, a, atol=1e-10)
    wide = factor.svd(of(spark, a.T), nu=2, nv=3)
    z = (a.T - a.T.mean(0)) / a.T.std(0, ddof=1)
    np.testing.assert_allclose(wide.d, np.linalg.svd(z, compute_uv=False)[:3], atol=1e-9)
    assert wide.u.dim == (5, 2) and wide.v.dim == (60, 3)
    np.testing.assert_allclose(factor.svd(m, method="blocks", k=3, q=2).d, np.linalg.svd((a - a.mean(0)) / a.std(0, ddof=1), compute_uv=False), atol=1e-9)
    pinv = factor.pseudoinverse(m).to_numpy()
    np.testing.assert_allclose(pinv, np.linalg.pinv(a), atol=1e-10)
    np.testing.assert_allclose(factor.pseudoinverse(of(spark, a.T)).to_numpy(), np.linalg.pinv(a.T), atol=1e-10)
    b = factor.ols(m[:, :4], m[:, 4:])[:, 0]
    np.testing.assert_allclose(b, np.linalg.lstsq(np.column_stack([np.ones(60), a[:, :4]]), a[:, 4], rcond=None)[0], atol=1e-10)
    low = of(spark, np.column_stack([a[:, 0], 2 * a[:, 0]]))
    np.testing.assert_allclose(factor.pseudoinverse(low).to_numpy(), np.linalg.pinv(low.to_numpy()), atol=1e-9)


def test_square(spark):
    z = np.random.default_rng(2).normal(size=(20, 6))
    a = z.T @ z + np.eye(6)
    m = of(spark, a)
    u = factor.chol(m)
    np.testing.assert_allclose(u.T @ u, a, atol=1e-10)
    np.testing.assert_allclose(factor.chol(m, full=True), u + u.T - np.diag(np.diag(u)))
    np.testing.assert_allclose(factor.inverse(m) @ a, np.eye(6), atol=1e-9)
    np.testing.assert_allclose(factor.eigen(m, k=2).values, np.linalg.eigvalsh(a)[::-1][:2], atol=1e-9)
    assert np.iscomplexobj(factor.eigen(of(spark, [[0.0, -1.0], [1.0, 0.0]])).values)
    with pytest.raises(np.linalg.LinAlgError):
        factor.chol(of(spark, -a))
    with pytest.raises(ValueError):
        factor.chol(of(spark, z))


def test_pca(spark):
    a = np.random.default_rng(3).normal(size=(40, 4)) * [1, 2, 3, 4] + 10
    p = factor.pca(of(spark, a), scaled=False)
    z = (a - a.mean(0)) / np.sqrt(39)
    d = np.linalg.svd(z, compute_uv=False)
    np.testing.assert_allclose(p.eigenvalues, d**2, atol=1e-9)
    np.testing.assert_allclose((p.ind_coord.to_numpy() ** 2).sum(0), 40 * d**2, rtol=1e-9)
    np.testing.assert_allclose(p.ind_contrib.to_numpy().sum(0), 100, atol=1e-8)
    assert factor.pca(of(spark, a), rank=2).ind_coord.ncol == 2 and abs(p.cumulative[-1] - 100) < 1e-9


def test_genotypes(spark):
    a = np.array([[0, 3, 0], [1, 3, 0], [2, 3, 0], [3, 3, 0]], float)
    m = of(spark, a)
    f = genotype.filter_low_coverage(m, 0.5)
    assert f.removed == 1 and f.matrix.dim == (4, 2)
    np.testing.assert_allclose(f.matrix.to_numpy(), a[:, [0, 2]])
    assert genotype.filter_low_coverage(m, 0.0).removed == 3
    assert genotype.filter_maf(m, 0.0, by_cols=True).matrix.ncol == 1
    for strategy in ("random", "mode", "mean"):
        got = genotype.impute(m, strategy=strategy).to_numpy()
        assert got[3, 0] in (0, 1, 2) and (got[:, 1] == 3).all()
    assert (genotype.impute(m, seed=4).to_numpy() == genotype.impute(m.to_coo(), seed=4).to_numpy()).all()


def test_batch(spark):
    a, b = np.arange(6.0).reshape(3, 2), np.eye(2) * 2
    got = {r["i"] * 2 + r["j"]: r["v"] for r in batch.apply_function({"a": of(spark, a)}, "blockmult", {"b": of(spark, b)}).collect()}
    np.testing.assert_allclose([got[k] for k in range(6)], (a @ b).ravel())
    names = {r["result"] for r in batch.apply_function({"a": of(spark, a)}, "QR").collect()}
    assert names == {"QR_a.Q", "QR_a.R"}
    assert batch.map_blocks(of(spark, a), lambda x: x[:, :1] * 2, 1).to_numpy()[2, 0] == 8
    with pytest.raises(ValueError):
        batch.apply_function({"a": of(spark, a)}, "nothing")


def test_create_and_collect(spark):
    np.testing.assert_allclose(Matrix.create(spark, 3, 2, [1, 2]).to_numpy(), np.resize([1, 2], 6).reshape(2, 3).T)
    assert Matrix.create(spark, 2, 2, 1.7, dtype="integer").to_numpy()[0, 0] == 1
    assert Matrix.create(spark, 2, 2, 5, dtype="logical").to_numpy()[0, 0] == 1
    with pytest.raises(ValueError):
        Matrix.create(spark, 0, 2)
    with pytest.raises(ValueError):
        Matrix.create(spark, 1, 2, dtype="text")
    with pytest.raises(MemoryError):
        Matrix.create(spark, 1000, 100).to_numpy(max_size_mb=0.1)
    assert list(of(spark, np.eye(2)).with_labels(["a", "b"], ["x", "y"]).to_pandas().columns) == ["x", "y"]


def test_diagonals(spark):
    a = np.arange(9.0).reshape(3, 3)
    m = of(spark, a)
    np.testing.assert_allclose(values(elementwise.diag_op(m, m, "*"), "k"), np.diag(a) ** 2)
    np.testing.assert_allclose(np.diag(elementwise.diag_scale(m, 2, "^", as_matrix=True).to_numpy()), np.diag(a) ** 2)
    np.testing.assert_allclose(values(elementwise.diag(of(spark, a[:2])), "k"), [0, 4])
    np.testing.assert_allclose(elementwise.diagonal_matrix(elementwise.diag(m), 3).to_numpy(), np.diag(np.diag(a)))
    with pytest.raises(ValueError):
        elementwise.set_diag(m, [1.0])


def test_options():
    options.set_options(compression="zstd", block_size=100)
    assert options.resolve("compression", None, "snappy") == "zstd" and options.resolve("compression", "gzip") == "gzip"
    for wrong in ({"compression": "rar"}, {"threads": 0}, {"nothing": 1}):
        with pytest.raises(ValueError):
            options.set_options(**wrong)
    options.set_options(compression=None, block_size=None)
    assert options.total_ram_mb() > 0 and options.can_allocate(1) and options.system_info()["cores"] >= 1


@pytest.mark.parametrize("side", [3, 4, 16])
def test_blocks_of_a_positive_definite_matrix(spark, side):
    x = np.random.default_rng(5).standard_normal((30, 11))
    a = x.T @ x
    b = np.random.default_rng(6).standard_normal((11, 5))
    for m in (of(spark, a), products.crossprod(of(spark, x))):
        low = blocks.chol_blocks(m, lower=True, side=side)
        np.testing.assert_allclose(low.to_numpy(), np.linalg.cholesky(a), atol=1e-10)
    np.testing.assert_allclose(blocks.chol_blocks(m, side=side).to_numpy(), np.linalg.cholesky(a).T, atol=1e-10)
    np.testing.assert_allclose(blocks.inverse_blocks(m, side=side).to_numpy(), np.linalg.inv(a), atol=1e-10)
    np.testing.assert_allclose(blocks.solve_blocks(m, of(spark, b), side=side).to_numpy(), np.linalg.solve(a, b), atol=1e-10)


def test_blocks_of_other_matrices(spark):
    with pytest.raises(np.linalg.LinAlgError):
        blocks.chol_blocks(of(spark, np.diag([1.0, 2.0, -1.0])), side=2)
    with pytest.raises(np.linalg.LinAlgError):  # no stored cell in the last block
        blocks.chol_blocks(Matrix.from_coo(spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0)], "i long, j int, v double"), 3, 3), side=2)
    with pytest.raises(ValueError):
        blocks.inverse_blocks(of(spark, np.ones((2, 3))))
    with pytest.raises(ValueError):
        blocks.solve_blocks(of(spark, np.eye(3)), of(spark, np.ones((2, 1))))
