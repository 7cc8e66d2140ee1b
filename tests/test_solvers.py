"""LU by blocks, Krylov eigenvalues and truncated singular values against numpy."""

import numpy as np
import pytest

from matloom.matrix import Matrix
from matloom.operators import blocks, krylov


def of(spark, a):
    return Matrix.from_numpy(spark, a)


@pytest.mark.parametrize("kind", ["general", "indefinite", "zero corner", "permutation"])
def test_solutions_of_any_square_matrix(spark, kind, monkeypatch):
    monkeypatch.setattr(blocks, "FANIN", 2)
    draw = np.random.default_rng(5)
    a = draw.standard_normal((13, 13))
    if kind == "indefinite":
        a = a + a.T
        assert np.linalg.eigvalsh(a)[0] < 0 < np.linalg.eigvalsh(a)[-1]
    if kind == "zero corner":
        a[:4, :4] = 0
    if kind == "permutation":
        a = np.eye(13)[draw.permutation(13)] * 2
    b = draw.standard_normal((13, 6))
    x = blocks.solve_general(of(spark, a), of(spark, b), side=4).to_numpy()
    np.testing.assert_allclose(a @ x, b, atol=1e-9)
    np.testing.assert_allclose(x, np.linalg.solve(a, b), atol=1e-8)


def test_sparse_systems_and_inverses(spark):
    a = np.diag(np.arange(1.0, 10)) + np.diag(np.ones(8), 1) - 3 * np.diag(np.ones(7), -2)
    cells = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    m = Matrix.from_coo(spark.createDataFrame(cells, "i long, j int, v double"), 9, 9)
    np.testing.assert_allclose(blocks.inverse_general(m, side=4).to_numpy(), np.linalg.inv(a), atol=1e-10)
    np.testing.assert_allclose(blocks.inverse_general(of(spark, [[4.0]])).to_numpy(), [[0.25]])


def test_singular_and_non_conformable_systems_are_refused(spark):
    a = np.outer(np.arange(6.0), np.ones(6)) + np.eye(6)
    a[5] = a[4]
    with pytest.raises(np.linalg.LinAlgError):
        blocks.solve_general(of(spark, a), of(spark, np.ones((6, 1))), side=2)
    with pytest.raises(np.linalg.LinAlgError):
        blocks.solve_general(of(spark, np.zeros((3, 3))), of(spark, np.ones((3, 1))), side=2)
    with pytest.raises(ValueError):
        blocks.solve_general(of(spark, a), of(spark, np.ones((5, 1))))
    with pytest.raises(ValueError):
        blocks.solve_general(of(spark, np.ones((5, 6))), of(spark, np.ones((5, 1))))


@pytest.fixture(scope="module")
def square():
    draw = np.random.default_rng(11)
    general = draw.standard_normal((40, 40))
    return {"symmetric": general + general.T, "general": general}


@pytest.mark.parametrize("which", ["LM", "SM", "LA", "SA", "LR", "SR", "LI", "SI"])
@pytest.mark.parametrize("kind", ["symmetric", "general"])
def test_eigenvalues_of_each_selection(square, kind, which):
    a = square[kind]
    every = np.linalg.eigvals(a) if kind == "general" else np.linalg.eigvalsh(a)
    found = krylov.iterate(lambda v: a @ v, 40, 4, which, 28, symmetric=kind == "symmetric")
    key = krylov.WANTED[which]
    np.testing.assert_allclose(np.sort(key(found.values)), np.sort(key(every))[:4], atol=1e-7)
    np.testing.assert_allclose(a @ found.vectors, found.vectors * found.values, atol=1e-6)
    assert (np.diff(found.values.real) <= 1e-9).all()


def test_eigenvalues_by_products_in_tasks(spark, square):
    a = np.diag(np.arange(1.0, 13)) + np.diag(np.ones(11), 1) + np.diag(np.ones(11), -1)
    cells = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    m = Matrix.from_coo(spark.createDataFrame(cells, "i long, j int, v double"), 12, 12)
    np.testing.assert_allclose(krylov.eigs(m, 2, ncv=8).values, np.linalg.eigvalsh(a)[::-1][:2], atol=1e-8)
    general = square["general"][:9, :9]
    found = krylov.eigs(of(spark, general), 3, "LI")
    np.testing.assert_allclose(general @ found.vectors, found.vectors * found.values, atol=1e-6)
    assert not krylov.is_symmetric(of(spark, general)) and krylov.is_symmetric(m)


def test_repeated_eigenvalues():
    for a, k in ((np.diag([3.0, 3.0, 1.0]), 3), (np.eye(4), 2), (np.zeros((3, 3)), 2)):
        found = krylov.iterate(lambda v, a=a: a @ v, len(a), k, "LM", len(a), symmetric=True)
        np.testing.assert_allclose(found.values, np.sort(np.diag(a))[::-1][:k], atol=1e-12)


def test_tolerance_and_restarts_are_obeyed(spark, square):
    a = square["symmetric"]
    run = lambda k, which, size, **options: krylov.iterate(lambda v: a @ v, 40, k, which, size, symmetric=True, **options)
    with pytest.raises(krylov.NotConverged):
        run(3, "SM", 5, max_iter=1)
    rough, fine = run(2, "LA", 6, tol=1e-2), run(2, "LA", 6, tol=1e-12)
    exact = np.linalg.eigvalsh(a)[::-1][:2]
    assert np.abs(fine.values - exact).max() < 1e-9 and np.abs(rough.values - exact).max() < 0.5
    for bad in (dict(k=0), dict(k=41), dict(k=2, which="XX"), dict(k=4, ncv=4)):
        with pytest.raises(ValueError):
            krylov.eigs(of(spark, a), **bad)


@pytest.mark.parametrize("shape", [(12, 60), (40, 40)])
def test_truncated_singular_values(spark, shape):
    draw = np.random.default_rng(12)
    a = draw.standard_normal(shape) @ np.diag(0.7 ** np.arange(shape[1]))
    found = krylov.truncated_svd(of(spark, a), 5, oversample=6)
    np.testing.assert_allclose(found.d, np.linalg.svd(a, compute_uv=False)[:5], rtol=1e-9)
    u, v = found.u.to_numpy(), found.v.to_numpy()
    np.testing.assert_allclose(u.T @ u, np.eye(5), atol=1e-10)
    np.testing.assert_allclose(v.T @ v, np.eye(5), atol=1e-10)
    np.testing.assert_allclose(a @ v, u * found.d, atol=1e-7)


def test_truncated_svd_of_low_rank(spark):
    a = np.outer(np.arange(1.0, 20), np.arange(1.0, 7)) + np.outer(np.ones(19), np.arange(6.0))
    found = krylov.truncated_svd(of(spark, a), 4)
    np.testing.assert_allclose(found.d, np.linalg.svd(a, compute_uv=False)[: len(found.d)], rtol=1e-9, atol=1e-9)
    assert len(found.d) == 2
    tiny = krylov.truncated_svd(of(spark, np.diag([1.0, 1e-9, 1e-10, 1e-12])), 3)
    np.testing.assert_allclose(tiny.d, [1, 1e-9, 1e-10], rtol=1e-4)
