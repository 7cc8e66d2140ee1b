"""Q as a tree of reflectors: applied to blocks, dependent columns, full and thin, against numpy."""

import numpy as np
import pytest

from matloom.matrix import Matrix
from matloom.operators import factor, reflectors


def of(spark, a):
    return Matrix.from_numpy(spark, a)


@pytest.mark.parametrize(("n", "p", "height"), [(1, 1, None), (50, 3, 4), (97, 4, 4), (20, 5, 20), (3, 6, None)])
@pytest.mark.parametrize("pivoted", [False, True])
def test_factors_and_products(spark, n, p, height, pivoted, monkeypatch):
    monkeypatch.setattr(reflectors, "FANOUT", 3)
    draw = np.random.default_rng(n)
    a, b = draw.standard_normal((n, p)), draw.standard_normal((n, 2))
    found = reflectors.reflectors(of(spark, a), pivoted=pivoted, height=height)
    assert found.rank == min(n, p) and (np.diag(found.r) >= 0).all()
    up = found.t_times(of(spark, a[:, found.pivot])).to_numpy()
    np.testing.assert_allclose(up, np.vstack([found.r, np.zeros((n - len(found.r), p))]), atol=1e-12)
    back = found.times(found.t_times(of(spark, b))).to_numpy()
    np.testing.assert_allclose(back, b, atol=1e-12)
    q = found.full().to_numpy()
    np.testing.assert_allclose(q.T @ q, np.eye(n), atol=1e-12)
    np.testing.assert_allclose(found.thin().to_numpy(), q[:, : min(n, p)], atol=1e-12)
    np.testing.assert_allclose(found.times(of(spark, b)).to_numpy(), q @ b, atol=1e-12)


def test_dependent_columns(spark):
    draw = np.random.default_rng(2)
    a = draw.standard_normal((60, 3)) @ draw.standard_normal((3, 7))
    a[:, 4] = 0
    found = reflectors.reflectors(of(spark, a), pivoted=True, height=7)
    assert found.rank == 3 and (np.diff(np.diag(found.r)[:3]) <= 0).all() and np.abs(found.r[3:]).max() < 1e-11
    np.testing.assert_allclose(found.thin().to_numpy() @ found.r, a[:, found.pivot], atol=1e-11)
    q, r = factor.qr(of(spark, a), thin=True)
    np.testing.assert_allclose(q.to_numpy() @ r, a, atol=1e-11)
    np.testing.assert_allclose(q.to_numpy().T @ q.to_numpy(), np.eye(7), atol=1e-12)


def test_dependent_columns_of_a_tall_matrix_and_zeros(spark):
    i = np.arange(1500.0)
    a = np.column_stack([i % 7, i % 7 * 2, np.zeros(1500), i % 5])
    q, r = factor.qr(of(spark, a), thin=True, method="tsqr")
    np.testing.assert_allclose(q.to_numpy() @ r, a, atol=1e-9)
    np.testing.assert_allclose(q.to_numpy().T @ q.to_numpy(), np.eye(4), atol=1e-12)
    sparse = Matrix.from_coo(spark.createDataFrame([(0, 0, 2.0), (7, 1, 3.0)], "i long, j int, v double"), 9, 2)
    found = reflectors.reflectors(sparse, height=2)
    np.testing.assert_allclose(found.r, [[2, 0], [0, 3]], atol=1e-12)


def test_refusals(spark):
    found = reflectors.reflectors(of(spark, np.ones((4, 2))))
    with pytest.raises(ValueError):
        found.times(of(spark, np.ones((3, 2))))
    with pytest.raises(ValueError):
        reflectors.Reflectors(found.nodes, 10_000, 2, 10, 1, found.r, found.signs, found.pivot, 2).full()
