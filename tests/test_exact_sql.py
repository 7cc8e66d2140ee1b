"""The SQL that factors are held against, itself against numpy and Student's t."""

import duckdb
import numpy as np
import pytest

from matloom.exact_sql import inverted, rotated, two_sided, upper_factor
from matloom.functions.student import correlation_p_values


def rows_of(a):
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, {j}, {float(a[i, j])!r}::DOUBLE)" for i in range(len(a)) for j in range(len(a))) + ") AS s(j, l, v)"


@pytest.fixture(params=["random", "equal", "diagonal"])
def symmetric(request):
    x = np.random.default_rng(5).standard_normal((9, 6))
    return {"random": x.T @ x, "equal": np.ones((6, 6)) + np.eye(6), "diagonal": np.diag([3.0, 1.0, 4.0, 1.0, 5.0, 9.0])}[request.param]


def test_eigenvalues(symmetric):
    found = duckdb.connect().execute(f"WITH RECURSIVE g AS ({rows_of(symmetric)}), {rotated('e', 'g', 6)} SELECT v FROM e ORDER BY k").fetchall()
    assert np.allclose([v for (v,) in found], np.linalg.eigvalsh(symmetric)[::-1], atol=1e-10)


def test_upper_factor(symmetric):
    found = np.zeros((6, 6))
    for j, k, v in duckdb.connect().execute(f"WITH RECURSIVE g AS ({rows_of(symmetric)}), {upper_factor('u', 'g', 6)} SELECT j, l, v FROM u").fetchall():
        found[j, k] = v
    assert np.allclose(found, np.linalg.cholesky(symmetric).T)


def test_inverse(symmetric):
    found = np.zeros((6, 6))
    for j, k, v in duckdb.connect().execute(f"WITH RECURSIVE g AS ({rows_of(symmetric)}), {inverted('w', 'g', 6)} SELECT j, l, v FROM w").fetchall():
        found[j, k] = v
    assert np.allclose(found, np.linalg.inv(symmetric))


def test_p_values():
    grid = [(r / 20, n) for r in range(20) for n in (3, 4, 5, 8, 9, 51, 52, 101, 102, 103, 104, 900)]
    source = ", ".join(f"({r}::DOUBLE, {n})" for r, n in grid)
    sql = f"WITH c(r, n) AS (VALUES {source}), t AS (SELECT r, n, r * sqrt(n - 2) / sqrt(1 - r * r) AS t FROM c) SELECT r, n, {two_sided('t', 'n')} FROM t"
    found = np.array(duckdb.connect().execute(sql).fetchall(), float)
    assert np.allclose(found[:, 2], correlation_p_values(found[:, 0], found[:, 1]), atol=1e-9)
