"""Rows by runs, versions of assigned cells, heavy inner indexes, against numpy."""

import numpy as np
import pytest

from matloom.matrix import Matrix
from matloom.operators import products, subset
from matloom.operators.subset import Rows
from matloom.sources.store import Store

N = 23
CHOICES = {
    "all": None, "run": slice(3, 9), "step": slice(1, None, 4), "backwards": slice(None, None, -3), "none": slice(5, 5), "one": 7, "last": range(20, 23),
    "list": [0, 1, 2, 7, 8, 22], "not one": ("not", 4), "not run": ("not", slice(2, 6)), "not step": ("not", slice(1, 20, 3)), "not not": ("not", ("not", [1, 2, 9])),
    "not unsorted": ("not", [9, 1, 9, 2]), "not all": ("not", None), "not none": ("not", []), "recycled": [True, False, True], "not recycled": ("not", [False, True, True, False]), "long mask": [k % 5 < 2 for k in range(40)],
    "unsorted": [4, 4, 0],
}


def wanted(index):
    every = np.arange(N)
    if isinstance(index, tuple):
        return np.setdiff1d(every, wanted(index[1]))
    if index is None or isinstance(index, slice):
        return every[index or slice(None)]
    values = np.atleast_1d(np.asarray(index))
    return every[np.resize(values, N)] if values.dtype == bool else every[values.astype(int)]


def test_rows(spark, monkeypatch):
    a = np.arange(N * 2.0).reshape(N, 2)
    m = Matrix.from_numpy(spark, a).with_labels([f"r{k}" for k in range(N)], ["a", "b"])
    m = Matrix(m.df.cache(), *m.dim, "rows", m.row_labels.cache(), m.col_labels)
    for most in (32, 0):  # as expressions and looked up
        monkeypatch.setattr(subset, "MOST_RUNS", most)
        for name, index in CHOICES.items():
            found, at = m[index, :], wanted(index)
            assert found.dim == (len(at), 2), name
            np.testing.assert_array_equal(found.to_numpy(), a[at], err_msg=name)
        named = m[("not", [0, 3]), :].row_labels.orderBy("idx").toPandas()
        assert named["idx"].tolist() == list(range(N - 2)) and named["name"].tolist() == [f"r{k}" for k in wanted(("not", [0, 3]))]


def test_runs_of_many_rows_are_few():
    n = 10**9
    found = Rows.of(("not", slice(5, n, 7)), n)
    assert len(found) == n - len(range(5, n, 7)) and len(found.runs) <= 3
    assert len(Rows.of(("not", [0, 10**8, 3]), n).runs) == 3 and len(Rows.of(("not", [0, 10**8, 3]), n)) == n - 3
    assert len(Rows.of([True, False], n)) == n // 2
    with pytest.raises(IndexError):
        Rows.of([3, n], n)
    with pytest.raises(IndexError):
        Rows.of(("not", [-1]), n)


def test_ranges_reach_the_scan(spark, tmp_path):
    Matrix.from_numpy(spark, np.ones((50, 2))).df.write.parquet(str(tmp_path / "m"))
    m = Matrix(spark.read.parquet(str(tmp_path / "m")), 50, 2, "rows")
    plan = m[[*range(10, 20), *range(30, 35)], :].df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(i,10)" in plan and "LessThan(i,35)" in plan and "Or(" in plan


@pytest.mark.parametrize("layout", ["to_wide", "to_rows", "to_coo"])
def test_versions(spark, tmp_path, layout):
    a = np.arange(15.0).reshape(5, 3)
    store = Store(spark, str(tmp_path))
    store.write("g/a", getattr(Matrix.from_numpy(spark, a), layout)())
    steps = [a.copy()]
    for rows, cols, value in ((slice(0, 2), [1], -1.0), ([4], [0, 2], [[7.0, 8.0]]), (("not", [0]), [2], [1.0, 2.0])):
        store.assign("g/a", rows, cols, value)
        a[np.ix_(np.arange(1, 5) if isinstance(rows, tuple) else np.arange(5)[rows], cols)] = np.resize(value, (1, 2)) if np.ndim(value) == 2 else np.resize(value, (4, 1)) if np.ndim(value) else value
        steps.append(a.copy())
    assert store.versions("g/a") == (0, 3)
    for k, step in enumerate(steps):
        np.testing.assert_array_equal(store.open("g/a", version=k).to_numpy(), step)
    # twice the same cell: the later one; no value: NaN; outside: left out
    patch = spark.createDataFrame([(0, 0, 5.0, 1), (0, 0, 4.0, 2), (3, 1, None, 1), (9, 0, 1.0, 1), (0, -1, 1.0, 1)], "i long, j int, w double, at int")
    a[0, 0], a[3, 1] = 4, np.nan
    np.testing.assert_array_equal(store.assign_cells("g/a", patch).to_numpy(), a)
    np.testing.assert_array_equal(store.compact("g/a").to_numpy(), a)
    assert store.versions("g/a") == (4, 4) and store.compact("g/a").dim == (5, 3)
    with pytest.raises(ValueError):
        store.open("g/a", version=1)
    if layout == "to_rows":
        assert store.append("g/a", Matrix.from_numpy(spark, [[1.0, 2, 3]])).to_numpy()[5].tolist() == [1, 2, 3]
    store.assign("g/a", [0], [0], 1.0)
    a[0, 0] = 1
    np.testing.assert_array_equal(store.open("g/a").to_numpy()[:5], a)


@pytest.mark.parametrize("most", [1, 6, 50])
def test_heavy_inner_indexes(spark, most):
    draw = np.random.default_rng(most)
    a, b = (draw.integers(-2, 3, s) * (draw.random(s) < 0.2) for s in ((30, 8), (8, 20)))
    a[:, 2], b[2], b[5, ::2], a[:, 6] = 1, 2, 3, 1  # long on both sides, on one, on the other
    b[6] = 0
    b[6, 3] = 4
    left, right = Matrix.from_numpy(spark, a).to_coo(), Matrix.from_numpy(spark, b).to_coo()
    np.testing.assert_array_equal(products.multiply_sparse(left, right, strategy="cells", most=most).to_numpy(), a @ b)
    heavy = {r["k"]: r["nx"] * r["ny"] for r in products._heavy(left.df.where("v <> 0").select("i", "j", "v").withColumnRenamed("j", "k"), right.df.where("v <> 0").withColumnRenamed("i", "k"), most).collect()}
    for k in range(8):
        pairs = np.count_nonzero(a[:, k]) * np.count_nonzero(b[k])
        assert (k in heavy) == (pairs > most) and heavy.get(k, 1) >= pairs / most / 1.0001 or pairs <= most


def test_rows_without_a_key_do_not_meet_others(spark):
    from matloom.operators.restructure import cbind

    table = spark.createDataFrame([(3, 1.0), (1, 2.0), (2, 3.0)], "k long, x double")
    loose, other, keyed = (Matrix.from_columns(table, ["x"], key) for key in (None, None, "k"))
    for a, b in ((loose, other), (loose, keyed), (keyed, loose)):
        for join in (lambda: a + b, lambda: cbind(a, b), lambda: products.crossprod(a, b)):
            with pytest.raises(ValueError, match="key"):
                join()
    assert sorted((loose + loose).to_coo().df.toPandas()["v"]) == [2, 4, 6] and (keyed + keyed).to_numpy().ravel().tolist() == [4, 6, 2]


def test_names_of_bound_columns(spark):
    from matloom.operators.restructure import cbind

    a, b = (Matrix.from_numpy(spark, np.ones((2, 2))).with_labels(None, names) for names in (["a", "b"], ["c", "d"]))
    assert [r["name"] for r in cbind(a, b).col_labels.orderBy("idx").collect()] == ["a", "b", "c", "d"]
    assert cbind(a, Matrix.from_numpy(spark, np.ones((2, 1)))).col_labels is None
