"""All eigenvalues of symmetric matrices in blocks, against numpy."""

import numpy as np
import pytest

from matloom.matrix import Matrix
from matloom.operators import jacobi


def of(spark, a):
    return Matrix.from_numpy(spark, a)


def test_every_two_meet_once(spark):
    from pyspark.sql import functions as F

    for players in (2, 4, 6, 10):
        every = spark.range(players).select("id", *[jacobi._partner(F.col("id"), t, players).alias(f"t{t}") for t in range(players - 1)]).toPandas().set_index("id")
        for t in every:
            assert all(every[t][every[t][b]] == b != every[t][b] for b in every.index)
        assert all(sorted(every.loc[b]) == [x for x in range(players) if x != b] for b in every.index)


@pytest.mark.parametrize(("n", "side", "kind"), [(12, 3, "any"), (10, 4, "any"), (5, 8, "any"), (12, 4, "equal"), (9, 3, "sparse")])
def test_values_and_vectors(spark, n, side, kind):
    draw = np.random.default_rng(n)
    a = draw.standard_normal((n, n))
    a = a + a.T
    if kind == "equal":  # three values, each of them four times
        q = np.linalg.qr(a)[0]
        a = q @ np.diag(np.repeat([3.0, 1.0, -2.0], 4)) @ q.T
    m = of(spark, a)
    if kind == "sparse":  # blocks without cells, a row of zeros
        a = np.diag([4.0, 1, 0, 3, 3, 0, 0, 2, 5])
        a[0, 8] = a[8, 0] = 1.5
        m = Matrix.from_coo(spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i long, j int, v double"), n, n)
    found = jacobi.eigen_blocks(m, side=side)
    np.testing.assert_allclose(found.values, np.sort(np.linalg.eigvalsh(a))[::-1], atol=1e-9)
    v = found.vectors.to_numpy()
    np.testing.assert_allclose(v.T @ v, np.eye(n), atol=1e-9)
    np.testing.assert_allclose(a @ v, v * found.values, atol=1e-8)
    assert (v[np.abs(v).round(9).argmax(0), np.arange(n)] > 0).all()


def test_values_alone_and_refusals(spark):
    zero = Matrix.from_coo(spark.createDataFrame([], "i long, j int, v double"), 6, 6)
    assert jacobi.eigen_blocks(zero, side=2, vectors=False).values.tolist() == [0.0] * 6
    with pytest.raises(ValueError):
        jacobi.eigen_blocks(of(spark, np.ones((2, 3))))
    with pytest.raises(ValueError):
        jacobi.eigen_blocks(of(spark, np.full((4, 4), np.nan)), side=2)


def test_eigen_leaves_the_driver_beyond_its_size(spark, monkeypatch):
    from matloom.operators import factor

    monkeypatch.setattr(factor, "LARGEST", 4)
    found = factor.eigen(of(spark, np.diag([1.0, 5, 3, 2, 4])))
    np.testing.assert_allclose(found.values, [5, 4, 3, 2, 1])
    assert isinstance(found.vectors, Matrix)
    with pytest.raises(ValueError):
        factor.eigen(of(spark, np.triu(np.ones((5, 5)))))
