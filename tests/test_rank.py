import numpy as np
import pytest

from prefmill.operators import rank


def cells_of(spark, a):
    r, c = np.nonzero(a)
    return spark.createDataFrame([(int(i) * 7, int(j) * 5, float(a[i, j])) for i, j in zip(r, c)], "row long, col long, value double")


@pytest.mark.parametrize("shape,r", [((40, 9), 9), ((40, 9), 4), ((9, 40), 6), ((30, 30), 17)])
@pytest.mark.parametrize("start", [256, 4])
def test_known_rank(spark, shape, r, start):
    rnd = np.random.default_rng(3)
    a = rnd.normal(size=(shape[0], r)) @ rnd.normal(size=(r, shape[1]))
    got = rank.stored_rank(cells_of(spark, a), start=start)
    assert got.exact and got.rank == r == np.linalg.matrix_rank(a)


def test_near_deficient_values(spark):
    """A singular value of 1e-10 counts, though its square is under the rounding unit."""
    rnd = np.random.default_rng(4)
    u, v = (np.linalg.qr(rnd.normal(size=(n, 5)))[0] for n in (200, 12))
    want = np.array([3, 1, 1e-4, 1e-10, 1e-18])
    got = rank.stored_rank(cells_of(spark, (u * want) @ v.T), tol=1e-13)
    assert got.rank == 4
    assert np.allclose(got.values[:4], want[:4], rtol=1e-4, atol=0)


def test_limit_repeats_and_empty(spark):
    a = np.diag(np.arange(1.0, 21))
    got = rank.stored_rank(cells_of(spark, a), start=4, limit=8)
    assert (got.rank, got.exact) == (8, False)
    df = spark.createDataFrame([(1, 1, 2.0), (1, 1, -2.0), (2, 1, 1.0), (2, 2, None)], "row long, col long, value double")
    assert rank.stored_rank(df).rank == 1
    assert rank.stored_rank(df.where("row > 5")).rank == 0
