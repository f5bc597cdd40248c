"""The dense graded Y (Y^T X), cut below 0.2, against numpy; and factors of stacks that hold it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefmill.operators import cells as C, nmf, propagated as P, scale
from prefmill.session import freeze


def ratings(spark, stars):
    rows = [(u, i, float(stars[u, i]), 0) for u, i in zip(*(x.tolist() for x in np.nonzero(stars)))]
    return freeze(spark.createDataFrame(rows, "user_id long, item_id long, rating double, ts long"))


@pytest.fixture(scope="module", params=[(14, 11, 0.4, 1 << 20), (40, 9, 0.15, 9)])
def made(request, spark):
    users, items, share, rows = request.param
    rng = np.random.default_rng(users)
    popular = rng.random(items) ** 2  # columns far apart, so that the cut meets some, all and none of their cells
    stars = rng.integers(1, 6, (users, items)) * (rng.random((users, items)) < share + popular)
    stars[0], stars[:, 0] = 5, 4
    x, y = stars / 5, (6 - stars) / 5
    far = y @ (y.T @ x)
    scaled = (far - far.min()) / (far.max() - far.min())
    return ratings(spark, stars), x, np.where(scaled < 0.2, 0, scaled), far, rows


def spelt(far, shape):
    """All cells of the operand, from its parts."""
    out = np.zeros(shape)
    mass = {r.user_id: r.mass for r in far.mass.collect()}
    x = np.zeros(shape)
    for r in far.prefs.collect():
        x[r.user_id, r.item_id] = r.x
    s = np.zeros((shape[1],) * 2)
    for r in far.s.collect():
        s[r.row, r.col] = r.value
    for r in far.columns.where("whole").collect():
        out[:, r.col] = [r.flat - r.slope * mass[u] for u in range(shape[0])] + x @ s[:, r.col]
    for r in far.fixes.collect():
        out[r.row, r.col] += r.value
    return out


def test_cells_sums_and_squares(made):
    r, x, want, plain, rows = made
    far = P.propagated(r, x.shape[1], block_rows=rows, tile_rows=4 * rows)
    assert np.isclose(far.low, plain.min()) and np.isclose(far.high, plain.max()) and far.opened <= far.n_pairs
    assert np.allclose(spelt(far, x.shape), want)
    assert {c.col: round(c.total, 9) for c in P.column_sums(far).collect()} == pytest.approx(
        {j: round(v, 9) for j, v in enumerate(want.sum(0))})
    assert np.isclose(P.square_sum(far), (want ** 2).sum())
    cheaper = np.minimum((want == 0).sum(0), (want > 0).sum(0)).sum()
    assert far.fixes.count() <= cheaper + x.shape[0] // 2


def test_factors_of_the_stack_against_dense_updates(spark, made):
    r, x, far, _, rows = made
    if rows < 100:
        pytest.skip("one stack is enough")
    users, items = x.shape
    scaled_x = np.where(x > 0, (x - x[x > 0].min()) / (x.max() - x[x > 0].min()), 0)
    t = np.vstack((scaled_x, far))
    upper = scale.minmax_positive(freeze(C.as_cells(C.graded(r), "x")))
    m = P.nmf_above(freeze(upper), P.propagated(r, items), 1000, 3, 4)
    row_ids, col_ids = [*range(users), *range(1000, 1000 + users)], list(range(items))
    size = float(2 * np.sqrt(t.sum() / (len(row_ids) * items * 3)))
    ids = lambda v: spark.createDataFrame([(i,) for i in v], "id long")
    at = lambda df: {q.id: q.features for q in df.collect()}
    start = [at(nmf._start(ids(v), 3, seed, size)) for v, seed in ((row_ids, 0), (col_ids, 1))]
    w, h = np.array([start[0][i] for i in row_ids]), np.array([start[1][i] for i in col_ids]).T
    losses = []
    for _ in range(4):
        w = w * (t @ h.T) / (w @ h @ h.T + nmf.TINY)
        h = h * (w.T @ t) / (w.T @ w @ h + nmf.TINY)
        losses.append(((t - w @ h) ** 2).sum())
    assert np.allclose(m.losses, losses) and losses[-1] < losses[0]
    rows, cols = at(m.rows), at(m.cols)
    assert np.allclose([rows[i] for i in row_ids], w) and np.allclose([cols[i] for i in col_ids], h.T)


def test_without_a_cut_every_column_is_whole(made):
    r, x, _, plain, _ = made
    far = P.propagated(r, x.shape[1], cut=0.0)
    assert far.fixes.count() == 0 and far.columns.where(~F.col("whole")).count() == 0
    assert np.allclose(spelt(far, x.shape), (plain - plain.min()) / (plain.max() - plain.min()))
