"""Cell algebra against dense numpy formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefmill.operators import cells as C, factor, nmf, product, scale, score, twosided
from prefmill.session import freeze


def dense(cells, shape, value="value"):
    m = np.zeros(shape)
    for r in cells.collect():
        m[r["row"], r["col"]] += r[value]
    return m


def table(spark, m):
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "row long, col long, value double")


def rated(spark, m):
    return spark.createDataFrame([(int(u), int(i), float(m[u, i]), int(u * 7 + i)) for u, i in zip(*np.nonzero(m))],
                                 "user_id long, item_id long, rating double, ts long")


@pytest.fixture(scope="module")
def stars():
    rng = np.random.default_rng(3)
    m = rng.integers(1, 6, (14, 11)) * (rng.random((14, 11)) < 0.5)
    m[0] = 5  # one user with everything
    return m


@pytest.mark.parametrize("budget", [1 << 27, 30, 5, 1])
def test_products_with_hot_keys_split(spark, stars, budget):
    m = table(spark, stars)
    assert np.allclose(dense(product.gram(m, budget), (11, 11)), stars.T @ stars)
    other = stars * (stars < 3)
    l = m.select(F.col("row").alias("key"), F.col("col").alias("row"), "value")
    r = table(spark, other).withColumnRenamed("row", "key")
    assert np.allclose(dense(product.cross_product(l, r, budget), (11, 11)), stars.T @ other)


def test_block_product_dense_and_sparse_agree(stars):
    rng = np.random.default_rng(0)
    key = np.repeat(np.arange(40), 6)
    cols = {"key": key, "part": key * 0, "id": np.concatenate([rng.choice(900, 6, replace=False) for _ in range(40)]),
            "value": rng.random(240), "is_row": np.ones(240, bool), "is_col": np.ones(240, bool)}
    want = np.zeros((900, 900))
    for g in range(40):
        v = np.zeros(900)
        v[cols["id"][key == g]] = cols["value"][key == g]
        want += np.outer(v, v)
    rows, rx = np.unique(cols["id"], return_inverse=True)
    nr = np.bincount(key)
    saved = product.BLOCK_CELLS, product.EXPAND
    try:
        product.BLOCK_CELLS, product.EXPAND = 3000, 50
        for part in (product._dense(40, key, rx, cols["value"], key, rx, cols["value"], rows, rows, False),
                     product._sparse(key, rx, cols["value"], rx, cols["value"], nr, rows, rows, False)):
            got = np.zeros((900, 900))
            for i, j, v in part:
                np.add.at(got, (i, j), v)
            assert np.allclose(got, want)
    finally:
        product.BLOCK_CELLS, product.EXPAND = saved


def test_binary_matrices(spark, stars):
    x = (stars >= 3).astype(float)
    y = (stars > 0) - x
    r = rated(spark, stars)
    assert np.allclose(dense(C.binary_cross(r), (11, 11)), y.T @ x)
    assert np.allclose(dense(C.binary_propagation(r), (14, 11)), y @ y.T @ x)


def graded(stars):
    return stars / 5, (6 - stars) / 5


def scaled(m):
    pos = m > 0
    return np.where(pos, (m - m[pos].min()) / (m[pos].max() - m[pos].min()), 0)


def test_graded_negative_side_without_dense_matrix(spark, stars):
    x, y = graded(stars)
    r = freeze(rated(spark, stars))
    s, base = freeze(C.item_gram(r)), C.column_base(r)
    got = {(v["row"], v["col"]): v["value"] for v in C.graded_cross(s, base, 11).collect()}
    want = y.T @ x
    for i in range(11):
        for j in range(11):
            assert abs(got.get((i, j), got.get((None, j))) - want[i, j]) < 1e-9
    m = twosided.build(r, 11)
    cells = spark.createDataFrame([(u, i) for u in range(14) for i in range(11)], "user_id long, item_id long")
    at = lambda df: {(v["user_id"], v["item_id"]): v["score"] for v in df.collect()}
    far, both = at(twosided.propagate(m, r, cells)), at(twosided.scores(m, r, cells, 0.2))
    want_far = y @ want
    want_both = np.hstack((x, 0.2 * y)) @ np.vstack((scaled(x.T @ x), scaled(want)))
    for u in range(14):
        for i in range(11):
            assert abs(far[u, i] - want_far[u, i]) < 1e-9
            assert abs(both[u, i] - want_both[u, i]) < 1e-9


def test_scaling_edges(spark):
    flat = spark.createDataFrame([(0, 0, 2.0), (0, 1, 2.0)], "row long, col long, value double")
    assert [r["value"] for r in scale.minmax_positive(flat).collect()] == [1.0, 1.0]
    m = spark.createDataFrame([(0, 0, 2.0), (0, 1, 4.0)], "row long, col long, value double")
    assert [r["value"] for r in scale.minmax_positive(m).orderBy("col").collect()] == [0.0, 1.0]
    assert [r["value"] for r in scale.minmax_all(m, 4).orderBy("col").collect()] == [0.5, 1.0]
    assert [r["value"] for r in scale.minmax_all(m, 2).orderBy("col").collect()] == [0.0, 1.0]
    assert scale.sparsify(scale.zero_below(m, 3.0)).count() == 1


def test_stacking_round_trip(spark, stars):
    m = table(spark, stars)
    for stack, axis in ((C.vstack, "row"), (C.hstack, "col")):
        tall = stack(m, C.transpose(m), 20)
        a, b = C.unstack(tall, 20, axis)
        assert np.allclose(dense(a, (14, 11)), stars) and np.allclose(dense(b, (11, 14)), stars.T)


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 9, "tile_rows": 13}])
def test_scores_and_lists(spark, stars, sizes):
    r = freeze(rated(spark, stars))
    s = freeze(C.star_gram(r))
    prefs = r.select("user_id", "item_id", F.col("rating").alias("value"))
    full = stars @ (stars.T @ stars)
    cells = spark.createDataFrame([(u, i) for u in range(16) for i in range(13)], "user_id long, item_id long")
    for v in score.score_cells(prefs, s, cells, **sizes).collect():
        inside = v["user_id"] < 14 and v["item_id"] < 11
        assert v["score"] == (full[v["user_id"], v["item_id"]] if inside else 0)
    for hide in (True, False):
        got = {}
        for v in score.top_items(prefs, s, 4, hide_seen=hide, **sizes).collect():
            got.setdefault(v["user_id"], {})[v["rank"]] = v["item_id"]
        for u in range(14):
            free = [i for i in range(11) if full[u, i] > 0 and not (hide and stars[u, i])]
            want = sorted(free, key=lambda i: (-full[u, i], -i))[:4]
            assert [got.get(u, {})[k] for k in sorted(got.get(u, {}))] == want


def test_lists_from_factors_with_seen_cells(spark, stars):
    rng = np.random.default_rng(1)
    u, v = rng.normal(size=(14, 3)), rng.normal(size=(11, 3))
    vec = lambda m, name: spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(m)], f"{name} long, features array<double>")
    seen = rated(spark, stars).select("user_id", "item_id")
    got = {}
    for r in score.top_by_factors(vec(u, "user_id"), vec(v, "id"), 3, seen).collect():
        got.setdefault(r["user_id"], {})[r["rank"]] = r["item_id"]
    for x in range(14):
        free = [i for i in range(11) if not stars[x, i]]
        want = sorted(free, key=lambda i: -(u[x] @ v[i]))[:3]
        assert [got.get(x, {})[k] for k in sorted(got.get(x, {}))] == want


def test_factor_formulas(spark, stars):
    rng = np.random.default_rng(2)
    p, q = rng.random((11, 3)), rng.random((11, 3))
    vec = lambda m, name="id": spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(m)], f"{name} long, features array<double>")
    rows, cols = vec(p), vec(q)
    x, y = graded(stars)
    prefs = C.graded(rated(spark, stars))
    users = factor.user_vectors(prefs, rows, 3)
    got = {r["user_id"]: r["features"] for r in users.collect()}
    assert np.allclose([got[u] for u in range(14)], x @ p)
    got = {r["user_id"]: r["features"] for r in factor.dislike_vectors(users, rows, 3).collect()}
    assert np.allclose([got[u] for u in range(14)], y @ p)
    cells = spark.createDataFrame([(i, j) for i in range(11) for j in range(11)], "row long, col long")
    r_hat = p @ q.T
    assert np.allclose(dense(factor.similarity_of_pairs(cells, rows, cols, 3), (11, 11)), r_hat.T @ r_hat)
    span = factor.product_span(rows, cols, block=4)
    assert np.isclose(span.low, r_hat.min()) and np.isclose(span.high, r_hat.max())
    assert factor.matrix_rank(rows, cols, 3) == 3
    done = factor.complete_factors(spark.range(13).select("id"), rows, 3).orderBy("id").collect()
    assert done[12]["features"] == [0.0, 0.0, 0.0] and np.allclose(done[4]["features"], p[4])


def test_small_matrices_by_als(spark):
    anti = spark.createDataFrame([(0, 2, 5.0), (1, 1, 1.0), (2, 0, 5.0)], "row int, col int, value float")
    model = factor.als_fit(anti, 3, 10, 0.01, seed=44444)
    got = {(r["user_id"], r["item_id"]): r["score"] for r in factor.predict(model, spark.createDataFrame([(i, j) for i in range(3) for j in range(3)], "user_id int, item_id int")).collect()}
    assert abs(got[0, 2] - 5) < 0.5 and abs(got[1, 1] - 1) < 0.5


def loss_of(m, model):
    n = [np.zeros((len(m), 3)), np.zeros((m.shape[1], 3))]
    for t, f in zip(n, (model.rows, model.cols)):
        for r in f.collect():
            t[r["id"]] = r["features"]
    assert (n[0] >= 0).all() and (n[1] >= 0).all()
    return ((m - n[0] @ n[1].T) ** 2).sum()


def test_nmf_counts_zeros_and_its_loss_falls(spark, stars):
    model = nmf.nmf_fit(freeze(table(spark, stars)), 3, 3)
    assert model.losses == sorted(model.losses, reverse=True)
    assert np.isclose(model.losses[-1], loss_of(stars, model))


def test_nmf_of_a_dense_matrix_kept_as_base_and_cells(spark, stars):
    x, y = graded(stars)
    r = freeze(rated(spark, stars))
    s, base = freeze(C.item_gram(r)), freeze(C.column_base(r))
    model = nmf.nmf_fit(freeze(s.withColumn("value", -F.col("value"))), 3, 3,
                        base=base.select("col", F.col("base").alias("value")), row_ids=spark.range(11).select("id"))
    assert model.losses == sorted(model.losses, reverse=True)
    assert np.isclose(model.losses[-1], loss_of(y.T @ x, model))


def test_two_sided_nmf_scores(spark, stars):
    x, y = graded(stars)
    r = freeze(rated(spark, stars))
    m = twosided.build(r, 11)
    model = twosided.fit_nmf(m, spark.range(11), 11, 3, 3)
    t = np.vstack((scaled(x.T @ x), scaled(y.T @ x)))
    assert np.isclose(model.losses[-1], loss_of(t, model)) and model.losses == sorted(model.losses, reverse=True)
    w, h = np.zeros((22, 3)), np.zeros((11, 3))
    for table_, df in ((w, model.rows), (h, model.cols)):
        for row in df.collect():
            table_[row["id"]] = row["features"]
    t_hat = w @ h.T
    want = np.hstack((x, 0.5 * y)) @ np.vstack((scaled(t_hat[:11]), scaled(t_hat[11:])))
    cells = spark.createDataFrame([(u, i) for u in range(14) for i in range(11)], "user_id long, item_id long")
    got = twosided.nmf_scores(model, 11, 11, r, cells, 3).collect()
    assert len(got) == 154 and all(np.isclose(v["score"], want[v["user_id"], v["item_id"]]) for v in got)


def test_best_component_values_against_numpy_and_fewer_rounds(spark):
    rng = np.random.default_rng(6)
    t = rng.random((25, 3)) @ rng.random((3, 18)) * (rng.random((25, 18)) < 0.7)
    cells = freeze(spark.createDataFrame(
        [(i, j, float(t[i, j])) for i, j in zip(*(x.tolist() for x in np.nonzero(t)))], "row long, col long, value double"))
    plain = nmf.nmf_fit(cells, 3, 15, marks=(5, 15))
    assert sorted(plain.marks) == [5, 15] and plain.marks[5].losses == plain.losses[:5]
    fast = nmf.hals(cells, 3, tol=0.1, most=20)
    size = float(2 * np.sqrt(t.sum() / (25 * 18 * 3)))
    at = lambda df: np.array([q.features for q in sorted(df.collect())])
    ids = lambda n: spark.createDataFrame([(i,) for i in range(n)], "id long")
    w, h = at(nmf._start(ids(25), 3, 0, size)), at(nmf._start(ids(18), 3, 1, size))
    losses = []
    for _ in fast.losses:
        for a, b, m in ((w, h, t), (h, w, t.T)):
            for d in range(3):
                g = b.T @ b
                a[:, d] = np.maximum(0, a[:, d] + ((m @ b)[:, d] - a @ g[:, d]) / g[d, d])
        losses.append(((t - w @ h.T) ** 2).sum())
    assert np.allclose(fast.losses, losses) and np.allclose(at(fast.rows), w) and np.allclose(at(fast.cols), h)
    reached = next(i for i, x in enumerate(fast.losses, 1) if x <= plain.losses[-1])
    assert reached < 8 and len(fast.losses) < 20  # half the rounds, and a stop before the last
