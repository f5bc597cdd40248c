import numpy as np
import pytest
from pyspark.sql import functions as F

from prefmill.operators import bias, cells as C, factor, metrics, pairmodel, search
from prefmill.session import freeze


@pytest.fixture(scope="module")
def planted(spark):
    """Ratings from two hidden tastes, so that models can find something."""
    rng = np.random.default_rng(9)
    a, b = rng.random((60, 2)), rng.random((40, 2))
    m = np.clip(np.round(1 + 4 * (a @ b.T) / (a @ b.T).max()), 1, 5)
    seen = rng.random(m.shape) < 0.5
    rows = [(u, i, float(m[u, i]), int(rng.integers(0, 1000))) for u, i in zip(*(x.tolist() for x in np.nonzero(seen)))]
    df = freeze(spark.createDataFrame(rows, "user_id long, item_id long, rating double, ts long"))
    return df.where("ts % 10 < 8"), df.where("ts % 10 >= 8")


def test_als_beats_the_mean_and_repeats(planted):
    train, test = planted
    models = [factor.fit_ratings(train, 4, 8, 0.05) for _ in range(2)]
    got = [metrics.errors(factor.predict(m, test)).first()["rmse"] for m in models]
    base = metrics.mean_baseline(train, train.limit(0), test).first()["baseline_rmse"]
    assert got[0] < 0.8 * base and abs(got[0] - got[1]) < 1e-6


def test_biased_model_covers_unknown_ids_and_stays_on_the_scale(spark, planted):
    train, test = planted
    model = bias.fit_biased(train, rank=3, iters=5)
    base = metrics.mean_baseline(train, train.limit(0), test).first()["baseline_rmse"]
    assert metrics.errors(bias.predict_biased(model, test)).first()["rmse"] < base
    odd = spark.createDataFrame([(999, 0), (0, 999), (999, 999)], "user_id long, item_id long")
    got = bias.predict_biased(model, odd).collect()
    assert len(got) == 3 and all(1 <= r["score"] <= 5 for r in got)
    assert any(abs(r["score"] - model.biases.mean) < 1e-9 for r in got)


def test_als_leaves_out_unknown_ids(spark, planted):
    model = factor.fit_ratings(planted[0], 2, 2)
    assert factor.predict(model, spark.createDataFrame([(999, 0), (0, 1)], "user_id long, item_id long")).count() == 1


def test_nonnegative_factors(planted):
    s = freeze(C.item_gram(planted[0]))
    model = factor.als_fit(s, 3, 3, 0.1)
    low = factor.row_factors(model).select(F.explode("features").alias("x")).agg(F.min("x")).first()[0]
    assert low >= 0


def test_pair_model_learns(planted):
    train, test = planted
    model = factor.fit_ratings(train, 2, 8, 0.05)
    rows, cols = factor.row_factors(model), factor.col_factors(model)
    emb = pairmodel.two_sided_embeddings(C.graded(train), cols, cols, cols, cols, 2)
    assert len(emb.users.first()["features"]) == 4 and len(emb.items.first()["features"]) == 4
    net = pairmodel.fit_pair_model(train, emb, 2, hidden=16, iters=60)
    scored = metrics.labelled(pairmodel.score_with(net, test.select("user_id", "item_id"), emb), test)
    assert metrics.roc_auc(scored).first()["auc"] > 0.7


def test_grid_marks_the_best(spark):
    got = search.search(spark, search.grid(a=[1, 2], b=[3, 1]), lambda a, b: a * b).collect()
    assert [(r["a"], r["b"]) for r in got if r["best"]] == [(2, 3)] and len(got) == 4
    got = search.search(spark, search.grid(a=[1, 2]), lambda a: a, largest=False).collect()
    assert [r["a"] for r in got if r["best"]] == [1]


def test_settings_run_side_by_side(spark):
    """At most ``at_once`` at a time, results in order, errors raised, the caller's pool untouched."""
    import threading
    import time
    now, most, lock = [0], [0], threading.Lock()

    def measure(a):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.2)
        n = spark.range(a).count()
        pool = spark.sparkContext.getLocalProperty(search.POOL)
        with lock:
            now[0] -= 1
        assert pool is not None
        return n

    got = search.search(spark, search.grid(a=[5, 3, 9, 1, 7]), measure, at_once=2).collect()
    assert [(r["a"], r["metric"]) for r in got] == [(5, 5.0), (3, 3.0), (9, 9.0), (1, 1.0), (7, 7.0)]
    assert most[0] == 2 and [r["a"] for r in got if r["best"]] == [9]
    assert spark.sparkContext.getLocalProperty(search.POOL) is None
    with pytest.raises(ZeroDivisionError):
        search.search(spark, search.grid(a=[1, 0, 2]), lambda a: 1 / a)
