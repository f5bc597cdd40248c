"""Biased factors by stratified descent: equal to a sequential run, folds equal to separate fits, no worse than damped biases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefmill.operators import bias, metrics, sgd
from prefmill.session import freeze


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(8)
    users, items = 50, 40
    a, b = rng.normal(size=(users, 2)), rng.normal(size=(items, 2))
    m = 3 + 0.5 * rng.normal(size=(users, 1)) + 0.7 * rng.normal(size=items) + 0.5 * (a @ b.T)
    m = np.clip(np.round(m), 1, 5)
    seen = rng.random(m.shape) < 0.6
    seen[3] = True  # one user rated everything
    rows = [(u, i, float(m[u, i])) for u, i in zip(*(x.tolist() for x in np.nonzero(seen)))]
    return freeze(spark.createDataFrame(rows, "user_id long, item_id long, rating double"))


def hashed(spark, pairs, *rest):
    cols = ", ".join(["user_id", "item_id"][:len(pairs[0])] + [str(x) for x in rest])
    names = ["user_id", "item_id"][:len(pairs[0])]
    df = spark.createDataFrame(pairs, ", ".join(f"{n} long" for n in names))
    return {tuple(r[:len(names)]): r["h"] for r in df.select(*names, F.expr(f"xxhash64({cols})").alias("h")).collect()}


def test_equals_a_sequential_run_of_the_schedule(spark, planted):
    blocks, rank, rate, reg, epochs = 3, 4, 0.05, 0.02, 3
    model = sgd.fit_sgd(planted, rank, epochs, rate, reg, seed=1, blocks=blocks)
    rows = [tuple(r) for r in planted.collect()]
    mean = sum(r[2] for r in rows) / len(rows)
    side = []
    for s in (0, 1):
        ids = spark.createDataFrame(sorted({(0, r[s], 0) for r in rows}), "model int, id long, block int")
        first = {r.id: np.array(r.features) for r in sgd.start(ids, s, rank, 1).collect()}
        block = {k[0]: h % blocks for k, h in hashed(spark, [(i,) for i in first], 1).items()}
        side.append((first, {i: 0.0 for i in first}, block))
    (p, bu, ub), (q, bi, ib) = side
    for epoch in range(epochs):
        turn = hashed(spark, [r[:2] for r in rows], epoch, 1)
        for s in range(blocks):
            for u, i, r in sorted((r for r in rows if (ib[r[1]] - ub[r[0]]) % blocks == s), key=lambda r: (turn[r[:2]], r[0], r[1])):
                gap = r - (mean + bu[u] + bi[i] + p[u] @ q[i])
                bu[u] += rate * (gap - reg * bu[u])
                bi[i] += rate * (gap - reg * bi[i])
                p[u], q[i] = p[u] + rate * (gap * q[i] - reg * p[u]), q[i] + rate * (gap * p[u] - reg * q[i])
    for r in model.state.collect():
        vectors, biases = (p, bu) if r.side == 0 else (q, bi)
        assert np.allclose(r.features, vectors[r.id], atol=1e-12) and abs(r.bias - biases[r.id]) < 1e-12
    assert model.state.count() == len(p) + len(q)


def test_folds_together_equal_separate_fits_and_beat_damped_biases(planted):
    settings = dict(rank=4, epochs=12, rate=0.1, reg=0.05)
    got = {(r.folds, r.fold): r for r in sgd.cross_validate(planted, (3, 5), blocks=2, **settings).collect()}
    assert sorted(got) == [(3, f) for f in range(3)] + [(5, f) for f in range(5)]
    own = F.pmod(F.xxhash64("user_id", "item_id", F.lit(3)), F.lit(3))
    split = freeze(planted.withColumn("fold", own))
    alone = sgd.fit_sgd(split.where("fold <> 1"), seed=0, blocks=2, **settings)
    held = split.where("fold = 1").drop("fold")
    want = metrics.errors(sgd.predict_sgd(alone, held)).first()
    assert got[3, 1].rmse == pytest.approx(want["rmse"], abs=1e-9) and got[3, 1].mae == pytest.approx(want["mae"], abs=1e-9)
    assert sum(r.n for r in got.values()) == 2 * planted.count()
    damped = metrics.errors(bias.predict_biased(bias.fit_biased(split.where("fold <> 1"), rank=4, iters=5), held)).first()["rmse"]
    assert got[3, 1].rmse <= damped


def test_unknown_ids_and_no_ratings(spark, planted):
    model = sgd.fit_sgd(planted, 2, 1, blocks=1)
    odd = spark.createDataFrame([(999, 0), (0, 999), (999, 999)], "user_id long, item_id long")
    got = {(r.user_id, r.item_id): r.score for r in sgd.predict_sgd(model, odd).collect()}
    mean = model.means.first()["mean"]
    assert len(got) == 3 and got[999, 999] == pytest.approx(mean)
    none = sgd.fit_sgd(planted.limit(0), 2, 2)
    assert none.state.count() == 0 and sgd.predict_sgd(none, odd).count() == 0
