"""The two-tower model: gradients against differences, lanes, learning, and equal reruns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefmill.operators import metrics, pairmodel, towers
from prefmill.session import freeze


def test_gradients_equal_numeric_differences():
    rng = np.random.default_rng(1)
    w = towers.start(4, 5, 3)
    for k in w:
        w[k] = w[k] + 0.1 * rng.normal(size=w[k].shape)
    u, v, y = rng.normal(size=(9, 4)), rng.normal(size=(9, 4)), rng.random((9, 2))
    _, g, _ = towers.gradients(w, u, v, y)
    loss = lambda: ((towers.forward(w, u, v)[0] - y) ** 2).sum()
    assert set(g) == set(w)
    for k, x in w.items():
        for at in list(np.ndindex(x.shape))[::3]:
            was, x[at] = x[at], x[at] + 1e-6
            up = loss()
            x[at] = was - 1e-6
            slope = (up - loss()) / 2e-6
            x[at] = was
            assert abs(slope - g[k][at]) < 1e-4 * max(1, abs(slope)), (k, at)


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(40, 3)), rng.normal(size=(30, 3))
    stars = np.clip(np.round(3 + a[:, :1] - np.abs(a[:, 1:2]) + b[:, 0] ** 2 - b[:, 2]), 1, 5)  # a sum of towers, as the model is
    seen = rng.random(stars.shape) < 0.6
    rows = [(u, i, float(stars[u, i])) for u, i in zip(*(x.tolist() for x in np.nonzero(seen)))]
    ratings = freeze(spark.createDataFrame(rows, "user_id long, item_id long, rating double"))
    emb = pairmodel.Embeddings(
        freeze(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(a)], "user_id long, features array<double>")),
        freeze(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(b)], "item_id long, features array<double>")))
    return ratings.where("(user_id + item_id) % 5 > 0"), ratings.where("(user_id + item_id) % 5 = 0"), emb


def test_loss_falls_and_a_rerun_is_equal(planted):
    train, test, emb = planted
    runs = [towers.fit_towers(t, emb, hidden=16, batch=100, steps=40, rate=0.02) for t in (train, train.repartition(5))]
    assert np.mean(runs[0].losses[-5:]) < 0.5 * np.mean(runs[0].losses[:3])
    assert all(np.array_equal(runs[0].weights[k], runs[1].weights[k]) for k in runs[0].weights)
    scored = towers.score_towers(runs[0], test.select("user_id", "item_id"), emb)
    assert scored.columns == ["user_id", "item_id", "score", "dislike"] and scored.count() == test.count()
    assert metrics.roc_auc(metrics.labelled(scored, test)).first()["auc"] > 0.75


def test_lanes_are_summed_in_a_tree(planted):
    train, _, emb = planted
    model = towers.fit_towers(train, emb, hidden=4, batch=10000, steps=1, lane=60)  # one minibatch in many lanes
    data = towers.pair_table(train.select("user_id", "item_id", F.array(F.col("rating") / 5, (6 - F.col("rating")) / 5).alias("y")), emb)
    lanes = -(-data.count() // 60)
    rows = data.withColumn("lane", F.pmod(F.xxhash64("item_id", "user_id", F.lit(0)), F.lit(lanes))).collect()
    w, total = towers.start(3, 4, 0), 0.0
    for k in range(lanes):
        part = [r for r in rows if r.lane == k]
        total += towers.gradients(w, *(np.array([r[c] for r in part]) for c in ("u", "v", "y")))[0]
    assert lanes > 4 and model.losses == pytest.approx([total / (2 * len(rows))])


def test_no_pairs(spark, planted):
    train, _, emb = planted
    model = towers.fit_towers(train.limit(0), emb, hidden=4, steps=3)
    assert model.losses == []
