import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from prefmill.operators import diversity, metrics, ordering, recommend, similar, stats
from prefmill.operators.scale import Span


@pytest.fixture(scope="module")
def scored(spark):
    rnd = random.Random(2)
    rows = [(round(rnd.random(), 1), rnd.randint(0, 1)) for _ in range(300)]
    return rows, spark.createDataFrame(rows, "score double, label int")


def test_roc_auc_with_ties(scored):
    rows, df = scored
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    got = metrics.roc_auc(df).first()
    assert np.isclose(got["auc"], want) and got["n_pos"] == len(pos)
    as_raw = df.select(F.col("score").alias("rawPrediction"), F.col("label").cast("double"))
    assert np.isclose(BinaryClassificationEvaluator(numBins=0).evaluate(as_raw), want)


def test_one_class_has_no_auc(spark):
    assert metrics.roc_auc(spark.createDataFrame([(0.1, 1), (0.4, 1)], "score double, label int")).first()["auc"] is None


def test_curves(scored):
    rows, df = scored
    p = sum(y for _, y in rows)
    got = {r["threshold"]: r for r in metrics.pr_curve(df).collect()}
    roc = {r["threshold"]: r for r in metrics.roc_curve(df).collect()}
    assert len(got) == len({s for s, _ in rows}) + 1 and (got[None]["precision"], got[None]["recall"]) == (1.0, 0.0)
    area, before = 0.0, None
    for t in sorted({s for s, _ in rows}, reverse=True):
        tp = sum(y for s, y in rows if s >= t)
        n = sum(1 for s, _ in rows if s >= t)
        assert np.isclose(got[t]["precision"], tp / n) and np.isclose(got[t]["recall"], tp / p)
        assert np.isclose(roc[t]["tpr"], tp / p) and np.isclose(roc[t]["fpr"], (n - tp) / (len(rows) - p))
        here = (tp / p, tp / n)
        area += (here[0] - (before[0] if before else 0)) * (here[1] + (before or here)[1]) / 2
        before = here
    assert np.isclose(metrics.pr_auc(df).first()["pr_auc"], area)


def test_running_totals_over_many_partitions(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    run, totals = ordering.running_totals(df.repartition(13), [F.desc("k")], ["v"])
    want, cum = {}, 0
    for k in range(999, -1, -1):
        cum += k % 7
        want[k] = cum
    assert {r["k"]: r["cum_v"] for r in run.collect()} == want and totals["v"] == cum


def test_errors_count_missing_predictions(spark):
    df = spark.createDataFrame([(3.0, 4.0), (5.0, 3.0)], "rating double, score double")
    r = metrics.errors(df, n_all=5).first()
    assert np.isclose(r["rmse"], np.sqrt(2.5)) and r["mae"] == 1.5 and r["rmse_all"] == 1.0


def test_histogram_last_bin_is_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.49,), (0.5,), (1.0,)], "x double")
    assert {r["bin"]: r["n"] for r in stats.histogram(df, "x", 0.0, 1.0, 2).collect()} == {1: 2, 2: 2}


def test_matrix_histogram_counts_empty_cells(tiny):
    rows, df = tiny
    got = {r["value"]: r["n"] for r in stats.matrix_histogram(df).collect()}
    shape = len({r[0] for r in rows}) * len({r[1] for r in rows})
    assert got[0.0] == shape - len(rows) and sum(got.values()) == shape


def test_pivot_takes_any_number_of_listed_columns_and_refuses_others(spark, tiny):
    rows, df = tiny
    wide = stats.pivot_ratings(df, list(range(2500)))
    assert len(wide.columns) == 2501
    got = {(r["user_id"], i): r[f"item_{i}"] for r in wide.collect() for i in range(15)}
    assert all(got[u, i] == r for u, i, r, _ in rows)
    with pytest.raises(ValueError):
        stats.pivot_ratings(df, [1, 2, 3])


def test_pearson_equals_numpy(tiny):
    rows, df = tiny
    m = np.zeros((12, 15))
    for u, i, r, _ in rows:
        m[u, i] = r
    used = [i for i in range(15) if m[:, i].any()]
    want = np.corrcoef(m[:, used].T)
    got = {r["item_id"]: r["pearson"] for r in similar.pearson_with(df, used[2]).collect()}
    for n, i in enumerate(used):
        assert np.isclose(got[i], want[2, n])


def test_titles_by_name(spark):
    items = spark.createDataFrame([(4, "a"), (2, "a"), (3, "b")], "item_id long, title string")
    assert similar.item_called(items, "a") == 2
    with pytest.raises(ValueError):
        similar.item_called(items, "c")


def test_unseen_and_favourites(spark, tiny):
    rows, df = tiny
    items = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "item_id long, title string")
    mine = {i for u, i, *_ in rows if u == 3}
    assert {r["item_id"] for r in recommend.unseen_candidates(items, df, 3).collect()} == set(range(20)) - mine
    assert {r["title"] for r in recommend.favourites(df, items, 3).collect()} == {f"t{i}" for u, i, r, _ in rows if u == 3 and r == 5}


# ------------------------------------------------------------- diversity

@pytest.fixture(scope="module")
def lists(spark):
    rng = np.random.default_rng(4)
    sim = rng.random((20, 20)) * (rng.random((20, 20)) < 0.7)
    sim = np.maximum(sim, sim.T)
    picks = {u: [int(i) for i in rng.choice(20, n, replace=False)] for u, n in enumerate((12, 12, 5, 2, 1))}
    rows = [(u, i, k + 1) for u, ids in picks.items() for k, i in enumerate(ids)]
    cells = spark.createDataFrame([(int(i), int(j), float(sim[i, j])) for i, j in zip(*np.nonzero(sim))], "row long, col long, value double")
    return picks, 1 - sim, spark.createDataFrame(rows, "user_id long, item_id long, rank int"), cells


def mean_pairs(far, ids):
    return np.mean([far[a, b] for n, a in enumerate(ids) for b in ids[n + 1:]])


def test_list_diversity(lists):
    picks, far, df, sims = lists
    packed = diversity.packed_by_cells(df, sims)
    for got in (diversity.list_diversity(df, sims), diversity.mean_distance(packed)):
        got = {r["user_id"]: r["diversity"] for r in got.collect()}
        assert sorted(got) == [0, 1, 2, 3]
        for u, v in got.items():
            assert np.isclose(v, mean_pairs(far, picks[u]))


def test_pair_distances(lists):
    picks, far, df, sims = lists
    got = {(r["user_id"], r["item_a"], r["item_b"]): r["distance"] for r in diversity.pair_distances(df, sims).collect()}
    want = {(u, a, b): far[a, b] for u, ids in picks.items() for n, a in enumerate(ids) for b in ids[n + 1:]}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_rerank_is_greedy(lists):
    picks, far, df, sims = lists
    got = {r["user_id"]: r for r in diversity.rerank(diversity.packed_by_cells(df, sims), 6).collect()}
    for u, ids in picks.items():
        chosen, rest = [ids[0]], ids[1:]
        while rest and len(chosen) < 6:
            means = [round(float(np.sum(far[chosen, c])), 12) for c in rest]
            chosen.append(rest.pop(int(np.argmax(means))))
        assert list(got[u]["items"]) == chosen
        if len(chosen) > 1:
            assert np.isclose(got[u]["diversity"], mean_pairs(far, chosen))


def test_factor_similarities_follow_list_order(spark):
    rng = np.random.default_rng(6)
    p, q = rng.normal(size=(8, 3)), rng.normal(size=(8, 3))
    m = p @ q.T
    pos = m > 0
    span = Span(float(m[pos].min()), float(m[pos].max()))
    far = 1 - np.where(pos, (m - span.low) / (span.high - span.low), 0)
    vec = lambda x: spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id long, features array<double>")
    ids = [5, 2, 7, 0]
    df = spark.createDataFrame([(1, i, k + 1) for k, i in enumerate(ids)], "user_id long, item_id long, rank int")
    got = diversity.mean_distance(diversity.packed_by_factors(df, vec(p), vec(q), span)).first()["diversity"]
    assert np.isclose(got, mean_pairs(far, ids))


def test_summary_takes_sorted_positions(spark):
    values = [0.3, 0.1, 0.9, 0.5, 0.5, 0.2, 0.7]
    r = diversity.summary(spark.createDataFrame([(v,) for v in values], "diversity double")).first()
    assert (r["median"], r["quarter"], r["n_users"]) == (sorted(values)[3], sorted(values)[1], 7)


def test_only_users_with_a_liked_training_item(spark, lists):
    _, _, df, _ = lists
    train = spark.createDataFrame([(0, 1, 2.0), (1, 1, 4.0), (3, 2, 3.0)], "user_id long, item_id long, rating double")
    assert {r["user_id"] for r in diversity.with_liked_train(df, train).collect()} == {1, 3}


def test_tasks_follow_work(spark):
    from prefmill.session import tasks_for
    cores = spark.sparkContext.defaultParallelism
    assert tasks_for(spark, 0, 10, 100) == 1
    assert tasks_for(spark, 15, 10, 100) == min(2, cores)
    assert tasks_for(spark, 100 * (cores + 5), 10, 100) == cores + 5
    assert tasks_for(spark, 1e15, 10, 100) >= 16 * cores
