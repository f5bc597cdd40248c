"""Nothing is lost or changed by nulls, signs, large ids, hot keys or the number of cores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefmill.operators import factor, metrics, ordering, product, score, search, splits, twosided
from prefmill.operators.cells import graded
from prefmill.operators.nmf import Nmf
from prefmill.session import freeze, freezing
from prefmill.sources import blocks, sinks


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_parts_by_time_add_up_with_and_without_times(spark, tiny, share):
    rows, df = tiny
    some = df.withColumn("ts", F.when(F.col("rating") > 3, F.col("ts")))
    none = df.withColumn("ts", F.lit(None).cast("long"))
    for times in (some, none):
        for shares in ((0.8,), (0.5, 0.9)):
            parts = splits.parts_by_time(times, *shares)
            sizes = [int(len(rows) * s) for s in (*shares, 1)]
            assert [p.count() for p in parts] == list(np.diff([0, *sizes]))
            named = splits.by_time(times, *shares).groupBy("role").count().collect()
            assert sorted(r["count"] for r in named) == sorted(p.count() for p in parts)
    late = splits.parts_by_time(some, 0.99)[1]
    assert late.where("ts IS NULL").count() == 0  # rows without a time come first


def test_cuts_with_nulls_in_a_later_column(spark):
    rows = [(1, None), (1, 5), (None, 2), (None, None), (2, -7), (2, 0)]
    df = spark.createDataFrame(rows, "a long, b long")
    order = sorted(rows, key=lambda r: [(v is not None, v or 0) for v in r])
    _, cuts = ordering.rank_cuts(df, ["a", "b"], list(range(7)))
    for p, cut in enumerate(cuts):
        got = [tuple(r) for r in df.where(ordering.is_before(["a", "b"], cut)).collect()]
        assert sorted(got, key=str) == sorted(order[:p], key=str)


def test_capped_test_rows_by_a_cut(tiny):
    rows, df = tiny
    got = splits.all_but(df, 1, 3, max_test=7).where("role = 'test'").select("user_id", "item_id").collect()
    want = []
    for u in range(12):
        want += sorted((v, i) for v, i, _, _ in rows if v == u)[:3]
    assert sorted(tuple(r) for r in got) == sorted(want)[:7]


def test_products_that_cancel_are_stored_either_way():
    key = np.array([0, 0, 1, 1, 2, 2])
    cols = {"key": key, "part": key * 0, "id": np.array([3, 5, 3, 5, 3, 9]), "value": np.array([1.0, 1.0, 1.0, -1.0, 2.0, -2.0]),
            "is_row": np.ones(6, bool), "is_col": np.ones(6, bool)}
    rows, rx = np.unique(cols["id"], return_inverse=True)
    total = []
    for part in (product._dense(3, key, rx, cols["value"], key, rx, cols["value"], rows, rows, False),
                 product._sparse(key, rx, cols["value"], rx, cols["value"], np.bincount(key), rows, rows, False)):
        got = {}
        for r, c, v in part:
            for i, j, x in zip(r.tolist(), c.tolist(), v.tolist()):
                got[i, j] = got.get((i, j), 0) + x
        total.append(got)
    assert total[0] == total[1] and total[0][3, 5] == 0


def test_a_key_long_on_one_side_is_split(spark, monkeypatch):
    monkeypatch.setattr(product, "SIDE_BUDGET", 10)
    left = freeze(spark.range(95).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("row"), F.lit(1.0).alias("value")))
    right = spark.createDataFrame([(1, 7, 2.0)], "key long, col long, value double")
    heavy, _ = product._heavy(left.groupBy("key").agg(F.count("*").alias("nl")).withColumn("nr", F.lit(1)), product.PAIR_BUDGET)
    assert heavy.first()["p"] == 10
    got = product.cross_product(left, freeze(right)).collect()
    assert sorted((r["row"], r["col"], r["value"]) for r in got) == [(i, 7, 2.0) for i in range(95)]


def test_als_takes_ids_of_any_size(spark, tiny):
    rows, df = tiny
    far = 3_000_000_000
    moved = freeze(df.select((F.col("user_id") + far).alias("user_id"), (F.col("item_id") - 2 * far).alias("item_id"), "rating"))
    model = factor.fit_ratings(moved, 3, 6, 0.05)
    assert {r["id"] for r in factor.row_factors(model).collect()} == {u + far for u, *_ in rows}
    known = factor.predict(model, moved)
    assert known.count() == len(rows) and metrics.errors(known).first()["rmse"] < 1.0
    asked = spark.createDataFrame([(far, 5), (1 << 40, -2 * far)], "user_id long, item_id long")
    assert factor.predict(model, asked).count() == 0


def test_group_bounds_follow_the_rows_not_the_cores(spark):
    prefs = spark.range(5000).select(F.col("id").alias("user_id"), F.lit(1).alias("item_id"), F.lit(1.0).alias("value"))
    matrix = spark.range(100)
    blocks_, tiles = score._grid(prefs, matrix, prefs, block_rows=10, tile_rows=7)
    assert blocks_ >= 1000 and tiles == 15


def test_only_asked_tiles_are_sent(spark, tiny):
    _, df = tiny
    prefs = df.select("user_id", "item_id", F.col("rating").alias("value"))
    matrix = freeze(spark.range(15 * 15).select((F.col("id") % 15).alias("row"), F.floor(F.col("id") / 15).alias("col"), F.lit(1.0).alias("value")))
    one = spark.createDataFrame([(3, 4)], "user_id long, item_id long")
    sent = score._groups(prefs, matrix, one, ["value"], 4, 6, wanted=True)
    users = {r["a"] for r in sent.where("side = 0").select("a").distinct().collect()}
    assert users == {3} and sent.select("block", "tile").distinct().count() == 1
    want = df.where("user_id = 3").agg(F.sum("rating")).first()[0]
    assert score.score_cells(prefs, matrix, one, block_rows=9, tile_rows=13).first()["score"] == want


def test_popular_items_are_cut_by_their_rows(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("user_id"), F.lit(4).cast("long").alias("item_id"), F.lit(3.0).alias("rating"), F.lit(0).cast("long").alias("ts"))
    path = str(tmp_path / "out")
    sinks.write_blocks(df, path, piece_rows=10)
    assert spark.read.text(path).where("value = '4:'").count() > 60
    assert blocks.read_blocks(spark, path).where("item_id = 4").count() == 1000


def test_a_metric_that_cannot_be_taken_never_wins(spark):
    got = search.search(spark, search.grid(a=[1, 2, 3]), lambda a: None if a == 1 else float(a), largest=False).collect()
    assert [r["a"] for r in got if r["best"]] == [2] and got[0]["metric"] is None
    assert [r["a"] for r in search.search(spark, search.grid(a=[1, 2]), lambda a: None).collect() if r["best"]] == [1]


def test_rows_that_the_updates_set_to_zero_stay_zero(spark):
    rng = np.random.default_rng(2)
    w, h = rng.random((8, 2)) + 0.1, rng.random((4, 2)) + 0.1
    w[1] = w[6] = h[2] = 0
    stars = np.array([[5, 0, 3, 1], [0, 4, 0, 2], [1, 1, 0, 0]])
    factors = lambda m: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, features array<double>")
    train = spark.createDataFrame([(u, i, float(stars[u, i]), 0) for u in range(3) for i in range(4) if stars[u, i]],
                                  "user_id long, item_id long, rating double, ts long")
    cells = spark.createDataFrame([(u, i) for u in range(3) for i in range(4)], "user_id long, item_id long")

    def scaled(m):
        p = m[m > 0]
        return np.where(m > 0, (m - p.min()) / (p.max() - p.min()), 0)

    t = w @ h.T
    x = stars / 5
    want = np.hstack((x, 0.5 * (1.2 - x))) @ np.vstack((scaled(t[:4]), scaled(t[4:])))
    got = twosided.nmf_scores(Nmf(factors(w), factors(h), []), 4, 4, freeze(train), cells, 2).collect()
    assert len(got) == 12 and all(np.isclose(r["score"], want[r["user_id"], r["item_id"]]) for r in got)
    assert graded(train).count() == 7


def test_loop_tables_take_turns(spark):
    keep = freezing(spark)
    tables = [spark.range(0)]
    for _ in range(5):
        tables.append(keep(tables[-1].unionByName(spark.range(3))))
    assert tables[-1].count() == 15 and len({t.inputFiles()[0].rsplit("/", 1)[0] for t in tables[1:]}) == 2
