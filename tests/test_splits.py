import pytest
from pyspark.sql import functions as F

from prefmill.operators import clean, ordering, splits


def roles(df, *more):
    return {(r["user_id"], r["item_id"]): tuple(r[c] for c in ("role", *more)) for r in df.collect()}


@pytest.mark.parametrize("fanout", [2, 3, 4096])
def test_rank_cuts_at_every_position(tiny, fanout):
    rows, df = tiny
    order = sorted((t, u, i) for u, i, _, t in rows)
    wanted = [0, 1, 2, 17, 50, len(rows) - 1, len(rows)]
    n, cuts = ordering.rank_cuts(df, ["ts", "user_id", "item_id"], wanted, fanout)
    assert n == len(rows)
    for p, cut in zip(wanted, cuts):
        got = {tuple(r) for r in df.where(ordering.is_before(["ts", "user_id", "item_id"], cut)).select("ts", "user_id", "item_id").collect()}
        assert got == set(order[:p]), p


def test_all_rows_at_one_time_are_cut_by_ids(spark):
    df = spark.createDataFrame([(u, i, 3.0, 9) for u in range(4) for i in range(5)], "user_id long, item_id long, rating double, ts long")
    got = roles(splits.by_time(df, 0.8))
    assert sorted(k for k, v in got.items() if v == ("test",)) == [(3, 1), (3, 2), (3, 3), (3, 4)]


def test_by_time_two_cuts(tiny):
    rows, df = tiny
    order = sorted((t, u, i) for u, i, _, t in rows)
    got = roles(splits.by_time(df, 0.6, 0.8))
    a, b = int(len(rows) * 0.6), int(len(rows) * 0.8)
    for p, (_, u, i) in enumerate(order):
        assert got[u, i] == ("train" if p < a else "validation" if p < b else "test",)


def test_parts_agree_with_roles(tiny):
    _, df = tiny
    for shares in ((0.8,), (0.6, 0.8), (0.0, 1.0)):
        named = splits.by_time(df, *shares)
        names = ["train", "test"] if len(shares) == 1 else ["train", "validation", "test"]
        for name, part in zip(names, splits.parts_by_time(df, *shares)):
            want = named.where(F.col("role") == name).drop("role")
            assert part.exceptAll(want).count() == 0 and part.count() == want.count()


def test_five_fold_remainder_goes_to_the_last_fold(tiny):
    rows, df = tiny
    rows = sorted(rows)[:53]
    small = df.join(df.sparkSession.createDataFrame([r[:2] for r in rows], "user_id long, item_id long"), ["user_id", "item_id"])
    got = splits.five_fold(small)
    want = {r[:2]: min(p // 10, 4) + 1 for p, r in enumerate(rows)}
    assert {(r["user_id"], r["item_id"]): r["fold"] for r in got.collect()} == want
    assert splits.fold_role(got, 5).where("role = 'test'").count() == 13


def test_all_but_and_its_cap(tiny):
    rows, df = tiny
    by_user = {}
    for u, i, *_ in sorted(rows):
        by_user.setdefault(u, []).append(i)
    test = [(u, i) for u in sorted(by_user) for i in by_user[u][1:4]]
    for cap in (0, 7):
        got = {k for k, v in roles(splits.all_but(df, 2, 4, cap)).items() if v == ("test",)}
        assert got == set(test[:cap] if cap else test)


def test_every_nth_and_sample(tiny):
    rows, df = tiny
    got = sorted((r["user_id"], r["item_id"]) for r in splits.every_nth(df, 7).collect())
    assert got == [r[:2] for r in sorted(rows)[::7]]
    a = splits.sample_cells(df.repartition(3), 10).collect()
    assert sorted(a) == sorted(splits.sample_cells(df.coalesce(1), 10).collect())


def test_hash_split_ignores_partitioning_and_is_near_its_share(spark):
    df = spark.range(20000).select((F.col("id") % 200).alias("user_id"), F.col("id").alias("item_id"), F.lit(1.0).alias("rating"), F.lit(0).alias("ts"))
    a = splits.by_hash(df, ["user_id", "item_id"]).where("role = 'train'")
    b = splits.by_hash(df.repartition(5), ["user_id", "item_id"]).where("role = 'train'")
    assert a.count() == b.count() and abs(a.count() / 20000 - 0.8) < 0.02
    assert a.exceptAll(b).count() == 0


def test_latest_rating_wins(spark):
    raw = spark.createDataFrame([(1, 1, 2.0, 5, 0), (1, 1, 4.0, 9, 0), (1, 1, 1.0, 9, 3), (2, 1, 3.0, 1, 0)], "user_id long, item_id long, rating double, ts long, n long")
    got = clean.latest_per_cell(raw, ["ts", "n"]).collect()
    assert sorted((r["user_id"], r["rating"]) for r in got) == [(1, 1.0), (2, 3.0)]


def test_trim_uses_floors_of_the_untrimmed_table(spark):
    rows = [(u, i, 1.0, 0) for u in range(6) for i in range(u + 1)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, rating double, ts long")
    # sizes 1..6: quantile 0.7 = 4.5, half to even = 4
    assert clean.activity_floor(clean.sizes_of(df, "user_id")) == 4.0
    kept = {(r["user_id"], r["item_id"]) for r in clean.trim_by_activity(df).collect()}
    assert kept == {(u, i) for u, i, *_ in rows if u + 1 >= 4 and 6 - i >= 4}


def test_empty_input_fails(spark):
    with pytest.raises(ValueError):
        clean.require_rows(spark.createDataFrame([], "user_id long"))
