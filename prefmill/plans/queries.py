"""The registered queries: name -> function of (spark, folder of Parquet tables).

Two rating tables are derived from the given ones: a dense one from ``events``
(``ev``) and a sparse one from ``orders`` and ``lineitem`` (``li``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import prefs as P
from ..functions.vectors import combine
from ..operators import (
    bias, bounded, cells as C, clean, diversity, extremes, factor, graph, metrics, nmf, ordering, pairmodel, points, propagated, product,
    rank, recommend, scale, score, search, sgd, similar, splits, stats, towers, twosided,
)
from ..session import freeze, scratch_path, spread
from ..sources import blocks, sinks, store, tables, text

DAY = 86400
USER = 7          # the user of single-user reports
ITEM = 7          # the item of similar-item reports

REGISTRY: dict = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def ev(spark, d) -> DataFrame:
    return tables.ratings_from_events(spark, d)


def li(spark, d) -> DataFrame:
    return tables.ratings_from_orders(spark, d)


def ev_split(spark, d):
    """Dense ratings cut 80/20 in time, as (train, test, all)."""
    r = freeze(ev(spark, d))
    train, test = splits.parts_by_time(r, 0.8)
    return train, test, r


def stars(ratings: DataFrame) -> DataFrame:
    return ratings.select("user_id", "item_id", F.col("rating").alias("value"))


def n_items(ratings: DataFrame) -> int:
    return ratings.select("item_id").distinct().count()


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


# ---------------------------------------------------------------- sources

@query
def read_ratings(spark, d):
    path = scratch_path(spark, "ratings")
    sinks.write_delimited(ev(spark, d).select("user_id", "item_id", F.col("rating").cast("int"), "ts"), path)
    return text.read_ratings(spark, path)


@query
def read_items(spark, d):
    path = scratch_path(spark, "items")
    items = tables.items_from_parts(spark, d)
    sinks.write_delimited(items.withColumn("genres", F.array_join("genres", "|")), path)
    return text.read_items(spark, path).withColumn("genres", F.array_join("genres", "|"))


@query
def read_users(spark, d):
    path = scratch_path(spark, "users")
    ages = F.array(*[F.lit(a) for a in text.AGE_GROUPS])
    key = F.col("c_custkey")
    users = tables.table(spark, d, "customer").select(
        key.alias("user_id"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("gender"),
        F.element_at(ages, (key % 7 + 1).cast("int")).alias("age_code"),
        (key % 21).alias("occupation_code"),
        F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("zip"),
    )
    sinks.write_delimited(users, path)
    return text.read_users(spark, path)


@query
def read_tags(spark, d):
    path = scratch_path(spark, "tags")
    raw = tables.ratings_from_events(spark, d, dedup=False).select("event_id", "user_id", "item_id", "ts")
    tags = tables.table(spark, d, "events").select("event_id", F.col("event_type").alias("tag"))
    sinks.write_delimited(raw.join(tags, "event_id").select("user_id", "item_id", "tag", "ts"), path)
    return text.read_tags(spark, path)


@query
def read_personal_ratings(spark, d):
    path = scratch_path(spark, "personal")
    entry = F.when(F.col("rating") >= 2, F.col("rating").cast("int").cast("string")).otherwise("?")
    titles = tables.items_from_parts(spark, d).select("item_id", "title")
    lines = ev(spark, d).join(titles, "item_id").select("user_id", "item_id", entry.alias("entry"), "ts", "title")
    sinks.write_delimited(lines, path)
    return text.read_personal_ratings(spark, path)


@query
def read_titles(spark, d):
    path = scratch_path(spark, "titles")
    parts = tables.table(spark, d, "part").select(
        "p_partkey", (1990 + F.col("p_size")).alias("year"),
        F.concat("p_name", F.lit(", édition "), "p_brand").alias("name"))
    sinks.write_delimited(parts, path, sep=",", encoding="ISO-8859-1")
    return text.read_titles(spark, path)


@query
def block_rows_forward_fill(spark, d):
    path = scratch_path(spark, "blocks")
    sinks.write_blocks(ev(spark, d), path)
    return blocks.read_blocks(spark, path)


@query
def reviews_select(spark, d):
    path = scratch_path(spark, "reviews")
    sinks.write_table(tables.reviews_from_labels(spark, d), path)
    return text.read_reviews(spark, path)


@query
def reg_click_join(spark, d):
    reg, clk = scratch_path(spark, "reg"), scratch_path(spark, "clk")
    day = lambda c: F.col(c).cast("date").cast("string")
    orders = tables.table(spark, d, "orders")
    sinks.write_delimited(orders.select(
        day("o_orderdate").alias("date"), F.concat(F.lit("u"), "o_orderkey").alias("uuid"),
        F.col("o_custkey").alias("customer_id"), (F.col("o_custkey") % 90).cast("double").alias("lat"),
        (F.col("o_custkey") % 180).cast("double").alias("lon")), reg, sep="\t")
    lines = tables.table(spark, d, "lineitem")
    sinks.write_delimited(lines.select(
        day("l_shipdate").alias("date"), F.concat(F.lit("u"), "l_orderkey").alias("uuid"),
        F.col("l_linenumber").alias("landing_page")), clk, sep="\t")
    clicks = text.read_clicks(spark, clk).withColumnRenamed("date", "click_date")
    return text.read_registrations(spark, reg).withColumnRenamed("date", "reg_date").join(clicks, "uuid").select(
        "uuid", "customer_id", F.col("reg_date").cast("string").alias("reg_date"),
        F.col("click_date").cast("string").alias("click_date"), "landing_page", "lat", "lon")


# ------------------------------------------------- expressions and cleaning

@query
def ratings_dedup(spark, d):
    return li(spark, d)


@query
def xoy_graded(spark, d):
    return C.graded(ev(spark, d))


@query
def xoy_binary(spark, d):
    return C.binary(ev(spark, d))


@query
def label_scale(spark, d):
    return ev(spark, d).select("user_id", "item_id", P.graded_like().alias("label"))


@query
def sigmoid(spark, d):
    return ev(spark, d).select("user_id", "item_id", F.round(P.sigmoid(F.col("rating") - 3), 6).alias("p"))


@query
def review_label(spark, d):
    r = text.not_neutral(tables.reviews_from_labels(spark, d))
    return r.withColumn("sentiment", P.sentiment()).groupBy("score", "sentiment").agg(F.count(F.lit(1)).alias("n"))


@query
def genre_counts(spark, d):
    """Word lists of the part names take the place of genre lists."""
    words = tables.table(spark, d, "part").select(F.split("p_name", " ").alias("genres"))
    return stats.genre_counts(words)


@query
def validate_ratings(spark, d):
    """Entered ratings of every event: 0..9 as text, ``?`` for tiny values."""
    value = F.col("value")
    entry = F.when(value < 1, "?").otherwise(F.floor(value / 10).cast("string"))
    raw = tables.table(spark, d, "events").select(entry.alias("entry"))
    return clean.check_entries(clean.require_rows(raw)).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("stars"))


@query
def activity_trim(spark, d):
    return clean.trim_by_activity(freeze(li(spark, d)))


@query
def concat_vectors(spark, d):
    r = freeze(ev(spark, d))
    return C.concat_user_vectors(C.graded(r), C.id_bound(r, "item_id")).withColumn("value", F.round("value", 6))


@query
def blend_scores(spark, d):
    """t1 + 0.5 t2 on rated cells: X and Y Y^T X, each scaled over positive cells."""
    r = freeze(ev(spark, d))
    t1 = scale.minmax_positive(C.as_cells(C.graded(r), "x")).select(
        F.col("row").alias("user_id"), F.col("col").alias("item_id"), F.col("value").alias("t1"))
    disliked = freeze(C.binary(r).where("y = 1").select("user_id", "item_id", F.col("y").cast("double").alias("value")))
    cross = freeze(C.binary_cross(r))
    far = score.score_cells(disliked, cross, r.select("user_id", "item_id"))
    t2 = scale.minmax_positive(far, "score", score.positive_extremes(disliked, cross)).withColumnRenamed("score", "t2")
    return t1.join(t2, ["user_id", "item_id"], "left").select(
        "user_id", "item_id", F.round(F.col("t1") + 0.5 * F.coalesce("t2", F.lit(0.0)), 6).alias("score"))


# ------------------------------------------------------------------ splits

@query
def split_by_digit(spark, d):
    return splits.by_digit(ev(spark, d)).select("user_id", "item_id", "rating", "role")


@query
def split_by_digit3(spark, d):
    return splits.by_digit3(li(spark, d), unit=DAY).select("user_id", "item_id", "rating", "role")


@query
def split_by_time(spark, d):
    return splits.by_time(freeze(li(spark, d)), 0.8).select("user_id", "item_id", "ts", "role")


@query
def split_by_time3(spark, d):
    r = splits.by_time(freeze(ev(spark, d)), 0.6, 0.8)
    return r.groupBy("role").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.sum("rating").alias("stars"))


@query
def split_by_hash(spark, d):
    return splits.by_hash(li(spark, d), ["user_id", "item_id"]).select("user_id", "item_id", "rating", "role")


@query
def reviews_split(spark, d):
    r = text.not_neutral(tables.reviews_from_labels(spark, d)).withColumn("sentiment", P.sentiment())
    return splits.by_hash(r, ["summary"], 0.8, 42).select("sentiment", "summary", "role")


@query
def five_fold(spark, d):
    return splits.five_fold(freeze(li(spark, d))).select("user_id", "item_id", "fold")


@query
def allbut_split(spark, d):
    return splits.all_but(freeze(ev(spark, d)), 1, 10).select("user_id", "item_id", "role")


@query
def allbut_split_capped(spark, d):
    return splits.all_but(freeze(ev(spark, d)), 11, 20, max_test=500).select("user_id", "item_id", "role")


@query
def every_nth(spark, d):
    return splits.every_nth(li(spark, d), 50).select("pos", "user_id", "item_id", "rating")


@query
def sample_cells(spark, d):
    return splits.sample_cells(ev(spark, d), 50).select("user_id", "item_id", "rating")


# ------------------------------------------------------- joins and summaries

def _mean_predictions(train, test):
    means = train.groupBy("item_id").agg(F.avg("rating").alias("score"))
    return metrics.labelled(test.select("user_id", "item_id").join(means, "item_id"), test)


@query
def join_pred_label(spark, d):
    train, test, _ = ev_split(spark, d)
    return _mean_predictions(train, test).select("user_id", "item_id", r6("score"), "rating", "label")


@query
def user_favourites(spark, d):
    return recommend.favourites(ev(spark, d), tables.items_from_parts(spark, d), USER)


@query
def unseen_candidates(spark, d):
    items = tables.items_from_parts(spark, d).select("item_id")
    return recommend.unseen_candidates(items, li(spark, d), USER)


@query
def recommend_titles(spark, d):
    r = freeze(li(spark, d))
    return recommend.recommend_by_mean(tables.items_from_parts(spark, d), r, USER).select("item_id", r6("score"), "title")


@query
def dataset_stats(spark, d):
    return stats.dataset_stats(li(spark, d))


@query
def rating_histogram(spark, d):
    return stats.rating_histogram(li(spark, d))


@query
def item_summary(spark, d):
    return stats.summary_by(li(spark, d), "item_id").select("item_id", "n_ratings", r6("mean_rating"))


@query
def user_summary(spark, d):
    return stats.summary_by(li(spark, d), "user_id").select("user_id", "n_ratings", r6("mean_rating"))


@query
def matrix_histogram(spark, d):
    return stats.matrix_histogram(freeze(li(spark, d)))


@query
def pivot_ratings(spark, d):
    r = freeze(ev(spark, d))
    return stats.pivot_ratings(r, list(range(tables.EVENT_ITEMS)))


@query
def mean_baseline(spark, d):
    r = freeze(splits.by_digit3(ev(spark, d)))
    part = lambda role: r.where(F.col("role") == role)
    return metrics.mean_baseline(part("train"), part("validation"), part("test")).select(
        r6("mean_rating"), r6("baseline_rmse"))


@query
def similar_items_pearson(spark, d):
    items = tables.items_from_parts(spark, d)
    return similar.similar_titles(freeze(ev(spark, d)), items, ITEM).select(
        "item_id", r6("pearson"), "n_ratings", r6("mean_rating"), "title")


@query
def similar_titles_by_name(spark, d):
    """The item is looked up by its title; items rated more than 30 times only."""
    r, items = freeze(li(spark, d)), tables.items_from_parts(spark, d)
    item = similar.item_called(items, "hot bolt")
    return similar.similar_titles(r, items, item, min_count=30).select(
        "item_id", r6("pearson"), "n_ratings", r6("mean_rating"), "title")


@query
def bias_model(spark, d):
    b = bias.fit_biases(freeze(ev(spark, d)))
    return b.items.select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), F.round("item_bias", 6).alias("bias")).unionByName(
        b.users.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), F.round("user_bias", 6).alias("bias")))


# ----------------------------------------------------------- matrix algebra

@query
def gram_items(spark, d):
    return C.item_gram(ev(spark, d)).select("row", "col", r6("value"))


@query
def gram_kept(spark, d):
    """S of the ratings, made by the first run over these files and found again by all later ones."""
    ask = lambda: store.kept(spark, "gram", [f"{d}/events.parquet"], {"version": 1}, lambda: C.item_gram(ev(spark, d)))
    ask()
    return ask().select("row", "col", r6("value"))


@query
def gram_items_sparse(spark, d):
    """Row counts and sums of S over the sparse ratings."""
    return C.star_gram(freeze(li(spark, d))).groupBy("row").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query
def gram_neg_binary(spark, d):
    return C.binary_cross(ev(spark, d))


@query
def gram_neg_graded(spark, d):
    """One row per stored cell of S; per column at most one row without ``row``
    id, which stands for all other cells of the column."""
    r = freeze(ev(spark, d))
    return C.graded_cross(freeze(C.item_gram(r)), C.column_base(r), n_items(r)).select("row", "col", r6("value"))


@query
def gram_neg_graded_sparse(spark, d):
    """The graded negative side over the sparse ratings, summed per column."""
    r = freeze(li(spark, d))
    base = freeze(C.column_base(r))
    s = C.item_gram(r, base.select("col", "base"), keep=True)
    return C.graded_cross(s, base, n_items(r)).groupBy("col").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query
def neg_propagation(spark, d):
    return C.binary_propagation(freeze(ev(spark, d)))


@query
def neg_propagation_graded(spark, d):
    """Y (Y^T X) with the dense graded Y, at the held-out cells."""
    train, test, r = ev_split(spark, d)
    return twosided.propagate(twosided.build(train, n_items(r)), train, test).select("user_id", "item_id", r6("score"))


@query
def minmax_positive(spark, d):
    return scale.minmax_positive(freeze(C.item_gram(ev(spark, d)))).select("row", "col", r6("value"))


@query
def minmax_all(spark, d):
    r = freeze(ev(spark, d))
    return scale.minmax_all(freeze(C.item_gram(r)), n_items(r) ** 2).select("row", "col", r6("value"))


@query
def minmax_threshold(spark, d):
    scaled = scale.minmax_positive(freeze(C.binary_cross(ev(spark, d))))
    return scale.sparsify(scale.zero_below(scaled, 0.1), 1e-2).select("row", "col", r6("value"))


@query
def stack_blocks(spark, d):
    """[S; Y^T X] one above the other, cut apart again and stacked side by side."""
    r = freeze(ev(spark, d))
    offset = C.id_bound(r, "item_id")
    tall = C.vstack(C.item_gram(r), C.binary_cross(r), offset)
    return C.hstack(*C.unstack(tall, offset), offset).select("row", "col", r6("value"), "block")


# ------------------------------------------------------------------ scoring

def _test_scores(spark, d):
    """X S at the held-out cells, S exact, with labels."""
    train, test, _ = ev_split(spark, d)
    got = score.score_cells(stars(train), freeze(C.star_gram(train)), test.select("user_id", "item_id"))
    return metrics.labelled(got.withColumn("score", F.col("score") / 125), test)


@query
def score_items_s(spark, d):
    return _test_scores(spark, d).select("user_id", "item_id", r6("score"), "label")


@query
def score_two_sided(spark, d):
    train, test, r = ev_split(spark, d)
    m = twosided.build(train, n_items(r))
    return twosided.scores(m, train, test).select("user_id", "item_id", F.round("score", 5).alias("score"))


@query
def topk_unseen(spark, d):
    train, _, _ = ev_split(spark, d)
    top = score.top_items(stars(train), freeze(C.star_gram(train)), 10)
    return top.select("user_id", "item_id", F.round(F.col("score") / 125, 6).alias("score"), "rank")


@query
def roc_auc(spark, d):
    return metrics.roc_auc(_test_scores(spark, d)).select(r6("auc"), "n_pos", "n_neg")


@query
def roc_curve(spark, d):
    return metrics.roc_curve(_test_scores(spark, d)).select(r6("threshold"), r6("tpr"), r6("fpr"))


@query
def pr_curve(spark, d):
    return metrics.pr_curve(_test_scores(spark, d)).select(r6("threshold"), r6("precision"), r6("recall"))


@query
def pr_curve_saved(spark, d):
    """The curve written as a table and read again."""
    path = scratch_path(spark, "curve")
    sinks.write_table(metrics.pr_curve(_test_scores(spark, d)), path)
    return spark.read.parquet(path).select(r6("threshold"), r6("precision"), r6("recall"))


@query
def pr_auc(spark, d):
    return metrics.pr_auc(_test_scores(spark, d)).select(r6("pr_auc"))


@query
def rmse(spark, d):
    r = freeze(splits.by_digit(li(spark, d), unit=DAY))
    train, test = r.where("role = 'train'"), r.where("role = 'test'")
    return metrics.errors(_mean_predictions(train, test), n_all=test.count()).select(r6("rmse"), r6("rmse_all"), "n")


@query
def mae_rmse(spark, d):
    train, test, _ = ev_split(spark, d)
    return metrics.errors(_mean_predictions(train, test)).select(r6("mae"), r6("rmse"))


# ---------------------------------------------------------------- diversity

def _lists(spark, d, k, hide_seen=True):
    train, _, _ = ev_split(spark, d)
    s = freeze(C.star_gram(train))
    return freeze(score.top_items(stars(train), s, k, hide_seen=hide_seen)), s, train


def _diversity_top10(spark, d):
    lists, s, train = _lists(spark, d, 10, hide_seen=False)
    return diversity.list_diversity(lists, scale.minmax_all(s, n_items(train) ** 2))


def _diversity_unseen(spark, d):
    lists, s, _ = _lists(spark, d, 50)
    return diversity.list_diversity(lists, scale.minmax_positive(s))


@query
def diversity_top10(spark, d):
    return _diversity_top10(spark, d).select("user_id", r6("diversity"))


@query
def diversity_unseen(spark, d):
    return _diversity_unseen(spark, d).select("user_id", r6("diversity"))


@query
def diversity_liked(spark, d):
    """Diversity of unseen lists, of users who liked something in training."""
    lists, s, train = _lists(spark, d, 50)
    liked = diversity.with_liked_train(lists, train)
    return diversity.list_diversity(liked, scale.minmax_positive(s)).select("user_id", r6("diversity"))


@query
def diversity_summary(spark, d):
    return diversity.summary(freeze(_diversity_unseen(spark, d))).select(
        r6("mean"), r6("median"), r6("quarter"), "n_users")


@query
def diversity_histogram(spark, d):
    return stats.histogram(_diversity_top10(spark, d).select(r6("diversity")), "diversity", 0.0, 1.0, 50)


@query
def topk_pairs(spark, d):
    lists, s, _ = _lists(spark, d, 10)
    return diversity.pair_distances(lists, scale.minmax_positive(s)).select("user_id", "item_a", "item_b", r6("distance"))


@query
def diversity_rerank(spark, d):
    lists, s, _ = _lists(spark, d, 50)
    return diversity.rerank(diversity.packed_by_cells(lists, scale.minmax_positive(s)))


# ------------------------------------------------------------------- models

@query
def als_ratings(spark, d):
    r = freeze(splits.by_digit3(li(spark, d), unit=DAY))
    model = factor.fit_ratings(r.where("role = 'train'"), rank=8, iters=5)
    return factor.predict(model, r.where("role = 'test'").select("user_id", "item_id", "rating"))


def _gram_model(train, rank, iters, reg, tau=0.1):
    s = scale.minmax_positive(freeze(C.item_gram(train)))
    return factor.als_fit(scale.sparsify(scale.zero_below(s, tau), 1e-2), rank, iters, reg)


def _score_gram_model(model, k, train, test):
    users = factor.user_vectors(C.graded(train), factor.row_factors(model), k)
    return factor.score_pairs(test.select("user_id", "item_id"), users, factor.col_factors(model), k)


@query
def als_gram(spark, d):
    train, test, _ = ev_split(spark, d)
    return _score_gram_model(_gram_model(train, 8, 5, 0.1), 8, train, test)


def _pref_model(train, rank, iters, reg):
    x = scale.sparsify(scale.minmax_positive(C.as_cells(C.graded(train), "x")), 1e-1)
    return factor.als_fit(x, rank, iters, reg, seed=444)


@query
def als_pref(spark, d):
    train, test, _ = ev_split(spark, d)
    return factor.predict(_pref_model(train, 8, 5, 0.1), test.select("user_id", "item_id"))


def _two_sided_cells(train, offset):
    """Scaled [S; Y^T X] for binary Y, which keeps the lower half sparse."""
    s, a = freeze(C.item_gram(train)), freeze(C.binary_cross(train))
    return scale.sparsify(C.vstack(scale.minmax_positive(s), scale.minmax_positive(a), offset), 1e-6)


def _score_two_sided_model(model, k, train, test, offset, beta=0.2):
    rows, cols = factor.row_factors(model), factor.col_factors(model)
    prefs = C.binary(train)
    upper = factor.user_vectors(C.graded(train), rows.where(F.col("id") < offset), k)
    lower = factor.user_vectors(
        prefs.where("y = 1"), rows.where(F.col("id") >= offset).withColumn("id", F.col("id") - offset), k, "y")
    users = upper.join(lower.withColumnRenamed("features", "neg"), "user_id", "left").select(
        "user_id", combine("features[{d}] + %r * coalesce(neg[{d}], 0D)" % beta, k).alias("features"))
    return factor.score_pairs(test.select("user_id", "item_id"), users, cols, k)


@query
def als_two_sided(spark, d):
    train, test, r = ev_split(spark, d)
    offset = C.id_bound(r, "item_id")
    model = factor.als_fit(_two_sided_cells(train, offset), 8, 5, 0.1)
    return _score_two_sided_model(model, 8, train, test, offset)


def _left_half_model(train, offset, rank, iters, reg):
    prefs = C.graded(train)
    t = scale.sparsify(C.hstack(
        scale.minmax_positive(C.as_cells(prefs, "x")), scale.minmax_positive(C.as_cells(prefs, "y")), offset), 1e-2)
    return factor.als_fit(t, rank, iters, reg)


@query
def als_hcat(spark, d):
    train, test, r = ev_split(spark, d)
    model = _left_half_model(train, C.id_bound(r, "item_id"), 8, 5, 0.1)
    return factor.predict(model, test.select("user_id", "item_id"))


def _neg_blend_cells(train, offset):
    """[X, Y Y^T X], both scaled, binary Y, cells of the right half under the cut left out."""
    x, far = C.as_cells(C.graded(train), "x"), freeze(C.binary_propagation(train))
    cut = scale.zero_below(scale.minmax_positive(far), propagated.CUT)
    return scale.sparsify(C.hstack(scale.minmax_positive(x), cut, offset), 1e-2)


def _neg_blend_model(train, offset, rank, iters, reg):
    return factor.als_fit(_neg_blend_cells(train, offset), rank, iters, reg)


def _neg_blend_halves(model, offset):
    """Both halves of the completed matrix, with the extremes of all their positive cells."""
    users, cols = freeze(factor.row_factors(model)), freeze(factor.col_factors(model))
    left = cols.where(F.col("id") < offset)
    right = cols.where(F.col("id") >= offset).withColumn("id", F.col("id") - offset)
    items = left.withColumnRenamed("features", "near").join(right.withColumnRenamed("features", "far"), "id", "left")
    return factor.Halves(users.select(F.col("id").alias("user_id"), F.col("features").alias("near"), F.col("features").alias("far")),
                         freeze(items.withColumnRenamed("id", "item_id")),
                         factor.product_span(users, left), factor.product_span(users, right))


def _score_neg_blend(model, k, test, offset, weight=-0.5):
    """Both halves of the completed matrix, scaled over all their positive cells, blended."""
    return factor.blend_pairs(test.select("user_id", "item_id"), _neg_blend_halves(model, offset), k, weight)


@query
def als_neg_hcat(spark, d):
    train, test, r = ev_split(spark, d)
    offset = C.id_bound(r, "item_id")
    return _score_neg_blend(_neg_blend_model(train, offset, 8, 5, 0.1), 8, test, offset)


@query
def neg_cut_columns(spark, d):
    """Column sums of the graded dense Y (Y^T X) of the training rows, scaled by its extremes and zero below 0.2."""
    train, _, r = ev_split(spark, d)
    far = propagated.propagated(train, n_items(r))
    return propagated.column_sums(far).select(F.col("col").alias("item_id"), F.round("total", 4).alias("total"))


def _tall_blend_model(train, far, below, k, iters, marks=()):
    """Factors of [X; Y Y^T X], both scaled, Y graded and dense."""
    upper = scale.minmax_positive(freeze(C.as_cells(C.graded(train), "x"))).where("value > 0")
    return propagated.nmf_above(freeze(upper), far, below, k, iters, marks=marks)


def _tall_halves(model, below):
    """Upper and lower half of the completed stack, with the extremes of all their positive cells."""
    upper, lower = map(freeze, (model.rows.where(F.col("id") < below),
                                model.rows.where(F.col("id") >= below).withColumn("id", F.col("id") - below)))
    users = upper.withColumnRenamed("features", "near").join(lower.withColumnRenamed("features", "far"), "id", "left")
    cols = model.cols.select(F.col("id").alias("item_id"), F.col("features").alias("near"), F.col("features").alias("far"))
    return factor.Halves(freeze(users.withColumnRenamed("id", "user_id")), cols,
                         factor.product_span(upper, model.cols), factor.product_span(lower, model.cols))


def _score_tall_blend(model, k, test, below, weight=0.5):
    """Upper and lower half of the completed stack, each scaled over all its positive cells, blended."""
    return factor.blend_pairs(test.select("user_id", "item_id"), _tall_halves(model, below), k, weight)


@query
def nmf_neg_blend(spark, d):
    """Held-out cells by the blended halves of the factored [X; Y Y^T X], graded, with the 0.2 cut."""
    train, test, r = ev_split(spark, d)
    below = C.id_bound(r, "user_id")
    model = _tall_blend_model(train, propagated.propagated(train, n_items(r)), below, 8, 4)
    return _score_tall_blend(model, 8, test, below)


def _left_half_stack(train, catalogue, below, cut=propagated.CUT):
    """Cells, column bases and rows of [X; Y], scaled together over the positive cells, zero below the cut.

    Y is 1.2 on unrated cells: the base of every column. Rated cells are stored as what they differ by.
    """
    prefs = freeze(C.graded(train))
    items = freeze(catalogue.select(F.col("item_id").alias("col")).distinct())
    users = freeze(prefs.select(F.col("user_id").alias("id")).distinct())
    f = prefs.agg(F.min(F.least("x", "y")), F.max(F.greatest("x", "y")), F.count(F.lit(1))).first()
    high = P.UNSEEN_DISLIKE if f[2] < users.count() * items.count() else f[1]
    span = scale.Span(f[0], high)

    def scaled(v):
        return F.when(span.scale(v) < cut, 0.0).otherwise(span.scale(v))

    base = items.withColumn("value", scaled(F.lit(P.UNSEEN_DISLIKE)))
    upper = prefs.select(F.col("user_id").alias("row"), F.col("item_id").alias("col"), scaled(F.col("x")).alias("value"))
    lower = prefs.select((F.col("user_id") + below).alias("row"), F.col("item_id").alias("col"),
                         (scaled(F.col("y")) - scaled(F.lit(P.UNSEEN_DISLIKE))).alias("value"))
    rows = users.unionByName(users.select((F.col("id") + below).alias("id")))
    return freeze(upper.unionByName(lower).where("value <> 0")), base, rows


@query
def nmf_left_half(spark, d):
    """Held-out cells by the left half of the factored [X; Y], Y dense."""
    train, test, r = ev_split(spark, d)
    below = C.id_bound(r, "user_id")
    cells, base, rows = _left_half_stack(train, r, below)
    model = nmf.nmf_fit(cells, 8, 4, base=base, row_ids=rows, base_from=below)
    users = model.rows.where(F.col("id") < below).withColumnRenamed("id", "user_id")
    return factor.score_pairs(test.select("user_id", "item_id"), users, model.cols, 8)


@query
def dot_cells(spark, d):
    """Cells of the completed matrix at all held-out ratings."""
    train, test, _ = ev_split(spark, d)
    model = factor.fit_ratings(train, 8, 5)
    users = factor.row_factors(model).withColumnRenamed("id", "user_id")
    return factor.score_pairs(test.select("user_id", "item_id"), users, factor.col_factors(model), 8)


@query
def complete_factors(spark, d):
    """Item vectors for the whole part catalogue, zeros where a part has no rating."""
    model = factor.fit_ratings(ev(spark, d), 8, 3)
    domain = tables.table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return factor.complete_factors(domain, factor.col_factors(model), 8)


@query
def score_items_factors(spark, d):
    """(X U) V^T against the non-negative factors of S, zeros of S counting as data."""
    train, test, _ = ev_split(spark, d)
    m = nmf.nmf_fit(freeze(scale.minmax_positive(freeze(C.item_gram(train)))), 8, 4)
    users = factor.user_vectors(C.graded(train), m.rows, 8)
    return factor.score_pairs(test.select("user_id", "item_id"), users, m.cols, 8)


@query
def factor_gram(spark, d):
    """Item similarity of the completed matrix at every stored cell of S."""
    r = freeze(ev(spark, d))
    model = factor.fit_ratings(r, 8, 3)
    return factor.similarity_of_pairs(
        C.item_gram(r).select("row", "col"), factor.row_factors(model), factor.col_factors(model), 8)


@query
def matrix_rank(spark, d):
    model = factor.fit_ratings(ev(spark, d), 8, 3)
    rank = factor.matrix_rank(factor.row_factors(model), factor.col_factors(model), 8)
    return spark.range(1).select(F.lit(rank).alias("rank"))


@query
def rank_gram(spark, d):
    """Rank of S as stored, with its greatest and its last counted singular value."""
    got = rank.stored_rank(C.item_gram(ev(spark, d)))
    row = (got.rank, float(got.values[0]), float(got.values[got.rank - 1]), got.width, got.exact)
    return spark.createDataFrame([row], "rank int, greatest double, least double, width int, exact boolean")


@query
def topk_products(spark, d):
    """Ten unseen items per user by the completed matrix, most products skipped by bounds."""
    r = freeze(li(spark, d))
    model = factor.fit_ratings(r, 8, 5)
    users = factor.row_factors(model).withColumnRenamed("id", "user_id")
    return bounded.top_products(users, factor.col_factors(model), 10, seen=r.select("user_id", "item_id"), bucket=512).table


@query
def product_extremes(spark, d):
    """Least and greatest inner product of any two embeddings, by bounds of blocks."""
    e = tables.table(spark, d, "embeddings").select(F.col("embedding").alias("features"))
    span = extremes.product_extremes(e, e, positive=False, block=256).span
    return spark.createDataFrame([(span.low, span.high)], "low double, high double").select(r6("low"), r6("high"))


def _loss_rows(spark, model):
    return spark.createDataFrame(
        [(i + 1, loss) for i, loss in enumerate(model.losses)], "iteration int, loss double")


@query
def nmf_gram(spark, d):
    return _loss_rows(spark, nmf.nmf_fit(freeze(scale.minmax_positive(freeze(C.item_gram(ev(spark, d))))), 8, 4))


@query
def nmf_hals(spark, d):
    """Losses of S factored by best component values, up to the stop by projected gradient."""
    return _loss_rows(spark, nmf.hals(freeze(scale.minmax_positive(freeze(C.item_gram(ev(spark, d))))), 8, tol=0.05, most=12))


@query
def nmf_pref(spark, d):
    return _loss_rows(spark, nmf.nmf_fit(freeze(C.as_cells(C.graded(ev(spark, d)), "x")), 8, 4))


def _graded_cross_nmf(train, catalogue, k, iters, s=None):
    """Factors of the scaled dense Y^T X, as column base less sparse cells; ``s`` is S, if it is there already."""
    s, base = freeze(C.item_gram(train)) if s is None else s, freeze(C.column_base(train))
    ids = freeze(catalogue.select(F.col("item_id").alias("id")).distinct())
    span = scale.positive_span(C.graded_cross(s, base, ids.count()))
    width = (span.high - span.low) or 1.0
    corr = s.select("row", "col", (-F.col("value") / width).alias("value"))
    flat = base.select("col", ((F.col("base") - span.low) / width).alias("value"))
    return nmf.nmf_fit(freeze(corr), k, iters, base=flat, row_ids=ids)


@query
def nmf_neg_graded(spark, d):
    r = freeze(ev(spark, d))
    return _loss_rows(spark, _graded_cross_nmf(r, r, 8, 4))


@query
def nmf_two_sided(spark, d):
    """Held-out cells scored with the non-negative factors of graded [S; Y^T X]."""
    train, test, r = ev_split(spark, d)
    ids, offset = r.select(F.col("item_id").alias("id")), C.id_bound(r, "item_id")
    m = twosided.build(train, n_items(r))
    return twosided.nmf_scores(twosided.fit_nmf(m, ids, offset, 8, 4), offset, m.n_items, train, test, 8)


def _embeddings(train, r, k, iters):
    s = freeze(C.item_gram(train))
    sides = (lambda: nmf.nmf_fit(freeze(scale.minmax_positive(s)), k, iters), lambda: _graded_cross_nmf(train, r, k, iters, s))
    pos, neg = search.side_by_side(train.sparkSession, lambda side: side(), search.grid(side=sides))
    return pairmodel.two_sided_embeddings(C.graded(train), pos.rows, pos.cols, neg.rows, neg.cols, k)


@query
def two_sided_embeddings(spark, d):
    train, _, r = ev_split(spark, d)
    return _embeddings(train, r, 4, 3).users


@query
def pair_model(spark, d):
    train, test, r = ev_split(spark, d)
    emb = _embeddings(train, r, 4, 3)
    emb = pairmodel.Embeddings(freeze(emb.users), freeze(emb.items))
    model = pairmodel.fit_pair_model(train, emb, 4, hidden=32, iters=15)
    return pairmodel.score_with(model, test.select("user_id", "item_id"), emb)


@query
def tower_model(spark, d):
    """Held-out pairs by the two-tower model on two-sided embeddings."""
    train, test, r = ev_split(spark, d)
    emb = _embeddings(train, r, 4, 3)
    emb = pairmodel.Embeddings(freeze(emb.users), freeze(emb.items))
    model = towers.fit_towers(train, emb, hidden=32, batch=256, steps=40, rate=0.01)
    return towers.score_towers(model, test.select("user_id", "item_id"), emb)


@query
def biased_mf(spark, d):
    """All titles for one user by estimate, the ten best."""
    r = freeze(ev(spark, d))
    model = bias.fit_biased(r, rank=8, iters=5)
    items = r.select("item_id").distinct().withColumn("user_id", F.lit(USER).cast("long"))
    return recommend.top_titles(
        bias.predict_biased(model, items).select("item_id", "score"), tables.items_from_parts(spark, d), 10)


@query
def recommend_titles_als(spark, d):
    r = freeze(li(spark, d))
    model = factor.fit_ratings(r, 8, 5)
    return recommend.recommend_by_model(model, tables.items_from_parts(spark, d), r, USER, 50)


@query
def sgd_mf(spark, d):
    """All titles for one user by the jointly learnt biased factors, the ten best."""
    r = freeze(ev(spark, d))
    model = sgd.fit_sgd(r, rank=8, epochs=5, rate=0.02)
    items = r.select("item_id").distinct().withColumn("user_id", F.lit(USER).cast("long"))
    return recommend.top_titles(
        sgd.predict_sgd(model, items).select("item_id", "score"), tables.items_from_parts(spark, d), 10)


@query
def cv_joint(spark, d):
    """RMSE and MAE of the jointly learnt biased factors per fold of 3 and of 5, all folds in the same joins."""
    return sgd.cross_validate(ev(spark, d), (3, 5), rank=8, epochs=4, rate=0.02)


@query
def cv_report(spark, d):
    """RMSE and MAE per fold of three-fold cross-validation of the biased model."""
    r = freeze(splits.hash_folds(ev(spark, d), 3))
    out = None
    for fold in range(3):
        model = bias.fit_biased(freeze(r.where(F.col("fold") != fold)), rank=4, iters=3)
        got = metrics.errors(bias.predict_biased(model, r.where(F.col("fold") == fold))).select(
            F.lit(fold).alias("fold"), "rmse", "mae", "n")
        out = got if out is None else out.unionByName(got)
    return out


@query
def grid_report(spark, d):
    """AUC on validation rows for a grid of ALS settings over S."""
    train, valid, _ = splits.parts_by_time(freeze(ev(spark, d)), 0.6, 0.8)
    s = freeze(scale.sparsify(scale.minmax_positive(freeze(C.item_gram(train))), 1e-2))

    def measure(rank, reg, iters):
        got = _score_gram_model(factor.als_fit(s, rank, iters, reg), rank, train, valid)
        return metrics.roc_auc(metrics.labelled(got, valid)).first()["auc"]

    return search.search(spark, search.grid(rank=[4, 8], reg=[0.1], iters=[3, 5]), measure)


@query
def pagerank(spark, d):
    """Customers and suppliers linked by their orders, both directions."""
    orders = tables.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = tables.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    n = lines.count()
    met = spread(lines, n, "l_orderkey").join(spread(orders, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    links = freeze(spread(met.select((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")), n, "src", "dst").distinct())
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.pagerank(both, iters=3).select("id", r6("rank"))


@query
def kmeans(spark, d):
    p = tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    return points.kmeans(p, 4)
