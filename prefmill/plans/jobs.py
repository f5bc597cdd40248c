"""Named jobs: whole experiments from ratings to a report ``(metric, value)``.

Each is a function of rating tables and settings; its defaults are the full
grid. The registered forms run it on the derived ratings, `als_tutorial` whole, the
others with fewer points on an axis and fewer rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.prefs import sentiment
from ..operators import (
    bounded, cells as C, clean, diversity, factor, metrics, nmf, pairmodel, propagated, recommend, scale, score, search, sgd,
    similar, splits, stats, towers, twosided,
)
from ..session import freeze, scratch_path, shuffles_dropped
from ..sources import blocks, sinks, tables, text
from . import queries as Q
from .queries import query


CELLS_AT_ONCE = 1 << 23  # training cells of ALS fits that run side by side, together


def report(spark, **numbers) -> DataFrame:
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in numbers.items()], "metric string, value double")


def auc(scored: DataFrame, truth: DataFrame) -> float:
    return metrics.roc_auc(metrics.labelled(scored, truth)).first()["auc"]


def best_row(found: DataFrame):
    return found.where("best").first()


def mean_of(per_user: DataFrame) -> float:
    return per_user.agg(F.avg("diversity")).first()[0]


def als_tutorial(spark, ratings, items, user_id, unit=1, ranks=(8, 12), regs=(0.1, 10.0), iters=(10, 20)):
    """Grid of ALS on ratings by validation RMSE; test RMSE against the mean.

    A round of ALS ships about a vector a rating each way, so fits run side by side only as far as they have few
    ratings; beyond that one fit at a time, with one round on disk. What a fit leaves goes once its error is known.
    """
    with shuffles_dropped(spark):
        r = freeze(splits.by_digit3(ratings, unit=unit).select("user_id", "item_id", "rating", "role"))
        train, valid, test = (r.where(F.col("role") == x) for x in ("train", "validation", "test"))
        n_train, n_valid, n_test = train.count(), valid.count(), test.count()
        at_once = max(1, min(search.AT_ONCE, CELLS_AT_ONCE // max(1, n_train)))
        rounds_kept = factor.ROUNDS_KEPT if at_once > 1 else 1

        def fit(rank, reg, iters):
            return factor.fit_ratings(train, rank, iters, reg, rounds_kept=rounds_kept)

        def error(model, rows, n):
            return metrics.errors(factor.predict(model, rows), n_all=n).first()["rmse_all"]

        def measure(rank, reg, iters):
            model = fit(rank, reg, iters)
            try:
                return error(model, valid, n_valid)
            finally:
                model.release()

        found = search.search(spark, search.grid(rank=ranks, reg=regs, iters=iters), measure, largest=False, at_once=at_once)
        b = best_row(found)
        model = fit(b["rank"], b["reg"], b["iters"])
        test_rmse = error(model, test, n_test)
        base = metrics.mean_baseline(train, valid, test).first()["baseline_rmse"]
        listed = recommend.recommend_by_model(model, items, train, user_id, 50).count()
        model.release()
    return report(spark, best_rank=b["rank"], best_reg=b["reg"], best_iters=b["iters"], validation_rmse=b["metric"],
                  test_rmse=test_rmse, baseline_rmse=base, improvement_pct=(base - test_rmse) / base * 100,
                  recommended=listed)


def _split3(ratings):
    return splits.parts_by_time(freeze(ratings), 0.6, 0.8)


def _pairs(rows):
    return rows.select("user_id", "item_id")


def nmf_search(spark, ranks, rounds, fit, scores, valid):
    """Grid of NMF over rank x rounds by validation AUC; the best settings with their model.

    ``fit(rank, most, marks)`` gives a model with those after the rounds ``marks``: one fit
    serves all rounds of a rank. ``scores(model, rank, rows)`` gives the scores of a model.
    """
    rounds = tuple(rounds)
    fits = search.side_by_side(spark, lambda rank: fit(rank, max(rounds), rounds).marks, search.grid(rank=ranks))
    models = {(rank, n): m for rank, marks in zip(ranks, fits) for n, m in marks.items()}
    b = best_row(search.search(spark, search.grid(rank=ranks, rounds=rounds),
                               lambda rank, rounds: auc(scores(models[rank, rounds], rank, valid), valid)))
    return b, models[b["rank"], b["rounds"]]


def item_gram(spark, ratings, ranks=(16, 12), regs=(0.1, 0.01), iters=(10, 20), nmf_ranks=(16, 25), nmf_rounds=(50, 80)):
    """Factors of X^T X by ALS and by NMF, each chosen by validation AUC; diversity after re-ranking."""
    train, valid, test = _split3(ratings)
    s = freeze(scale.minmax_positive(freeze(C.item_gram(train))))
    kept = freeze(scale.sparsify(scale.zero_below(s, 0.1), 1e-2))
    prefs = freeze(C.graded(train))

    def als_scores(rank, reg, iters, rows):
        model = factor.als_fit(kept, rank, iters, reg)
        users = factor.user_vectors(prefs, factor.row_factors(model), rank)
        return factor.score_pairs(_pairs(rows), users, factor.col_factors(model), rank)

    b = best_row(search.search(spark, search.grid(rank=ranks, reg=regs, iters=iters),
                               lambda **g: auc(als_scores(**g, rows=valid), valid)))


    def nmf_scores(m, k, rows):
        return factor.score_pairs(_pairs(rows), factor.user_vectors(prefs, m.rows, k), m.cols, k)

    n, m = nmf_search(spark, nmf_ranks, nmf_rounds, lambda k, most, marks: nmf.nmf_fit(s, k, most, marks=marks), nmf_scores, valid)
    users = freeze(factor.user_vectors(prefs, m.rows, n["rank"]))
    lists = freeze(bounded.top_products(users, m.cols, 50, seen=_pairs(train)).table)
    packed = diversity.packed_by_factors(lists, m.rows, m.cols, factor.product_span(m.rows, m.cols))
    return report(spark, best_rank=b["rank"], validation_auc=b["metric"],
                  als_test_auc=auc(als_scores(b["rank"], b["reg"], b["iters"], test), test),
                  nmf_rank=n["rank"], nmf_rounds=n["rounds"], nmf_validation_auc=n["metric"],
                  nmf_test_auc=auc(nmf_scores(m, n["rank"], test), test),
                  reranked_diversity=mean_of(diversity.rerank(packed)))


def preferences(spark, ratings, ranks=(8, 12), regs=(0.1, 0.01), iters=(10, 20), nmf_ranks=(16, 25), nmf_rounds=(50, 80)):
    """Factors of X itself by ALS and by NMF, each chosen by validation AUC; diversity of unseen lists."""
    train, valid, test = _split3(ratings)
    b = best_row(search.search(
        spark, search.grid(rank=ranks, reg=regs, iters=iters),
        lambda rank, reg, iters: auc(factor.predict(Q._pref_model(train, rank, iters, reg), _pairs(valid)), valid)))
    als_auc = auc(factor.predict(Q._pref_model(train, b["rank"], b["iters"], b["reg"]), _pairs(test)), test)
    x = freeze(C.as_cells(C.graded(train), "x"))

    def nmf_scores(m, k, rows):
        return factor.score_pairs(_pairs(rows), m.rows.withColumnRenamed("id", "user_id"), m.cols, k)

    n, m = nmf_search(spark, nmf_ranks, nmf_rounds, lambda k, most, marks: nmf.nmf_fit(x, k, most, marks=marks), nmf_scores, valid)
    rank = n["rank"]
    users = m.rows.withColumnRenamed("id", "user_id")
    lists = freeze(bounded.top_products(users, m.cols, 50, seen=_pairs(train)).table)
    sims = freeze(factor.turned(m.rows, m.cols, rank))
    packed = diversity.packed_by_factors(lists, sims, m.cols, factor.product_span(sims, m.cols))
    return report(spark, best_rank=b["rank"], validation_auc=b["metric"], als_test_auc=als_auc,
                  nmf_rank=rank, nmf_rounds=n["rounds"], nmf_validation_auc=n["metric"],
                  nmf_test_auc=auc(nmf_scores(m, rank, test), test),
                  diversity=mean_of(diversity.mean_distance(packed)))


def two_sided(spark, ratings, ranks=(16, 12), regs=(0.1, 0.01), iters=(10, 20), nmf_ranks=(16, 25), nmf_rounds=(50, 80)):
    """[X^T X; Y^T X]: exact scores, ALS and NMF factors, each chosen by validation AUC; diversity of unseen lists."""
    train, valid, test = _split3(ratings)
    n_items = ratings.select("item_id").distinct().count()
    offset = C.id_bound(ratings, "item_id")
    t = freeze(Q._two_sided_cells(train, offset))

    def scores(rank, reg, iters, rows):
        return Q._score_two_sided_model(factor.als_fit(t, rank, iters, reg), rank, train, rows, offset)

    b = best_row(search.search(spark, search.grid(rank=ranks, reg=regs, iters=iters),
                               lambda **g: auc(scores(**g, rows=valid), valid)))
    m = twosided.build(train, n_items)
    lists = freeze(score.top_items(Q.stars(train), m.s, 50))
    div = freeze(diversity.list_diversity(lists, scale.minmax_positive(m.s)))
    d = diversity.summary(div).first()
    ids = ratings.select(F.col("item_id").alias("id"))

    def nmf_scores(model, k, rows):
        return twosided.nmf_scores(model, offset, n_items, train, rows, k)

    n, factors = nmf_search(spark, nmf_ranks, nmf_rounds,
                            lambda k, most, marks: twosided.fit_nmf(m, ids, offset, k, most, marks=marks), nmf_scores, valid)
    return report(spark, best_rank=b["rank"], validation_auc=b["metric"],
                  als_test_auc=auc(scores(b["rank"], b["reg"], b["iters"], test), test),
                  nmf_rank=n["rank"], nmf_rounds=n["rounds"], nmf_validation_auc=n["metric"],
                  nmf_test_auc=auc(nmf_scores(factors, n["rank"], test), test),
                  exact_test_auc=auc(twosided.scores(m, train, test), test),
                  diversity=d["mean"], diversity_median=d["median"], diversity_quarter=d["quarter"])


def left_half(spark, ratings, ranks=(16, 25), regs=(0.1, 0.01), iters=(10, 20), nmf_ranks=(16, 25), nmf_rounds=(50, 80)):
    """ALS on [X, Y] and NMF on [X; Y] with the dense Y, scored on the left half, each chosen by validation AUC."""
    train, valid, test = _split3(ratings)
    offset = C.id_bound(ratings, "item_id")

    def scores(rank, reg, iters, rows):
        return factor.predict(Q._left_half_model(train, offset, rank, iters, reg), _pairs(rows))

    b = best_row(search.search(spark, search.grid(rank=ranks, reg=regs, iters=iters),
                               lambda **g: auc(scores(**g, rows=valid), valid)))
    below = C.id_bound(ratings, "user_id")
    cells, base, rows = Q._left_half_stack(train, ratings, below)

    def nmf_scores(m, k, rows):
        users = m.rows.where(F.col("id") < below).withColumnRenamed("id", "user_id")
        return factor.score_pairs(_pairs(rows), users, m.cols, k)

    n, m = nmf_search(spark, nmf_ranks, nmf_rounds, lambda k, most, marks: nmf.nmf_fit(
        cells, k, most, base=base, row_ids=rows, base_from=below, marks=marks), nmf_scores, valid)
    return report(spark, best_rank=b["rank"], validation_auc=b["metric"],
                  test_auc=auc(scores(b["rank"], b["reg"], b["iters"], test), test),
                  nmf_rank=n["rank"], nmf_rounds=n["rounds"], nmf_validation_auc=n["metric"],
                  nmf_test_auc=auc(nmf_scores(m, n["rank"], test), test))


def neg_blend(spark, ratings, ranks=(16, 12), regs=(0.1, 0.01), iters=(10, 20), nmf_ranks=(16, 25), nmf_rounds=(50, 80)):
    """[X, Y Y^T X] side by side by ALS (binary Y, halves blended 1, -0.5) and one above the other by
    NMF (graded dense Y, blended 1, +0.5; cells of Y Y^T X below 0.2 are 0), each chosen by validation AUC."""
    train, valid, test = _split3(ratings)
    offset = C.id_bound(ratings, "item_id")
    stack = freeze(Q._neg_blend_cells(train, offset))  # the same for all settings
    fitted = {}

    def measure(rank, reg, iters):
        fitted[rank, reg, iters] = Q._neg_blend_halves(factor.als_fit(stack, rank, iters, reg), offset)
        return auc(factor.blend_pairs(_pairs(valid), fitted[rank, reg, iters], rank, -0.5), valid)

    b = best_row(search.search(spark, search.grid(rank=ranks, reg=regs, iters=iters), measure))
    als_auc = auc(factor.blend_pairs(_pairs(test), fitted[b["rank"], b["reg"], b["iters"]], b["rank"], -0.5), test)
    below = C.id_bound(ratings, "user_id")
    far = propagated.propagated(train, ratings.select("item_id").distinct().count())
    halves = {}

    def blended(m, k, rows):
        if id(m) not in halves:
            halves[id(m)] = Q._tall_halves(m, below)
        return factor.blend_pairs(_pairs(rows), halves[id(m)], k, 0.5)

    n, m = nmf_search(spark, nmf_ranks, nmf_rounds, lambda k, most, marks: Q._tall_blend_model(train, far, below, k, most, marks),
                      blended, valid)
    return report(spark, best_rank=b["rank"], validation_auc=b["metric"], als_test_auc=als_auc,
                  nmf_rank=n["rank"], nmf_rounds=n["rounds"], nmf_validation_auc=n["metric"],
                  nmf_test_auc=auc(blended(m, n["rank"], test), test), cut_cells=far.fixes.count())


def pair_model(spark, ratings, k=25, nmf_iters=50, hidden=128, iters=15, batch=50, steps=2000, rate=1e-3):
    """Two-sided embeddings, the two-tower model and a perceptron on them: AUC on the last rows."""
    train, valid, test = _split3(ratings)
    emb = Q._embeddings(train, ratings, k, nmf_iters)
    emb = pairmodel.Embeddings(freeze(emb.users), freeze(emb.items))
    model = pairmodel.fit_pair_model(train, emb, k, hidden, iters)
    both = [auc(pairmodel.score_with(model, _pairs(x), emb), x) for x in (valid, test)]
    net = towers.fit_towers(train, emb, hidden, batch, steps, rate)
    tower = [auc(towers.score_towers(net, _pairs(x), emb), x) for x in (valid, test)]
    return report(spark, validation_auc=both[0], test_auc=both[1], first_loss=net.losses[0], last_loss=net.losses[-1],
                  tower_validation_auc=tower[0], tower_test_auc=tower[1])


def block_files(spark, path, nmf_ranks=(30, 40), nmf_rounds=(50, 80)):
    """Block files: read, trim, random split; the exact scorers, ALS, and NMF of S, of X and of [S; Y^T X],
    rank and rounds of each chosen by AUC on a tenth of the training rows that no fit has seen."""
    r = blocks.read_blocks(spark, path).select(
        "user_id", "item_id", "rating", (F.date_diff(F.to_date("date"), F.to_date(F.lit("1970-01-01"))).cast("long") * Q.DAY).alias("ts"))
    raw = freeze(r)
    ids = ["user_id", "item_id"]
    kept = freeze(splits.by_hash(clean.trim_by_activity(raw), ids))
    train, test = (kept.where(F.col("role") == x).drop("role") for x in ("train", "test"))
    inner = freeze(splits.by_hash(train, ids, 0.9, 7))
    fitted, valid = (inner.where(F.col("role") == x).drop("role") for x in ("train", "test"))
    n_items = kept.select("item_id").distinct().count()
    m = twosided.build(train, n_items)
    by_s = score.score_cells(Q.stars(train), m.s, _pairs(test))
    pref = factor.predict(Q._pref_model(train, 8, 5, 0.1), _pairs(test))

    prefs, offset = freeze(C.graded(fitted)), C.id_bound(kept, "item_id")
    s, x = freeze(scale.minmax_positive(freeze(C.item_gram(fitted)))), freeze(C.as_cells(prefs, "x"))
    both, known = twosided.build(fitted, n_items), kept.select(F.col("item_id").alias("id"))
    forms = {
        "gram": (lambda k, most, marks: nmf.nmf_fit(s, k, most, marks=marks),
                 lambda f, k, rows: factor.score_pairs(_pairs(rows), factor.user_vectors(prefs, f.rows, k), f.cols, k)),
        "preference": (lambda k, most, marks: nmf.nmf_fit(x, k, most, marks=marks),
                       lambda f, k, rows: factor.score_pairs(_pairs(rows), f.rows.withColumnRenamed("id", "user_id"), f.cols, k)),
        "two_sided": (lambda k, most, marks: twosided.fit_nmf(both, known, offset, k, most, marks=marks),
                      lambda f, k, rows: twosided.nmf_scores(f, offset, n_items, fitted, rows, k)),
    }
    found = {}
    for name, (fit, scores) in forms.items():
        n, model = nmf_search(spark, nmf_ranks, nmf_rounds, fit, scores, valid)
        found |= {f"{name}_nmf_rank": n["rank"], f"{name}_nmf_rounds": n["rounds"], f"{name}_nmf_validation_auc": n["metric"],
                  f"{name}_nmf_auc": auc(scores(model, n["rank"], test), test)}
    return report(spark, n_read=raw.count(), n_kept=kept.count(), n_items=n_items,
                  gram_auc=auc(by_s, test), two_sided_auc=auc(twosided.scores(m, train, test), test),
                  preference_auc=auc(pref, test), **found)


def explore(spark, ratings, items, user_id, item_id, rank=100, epochs=20, rate=0.005):
    """Statistics, trimming, biased factors cross-validated in 3 and in 5 folds, similar titles."""
    ratings = freeze(ratings)
    s = stats.dataset_stats(ratings).first()
    kept = freeze(clean.trim_by_activity(ratings))
    cv = {r["folds"]: r for r in sgd.cross_validate(kept, (3, 5), rank=rank, epochs=epochs, rate=rate).groupBy("folds").agg(
        F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae")).collect()}
    liked = recommend.favourites(kept, items, user_id).count()
    alike = similar.similar_titles(kept, items, item_id).count()
    return report(spark, n_ratings=s["n_ratings"], n_users=s["n_users"], n_items=s["n_items"], n_kept=kept.count(),
                  cv_rmse=cv[3]["rmse"], cv_mae=cv[3]["mae"], cv5_rmse=cv[5]["rmse"], cv5_mae=cv[5]["mae"],
                  favourites=liked, similar=alike)


def cell_products(spark, ratings, rank=8, reg=0.1, iters=5, unit=1):
    """Binary [X^T X; Y^T X] as distributed cells, its shape, and ALS on it."""
    r = freeze(splits.by_digit3(ratings, unit=unit))
    train, test = (r.where(F.col("role") == x).drop("role") for x in ("train", "test"))
    offset = C.id_bound(r, "item_id")
    t = freeze(Q._two_sided_cells(train, offset))
    shape = t.agg(F.max("row") + 1, F.max("col") + 1, F.count(F.lit(1))).first()
    got = Q._score_two_sided_model(factor.als_fit(t, rank, iters, reg), rank, train, test, offset)
    return report(spark, n_rows=shape[0], n_cols=shape[1], n_cells=shape[2], test_auc=auc(got, test))


@query
def job_als_tutorial(spark, d):
    return als_tutorial(spark, Q.li(spark, d), tables.items_from_parts(spark, d), Q.USER, Q.DAY)


@query
def job_item_gram(spark, d):
    return item_gram(spark, freeze(Q.ev(spark, d)), iters=(10,), nmf_ranks=(8, 16), nmf_rounds=(4, 8))


@query
def job_preferences(spark, d):
    return preferences(spark, freeze(Q.ev(spark, d)), iters=(10,), nmf_ranks=(8, 16), nmf_rounds=(4, 8))


@query
def job_two_sided(spark, d):
    return two_sided(spark, freeze(Q.ev(spark, d)), iters=(10,), nmf_ranks=(8, 16), nmf_rounds=(4, 8))


@query
def job_left_half(spark, d):
    return left_half(spark, freeze(Q.ev(spark, d)), iters=(10,), nmf_ranks=(8, 16), nmf_rounds=(4, 8))


@query
def job_neg_blend(spark, d):
    return neg_blend(spark, freeze(Q.ev(spark, d)), ranks=(8, 12), regs=(0.1,), iters=(5, 10), nmf_ranks=(8,), nmf_rounds=(3, 6))


@query
def job_pair_model(spark, d):
    return pair_model(spark, freeze(Q.ev(spark, d)), k=4, nmf_iters=3, hidden=32, batch=256, steps=40, rate=0.01)


@query
def job_block_files(spark, d):
    path = scratch_path(spark, "blocks")
    sinks.write_blocks(Q.ev(spark, d), path)
    return block_files(spark, path, nmf_ranks=(4, 8), nmf_rounds=(2, 4))


@query
def job_explore(spark, d):
    return explore(spark, Q.ev(spark, d), tables.items_from_parts(spark, d), Q.USER, Q.ITEM, rank=8, epochs=4, rate=0.02)


@query
def job_reviews(spark, d):
    """Read, label and split the reviews: rows per sentiment and role."""
    r = text.not_neutral(tables.reviews_from_labels(spark, d)).withColumn("sentiment", sentiment())
    return splits.by_hash(r, ["summary"], 0.8, 42).groupBy("sentiment", "role").agg(F.count(F.lit(1)).alias("n"))


@query
def job_cell_products(spark, d):
    return cell_products(spark, Q.ev(spark, d))


@query
def job_cv_subsets(spark, d):
    """Write the five positional folds and both per-user splits; rows of each part."""
    r = freeze(Q.ev(spark, d))
    parts = splits.five_fold(r).select(F.concat(F.lit("r"), "fold").alias("set"), *r.columns).withColumn("role", F.lit("test"))
    for name, start, stop in (("ra", 1, 10), ("rb", 11, 20)):
        parts = parts.unionByName(splits.all_but(r, start, stop).withColumn("set", F.lit(name)))
    path = scratch_path(spark, "subsets")
    sinks.write_splits(parts.withColumnRenamed("set", "fold"), path)
    return spark.read.parquet(path).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))
