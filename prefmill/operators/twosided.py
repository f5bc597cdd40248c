"""Scores from the positive and negative item matrices, S = X^T X and Y^T X."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.prefs import UNSEEN_DISLIKE
from ..functions.vectors import dot
from ..session import freeze
from .cells import column_base, graded, graded_cross, item_gram, user_mass
from .factor import dislike_vectors, product_span, user_vectors
from .nmf import Nmf, nmf_fit
from .scale import Span, minmax_positive, positive_span
from .score import score_cells

BETA = 0.2


@dataclass
class TwoSided:
    """S, the per-column base of Y^T X, catalogue size, and the scaling spans."""

    s: DataFrame
    base: DataFrame
    n_items: int
    pos: Span
    neg: Span


def build(train: DataFrame, n_items: int) -> TwoSided:
    s, base = freeze(item_gram(train)), freeze(column_base(train))
    return TwoSided(s, base, n_items, positive_span(s), positive_span(graded_cross(s, base, n_items)))


def _facts(m: TwoSided, train: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets with x S, x S scaled, column base and sum, and the user's mass."""
    s = m.s.withColumn("scaled", m.pos.scale("value"))
    prefs = train.select("user_id", "item_id", (F.col("rating") / 5).alias("value"))
    met = score_cells(prefs, s, targets.select("user_id", "item_id"), ["value", "scaled"], ["xs", "xs_scaled"])
    sums = m.s.groupBy("col").agg(F.sum("value").alias("s_sum"))
    columns = m.base.join(sums, "col").withColumnRenamed("col", "item_id")
    return met.join(columns, "item_id", "left").join(user_mass(train), "user_id", "left").na.fill(
        0.0, ["mass", "base", "s_sum"])


def _y_cross(n_items: int):
    """y_u (Y^T X) at a cell, from ``_facts`` columns."""
    return UNSEEN_DISLIKE * (n_items * F.col("base") - F.col("s_sum")) - F.col("mass") * F.col("base") + F.col("xs")


def propagate(m: TwoSided, train: DataFrame, targets: DataFrame) -> DataFrame:
    """Y (Y^T X) at the target cells, graded and dense."""
    return _facts(m, train, targets).select("user_id", "item_id", _y_cross(m.n_items).alias("score"))


def scores(m: TwoSided, train: DataFrame, targets: DataFrame, beta: float = BETA) -> DataFrame:
    """[x, beta y] T at the target cells, T being S and Y^T X, each scaled over
    its positive cells, one above the other. Every cell of Y^T X in a column
    with ratings is positive, so its scaling is affine."""
    width = m.neg.high - m.neg.low
    y_sum = UNSEEN_DISLIKE * m.n_items - F.col("mass")
    scaled = (_y_cross(m.n_items) - m.neg.low * y_sum) / width if width > 0 else y_sum
    lower = F.when(F.col("base") > 0, scaled).otherwise(0.0)
    return _facts(m, train, targets).select(
        "user_id", "item_id", (F.col("xs_scaled") + beta * lower).alias("score"))


def fit_nmf(m: TwoSided, item_ids: DataFrame, offset: int, k: int, iters: int, seed: int = 0, marks: tuple[int, ...] = ()) -> Nmf:
    """Non-negative factors of the scaled [S; Y^T X], graded. The lower half starts
    at row ``offset`` and enters as a column constant less the scaled cells of S."""
    width = (m.neg.high - m.neg.low) or 1.0
    upper = minmax_positive(m.s, span=m.pos)
    lower = m.s.select((F.col("row") + offset).alias("row"), "col", (-F.col("value") / width).alias("value"))
    base = m.base.select("col", ((F.col("base") - m.neg.low) / width).alias("value"))
    ids = item_ids.select("id").distinct()
    rows = ids.unionByName(ids.select((F.col("id") + offset).alias("id")))
    return nmf_fit(freeze(upper.unionByName(lower)), k, iters, seed, base, rows, offset, marks)


def nmf_scores(model: Nmf, offset: int, n_items: int, train: DataFrame, targets: DataFrame, k: int,
               beta: float = 0.5) -> DataFrame:
    """[x, beta y] times the completed halves, each scaled over its positive cells.

    Completed cells of two factor rows that are not all 0 are positive, and their
    scaling is affine: it moves out of the product. Rows that the updates have
    set to 0 complete to 0 cells, which stay 0: they take no part in the sums.
    """
    pos = freeze(model.rows.where(F.col("id") < offset))
    neg = freeze(model.rows.where(F.col("id") >= offset).withColumn("id", F.col("id") - offset))
    prefs = graded(train)
    up = user_vectors(prefs, pos, k).withColumnRenamed("features", "_up")
    down = dislike_vectors(user_vectors(prefs, neg, k), neg, k).withColumnRenamed("features", "_down")
    items = model.cols.select(F.col("id").alias("item_id"), F.col("features").alias("_v"))
    a, b = product_span(pos, model.cols), product_span(neg, model.cols)
    live = F.exists("features", lambda x: x > 0)
    live_pos, live_neg = (m.where(live).select(F.col("id").alias("item_id")) for m in (pos, neg))
    n_down = live_neg.count()
    mass = prefs.select("user_id", "item_id", "x").join(live_pos.withColumn("_p", F.lit(1)), "item_id", "left").join(
        live_neg.withColumn("_n", F.lit(1)), "item_id", "left").groupBy("user_id").agg(
        F.coalesce(F.sum(F.col("x") * F.col("_p")), F.lit(0.0)).alias("_mass_up"),
        F.coalesce(F.sum(F.col("x") * F.col("_n")), F.lit(0.0)).alias("_mass_down"))
    y_sum = UNSEEN_DISLIKE * n_down - F.col("_mass_down")
    upper = (dot("_up", "_v", k) - a.low * F.col("_mass_up")) / ((a.high - a.low) or 1.0)
    lower = (dot("_down", "_v", k) - b.low * y_sum) / ((b.high - b.low) or 1.0)
    score = F.when(F.exists("_v", lambda x: x > 0), upper + beta * lower).otherwise(F.lit(0.0))
    return (
        targets.select("user_id", "item_id").join(up.join(down, "user_id"), "user_id")
        .join(mass, "user_id").join(items, "item_id").select("user_id", "item_id", score.alias("score"))
    )
