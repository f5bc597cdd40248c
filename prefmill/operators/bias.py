"""Biased factor model: mean, item and user biases, and ALS on what is left."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame, functions as F

from ..functions.prefs import clamp
from ..functions.vectors import dot
from ..session import freeze
from .factor import als_fit, col_factors, row_factors

ITEM_DAMPING = 10.0
USER_DAMPING = 15.0


@dataclass
class Biases:
    mean: float
    items: DataFrame
    users: DataFrame


def fit_biases(ratings: DataFrame, item_damping: float = ITEM_DAMPING, user_damping: float = USER_DAMPING) -> Biases:
    """Damped deviations from the mean: items first, then users on the remainder."""
    mean = float(ratings.agg(F.avg("rating")).first()[0])
    items = freeze(ratings.groupBy("item_id").agg(
        (F.sum(F.col("rating") - mean) / (item_damping + F.count(F.lit(1)))).alias("item_bias")))
    rest = ratings.join(items, "item_id")
    users = freeze(rest.groupBy("user_id").agg(
        (F.sum(F.col("rating") - mean - F.col("item_bias")) / (user_damping + F.count(F.lit(1)))).alias("user_bias")))
    return Biases(mean, items, users)


def with_biases(pairs: DataFrame, b: Biases) -> DataFrame:
    """Add ``base``: mean plus the biases known for the pair."""
    zero = F.lit(0.0)
    return pairs.join(b.items, "item_id", "left").join(b.users, "user_id", "left").withColumn(
        "base", F.lit(b.mean) + F.coalesce("item_bias", zero) + F.coalesce("user_bias", zero)
    ).drop("item_bias", "user_bias")


@dataclass
class BiasedModel:
    biases: Biases
    als: ALSModel
    rank: int


def fit_biased(ratings: DataFrame, rank: int = 8, iters: int = 5, reg: float = 0.1, seed: int = 999) -> BiasedModel:
    b = fit_biases(ratings)
    rest = with_biases(ratings, b).select(
        F.col("user_id").alias("row"), F.col("item_id").alias("col"), (F.col("rating") - F.col("base")).alias("value"))
    return BiasedModel(b, als_fit(rest, rank, iters, reg, nonnegative=False, seed=seed), rank)


def predict_biased(model: BiasedModel, pairs: DataFrame) -> DataFrame:
    """Estimates on the 1..5 scale for every pair; unknown ids fall back to what is known."""
    u = row_factors(model.als).select(F.col("id").alias("user_id"), F.col("features").alias("_u"))
    v = col_factors(model.als).select(F.col("id").alias("item_id"), F.col("features").alias("_v"))
    scored = with_biases(pairs, model.biases).join(u, "user_id", "left").join(v, "item_id", "left")
    return scored.withColumn(
        "score", clamp(F.col("base") + F.coalesce(dot("_u", "_v", model.rank), F.lit(0.0)))
    ).drop("_u", "_v", "base")
