"""Counts, histograms and summaries of rating tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def dataset_stats(ratings: DataFrame) -> DataFrame:
    """One row: sizes, distinct ids, missing ratings, matrix shape."""
    return ratings.agg(
        F.count(F.lit(1)).alias("n_ratings"),
        F.count_distinct("user_id").alias("n_users"),
        F.count_distinct("item_id").alias("n_items"),
        F.count_if(F.col("rating").isNull()).alias("n_missing"),
        (F.max("user_id") + 1).alias("n_rows"),
        (F.max("item_id") + 1).alias("n_cols"),
    )


def rating_histogram(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


def summary_by(ratings: DataFrame, key: str) -> DataFrame:
    return ratings.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_ratings"), F.avg("rating").alias("mean_rating")
    )


def matrix_histogram(ratings: DataFrame) -> DataFrame:
    """Value counts of the zero-filled users x items matrix, without filling it."""
    counts = rating_histogram(ratings).withColumnRenamed("rating", "value")
    shape = ratings.agg(
        F.count_distinct("user_id").alias("u"), F.count_distinct("item_id").alias("i"),
        F.count(F.lit(1)).alias("n"),
    )
    empty = shape.select(F.lit(0.0).alias("value"), (F.col("u") * F.col("i") - F.col("n")).alias("n"))
    return counts.unionByName(empty.where("n > 0"))


def pivot_ratings(ratings: DataFrame, item_ids: list[int]) -> DataFrame:
    """Wide export for a given list of items; 0 where unrated. Ratings of other items are refused, not dropped."""
    known = ratings.sparkSession.createDataFrame([(i,) for i in item_ids], "item_id long")
    if not ratings.join(known, "item_id", "left_anti").isEmpty():
        raise ValueError("ratings of items that are not in the list")
    wide = ratings.groupBy("user_id").pivot("item_id", item_ids).agg(F.avg("rating"))
    return wide.select(
        "user_id", *[F.coalesce(F.col(f"`{i}`"), F.lit(0.0)).alias(f"item_{i}") for i in item_ids]
    )


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts over equal bins of ``[low, high]``; the last bin is closed."""
    bucket = F.least(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    return (
        df.where(F.col(value).between(low, high))
        .groupBy(bucket.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def genre_counts(items: DataFrame) -> DataFrame:
    return items.select(F.explode("genres").alias("genre")).groupBy("genre").agg(
        F.count(F.lit(1)).alias("n"))
