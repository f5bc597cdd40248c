"""Similar items by Pearson correlation of zero-filled rating columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import freeze


def pearson_with(ratings: DataFrame, item_id: int) -> DataFrame:
    """Correlation of every item's column with one item's column.

    Missing ratings are zeros, so all moments are sums over stored ratings and
    n is the number of users. Work is linear in the ratings, and the one item's
    column is written first, so that its size decides how it is joined. Items with a
    constant column have no correlation and are left out.
    """
    target = freeze(ratings.where(F.col("item_id") == item_id).select("user_id", F.col("rating").alias("x")))
    n = ratings.agg(F.count_distinct("user_id")).first()[0]
    t = target.agg(F.sum("x"), F.sum(F.col("x") * F.col("x"))).first()
    sx, sxx = float(t[0] or 0.0), float(t[1] or 0.0)
    y = F.col("rating")
    sums = ratings.join(target, "user_id", "left").groupBy("item_id").agg(
        F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.coalesce(F.sum(y * F.col("x")), F.lit(0.0)).alias("sxy"),
        F.count(F.lit(1)).alias("n_ratings"), F.avg("rating").alias("mean_rating"),
    )
    spread = F.sqrt((n * F.lit(sxx) - sx * sx) * (n * F.col("syy") - F.col("sy") * F.col("sy")))
    r = (n * F.col("sxy") - sx * F.col("sy")) / F.nullif(spread, F.lit(0.0))
    return sums.withColumn("pearson", r).where("pearson IS NOT NULL").select(
        "item_id", "pearson", "n_ratings", "mean_rating")


def item_called(items: DataFrame, title: str) -> int:
    """The (smallest) id carrying a title."""
    row = items.where(F.col("title") == title).agg(F.min("item_id")).first()
    if row[0] is None:
        raise ValueError(f"no item is titled {title!r}")
    return int(row[0])


def similar_titles(ratings: DataFrame, items: DataFrame, item_id: int, min_count: int = 0, n: int = 10) -> DataFrame:
    """The ``n`` items most correlated with ``item_id`` (itself included) rated
    more than ``min_count`` times, with titles."""
    best = (
        pearson_with(ratings, item_id).where(F.col("n_ratings") > min_count)
        .orderBy(F.desc(F.round("pearson", 9)), "item_id").limit(n)
    )
    return best.join(items.select("item_id", "title"), "item_id", "left")
