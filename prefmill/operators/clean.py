"""Cleaning: duplicates, validity, activity trimming."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import freeze


def latest_per_cell(raw: DataFrame, order: list[str]) -> DataFrame:
    """One row per (user, item): the latest by ``order``, then by rating.

    An aggregate, not a window, so that copies of one cell are merged before
    the shuffle however many there are.
    """
    last = F.max(F.struct(*order, "rating")).alias("last")
    return raw.groupBy("user_id", "item_id").agg(last).select(
        "user_id", "item_id", F.col("last.rating").alias("rating"), F.col("last.ts").alias("ts")
    )


def require_rows(df: DataFrame, what: str = "ratings") -> DataFrame:
    """Fail early on empty input."""
    if df.isEmpty():
        raise ValueError(f"no {what} provided")
    return df


def check_entries(raw: DataFrame) -> DataFrame:
    """Classify entered ratings: stored (1..5), skipped (0 or '?') or rejected.

    ``raw`` carries the rating as text in ``entry``.
    """
    value = F.expr("try_cast(entry AS INT)")
    return raw.withColumn(
        "status",
        F.when(value.between(1, 5), "stored")
        .when((value == 0) | (F.trim("entry") == "?"), "skipped")
        .otherwise("rejected"),
    ).withColumn("rating", F.when(F.col("status") == "stored", value.cast("double")))


def sizes_of(ratings: DataFrame, key: str) -> DataFrame:
    return ratings.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def activity_floor(sizes: DataFrame, q: float = 0.7) -> float:
    """The rounded ``q`` quantile (interpolated, half to even) of ``sizes_of`` a key.

    Equal sizes are counted first, so the quantile sees distinct sizes only.
    """
    freq = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("f"))
    return float(freq.agg(F.bround(F.percentile("n", F.lit(q), F.col("f")), 0).alias("x")).first()["x"])


def trim_by_activity(ratings: DataFrame, q: float = 0.7) -> DataFrame:
    """Drop items and users rated less often than the ``q`` quantile.

    Both floors come from the untrimmed table.
    """
    kept = ratings
    for key in ("item_id", "user_id"):
        sizes = freeze(sizes_of(ratings, key))
        rare = sizes.where(F.col("n") < activity_floor(sizes, q)).select(key)
        kept = kept.join(rare, key, "left_anti")
    return kept.select(*ratings.columns)
