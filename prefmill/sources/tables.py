"""Rating, item and review tables derived from the star-schema Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.clean import latest_per_cell

# Lower bounds of ratings 2..5 on the event value.
VALUE_STEPS = (11, 25, 45, 80)
# Items of the events ratings: ids 0 .. 99 at every scale.
EVENT_ITEMS = 100


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def epoch_seconds(ts: str) -> Column:
    """Seconds since 1970 of a zone-free timestamp, whatever the session zone."""
    c = F.col(ts)
    days = F.date_diff(c.cast("date"), F.to_date(F.lit("1970-01-01"))).cast("long")
    return days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def ratings_from_events(spark: SparkSession, folder: str, dedup: bool = True) -> DataFrame:
    """Dense ratings: users x 100 items, stars by event value."""
    stars = F.lit(1)
    for step in VALUE_STEPS:
        stars = stars + (F.col("value") >= step).cast("int")
    raw = table(spark, folder, "events").select(
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        stars.cast("double").alias("rating"),
        epoch_seconds("ts").alias("ts"),
        "event_id",
    )
    if not dedup:
        return raw
    return latest_per_cell(raw, ["ts", "event_id"])


def ratings_from_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse ratings: customers x parts, stars by ordered quantity."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate"
    )
    raw = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("rating"),
        epoch_seconds("l_shipdate").alias("ts"),
        "l_orderkey",
        "l_linenumber",
    )
    return latest_per_cell(raw, ["ts", "l_orderkey", "l_linenumber"])


def items_from_parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("title"),
        F.split("p_type", " ").alias("genres"),
    )


def reviews_from_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Scores 1..5 (from the two label columns and the text length) with the text."""
    labels = table(spark, folder, "labels")
    docs = table(spark, folder, "documents").select("doc_id", "text", "n_chars")
    score = 1 + 2 * F.col("quality") + (1 - F.col("toxic")) + (F.col("n_chars") % 2)
    return labels.join(docs, "doc_id").select(
        "doc_id", score.cast("int").alias("score"), F.col("text").alias("summary")
    )
