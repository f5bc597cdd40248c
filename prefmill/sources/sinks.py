"""Writers. All write in parallel, one file per partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_delimited(df: DataFrame, path: str, sep: str = "::", encoding: str = "UTF-8") -> None:
    """Fields joined by ``sep``, nulls as empty fields."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    lines = df.select(F.concat_ws(sep, *fields).alias("value"))
    if encoding == "UTF-8":
        lines.write.text(path)
    else:  # the text sink knows no other encoding
        lines.write.csv(path, sep="\x01", quote="", escapeQuotes=False, encoding=encoding)


def write_table(df: DataFrame, path: str) -> None:
    """Curves, diversity values, factors, embeddings, reports."""
    df.write.mode("overwrite").parquet(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per fold and role."""
    by = [c for c in ("fold", "role") if c in df.columns]
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_blocks(ratings: DataFrame, path: str, piece_rows: int = 100_000) -> None:
    """Block files. An item's ratings are cut into blocks of about ``piece_rows``, each with
    its own header, so that one popular item does not become one task."""
    pieces = ratings.groupBy("item_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(piece_rows)).alias("pieces"))
    own = ratings.join(pieces, "item_id").select(
        "item_id", F.pmod(F.xxhash64("user_id"), F.col("pieces")).alias("piece"), F.lit(1).alias("line"), "user_id",
        F.concat_ws(",", F.col("user_id").cast("string"), F.col("rating").cast("int").cast("string"),
                    F.expr("date_add(DATE'1970-01-01', CAST(floor(ts / 86400) AS INT))").cast("string")).alias("value"),
    )
    heads = own.select("item_id", "piece").distinct().select(
        "item_id", "piece", F.lit(0).alias("line"), F.lit(None).cast("long").alias("user_id"),
        F.concat(F.col("item_id").cast("string"), F.lit(":")).alias("value"))
    own.unionByName(heads).repartitionByRange("item_id", "piece").sortWithinPartitions(
        "item_id", "piece", "line", "user_id").select("value").write.text(path)
