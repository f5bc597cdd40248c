"""Block files: a line ``item:`` followed by that item's ``user,rating,date`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

HEADER = r"^(\d+):\s*$"


def read_blocks(spark: SparkSession, path) -> DataFrame:
    """Ratings with the item id of the header above them.

    Lines are ordered within a file split. The last header of each split is
    carried into the following splits of the same file, so a block may span
    any number of splits and the file is never read as one piece.
    """
    lines = spark.read.text(path).select(
        "value",
        F.monotonically_increasing_id().alias("at"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    ).where(F.trim("value") != "")
    header = F.when(F.col("value").rlike(HEADER), F.regexp_extract("value", HEADER, 1).cast("long"))
    lines = lines.withColumn("header", header)

    within = Window.partitionBy("file", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    filled = lines.withColumn("local", F.last("header", ignorenulls=True).over(within))

    ends = lines.groupBy("file", "start").agg(F.max_by("header", F.when(F.col("header").isNotNull(), F.col("at"))).alias("end"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("file", "start", F.last("end", ignorenulls=True).over(earlier).alias("carried"))

    field = F.split("value", ",")
    return (
        filled.where("header IS NULL").join(carried, ["file", "start"], "left")
        .select(
            field[0].cast("long").alias("user_id"),
            F.coalesce("local", "carried").alias("item_id"),
            field[1].cast("double").alias("rating"),
            field[2].alias("date"),
        )
    )
