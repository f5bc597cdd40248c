"""Readers of the delimited rating-data formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.clean import require_rows

# Age codes of the users file.
AGE_GROUPS = {
    1: "Under 18", 18: "18-24", 25: "25-34", 35: "35-44", 45: "45-49", 50: "50-55", 56: "56+",
}
# Occupation codes of the users file.
OCCUPATIONS = {
    0: "other", 1: "academic/educator", 2: "artist", 3: "clerical/admin", 4: "college/grad student",
    5: "customer service", 6: "doctor/health care", 7: "executive/managerial", 8: "farmer",
    9: "homemaker", 10: "K-12 student", 11: "lawyer", 12: "programmer", 13: "retired",
    14: "sales/marketing", 15: "scientist", 16: "self-employed", 17: "technician/engineer",
    18: "tradesman/craftsman", 19: "unemployed", 20: "writer",
}


def _delimited(spark: SparkSession, path, schema: str, sep: str = "::", encoding: str = "UTF-8") -> DataFrame:
    """Plain split at ``sep``: quotes and blanks are data. Short lines give nulls."""
    return spark.read.csv(path, schema=schema, sep=sep, quote="", encoding=encoding)


def read_ratings(spark: SparkSession, path, sep: str = "::") -> DataFrame:
    """``user::item::rating[::timestamp]``; ratings of 0 are not ratings."""
    raw = _delimited(spark, path, "user_id long, item_id long, rating double, ts long", sep)
    return raw.where(F.col("rating") > 0)


def read_ratings_checked(spark: SparkSession, path, sep: str = "::") -> DataFrame:
    return require_rows(read_ratings(spark, path, sep))


def read_items(spark: SparkSession, path) -> DataFrame:
    """``item::title::genre|genre``."""
    raw = _delimited(spark, path, "item_id long, title string, genres string")
    return raw.withColumn("genres", F.split("genres", "[|]"))


def _decoded(code: str, names: dict[int, str]) -> Column:
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.create_map(*pairs)[F.col(code)]


def read_users(spark: SparkSession, path) -> DataFrame:
    """``user::gender::age code::occupation code::zip``, codes spelled out."""
    raw = _delimited(
        spark, path, "user_id long, gender string, age_code int, occupation_code int, zip string")
    return raw.withColumn("age", _decoded("age_code", AGE_GROUPS)).withColumn(
        "occupation", _decoded("occupation_code", OCCUPATIONS))


def read_tags(spark: SparkSession, path) -> DataFrame:
    return _delimited(spark, path, "user_id long, item_id long, tag string, ts long")


def read_personal_ratings(spark: SparkSession, path) -> DataFrame:
    """``0::item::rating::ts[::title]`` where ``?`` means not rated; such rows are dropped."""
    raw = _delimited(spark, path, "user_id long, item_id long, entry string, ts long, title string")
    return raw.withColumn("rating", F.expr("try_cast(entry AS DOUBLE)")).where(
        F.col("rating").between(1, 5)).select("user_id", "item_id", "rating", "ts", "title")


def read_titles(spark: SparkSession, path) -> DataFrame:
    """``id,year,name`` in Latin-1 without header; names may hold commas."""
    line = _delimited(spark, path, "line string", sep="\x01", encoding="ISO-8859-1")
    part = F.split("line", ",", 3)
    return line.select(
        part[0].cast("long").alias("item_id"),
        F.expr("try_cast(split(line, ',', 3)[1] AS DOUBLE)").alias("year"),
        part[2].alias("name"),
    )


def read_registrations(spark: SparkSession, path) -> DataFrame:
    return _delimited(
        spark, path, "date date, uuid string, customer_id string, lat double, lon double", sep="\t")


def read_clicks(spark: SparkSession, path) -> DataFrame:
    return _delimited(spark, path, "date date, uuid string, landing_page int", sep="\t")


def read_edges(spark: SparkSession, path) -> DataFrame:
    return _delimited(spark, path, "src long, dst long", sep=" ")


def read_points(spark: SparkSession, path) -> DataFrame:
    """Blank-separated coordinates, one point per line."""
    xs = F.transform(F.split(F.trim("value"), "\\s+"), lambda x: x.cast("double"))
    return spark.read.text(path).select(xs.alias("features"))


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Score and summary of reviews that are not neutral; the filter reaches the scan."""
    return not_neutral(spark.read.parquet(path))


def read_reviews_jdbc(spark: SparkSession, url: str, table: str = "Reviews", **options) -> DataFrame:
    """The same from a database; projection and filter are pushed to it."""
    return not_neutral(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load())


def not_neutral(reviews: DataFrame) -> DataFrame:
    return reviews.select("score", "summary").where(F.col("score") != 3)
