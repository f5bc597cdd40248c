"""Preference matrices as cell tables, stacking, and the dense negative side.

The graded negative preference is 1.2 on every unrated cell. It is never
stored: with X the graded positive cells, c its column sums and S = X^T X,

    Y^T X [i, j]      = 1.2 c_j - S[i, j]
    y_u (Y^T X) [j]   = 1.2 (n b_j - s_j) - b_j |x_u| + (x_u S)[j],   b_j = 1.2 c_j

for n catalogue items, s_j the column sums of S and |x_u| the sum of x_u.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.prefs import UNSEEN_DISLIKE, disliked, graded_dislike, graded_like, liked, observed
from ..session import freeze
from .product import cross_product, gram


def graded(ratings: DataFrame) -> DataFrame:
    """X, O and the observed part of Y, graded."""
    return ratings.select(
        "user_id", "item_id", graded_like().alias("x"), observed().alias("o"), graded_dislike().alias("y")
    )


def binary(ratings: DataFrame, threshold: float = 3) -> DataFrame:
    return ratings.select(
        "user_id", "item_id", liked("rating", threshold).alias("x"), observed().cast("int").alias("o"),
        disliked("rating", threshold).alias("y"),
    )


def as_cells(prefs: DataFrame, value: str) -> DataFrame:
    """Cells ``(row=user, col=item, value)`` of the non-zero values."""
    return prefs.where(F.col(value) != 0).select(
        F.col("user_id").alias("row"), F.col("item_id").alias("col"), F.col(value).cast("double").alias("value")
    )


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def star_cells(ratings: DataFrame) -> DataFrame:
    return ratings.select(
        F.col("user_id").alias("row"), F.col("item_id").alias("col"), F.col("rating").alias("value"))


def star_gram(ratings: DataFrame, columns: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """25 S: products of whole stars, whose sums are exact; ``columns`` and ``keep`` as in ``gram``."""
    return gram(star_cells(ratings), columns=columns, keep=keep)


def item_gram(ratings: DataFrame, columns: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """S = X^T X for graded X."""
    return star_gram(ratings, columns, keep).withColumn("value", F.col("value") / 25)


def binary_cross(ratings: DataFrame, threshold: float = 3) -> DataFrame:
    """Y^T X for binary preferences: item i disliked and item j liked by one user."""
    prefs = binary(ratings, threshold)
    y = prefs.where("y = 1").select(
        F.col("user_id").alias("key"), F.col("item_id").alias("row"), F.col("y").alias("value"))
    x = prefs.where("x = 1").select(
        F.col("user_id").alias("key"), F.col("item_id").alias("col"), F.col("x").alias("value"))
    return cross_product(y, x)


def binary_propagation(ratings: DataFrame, threshold: float = 3) -> DataFrame:
    """Y (Y^T X) for binary preferences, users x items."""
    a = freeze(binary_cross(ratings, threshold)).select(F.col("row").alias("key"), "col", "value")
    y = binary(ratings, threshold).where("y = 1").select(
        F.col("item_id").alias("key"), F.col("user_id").alias("row"), F.col("y").alias("value"))
    return cross_product(y, a)


def column_base(ratings: DataFrame) -> DataFrame:
    """Per item j: ``c`` (column sum of graded X) and ``base = 1.2 c``, the value
    of Y^T X wherever S holds no cell."""
    return ratings.groupBy(F.col("item_id").alias("col")).agg(
        (F.sum("rating") / 5).alias("c")
    ).withColumn("base", F.col("c") * UNSEEN_DISLIKE)


def graded_cross(s: DataFrame, base: DataFrame, n_items: int) -> DataFrame:
    """Y^T X for graded preferences, whole but compact: one row per stored cell of
    S, and per column one row with no ``row`` id standing for all other of its
    ``n_items`` cells (left out where there are none). Cells of S that have their
    column's ``base`` already are not joined with it."""
    based = s if "base" in s.columns else s.join(base, "col")
    stored = based.select("row", "col", (F.col("base") - F.col("value")).alias("value"))
    filled = s.groupBy("col").agg(F.count(F.lit(1)).alias("n"))
    rest = base.join(filled, "col", "left").where(F.coalesce("n", F.lit(0)) < n_items).select(
        F.lit(None).cast("long").alias("row"), "col", F.col("base").alias("value"))
    return stored.unionByName(rest)


def user_mass(ratings: DataFrame) -> DataFrame:
    """|x_u| per user."""
    return ratings.groupBy("user_id").agg((F.sum("rating") / 5).alias("mass"))


def vstack(top: DataFrame, bottom: DataFrame, offset: int) -> DataFrame:
    """[top; bottom]: rows of ``bottom`` start at ``offset``. ``block`` tags the part."""
    return top.select("row", "col", "value", F.lit(1).alias("block")).unionByName(
        bottom.select((F.col("row") + offset).alias("row"), "col", "value", F.lit(2).alias("block")))


def hstack(left: DataFrame, right: DataFrame, offset: int) -> DataFrame:
    """[left, right]: columns of ``right`` start at ``offset``."""
    return left.select("row", "col", "value", F.lit(1).alias("block")).unionByName(
        right.select("row", (F.col("col") + offset).alias("col"), "value", F.lit(2).alias("block")))


def unstack(cells: DataFrame, offset: int, axis: str = "row") -> tuple[DataFrame, DataFrame]:
    """Take a stacked table apart again."""
    first = cells.where(F.col(axis) < offset).select("row", "col", "value")
    second = cells.where(F.col(axis) >= offset).withColumn(axis, F.col(axis) - offset)
    return first, second.select("row", "col", "value")


def concat_user_vectors(prefs: DataFrame, offset: int, beta: float = 0.2) -> DataFrame:
    """[x, beta y] per user over observed cells: y moves ``offset`` columns right."""
    return hstack(as_cells(prefs, "x"), as_cells(prefs, "y").withColumn("value", F.col("value") * beta), offset)


def id_bound(ratings: DataFrame, col: str) -> int:
    """One past the largest id: the offset at which a stacked block starts."""
    return int(ratings.agg(F.max(col)).first()[0]) + 1
