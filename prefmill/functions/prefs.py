"""Preference, label and scaling expressions on rating columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

STARS = 5            # top of the rating scale
LIKED = 3            # lowest rating that counts as positive
UNSEEN_DISLIKE = 1.2  # graded negative preference of a cell nobody rated


def liked(rating: str = "rating", threshold: float = LIKED) -> Column:
    return (F.col(rating) >= threshold).cast("int")


def graded_like(rating: str = "rating") -> Column:
    return F.col(rating) / STARS


def observed(rating: str = "rating") -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(rating)))


def graded_dislike(rating: str = "rating") -> Column:
    return (STARS + 1 - F.col(rating)) / STARS


def disliked(rating: str = "rating", threshold: float = LIKED) -> Column:
    return observed(rating).cast("int") - liked(rating, threshold)


def sentiment(score: str = "score") -> Column:
    return F.when(F.col(score) < LIKED, "negative").otherwise("positive")


def sigmoid(x: str | Column) -> Column:
    return 1 / (1 + F.exp(-(F.col(x) if isinstance(x, str) else x)))


def clamp(x: Column, low: float = 1.0, high: float = 5.0) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def last_digit(ts: str = "ts", unit: int = 1) -> Column:
    """Last digit of the timestamp counted in ``unit`` seconds."""
    return F.floor(F.col(ts) / unit) % 10


def rated_at(ts: str = "ts") -> Column:
    """The moment of a rating, from epoch seconds."""
    return F.timestamp_seconds(ts)
