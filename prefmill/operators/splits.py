"""Train / test splits of rating tables. All add columns; none collects rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.prefs import last_digit
from ..session import freeze
from .ordering import is_before, positions, rank_cuts

TIME_ORDER = ["ts", "user_id", "item_id"]
FILE_ORDER = ["user_id", "item_id"]


def by_digit(ratings: DataFrame, bound: int = 8, unit: int = 1) -> DataFrame:
    """Train where the last timestamp digit is below ``bound``, else test."""
    return ratings.withColumn("role", F.when(last_digit("ts", unit) < bound, "train").otherwise("test"))


def by_digit3(ratings: DataFrame, low: int = 6, high: int = 8, unit: int = 1) -> DataFrame:
    digit = last_digit("ts", unit)
    return ratings.withColumn(
        "role",
        F.when(digit < low, "train").when(digit < high, "validation").otherwise("test"),
    )


def by_time(ratings: DataFrame, *shares: float, roles=("train", "validation", "test")) -> DataFrame:
    """Chronological split: the first ``floor(n * share)`` rows are train, and so on.

    One share gives train/test, two give train/validation/test. Rows with equal
    time are ordered by user and item; rows without a time come before all
    others. The cut is found by counting, so the split itself is a filter: no
    sort, no shuffle.
    """
    _, cuts = rank_cuts(ratings, TIME_ORDER, lambda n: [int(n * s) for s in shares])
    names = [roles[0], roles[2]] if len(shares) == 1 else list(roles)
    role = F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names))):
        role = F.when(is_before(TIME_ORDER, cut), name).otherwise(role)
    return ratings.withColumn("role", role)


def parts_by_time(ratings: DataFrame, *shares: float) -> list[DataFrame]:
    """The parts of ``by_time`` as separate tables; each is a filter its scan can use."""
    _, cuts = rank_cuts(ratings, TIME_ORDER, lambda n: [int(n * s) for s in shares])
    tests = [is_before(TIME_ORDER, cut) for cut in cuts]
    parts = [ratings.where(tests[0])]
    for low, high in zip(tests, tests[1:]):
        parts.append(ratings.where(~low & high))
    return [*parts, ratings.where(~tests[-1])]


def _digest(cols, seed: int):
    """md5 of the columns and the seed, which any engine gives alike."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed))).cast("binary"))


def _bucket(cols, seed: int, n: int):
    return F.conv(F.substring(_digest(cols, seed), 1, 8), 16, 10).cast("long") % n


def by_hash(df: DataFrame, keys: list[str], share: float = 0.8, seed: int = 42) -> DataFrame:
    """Random split that does not depend on how rows are partitioned."""
    return df.withColumn(
        "role", F.when(_bucket(keys, seed, 1000) < int(share * 1000), "train").otherwise("test")
    )


def hash_folds(ratings: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return ratings.withColumn("fold", _bucket(FILE_ORDER, seed, n).cast("int"))


def five_fold(ratings: DataFrame, n_folds: int = 5) -> DataFrame:
    """Positional folds 1..n in (user, item) order; the last takes the remainder.

    A row is test in its own fold and train in all others.
    """

    def edges(n):
        size = n // n_folds
        return [size * i for i in range(1, n_folds)]

    _, cuts = rank_cuts(ratings, FILE_ORDER, edges)
    fold = F.lit(1)
    for cut in cuts:
        fold = fold + F.when(is_before(FILE_ORDER, cut), 0).otherwise(1)
    return ratings.withColumn("fold", fold)


def fold_role(folded: DataFrame, fold: int) -> DataFrame:
    return folded.withColumn("role", F.when(F.col("fold") == fold, "test").otherwise("train"))


def all_but(ratings: DataFrame, start: int = 1, stop: int = 10, max_test: int = 0) -> DataFrame:
    """Each user's ``start``-th to ``stop``-th rating (by item) is test, the rest train.

    ``max_test`` above 0 keeps only that many test rows over all users, in
    (user, item) order. Only a user's first ``stop`` rows reach the ranking
    window; Spark cuts the others off before the shuffle.
    """
    w = Window.partitionBy("user_id").orderBy("item_id")
    first = (
        ratings.select(*FILE_ORDER).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= stop)
    )
    test = first.where(F.col("nth") >= start).select(*FILE_ORDER)
    if max_test > 0:
        test = freeze(test)
        _, (cut,) = rank_cuts(test, FILE_ORDER, [max_test])
        test = test.where(is_before(FILE_ORDER, cut))
    return ratings.join(test.withColumn("role", F.lit("test")), FILE_ORDER, "left").withColumn(
        "role", F.coalesce("role", F.lit("train")))


def every_nth(df: DataFrame, n: int, order: list[str] = FILE_ORDER) -> DataFrame:
    """Rows at global positions 0, n, 2n, ..."""
    return positions(df, [F.col(c) for c in order]).where(F.col("pos") % n == 0)


def sample_cells(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows at random, the same ones however rows are partitioned."""
    return df.orderBy(_digest(FILE_ORDER, seed), *FILE_ORDER).limit(n)
