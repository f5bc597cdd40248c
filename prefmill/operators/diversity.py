"""Diversity of recommendation lists: mean pairwise distance 1 - similarity.

Lists are ``(user_id, item_id, rank)`` with at most k items per user, so all
per-user work is bounded by k. Similarities are scaled cells; a missing cell is
similarity 0. The sum over a list's pairs is the list scored against the
similarity matrix, so no table of pairs is built.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .ordering import value_at
from .scale import Span
from .score import list_similarities, score_cells

LISTS = 256    # lists looked at in one go

def list_diversity(lists: DataFrame, sims: DataFrame) -> DataFrame:
    """Per user with two or more listed items: mean distance over the list's pairs."""
    off = sims.where("row <> col")
    ones = lists.select("user_id", "item_id", F.lit(1.0).alias("value"))
    hit = score_cells(ones, off, lists.select("user_id", "item_id"))
    n = F.count(F.lit(1))
    return hit.groupBy("user_id").agg(
        (1 - F.sum("score") / F.nullif(n * (n - 1), F.lit(0))).alias("diversity")
    ).where("diversity IS NOT NULL")


def pair_distances(lists: DataFrame, sims: DataFrame) -> DataFrame:
    """Distances of all item pairs within each (short) list, better ranked item first."""
    near = list_similarities(lists, sims)
    ids = lists.groupBy("user_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "item_id"))), lambda s: s["item_id"]).alias("ids"))
    spread = near.join(ids, "user_id").select(
        "user_id", F.col("item_id").alias("item_b"), F.col("rank").alias("rank_b"),
        F.posexplode(F.arrays_zip("ids", "sims")))
    return spread.where(F.col("pos") + 1 < F.col("rank_b")).select(
        "user_id", F.col("col.ids").alias("item_a"), "item_b", (1 - F.col("col.sims")).alias("distance"))


def packed_by_cells(lists: DataFrame, sims: DataFrame) -> DataFrame:
    """Per user: list items in rank order and their similarities, column by column."""
    return list_similarities(lists, sims).groupBy("user_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "item_id", "sims"))).alias("list")
    ).select(
        "user_id", F.transform("list", lambda s: s["item_id"]).alias("ids"),
        F.flatten(F.transform("list", lambda s: s["sims"])).alias("flat"))


def packed_by_factors(lists: DataFrame, rows: DataFrame, cols: DataFrame, span: Span) -> DataFrame:
    """The same for similarities given as inner products of two item factor tables, scaled over positive
    cells by ``span``. The factors of a list stand for its similarities, which are multiplied where they are used."""
    a = rows.select(F.col("id").alias("item_id"), F.col("features").cast("array<double>").alias("a"))
    b = cols.select(F.col("id").alias("item_id"), F.col("features").cast("array<double>").alias("b"))
    sides = lists.join(a, "item_id").join(b, "item_id").groupBy("user_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "item_id", "a", "b"))).alias("list"))
    return sides.select(
        "user_id", F.transform("list", lambda s: s["item_id"]).alias("ids"),
        F.flatten(F.transform("list", lambda s: s["a"])).alias("a"),
        F.flatten(F.transform("list", lambda s: s["b"])).alias("b"),
        F.lit(float(span.low)).alias("low"), F.lit(float(span.high - span.low)).alias("width"))


def _each_list(batches):
    """(user ids, per user items and similarities column by column) for a few lists at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, LISTS):
            part = batch.slice(at, LISTS)
            lists = [x.values.to_numpy() for x in part.column("ids")]
            yield part.column("user_id"), ((ids, _similarities(part, i, len(ids))) for i, ids in enumerate(lists))


def _similarities(part, i: int, size: int) -> np.ndarray:
    """Those of list ``i``: as they are, or multiplied from its factors and scaled."""
    if "flat" in part.schema.names:
        return part.column("flat")[i].values.to_numpy()
    a, b = (part.column(c)[i].values.to_numpy().reshape(size, -1) for c in ("a", "b"))
    low, width = part.column("low")[i].as_py(), part.column("width")[i].as_py()
    m = b @ a.T
    return np.where(m > 0, (m - low) / width if width > 0 else 1.0, 0.0).ravel()


def mean_distance(packed: DataFrame) -> DataFrame:
    """Mean distance over each list's pairs, better ranked item first."""
    def measure(batches):
        for users, lists in _each_list(batches):
            out = []
            for ids, flat in lists:
                far = 1.0 - flat.reshape(len(ids), len(ids)).T
                pairs = far[np.triu_indices(len(ids), 1)]
                out.append(float(pairs.mean()) if len(pairs) else None)
            yield pa.RecordBatch.from_arrays([users, pa.array(out, pa.float64())], ["user_id", "diversity"])

    return packed.mapInArrow(measure, "user_id long, diversity double").where("diversity IS NOT NULL")


def rerank(packed: DataFrame, n: int = 10) -> DataFrame:
    """Greedy diverse re-ranking of each list.

    Starts with the best item and repeatedly adds the candidate with the largest
    mean distance to those chosen (the better ranked one on ties). Returns the
    chosen items in order and the mean distance over their pairs.
    """
    def choose(batches):
        for users, lists in _each_list(batches):
            picks = [greedy(ids, flat, n) for ids, flat in lists]
            yield pa.RecordBatch.from_arrays(
                [users, pa.array([p[0] for p in picks], pa.list_(pa.int64())), pa.array([p[1] for p in picks], pa.float64())],
                ["user_id", "items", "diversity"])

    return packed.mapInArrow(choose, "user_id long, items array<long>, diversity double")


def greedy(ids, flat_sims, n):
    """Chosen ids and their mean pairwise distance, for one list."""
    size = len(ids)
    far = 1.0 - flat_sims.reshape(size, size).T
    chosen, total = [0], far[0].copy()
    while len(chosen) < min(n, size):
        reach = np.round(total, 12)
        reach[chosen] = -np.inf
        best = int(np.argmax(reach))
        chosen.append(best)
        total += far[best]
    pairs = np.triu_indices(len(chosen), 1)
    inner = far[np.ix_(chosen, chosen)][pairs]
    return [int(ids[c]) for c in chosen], float(inner.mean()) if len(inner) else None


def summary(per_user: DataFrame, value: str = "diversity") -> DataFrame:
    """Mean, and the values at sorted positions n/2 and n/4 (not interpolated).

    One row. The positions are found by distributed counting.
    """
    n, (half, quarter) = value_at(per_user, value, lambda n: [n // 2, n // 4])
    return per_user.agg(
        F.avg(value).alias("mean"), F.lit(half).alias("median"), F.lit(quarter).alias("quarter"),
        F.lit(n).cast("long").alias("n_users"))


def with_liked_train(lists: DataFrame, train: DataFrame, threshold: float = 3) -> DataFrame:
    """Optional filter: users with at least one positive training rating."""
    return lists.join(train.where(F.col("rating") >= threshold).select("user_id").distinct(), "user_id", "left_semi")
