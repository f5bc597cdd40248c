"""Exact top-k inner products with bounds: most of U V^T is never multiplied.

Items are laid out by falling norm and cut into buckets. Every user meets the first
bucket, whose k-th best unseen score is a floor for the rest: by Cauchy-Schwarz a
bucket whose greatest norm times the user's misses that floor holds nothing for the
user. The others are laid out by how many buckets they still need, in blocks, so that
a block is joined with few buckets beyond those of its neediest user. Blocks grow with the
number of users, and meet buckets of ``STRIP_ROWS`` items at a time: a user travels once a strip, not once a bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import freeze, tasks_for
from .ordering import positions
from .score import rank_per_user
from .stream import group_batches

BUCKET = 4096
BUCKETS = 1 << 16      # bound on their number, and so on the norms sent to all tasks
STRIP_ROWS = 1 << 15   # items a block of users meets in one group
GROUPS = 64            # groups before a group takes several buckets
BLOCKS = 64            # blocks of users before blocks grow
BLOCK_MOST = 1 << 16   # users of a block
SLICE = 256            # users multiplied at once
SLACK = 1e-9           # rounding of norms and products
_NORM = "sqrt(aggregate(transform(features, x -> double(x) * double(x)), 0D, (a, x) -> a + x))"


@dataclass
class TopProducts:
    """``table(user_id, item_id, score, rank)``; ``done`` of ``total`` products were taken."""

    table: DataFrame
    done: int
    total: int


def _vectors(column) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=float)


def _best(scores: np.ndarray, k: int, least: np.ndarray):
    """Cells at or above ``least`` and the k-th best of their row, ties included."""
    if scores.shape[1] > k:
        least = np.maximum(least, np.partition(scores, scores.shape[1] - k, axis=1)[:, -k])
    return np.nonzero((scores >= least[:, None]) & np.isfinite(scores))


def top_products(users: DataFrame, items: DataFrame, k: int, seen: DataFrame | None = None, positive: bool = False,
                 bucket: int = BUCKET, block: int = BUCKET) -> TopProducts:
    """Top ``k`` items of ``items(id, features)`` per user of ``users(user_id, features)``, without those in ``seen(user_id, item_id)``.

    Ties go to the larger item id; with ``positive`` only scores above 0 count. Rows without id or vector are left out; an id has one row.
    """
    spark = users.sparkSession
    double = F.col("features").cast("array<double>").alias("features")
    users = users.dropna().select(F.col("user_id").cast("long").alias("user_id"), double)
    by_norm = items.dropna().select(F.col("id").cast("long").alias("id"), double).withColumn("norm", F.expr(_NORM))
    n_items, n_users = by_norm.count(), users.count()
    bucket = max(bucket, -(-n_items // BUCKETS))
    placed = freeze(positions(by_norm, [F.desc("norm"), F.desc("id")], "pos").withColumn("bucket", F.floor(F.col("pos") / bucket)))
    head = placed.where("bucket = 0").orderBy("pos").toArrow()                        # ``bucket`` rows
    tops = placed.where("bucket > 0").groupBy("bucket").agg(F.max("norm").alias("top")).orderBy("bucket").toArrow()
    sent = spark.sparkContext.broadcast((
        head.column("id").to_numpy(), _vectors(head.column("features")), tops.column("top").to_numpy()))
    floor = np.nextafter(0, 1) if positive else -np.inf
    where = placed.select(F.col("id").alias("item_id"), "pos", "bucket")
    hidden = None
    if seen is not None:
        seen = seen.dropna().select(F.col("user_id").cast("long").alias("user_id"), F.col("item_id").cast("long").alias("item_id")).distinct()
        hidden = freeze(seen.join(where, "item_id"))
        users = users.join(hidden.where("bucket = 0").groupBy("user_id").agg(  # at most ``bucket`` places a user
            F.collect_list(F.col("pos").cast("int")).alias("hide")), "user_id", "left")
    else:
        users = users.withColumn("hide", F.lit(None).cast("array<int>"))

    def first(batches):
        ids, vectors, tops = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                u = _vectors(part.column("features"))
                scores = u @ vectors.T if len(ids) else np.zeros((len(u), 0))
                for row, hide in enumerate(part.column("hide").to_pylist()):
                    if hide:
                        scores[row, hide] = -np.inf
                p, q = _best(scores, k, np.full(len(u), floor))
                least = np.full(len(u), floor)
                if scores.shape[1] >= k:
                    least = np.maximum(least, np.partition(scores, scores.shape[1] - k, axis=1)[:, -k])
                size = np.sqrt((u * u).sum(1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    cut = np.where(size > 0, least / size, np.inf if positive else -np.inf)
                last = np.searchsorted(-tops, -cut * (1 - SLACK), side="right")  # buckets that can reach the floor
                last[cut <= 0] = len(tops)
                edges = np.searchsorted(p, np.arange(len(u) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("user_id"), part.column("features"), pa.array(least), pa.array(last.astype(np.int32)),
                     pa.ListArray.from_arrays(edges, pa.array(ids[q])), pa.ListArray.from_arrays(edges, pa.array(scores[p, q]))],
                    ["user_id", "features", "least", "last", "found", "scores"])

    begun = freeze(users.select("user_id", "features", "hide").mapInArrow(
        first, "user_id long, features array<double>, least double, last int, found array<long>, scores array<double>"))
    own = begun.select("user_id", F.explode(F.arrays_zip("found", "scores")).alias("z")).select(
        "user_id", F.col("z.found").alias("item_id"), F.col("z.scores").alias("score"))
    needy = begun.where("last > 0")
    block = max(block, min(BLOCK_MOST, -(-needy.count() // BLOCKS)))
    more = freeze(positions(needy.select("user_id", "last", "least", "features"), [F.col("last"), F.col("user_id")], "at").withColumn(
        "block", F.floor(F.col("at") / block)))
    pairs = freeze(more.groupBy("block").agg(F.max("last").alias("last"), F.count(F.lit(1)).alias("n")).select(
        "block", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("last").cast("long"))).alias("bucket")))
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"))
    opened = pairs.join(sizes, "bucket").agg(F.sum(F.col("n") * F.col("m")), F.count(F.lit(1))).first()
    done = n_users * min(bucket, n_items) + (opened[0] or 0)
    if not opened[1]:
        return TopProducts(rank_per_user(own, k), done, n_users * n_items)

    side = lambda df, n, a, b, f, least: df.select("block", "strip", F.lit(n).alias("side"), a.alias("a"), b.alias("b"), f.alias("f"), least.alias("least"))
    none, no_vector, zero = F.lit(0).cast("long"), F.lit(None).cast("array<double>"), F.lit(0.0)
    strip = max(1, min(STRIP_ROWS // bucket, opened[1] // GROUPS))
    strips = F.floor(F.col("bucket") / strip).cast("long").alias("strip")
    by_strip = pairs.select("block", strips).distinct()
    laid = side(more.join(by_strip, "block"), 0, F.col("user_id"), none, F.col("features"), F.col("least")).unionByName(
        side(placed.join(pairs, "bucket").withColumn("strip", strips), 1, F.col("id"), none, F.col("features"), zero))
    if hidden is not None:
        asked = hidden.join(more.select("user_id", "block"), "user_id").join(pairs.select("block", "bucket"), ["block", "bucket"])
        laid = laid.unionByName(side(asked.withColumn("strip", strips), 2, F.col("user_id"), F.col("item_id"), no_vector, zero))

    def rest(batches):
        for g in group_batches(batches, ("block", "strip"), 2 * BUCKET):
            key = np.flatnonzero((np.diff(g["block"]) != 0) | (np.diff(g["strip"]) != 0)) + 1
            for at, end in zip(np.r_[0, key], np.r_[key, len(g["block"])]):
                lo, hi = at + np.searchsorted(g["side"][at:end], (1, 2))
                if lo == at or hi == lo:
                    continue
                u, ids = g["a"][at:lo], g["a"][lo:hi]  # both in rising order
                vectors = np.stack(g["f"][lo:hi])
                hu, hi_ = np.searchsorted(u, g["a"][hi:end]), np.searchsorted(ids, g["b"][hi:end])
                for s in range(0, len(u), SLICE):
                    t = min(s + SLICE, len(u))
                    scores = np.stack(g["f"][at + s:at + t]) @ vectors.T
                    on = (hu >= s) & (hu < t)
                    scores[hu[on] - s, hi_[on]] = -np.inf
                    least = g["least"][at + s:at + t]
                    least = np.where(np.isfinite(least), least - np.abs(least) * SLACK, least)
                    p, q = _best(scores, k, np.maximum(least, floor))
                    yield pa.RecordBatch.from_pydict({"user_id": u[s + p], "item_id": ids[q], "score": scores[p, q]})

    n = tasks_for(spark, by_strip.count(), 1, 16)
    found = laid.repartition(n, "block", "strip").sortWithinPartitions("block", "strip", "side", "a", "b").mapInArrow(
        rest, "user_id long, item_id long, score double")
    return TopProducts(rank_per_user(own.unionByName(found), k), done, n_users * n_items)
