"""Audit of filters that overlap: what each one removes in every order they could run in.

Documents are reduced to classes (part, set of failed filters, label) with a
number; copies count as the filter for copies says. For a set of filters, the
step at which a document of a class falls is the smallest position of a failed
filter, so a matrix of failed filters (0 where failed, infinite elsewhere) and a
matrix of positions (the inverse permutation of every order) give all removal
steps by a product in which the sum is replaced by a minimum. The counts of the
classes are then added up at the steps they fall at.

Only classes meet the orders, never documents: their number depends on parts and
filters alone. Null texts count as empty, a null lang as the part ''. A null
doc_id is larger than all others and has no labels. Rows with one id are all
counted and are no copies of each other; several labels of an id count as one
that has each fault any of them has, and is good if any is. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import freeze

LAST = (1 << 63) - 1
FILTERS = "ABCDE"
COPY = FILTERS.index("E")
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
_CAPITALS = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"
_INNER = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point
_CHUNK = 256  # classes spread over all orders at a time


def failures(raw: bytes) -> int:
    """The filters A to D that a text fails, one bit each."""
    words = raw.split()  # at the six ASCII blanks
    points = len(raw.translate(None, _INNER))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return ((len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1
            | (100 * capitals > 3 * points) << 2 | (len(raw.translate(None, _SYMBOLS)) < len(raw)) << 3)


def measured(docs: DataFrame) -> DataFrame:
    """(ord, part, mask, digest) of every row: id, language, filters A to D, SHA-256 of the text. No shuffle."""
    def run(batches):
        import hashlib

        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("ord"), b.column("part"), pa.array([failures(t) for t in texts], pa.int32()),
                 pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], ["ord", "part", "mask", "digest"])

    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"),
                        F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return plain.mapInArrow(run, "ord long, part string, mask int, digest binary")


def classes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part fail just these filters and have these labels.

    Copies: within rows of one digest, part and label only the smallest id and its
    number of rows matter, so a group of copies shrinks to a few rows before its
    members are compared.
    """
    merged = freeze(measured(docs)).groupBy("ord", "part", "mask", "digest").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = F.lit(False)
    known = merged.where(F.col("ord") < LAST).join(marks, F.col("ord") == F.col("labelled"), "left").select(
        *merged.columns, F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    every = known.unionByName(merged.where(F.col("ord") == LAST).withColumns({"good": no, "toxic": no}))
    alike = every.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.struct("ord", "n")).alias("first"))
    least = F.min("first.ord").over(Window.partitionBy("digest"))
    split = alike.withColumn("early", F.when(F.col("first.ord") == least, F.col("first.n")).otherwise(F.lit(0)))
    either = F.explode(F.array(
        F.struct(F.col("mask").alias("m"), F.col("early").cast("long").alias("k")),
        F.struct(F.col("mask").bitwiseOR(F.lit(1 << COPY)).alias("m"), (F.col("n") - F.col("early")).alias("k"))))
    return split.select("part", "good", "toxic", either.alias("x")).where("x.k > 0").groupBy(
        "part", F.col("x.m").alias("mask"), "good", "toxic").agg(F.sum("x.k").alias("n"))


def positions(filters: str) -> tuple[list[str], np.ndarray]:
    """All orders, and the position (from 1) of every filter in each: filters x orders."""
    orders = ["".join(p) for p in permutations(filters)]
    return orders, np.array([[o.index(f) + 1 for o in orders] for f in filters], np.int64)


def removal_steps(failed: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Min-plus product of classes x filters (true: failed) and filters x orders; filters + 1 where nothing failed."""
    cost = np.where(failed, 0, len(position) + 1)
    return np.minimum((cost[:, :, None] + position[None, :, :]).min(1), len(position) + 1)


def scatter(failed: np.ndarray, part: np.ndarray, parts: int, n: np.ndarray, good: np.ndarray, toxic: np.ndarray,
            orders: list[str], position: np.ndarray, filters: str) -> np.ndarray:
    """Counts by part, order, step and kind (as ``COUNTS``), from classes and their numbers."""
    k, steps = len(filters), removal_steps(failed, position)
    out = np.zeros((parts, len(orders), k, len(COUNTS)), np.int64)
    by_step = np.array([[filters.index(f) for f in o] for o in orders]).T  # step x order: the filter that acts
    every = np.arange(len(orders))[None, :]
    rows = part[:, None]
    alone = failed & (failed.sum(1) == 1)[:, None]
    for s in range(1, k + 1):
        acts = failed[:, by_step[s - 1]]
        for kind, hit, weight in (
                (0, steps > s, n), (1, steps == s, n), (2, acts & (steps < s), n), (3, alone[:, by_step[s - 1]], n),
                (4, steps == s, n * good), (5, steps == s, n * toxic)):
            np.add.at(out[:, :, s - 1, kind], (rows, every), hit * weight[:, None])
    return out


def audit(classes: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step.

    ``classes`` is as ``classes()`` gives it, bit i of ``mask`` for the i-th of
    ``filters``. ``shapley`` is what a filter removes in a part over all orders; divided
    by their number it is the filter's Shapley value.
    """
    kinds = ", ".join(f"{c} long" for c in COUNTS)

    def run(batches):
        orders, position = positions(filters)
        for whole in batches:
            for at in range(0, whole.num_rows, _CHUNK):
                b = whole.slice(at, _CHUNK)
                names, part = np.unique(np.array(b.column("part").to_pylist(), object), return_inverse=True)
                mask, n = (np.array(b.column(c).to_pylist(), np.int64) for c in ("mask", "n"))
                good, toxic = (np.array(b.column(c).to_pylist(), bool) for c in ("good", "toxic"))
                failed = (mask[:, None] >> np.arange(len(filters)) & 1).astype(bool)
                counts = scatter(failed, part, len(names), n, good, toxic, orders, position, filters)
                steps = len(filters)
                cells = len(orders) * steps
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(names, cells).tolist(), pa.string()),
                     pa.array(np.tile(np.repeat(orders, steps), len(names)).tolist(), pa.string()),
                     pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(names) * len(orders))),
                     *[pa.array(counts[..., i].ravel()) for i in range(len(COUNTS))]],
                    ["part", "filter_order", "step", *COUNTS])

    spread = classes.select("part", "mask", "n", "good", "toxic").mapInArrow(run, f"part string, filter_order string, step int, {kinds}")
    total = spread.groupBy("part", "filter_order", "step").agg(*[F.sum(c).alias(c) for c in COUNTS])
    named = total.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    share = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return named.select("part", "filter_order", "step", *COUNTS, share.alias("shapley"), "filter")
