"""Biased factor model learnt as one: biases and vectors move together, rating by rating.

    estimate(u, i) = mean + b_u + b_i + p_u . q_i

Stochastic gradient descent in strata: users and items are hashed into the same
number of blocks, and in stratum s user block g meets item block g + s only, so the
tasks of a stratum share no vector and need no locks; after all strata, a Latin
square, every rating has been visited once. A task walks its ratings in an order
hashed from epoch and ids, so any number of executors gives the same numbers as a
sequential run. State is written after every stratum.

``model`` in the key lets several fits, such as the folds of a cross-validation,
go through the same joins: each rating is copied to the models that learn from it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.prefs import clamp
from ..functions.vectors import combine, dot
from ..session import freeze, freezing, scratch_path, tasks_for

CELL = 1 << 20        # ratings of a user block and an item block
SMALL = 1 << 14       # ratings worth a task of their own
USERS, ITEMS = 0, 1
SPREAD = 0.1          # standard deviation of the first vectors
STATE = "model int, side int, block int, id long, bias double, features array<double>"


@dataclass
class Biased:
    means: DataFrame   # model, mean
    state: DataFrame   # as STATE
    rank: int


def start(ids: DataFrame, side: int, rank: int, seed: int) -> DataFrame:
    """``ids(model, id, block)`` with zero bias and vectors drawn evenly, by id, with deviation ``SPREAD``."""
    step, wide = 1 << 20, 2 * SPREAD * 3 ** 0.5
    draw = f"((pmod(xxhash64(id, {{d}}, {seed + side}), {step}) + 0.5D) / {step}D - 0.5D) * {wide!r}D"
    return ids.select("model", F.lit(side).alias("side"), "block", "id", F.lit(0.0).alias("bias"), combine(draw, rank).alias("features"))


def walk(user, item, rating, mean: float, bu, bi, p, q, rate: float, reg: float) -> None:
    """One pass over ratings in their order; biases and vectors change in place."""
    for u, i, r in zip(user.tolist(), item.tolist(), rating.tolist()):
        pu, qi = p[u], q[i]
        gap = r - (mean + bu[u] + bi[i] + pu @ qi)
        bu[u] += rate * (gap - reg * bu[u])
        bi[i] += rate * (gap - reg * bi[i])
        p[u], q[i] = pu + rate * (gap * qi - reg * pu), qi + rate * (gap * pu - reg * qi)


def _step(rank: int, rate: float, reg: float):
    """The work of one user block and the item block it meets."""
    def run(key, cells: pa.Table, state: pa.Table) -> pa.Table:
        if not cells.num_rows or not state.num_rows:
            return state.select(["model", "side", "block", "id", "bias", "features"])
        side, ids, bias = (state.column(c).to_numpy() for c in ("side", "id", "bias"))
        vectors = state.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, rank)
        place, b, f = [], [], []
        for s, name in ((USERS, "user_id"), (ITEMS, "item_id")):
            mine = np.flatnonzero(side == s)
            mine = mine[np.argsort(ids[mine])]
            place.append((mine, np.searchsorted(ids[mine], cells.column(name).to_numpy())))
            b.append(bias[mine].copy())
            f.append(vectors[mine].copy())
        order = np.lexsort([cells.column(c).to_numpy() for c in ("item_id", "user_id", "turn")])
        walk(place[0][1][order], place[1][1][order], cells.column("rating").to_numpy()[order], cells.column("mean")[0].as_py(),
             b[0], b[1], f[0], f[1], rate, reg)
        mine = np.concatenate([m for m, _ in place])
        out = state.take(pa.array(mine))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, rank * len(mine) + 1, rank), pa.int32()), pa.array(np.concatenate(f).ravel()))
        return pa.Table.from_arrays([out.column("model"), out.column("side"), out.column("block"), out.column("id"),
                                     pa.array(np.concatenate(b)), flat], ["model", "side", "block", "id", "bias", "features"])
    return run


def blocks_for(spark, n: int) -> int:
    """Blocks of users and of items for ``n`` ratings: one per core, more only once their square of cells needs it.

    A pass writes the state once per stratum, and there are as many strata as blocks.
    """
    return max(tasks_for(spark, n, SMALL, float("inf")), int(np.ceil((n / CELL) ** 0.5)))


def fit_sgd(ratings: DataFrame, rank: int = 100, epochs: int = 20, rate: float = 0.005, reg: float = 0.02, seed: int = 0,
            blocks: int | None = None) -> Biased:
    """Fit ``ratings(user_id, item_id, rating[, model])``, one model per value of ``model``; of equal cells each counts."""
    spark = ratings.sparkSession
    given = ratings if "model" in ratings.columns else ratings.withColumn("model", F.lit(0))
    given = freeze(given.select(F.col("model").cast("int").alias("model"), F.col("user_id").cast("long").alias("user_id"),
                                F.col("item_id").cast("long").alias("item_id"), F.col("rating").cast("double").alias("rating")))
    means = freeze(given.groupBy("model").agg(F.avg("rating").alias("mean")))
    n = given.count()
    n_blocks = blocks or blocks_for(spark, n)

    def block(c):
        return F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(n_blocks)).cast("int")

    cells = given.join(means, "model").select(
        "model", block("user_id").alias("g"), F.pmod(block("item_id") - block("user_id"), F.lit(n_blocks)).alias("stratum"),
        "user_id", "item_id", "rating", "mean")
    path = scratch_path(spark, "strata")
    cells.repartition("stratum", "g").write.partitionBy("stratum").parquet(path)
    full = {r[0] for r in cells.select("stratum").distinct().collect()}  # as many numbers as there are blocks
    schema = cells.drop("stratum").schema
    sides = [start(given.select("model", F.col(c).alias("id")).distinct().withColumn("block", block("id")), s, rank, seed)
             for s, c in ((USERS, "user_id"), (ITEMS, "item_id"))]
    keep = freezing(spark, "state")
    state = keep(sides[0].unionByName(sides[1]))
    for epoch in range(epochs):
        for s in sorted(full):
            here = spark.read.schema(schema).parquet(f"{path}/stratum={s}").withColumn(
                "turn", F.xxhash64("user_id", "item_id", F.lit(epoch), F.lit(seed)))
            met = state.withColumn("g", F.when(F.col("side") == USERS, F.col("block")).otherwise(
                F.pmod(F.col("block") - F.lit(s), F.lit(n_blocks))))
            state = keep(here.groupBy("model", "g").cogroup(met.groupBy("model", "g")).applyInArrow(_step(rank, rate, reg), STATE))
    return Biased(means, state, rank)


def predict_sgd(model: Biased, pairs: DataFrame) -> DataFrame:
    """Estimates on the 1..5 scale for every pair of a known model; unknown ids fall back to what is known."""
    asked = pairs if "model" in pairs.columns else pairs.withColumn("model", F.lit(0))

    def side(s, name):
        return model.state.where(F.col("side") == s).select(
            F.col("model").alias(f"_m{s}"), F.col("id").alias(f"_id{s}"), F.col("bias").alias(f"_b{s}"), F.col("features").alias(f"_f{s}"))

    out = asked.join(model.means.select(F.col("model").alias("_m"), F.col("mean").alias("_mean")), F.col("model") == F.col("_m"))
    for s, name in ((USERS, "user_id"), (ITEMS, "item_id")):
        out = out.join(side(s, name), (F.col("model") == F.col(f"_m{s}")) & (F.col(name) == F.col(f"_id{s}")), "left")
    zero = F.lit(0.0)
    score = F.col("_mean") + F.coalesce("_b0", zero) + F.coalesce("_b1", zero) + F.coalesce(dot("_f0", "_f1", model.rank), zero)
    return out.select(*pairs.columns, clamp(score).alias("score"))


def cross_validate(ratings: DataFrame, folds: tuple[int, ...] = (3, 5), seed: int = 0, **settings) -> DataFrame:
    """(folds, fold, rmse, mae, n): all folds of all divisions, fitted by the same joins.

    Model ``number`` of a division into k folds learns from the other k - 1.
    """
    first = np.cumsum([0, *folds])[:-1].tolist()
    spread = F.array(*[F.struct(
        F.lit(k).alias("folds"), F.pmod(F.xxhash64("user_id", "item_id", F.lit(seed + k)), F.lit(k)).cast("int").alias("own"),
        F.lit(at).alias("at")) for k, at in zip(folds, first)])
    dealt = freeze(ratings.select("user_id", "item_id", "rating", F.explode(spread).alias("d")).select(
        "user_id", "item_id", "rating", "d.*"))
    others = F.filter(F.sequence(F.lit(0), F.col("folds") - 1), lambda f: f != F.col("own"))
    learnt = dealt.withColumn("fold", F.explode(others)).withColumn("model", F.col("at") + F.col("fold"))
    model = fit_sgd(learnt.select("model", "user_id", "item_id", "rating"), seed=seed, **settings)
    got = predict_sgd(model, dealt.withColumn("model", F.col("at") + F.col("own")))
    gap = F.col("score") - F.col("rating")
    return got.groupBy("folds", F.col("own").alias("fold")).agg(
        F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"), F.count(F.lit(1)).alias("n"))
