"""Matrix factorisation by Spark ML ALS, and scoring from factor tables.

Factor tables are ``(id, features)``. Scores of all users against an item
matrix U V^T are taken as (X U) V^T: one k-vector per user, then inner products
for the cells asked for. The dense product is never formed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, functions as F

from ..functions.prefs import UNSEEN_DISLIKE
from ..functions.vectors import combine, dot, literal, outer_sums, times_matrix, vec_sum, weighted_sum, zeros
from ..session import freeze, shared_dir, tasks_for
from .extremes import product_extremes
from .ordering import positions
from .scale import Span

BLOCK = 4096      # factor rows per side of an all-pairs block
ONE_JOB = 64      # pairs of blocks that are all multiplied, as bounds take more jobs than they save
INT_MAX = 2**31 - 1
ROUNDS_KEPT = 2   # rounds of ALS whose shuffle files are held at a time


@dataclass
class Factors:
    """What ALS found: ``(id, features)`` of rows and of columns, under the ids they came with."""

    userFactors: DataFrame
    itemFactors: DataFrame
    rank: int
    fitted: tuple = ()  # both as the fit gave them

    def release(self) -> None:
        """Delete what the fit left on disk and in memory; the factors cannot be read after that."""
        for factors in self.fitted:
            _release(factors)


def _release(factors: DataFrame) -> None:
    """Drop the rows that ALS keeps for a factor table, the shuffles these come from, and the item factors of the last checkpoint.

    Without that they go when the driver's collector finds the model unused. The
    search ends at the blocks of ratings: what lies before them is the caller's.
    """
    spark = factors.sparkSession
    left, seen, kept = [factors._jdf.rdd()], set(), None
    while left:
        rdd = left.pop()
        name = rdd.name() or ""
        if rdd.id() in seen or name == "ratingBlocks":
            continue
        seen.add(rdd.id())
        if kept is None and rdd.getStorageLevel().useMemory():
            kept = rdd
            kept.unpersist(False)
            kept.cleanShuffleDependencies(False)
        if name.startswith("itemFactors-"):
            rdd.unpersist(False)
            if rdd.getCheckpointFile().isDefined():
                path = spark._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        else:
            deps = rdd.dependencies()
            left += [deps.apply(i).rdd() for i in range(deps.size())]


def _numbered(cells: DataFrame, col: str) -> DataFrame:
    """A dense number for every id of a column, frozen so that it cannot change."""
    return freeze(positions(cells.select(col).distinct(), [F.col(col)], "n"))


def als_fit(cells: DataFrame, rank: int, iters: int, reg: float, nonnegative: bool = True,
            seed: int = 999, blocks: int | None = None, rounds_kept: int = ROUNDS_KEPT) -> Factors:
    """Explicit ALS on ``(row, col, value)`` cells.

    Spark's ALS takes 32-bit ids; larger ones are numbered before and named
    again afterwards. ``blocks`` defaults to one per two million cells, or per
    core where there are fewer. Every ``rounds_kept``-th round is checkpointed, which lets Spark delete the
    shuffle files of those before; 1 keeps least on disk and takes about a fifth more work than 2.
    """
    spark = cells.sparkSession
    shared_dir(spark)  # lets ALS cut its lineage while iterating
    facts = cells.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}_{c}") for c in ("row", "col") for k, f in (
        ("lo", F.min), ("hi", F.max))]).first()
    names = {c: _numbered(cells, c) for c in ("row", "col") if (facts[f"hi_{c}"] or 0) > INT_MAX or (facts[f"lo_{c}"] or 0) < -INT_MAX}
    for c, known in names.items():
        cells = cells.join(known, c).withColumn(c, F.col("n")).drop("n")
    blocks = blocks or max(-(-facts["n"] // (1 << 21)), tasks_for(spark, facts["n"], 1 << 14, 1 << 21))
    als = ALS(
        rank=rank, maxIter=iters, regParam=reg, nonnegative=nonnegative, seed=seed,
        userCol="row", itemCol="col", ratingCol="value", coldStartStrategy="drop",
        numUserBlocks=blocks, numItemBlocks=blocks, checkpointInterval=rounds_kept,
    )
    model = als.fit(cells.select(
        F.col("row").cast("int"), F.col("col").cast("int"), F.col("value").cast("float")))

    def named(factors, c):
        factors = factors.select(F.col("id").cast("long").alias("id"), "features")
        if c not in names:
            return factors
        return factors.join(names[c], F.col("id") == F.col("n")).select(F.col(c).cast("long").alias("id"), "features")

    found = model.userFactors, model.itemFactors
    return Factors(named(found[0], "row"), named(found[1], "col"), rank, found)


def fit_ratings(ratings: DataFrame, rank: int = 8, iters: int = 10, reg: float = 0.1,
                nonnegative: bool = False, seed: int = 999, rounds_kept: int = ROUNDS_KEPT) -> Factors:
    return als_fit(
        ratings.select(F.col("user_id").alias("row"), F.col("item_id").alias("col"),
                       F.col("rating").alias("value")), rank, iters, reg, nonnegative, seed, rounds_kept=rounds_kept)


def row_factors(model: Factors) -> DataFrame:
    return model.userFactors


def col_factors(model: Factors) -> DataFrame:
    return model.itemFactors


def predict(model: Factors, pairs: DataFrame) -> DataFrame:
    """Scores of the given (user, item) pairs; pairs with unknown ids, of whatever size, are left out."""
    users = model.userFactors.withColumnRenamed("id", "user_id")
    return score_pairs(pairs, users, model.itemFactors, model.rank)


def complete_factors(domain: DataFrame, factors: DataFrame, k: int) -> DataFrame:
    """One vector for every id of ``domain(id)``: zeros where the model has none."""
    return domain.select("id").distinct().join(factors, "id", "left").select(
        "id", F.coalesce(F.col("features").cast("array<double>"), zeros(k)).alias("features"))


def user_vectors(prefs: DataFrame, factors: DataFrame, k: int, value: str = "x") -> DataFrame:
    """Rows of X U: per user, the item factors summed with the user's preferences."""
    f = factors.withColumnRenamed("id", "item_id")
    return prefs.join(f, "item_id").groupBy("user_id").agg(weighted_sum(value, "features", k).alias("features"))


def dislike_vectors(user_vecs: DataFrame, factors: DataFrame, k: int) -> DataFrame:
    """Rows of Y U for the graded dense Y: 1.2 times the factor sum, less X U."""
    total = factors.agg(vec_sum("features", k).alias("t")).first()["t"]
    return user_vecs.withColumn("_t", literal(UNSEEN_DISLIKE * x for x in total)).select(
        "user_id", combine("_t[{d}] - features[{d}]", k).alias("features"))


def score_pairs(pairs: DataFrame, users: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Inner products for (user, item) pairs; unknown ids are left out."""
    u = users.select("user_id", F.col("features").alias("_u"))
    v = items.select(F.col("id").alias("item_id"), F.col("features").alias("_v"))
    return pairs.join(u, "user_id").join(v, "item_id").withColumn("score", dot("_u", "_v", k)).drop("_u", "_v")


@dataclass
class Halves:
    """Two completed matrices over the same users and items, as ``users(user_id, near, far)`` and ``items(item_id, near, far)``
    with a null ``far`` where that half has none, and the spans of their positive cells."""

    users: DataFrame
    items: DataFrame
    near: Span
    far: Span


def blend_pairs(pairs: DataFrame, halves: Halves, k: int, weight: float) -> DataFrame:
    """Both halves at (user, item) pairs, each scaled over its positive cells, blended 1 to ``weight`` in one pass;
    ids unknown to the near half are left out, the far half counts as 0 where it has none."""
    u, v = (x.withColumnsRenamed({"near": f"_{c}n", "far": f"_{c}f"}) for c, x in (("u", halves.users), ("v", halves.items)))
    near, far = (F.when(d > 0, span.scale(d)).otherwise(0.0) for d, span in (
        (dot("_un", "_vn", k), halves.near), (dot("_uf", "_vf", k), halves.far)))
    return pairs.join(u, "user_id").join(v, "item_id").select("user_id", "item_id", (near + weight * far).alias("score"))


def factor_gram(factors: DataFrame, k: int) -> np.ndarray:
    """U^T U: k x k numbers, the only factor-derived values held on the driver."""
    return symmetric(factors.agg(outer_sums("features", k).alias("g")).first()["g"], k)


def symmetric(upper, k: int) -> np.ndarray:
    """A k x k matrix from its upper triangle, row by row."""
    g = np.zeros((k, k))
    g[np.triu_indices(k)] = [x or 0.0 for x in upper]
    return g + np.triu(g, 1).T


def matrix_rank(rows: DataFrame, cols: DataFrame, k: int) -> int:
    """Rank of U V^T, from the two k x k Grams."""
    return int(np.linalg.matrix_rank(factor_gram(rows, k) @ factor_gram(cols, k)))


def turned(rows: DataFrame, cols: DataFrame, k: int) -> DataFrame:
    """Item vectors v (U^T U): their inner products with V are the cells of R^T R, R = U V^T."""
    g = literal(factor_gram(rows, k).ravel())
    return cols.withColumn("_g", g).select("id", times_matrix("features", "_g", k).alias("features"))


def similarity_of_pairs(pairs: DataFrame, rows: DataFrame, cols: DataFrame, k: int) -> DataFrame:
    """Cells of R^T R for R = U V^T at ``pairs(row, col)``."""
    left = turned(rows, cols, k).withColumnsRenamed({"id": "row", "features": "_a"})
    right = cols.select(F.col("id").alias("col"), F.col("features").alias("_b"))
    return pairs.join(left, "row").join(right, "col").select("row", "col", dot("_a", "_b", k).alias("value"))


def product_span(rows: DataFrame, cols: DataFrame, positive: bool = True, block: int = BLOCK) -> Span:
    """Extremes of U V^T over all cells (or the positive ones).

    Both factor tables are cut into blocks of about ``block`` ids; a task
    multiplies two blocks and returns one row. Where they make many pairs,
    bounds leave most of them out.
    """
    nr, nc = -(-rows.count() // block) or 1, -(-cols.count() // block) or 1
    if nr * nc > ONE_JOB:
        return product_extremes(rows, cols, positive, block).span

    def side(df, own, n_own, other, n_other, is_row):
        return df.select(
            F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other),
            F.lit(is_row).alias("is_row"), F.col("features").cast("array<double>").alias("features"))

    both = side(rows, "rb", nr, "cb", nc, True).unionByName(side(cols, "cb", nc, "rb", nr, False))

    def extremes(table: pa.Table) -> pa.Table:
        f = np.array(table.column("features").to_pylist())
        is_row = table.column("is_row").to_numpy()
        low, high = None, None
        if is_row.any() and not is_row.all():
            m = f[is_row] @ f[~is_row].T
            m = m[m > 0] if positive else m.ravel()
            if len(m):
                low, high = float(m.min()), float(m.max())
        return pa.table({"low": pa.array([low], pa.float64()), "high": pa.array([high], pa.float64())})

    row = both.groupBy("rb", "cb").applyInArrow(extremes, "low double, high double").agg(
        F.min("low"), F.max("high")).first()
    return Span(float(row[0] or 0.0), float(row[1] or 0.0))
