"""Non-negative factorisation in which cells not stored count as zeros.

Multiplicative updates for the squared error |T - W H|^2:

    W <- W * (T H^T) / (W H H^T),   H <- H * (W^T T) / (W^T W H)

T H^T and W^T T are joins with sums; H H^T and W^T W are k x k numbers. A T
that is a constant per column plus sparse cells (the graded negative side) is
factorised in that form, without spelling out its cells.

``hals`` takes the same joins and Grams further per round: components are set one
after the other to their best value with all others fixed,

    w_d <- max(0, w_d + (T H^T - W H H^T)_d / (H H^T)_dd),

and it ends when the projected gradient has shrunk to a given part of its start.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import combine, dot, literal, outer_sums, times_matrix, vec_sum, weighted_sum, zeros
from ..session import freeze, freezing
from .factor import factor_gram, symmetric

TINY = 1e-12


@dataclass
class Nmf:
    rows: DataFrame
    cols: DataFrame
    losses: list[float]
    marks: dict[int, Nmf] = field(default_factory=dict)   # the model after some of the rounds


def _start(ids: DataFrame, k: int, seed: int, scale: float) -> DataFrame:
    """Seeded positive start that depends on the id only."""
    step = 1 << 20
    draw = f"(pmod(xxhash64(id, {{d}}, {seed}), {step}) + 1) / {step}D * {scale!r}D"
    return ids.select("id", combine(draw, k).alias("features"))


def _updated(old: DataFrame, numer: DataFrame, gram: np.ndarray, k: int, keep, shift=None, shift_from: int = 0) -> DataFrame:
    """``old * (numer + shift) / (old gram)``, written by ``keep``; numerators below 0 by rounding
    count as 0. ``hit`` is each new vector's product with its numerator."""
    joined = (
        old.join(numer, "id", "left").withColumn("_g", literal(gram.ravel()))
        .withColumn("_s", F.when(F.col("id") >= shift_from, literal(shift)).otherwise(zeros(k)) if shift else zeros(k))
    )
    top = joined.withColumn("_low", times_matrix("features", "_g", k)).withColumn(
        "num", combine("greatest(coalesce(num[{d}], 0D) + _s[{d}], 0D)", k))
    step = "features[{d}] * num[{d}] / (_low[{d}] + " + f"{TINY}D)"
    new = top.select("id", combine(step, k).alias("features"), "num")
    return keep(new.select("id", "features", dot("features", "num", k).alias("hit")))


def _best(old: DataFrame, numer: DataFrame, gram: np.ndarray, k: int, keep, shift=None, shift_from: int = 0) -> DataFrame:
    """One pass of best component values over all rows; ``slope`` is the squared projected gradient of each row before it."""
    extra = np.array([x or 0.0 for x in shift]) if shift else np.zeros(k)

    def run(batches):
        for b in batches:
            ids = b.column("id").to_numpy()
            x = np.array(b.column("features").to_pylist(), float).reshape(-1, k)
            num = np.array([v or [0.0] * k for v in b.column("num").to_pylist()], float).reshape(-1, k)
            num = np.maximum(num + extra * (ids >= shift_from)[:, None], 0.0)
            down = x @ gram - num
            slope = (np.where(x > 0, down, np.minimum(down, 0.0)) ** 2).sum(1)
            for d in range(k):
                if gram[d, d] > TINY:
                    x[:, d] = np.maximum(0.0, x[:, d] + (num[:, d] - x @ gram[:, d]) / gram[d, d])
            yield pa.RecordBatch.from_pydict({
                "id": b.column("id"), "features": pa.array(list(x), pa.list_(pa.float64())), "hit": (x * num).sum(1), "slope": slope})

    return keep(old.select("id", "features").join(numer, "id", "left").mapInArrow(
        run, "id long, features array<double>, hit double, slope double"))


def _facts(factors: DataFrame, k: int) -> tuple[np.ndarray, float]:
    """F^T F, and the summed products with the numerator of the last update."""
    row = factors.agg(outer_sums("features", k).alias("g"), F.sum("hit").alias("hit")).first()
    return symmetric(row["g"], k), row["hit"] or 0.0


def nmf_fit(cells: DataFrame, k: int, iters: int, seed: int = 0, base: DataFrame | None = None,
            row_ids: DataFrame | None = None, base_from: int = 0, marks: tuple[int, ...] = (), tol: float | None = None) -> Nmf:
    """Factorise frozen cells ``(row, col, value)``.

    ``base(col, value)`` is a constant added to every row of a column, or to
    the rows from ``base_from`` on; then ``row_ids(id)`` must list the rows.
    ``marks`` are rounds whose models are kept, so that one fit serves several
    settings. With ``tol``, rounds set best component values (``hals``) and end early when the
    projected gradient is below ``tol`` times its first norm.
    """
    update = _updated if tol is None else _best
    first_slope = None
    kept: dict[int, Nmf] = {}
    row_ids = row_ids if row_ids is not None else cells.select(F.col("row").alias("id")).distinct()
    col_ids = cells.select(F.col("col").alias("id"))
    if base is not None:
        col_ids = col_ids.union(base.select(F.col("col").alias("id")))
        base = freeze(base.select(F.col("col").alias("id"), F.col("value").alias("base")))
    row_ids, col_ids = freeze(row_ids), freeze(col_ids.distinct())
    n, m = row_ids.count(), col_ids.count()
    n_based = row_ids.where(F.col("id") >= base_from).count()
    total = cells.agg(F.sum("value"), F.sum(F.col("value") * F.col("value"))).first()
    total_sum, square = total[0] or 0.0, total[1] or 0.0
    if base is not None:
        b = base.agg(F.sum("base"), F.sum(F.col("base") * F.col("base"))).first()
        mixed = cells.where(F.col("row") >= base_from).join(base.withColumnRenamed("id", "col"), "col").agg(
            F.sum(F.col("value") * F.col("base"))).first()[0] or 0.0
        total_sum, square = total_sum + n_based * b[0], square + n_based * b[1] + 2 * mixed
    scale = 2 * float(np.sqrt(max(total_sum, TINY) / (n * m * k)))
    w = freeze(_start(row_ids, k, seed, scale))
    h = freeze(_start(col_ids, k, seed + 1, scale))
    gram_h = factor_gram(h, k)
    losses = []
    keep_w, keep_h = freezing(cells.sparkSession, "rows"), freezing(cells.sparkSession, "cols")
    for done in range(1, iters + 1):
        num = cells.join(h.select(F.col("id").alias("col"), "features"), "col").groupBy(
            F.col("row").alias("id")).agg(weighted_sum("value", "features", k).alias("num"))
        shift = None
        if base is not None:
            shift = base.join(h, "id").agg(weighted_sum("base", "features", k).alias("t")).first()["t"]
        w = update(w, num, gram_h, k, keep_w, shift, base_from)
        gram_w, _ = _facts(w, k)

        num = cells.join(w.select(F.col("id").alias("row"), "features"), "row").groupBy(
            F.col("col").alias("id")).agg(weighted_sum("value", "features", k).alias("num"))
        if base is not None:
            mass = w.where(F.col("id") >= base_from).agg(vec_sum("features", k).alias("t")).first()["t"]
            num = base.join(num, "id", "left").withColumn("_m", literal(mass)).select(
                "id", combine("coalesce(num[{d}], 0D) + base * _m[{d}]", k).alias("num"))
        h = update(h, num, gram_w, k, keep_h)
        gram_h, cross = _facts(h, k)  # cross: the sum of T * (W H) over all cells
        losses.append(float(square - 2 * cross + np.sum(gram_w * gram_h)))
        if done in marks:
            kept[done] = Nmf(freeze(w.select("id", "features")), freeze(h.select("id", "features")), list(losses))
        if tol is not None:
            slope = float(np.sqrt(sum(f.agg(F.sum("slope")).first()[0] or 0.0 for f in (w, h))))
            first_slope = slope if first_slope is None else first_slope
            if slope <= tol * first_slope:
                break
    return Nmf(w.select("id", "features"), h.select("id", "features"), losses, kept)


def hals(cells: DataFrame, k: int, tol: float = 1e-2, most: int = 200, seed: int = 0, **operand) -> Nmf:
    """Factors by best component values until the projected gradient is below ``tol`` of its start, ``most`` rounds at the latest."""
    return nmf_fit(cells, k, most, seed, tol=tol, **operand)
