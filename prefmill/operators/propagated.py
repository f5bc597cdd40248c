"""Y (Y^T X) for the graded dense Y: users x items, every cell filled, never formed.

With S = X^T X, c the column sums of X, b = 1.2 c and |x_u| the mass of a user,

    cell(u, j) = flat_j - b_j |x_u| + (x_u S)_j,   flat_j = 1.2 (n b_j - sum_i S_ij).

Scaling by the extremes keeps that form. Zeroing cells below a cut breaks it
in places, so every column takes the cheaper of two forms: the affine one, with the
cells under the cut taken off as sparse cells; or nothing but its cells above the
cut. Bounds from the masses of users and the greatest cell of a column settle
most columns and, for the extremes, most blocks without a multiplication. What the
factorisation needs are products with k columns, taken as X (S H) by two joins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.prefs import UNSEEN_DISLIKE
from ..functions.vectors import combine, literal, vec_sum, weighted_sum, zeros
from ..session import freeze, freezing
from .cells import column_base, item_gram, user_mass
from .factor import factor_gram
from .nmf import TINY, Nmf, _facts, _start, _updated
from .product import gram
from .score import BLOCK_ROWS, TILE_ROWS, _each_group, _grid, _groups, placed_slices

CUT = 0.2


@dataclass
class Propagated:
    """The scaled matrix with cells under the cut zeroed.

    ``columns(col, flat, slope, whole)`` and ``s(row, col, value)`` are scaled; where
    ``whole``, a cell is flat - slope * mass + x S, plus what ``fixes(row, col, value)`` says;
    elsewhere ``fixes`` has all there is. ``opened`` of ``n_pairs`` (user block, column) pairs were multiplied for the extremes.
    """

    prefs: DataFrame
    s: DataFrame
    columns: DataFrame
    mass: DataFrame
    fixes: DataFrame
    low: float
    high: float
    opened: int
    n_pairs: int


def _column_facts(c: np.ndarray, flat: np.ndarray, slope: np.ndarray, m: np.ndarray):
    """Different columns of a group with their flat, slope and greatest cell of S."""
    cols, first, which = np.unique(c, return_index=True, return_inverse=True)
    top = np.zeros(len(cols))
    np.maximum.at(top, which, m)
    return cols, flat[first], slope[first], top, which


def _cells(u, i, x, r, c, m, cols, flat, slope, users, mass):
    """Slices of cells: users, columns, values."""
    for us, cs, product in placed_slices(u, i, x, r, c, m):
        at = np.searchsorted(cols, cs)
        yield us, cs, flat[at][None, :] - slope[at][None, :] * mass[np.searchsorted(users, us)][:, None] + product


def _survey(group):
    """Least and greatest cell of a group, and how many of its columns had to be multiplied for them."""
    (u, i, (x, *_)), (r, c, (m, flat, slope)), _ = group
    if not len(u) or not len(r):
        return
    users, which = np.unique(u, return_inverse=True)
    mass = np.bincount(which, x)
    cols, flat, slope, top, column = _column_facts(c, flat, slope, m)
    lower = flat - slope * mass.max()
    upper = flat - slope * mass.min() + mass.max() * top
    low, high, done = np.inf, -np.inf, np.zeros(len(cols), bool)
    while True:
        # the two columns that promise most; then all that could still win
        todo = (lower < low) | (upper > high) if done.any() else np.isin(np.arange(len(cols)), (lower.argmin(), upper.argmax()))
        todo &= ~done
        if not todo.any():
            yield low, high, int(done.sum()), len(cols)
            return
        pick = todo[column]
        for _, _, cells in _cells(u, i, x, r[pick], c[pick], m[pick], cols, flat, slope, users, mass):
            low, high = min(low, cells.min()), max(high, cells.max())
        done |= todo


def _laid(prefs: DataFrame, cells: DataFrame, values: list[str], block_rows: int, tile_rows: int) -> DataFrame:
    given = prefs.select("user_id", "item_id", F.col("x").alias("value"))
    return _groups(given, cells, None, values, *_grid(given, cells, None, block_rows, tile_rows))


def propagated(train: DataFrame, n_items: int, cut: float = CUT, block_rows: int = BLOCK_ROWS, tile_rows: int = TILE_ROWS) -> Propagated:
    """Y (Y^T X) over the users and items of ``train``, scaled by its extremes, zero below ``cut``."""
    prefs = freeze(train.select("user_id", "item_id", (F.col("rating") / 5).alias("x")))
    s, mass = freeze(item_gram(train)), freeze(user_mass(train))
    sums = s.groupBy("col").agg(F.sum("value").alias("s_sum"), F.max("value").alias("top"))
    columns = freeze(column_base(train).join(sums, "col").select(
        "col", (UNSEEN_DISLIKE * (n_items * F.col("base") - F.col("s_sum"))).alias("flat"), F.col("base").alias("slope"), "top"))
    wide = freeze(s.join(columns.select("col", "flat", "slope"), "col"))

    def extremes(batches):
        for group in _each_group(batches, 3):
            for row in _survey(group):
                yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip(("low", "high", "opened", "pairs"), row)})

    found = _laid(prefs, wide, ["value", "flat", "slope"], block_rows, tile_rows).mapInArrow(
        extremes, "low double, high double, opened long, pairs long").agg(
        F.min("low"), F.max("high"), F.sum("opened"), F.sum("pairs")).first()
    low, high = found[0] or 0.0, found[1] or 0.0
    width = (high - low) or 1.0
    least = low + cut * width
    m = mass.agg(F.min("mass"), F.max("mass"), F.count(F.lit(1))).first()
    lower = F.col("flat") - F.col("slope") * (m[1] or 0.0)
    upper = F.col("flat") - F.col("slope") * (m[0] or 0.0) + F.col("top") * (m[1] or 0.0)
    sorted_out = freeze(columns.withColumn("open", (lower < least) & (upper >= least)).withColumn("over", lower >= least))
    mixed = freeze(wide.join(sorted_out.where("open").select("col"), "col", "left_semi"))

    def count(batches):
        for (u, i, (x, *_)), (r, c, (v, flat, slope)), _ in _each_group(batches, 3):
            if not len(u) or not len(r):
                continue
            users, which = np.unique(u, return_inverse=True)
            cols, flat, slope, _, _ = _column_facts(c, flat, slope, v)
            for _, cs, cells in _cells(u, i, x, r, c, v, cols, flat, slope, users, np.bincount(which, x)):
                yield pa.RecordBatch.from_pydict({"col": cs, "under": (cells < least).sum(0)})

    under = _laid(prefs, mixed, ["value", "flat", "slope"], block_rows, tile_rows).mapInArrow(
        count, "col long, under long").groupBy("col").agg(F.sum("under").alias("under"))
    settled = freeze(sorted_out.join(under, "col", "left").select(
        "col", "flat", "slope", "open", F.coalesce(F.col("under") * 2 <= m[2], F.col("over")).alias("whole")))
    told = mixed.join(settled.select("col", F.col("whole").cast("double").alias("whole")), "col")

    def fix(batches):
        for (u, i, (x, *_)), (r, c, (v, flat, slope, whole)), _ in _each_group(batches, 4):
            if not len(u) or not len(r):
                continue
            users, which = np.unique(u, return_inverse=True)
            cols, first = np.unique(c, return_index=True)
            flat, slope, whole = flat[first], slope[first], whole[first] > 0
            for us, cs, cells in _cells(u, i, x, r, c, v, cols, flat, slope, users, np.bincount(which, x)):
                affine = whole[np.searchsorted(cols, cs)][None, :]
                p, q = np.nonzero((cells < least) == affine)
                value = (cells[p, q] - low) / width * np.where(affine[0, q], -1.0, 1.0)
                yield pa.RecordBatch.from_pydict({"row": us[p], "col": cs[q], "value": value})

    fixes = freeze(_laid(prefs, told, ["value", "flat", "slope", "whole"], block_rows, tile_rows).mapInArrow(
        fix, "row long, col long, value double"))
    scaled = freeze(settled.select("col", ((F.col("flat") - low) / width).alias("flat"), (F.col("slope") / width).alias("slope"), "whole"))
    kept = freeze(s.join(scaled.where("whole").select("col"), "col", "left_semi").select(
        "row", "col", (F.col("value") / width).alias("value")))
    return Propagated(prefs, kept, scaled, mass, fixes, low, high, found[2] or 0, found[3] or 0)


def column_sums(far: Propagated) -> DataFrame:
    """(col, total): sums of the columns of the cut matrix, without its cells."""
    x = far.prefs.groupBy(F.col("item_id").alias("row")).agg(F.sum("x").alias("c"))
    met = far.s.join(x, "row").groupBy("col").agg(F.sum(F.col("value") * F.col("c")).alias("xs"))
    m = far.mass.agg(F.count(F.lit(1)), F.sum("mass")).first()
    affine = far.columns.join(met, "col", "left").select("col", F.when(
        F.col("whole"), F.col("flat") * m[0] - F.col("slope") * (m[1] or 0.0) + F.coalesce("xs", F.lit(0.0))).otherwise(0.0).alias("total"))
    return affine.unionByName(far.fixes.select("col", F.col("value").alias("total"))).groupBy("col").agg(F.sum("total").alias("total"))


def square_sum(far: Propagated) -> float:
    """Sum of the squared cells, from products of S with itself and sums of the columns."""
    items = far.prefs.join(far.mass, "user_id").groupBy(F.col("item_id").alias("row")).agg(
        F.sum("x").alias("c"), F.sum(F.col("x") * F.col("mass")).alias("q"))
    met = far.s.join(items, "row").groupBy("col").agg(
        F.sum(F.col("value") * F.col("c")).alias("cp"), F.sum(F.col("value") * F.col("q")).alias("qp"))
    m = far.mass.agg(F.count(F.lit(1)), F.sum("mass"), F.sum(F.col("mass") * F.col("mass"))).first()
    n, m1, m2 = m[0], m[1] or 0.0, m[2] or 0.0
    f, b = F.col("flat"), F.col("slope")
    cp, qp = F.coalesce("cp", F.lit(0.0)), F.coalesce("qp", F.lit(0.0))
    affine = far.columns.where("whole").join(met, "col", "left").agg(F.sum(
        n * f * f + m2 * b * b - 2 * m1 * f * b + 2 * f * cp - 2 * b * qp)).first()[0] or 0.0
    # |X S_j|^2 = S_j' (X' X) S_j, and X' X = S: once more times S, at the cells of S_j
    plain = freeze(item_gram(far.prefs.withColumn("rating", F.col("x") * 5)))
    twice = gram(plain).withColumnRenamed("value", "v2")
    width = (far.high - far.low) or 1.0
    product = far.s.join(twice, ["row", "col"]).agg(F.sum(F.col("value") * F.col("v2"))).first()[0] or 0.0
    v = F.col("value")
    return affine + product / width + (far.fixes.agg(F.sum(F.when(v < 0, -v * v).otherwise(v * v))).first()[0] or 0.0)


def nmf_above(upper: DataFrame, far: Propagated, offset: int, k: int, iters: int, seed: int = 0, marks: tuple[int, ...] = ()) -> Nmf:
    """Non-negative factors of [upper; far]: ``upper(row, col, value)`` is sparse, far's users start at row ``offset``.

    Multiplicative updates as in ``nmf``; no cell of the affine part is made. The models after the rounds ``marks`` are kept.
    """
    sparse = freeze(upper.select("row", "col", "value").unionByName(
        far.fixes.select((F.col("row") + offset).alias("row"), "col", "value")))
    users = far.mass.select(F.col("user_id").alias("id"))
    row_ids = freeze(users.unionByName(users.select((F.col("id") + offset).alias("id"))).unionByName(
        upper.select(F.col("row").alias("id"))).distinct())
    col_ids = freeze(far.columns.select(F.col("col").alias("id")).unionByName(upper.select(F.col("col").alias("id"))).distinct())
    square = square_sum(far) + (upper.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0)
    total = (column_sums(far).agg(F.sum("total")).first()[0] or 0.0) + (upper.agg(F.sum("value")).first()[0] or 0.0)
    scale = 2 * float(np.sqrt(max(total, TINY) / (row_ids.count() * col_ids.count() * k)))
    w, h = freeze(_start(row_ids, k, seed, scale)), freeze(_start(col_ids, k, seed + 1, scale))
    whole = freeze(far.columns.where("whole").select(F.col("col").alias("id"), "flat", "slope"))
    masses = far.mass.select((F.col("user_id") + offset).alias("id"), "mass")

    def summed(*parts):
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        return both.groupBy("id").agg(vec_sum("num", k).alias("num"))

    def for_rows(h):
        near = sparse.join(h.select(F.col("id").alias("col"), "features"), "col").groupBy(
            F.col("row").alias("id")).agg(weighted_sum("value", "features", k).alias("num"))
        t = whole.join(h, "id").agg(weighted_sum("flat", "features", k).alias("flat"), weighted_sum("slope", "features", k).alias("slope")).first()
        sh = far.s.join(h.select(F.col("id").alias("col"), "features"), "col").groupBy(
            F.col("row").alias("item_id")).agg(weighted_sum("value", "features", k).alias("features"))
        xsh = far.prefs.join(sh, "item_id").groupBy((F.col("user_id") + offset).alias("id")).agg(
            weighted_sum("x", "features", k).alias("far"))
        level = masses.join(xsh, "id", "left").withColumn("_f", _numbers(t["flat"], k)).withColumn("_b", _numbers(t["slope"], k))
        return summed(near, level.select("id", combine("_f[{d}] - mass * _b[{d}] + coalesce(far[{d}], 0D)", k).alias("num")))

    def for_cols(w):
        near = sparse.join(w.select(F.col("id").alias("row"), "features"), "row").groupBy(
            F.col("col").alias("id")).agg(weighted_sum("value", "features", k).alias("num"))
        lower = w.join(masses, "id")
        t = lower.agg(vec_sum("features", k).alias("one"), weighted_sum("mass", "features", k).alias("mass")).first()
        xw = far.prefs.join(lower.select((F.col("id") - offset).alias("user_id"), "features"), "user_id").groupBy(
            F.col("item_id").alias("row")).agg(weighted_sum("x", "features", k).alias("features"))
        sxw = far.s.join(xw, "row").groupBy(F.col("col").alias("id")).agg(weighted_sum("value", "features", k).alias("far"))
        level = whole.join(sxw, "id", "left").withColumn("_w", _numbers(t["one"], k)).withColumn("_m", _numbers(t["mass"], k))
        return summed(near, level.select("id", combine("flat * _w[{d}] - slope * _m[{d}] + coalesce(far[{d}], 0D)", k).alias("num")))

    gram_h = factor_gram(h, k)
    losses, kept = [], {}
    keep_w, keep_h = freezing(sparse.sparkSession, "rows"), freezing(sparse.sparkSession, "cols")
    for done in range(1, iters + 1):
        w = _updated(w, for_rows(h), gram_h, k, keep_w)
        gram_w, _ = _facts(w, k)
        h = _updated(h, for_cols(w), gram_w, k, keep_h)
        gram_h, cross = _facts(h, k)
        losses.append(float(square - 2 * cross + np.sum(gram_w * gram_h)))
        if done in marks:
            kept[done] = Nmf(freeze(w.select("id", "features")), freeze(h.select("id", "features")), list(losses))
    return Nmf(w.select("id", "features"), h.select("id", "features"), losses, kept)


def _numbers(values, k: int):
    """A literal vector; sums over nothing are zeros."""
    return literal(v or 0.0 for v in values) if values else zeros(k)
