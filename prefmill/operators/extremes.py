"""Extremes of U V^T with bounds: pairs of blocks that cannot hold one are never multiplied.

Both factor tables are laid out by their strongest coordinate and norm, and cut into
blocks. A block is summed up in a box (least and greatest value per coordinate, least
positive one), a ball (centre, radius) and its longest vector. These bound all products
of a pair of blocks from both sides. The longest vectors give first extremes; pairs that
could pass them are opened, the most promising first, and what the products found rules
out more of the rest. Boxes of one side, at most ``BOXES``, are sent to all tasks. The last
pairs are opened by tiles of many blocks: a block travels once a tile, not once a pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import freeze
from .ordering import positions
from .scale import Span

BOXES = 4096            # blocks of the side that is sent
FIRST = (64, 512)       # pairs opened in the first rounds; the last opens what is left
SLACK = 1e-12           # rounding of bounds and products, as a share of the norms
SLICE = 128             # boxes bounded at once
TILE = 1 << 15          # vectors on either side of a tile
WIDE = 1 << 13          # vectors a block is multiplied with at once
_BOX = "block long, lo array<double>, hi array<double>, least array<double>, centre array<double>, radius double, longest array<double>"
_SIZES = "transform(features, x -> abs(x))"


@dataclass
class Extremes:
    """``span`` over all cells; ``opened`` of ``pairs`` pairs of blocks were multiplied."""

    span: Span
    opened: int
    pairs: int


def _laid(factors: DataFrame, n: int, block: int) -> DataFrame:
    """Vectors in blocks of like direction and norm; written, as two joins must see the same blocks."""
    f = factors.select(F.col("features").cast("array<double>").alias("features")).withColumn("at", F.expr(
        f"array_position({_SIZES}, array_max({_SIZES}))")).withColumn(
        "axis", F.col("at") * F.signum(F.get("features", F.col("at").cast("int") - 1))).withColumn(
        "norm", F.expr("sqrt(aggregate(features, 0D, (a, x) -> a + x * x))"))
    order = [F.col("axis"), F.desc("norm"), F.col("features")]
    placed = positions(f.select("axis", "norm", "features"), order, "pos") if n > block else f.withColumn("pos", F.lit(0))
    return freeze(placed.select(F.floor(F.col("pos") / block).cast("long").alias("block"), "features"))


def _matrix(column) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors must have one length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)


def _box(table: pa.Table) -> pa.Table:
    f = _matrix(table.column("features"))
    centre = f.mean(0)
    least = np.where(f > 0, f, np.inf).min(0)
    norms = np.einsum("ij,ij->i", f, f)
    return pa.table({
        "block": table.column("block").slice(0, 1).combine_chunks(), "lo": [f.min(0).tolist()], "hi": [f.max(0).tolist()],
        "least": [least.tolist()], "centre": [centre.tolist()],
        "radius": [float(np.sqrt(((f - centre) ** 2).sum(1).max()))], "longest": [f[norms.argmax()].tolist()]})


@dataclass
class _Boxes:
    block: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    least: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    longest: np.ndarray

    @classmethod
    def of(cls, part) -> _Boxes:
        return cls(*(np.array(part.column(c).to_pylist()) for c in ("block", "lo", "hi", "least", "centre", "radius", "longest")))


def bounds(a: _Boxes, b: _Boxes) -> tuple[np.ndarray, np.ndarray]:
    """No product of a block of ``a`` and one of ``b`` is below the first or above the second array."""
    shape = len(a.block), len(b.block)
    low, high = np.zeros(shape), np.zeros(shape)
    some = np.full(shape, np.inf)  # where nothing is negative, a positive product has a positive term
    for d in range(a.lo.shape[1]):
        ends = [np.multiply.outer(x[:, d], y[:, d]) for x in (a.lo, a.hi) for y in (b.lo, b.hi)]
        low += np.minimum.reduce(ends)
        high += np.maximum.reduce(ends)
        some = np.minimum(some, np.multiply.outer(a.least[:, d], b.least[:, d]))
    size = lambda x: np.sqrt((x * x).sum(1))
    middle = a.centre @ b.centre.T
    reach = np.multiply.outer(size(a.centre), b.radius) + np.multiply.outer(a.radius, size(b.centre)) + np.multiply.outer(a.radius, b.radius)
    norms = np.multiply.outer(size(a.longest), size(b.longest))
    low, high = np.maximum.reduce([low, middle - reach, -norms]), np.minimum.reduce([high, middle + reach, norms])
    whole = np.logical_and.outer((a.lo >= 0).all(1), (b.lo >= 0).all(1)) & np.isfinite(some)
    slack = SLACK * a.lo.shape[1] * norms
    return np.where(whole & (some > low), some, low - slack), high + slack


def _ends(m: np.ndarray, positive: bool) -> tuple[float | None, float | None]:
    m = m[m > 0] if positive else m.ravel()
    return (float(m.min()), float(m.max())) if len(m) else (None, None)


def _wider(span, found):
    """``span`` widened by a row of (low, high), either of which may be null."""
    low, high = found
    return (min(span[0], np.inf if low is None else low), max(span[1], -np.inf if high is None else high))


def _by_tiles(sides: list[DataFrame], pairs: DataFrame, blocks: int, positive: bool) -> DataFrame:
    """Least and greatest products of ``pairs(rb, cb)``, per slice: those of ``blocks`` x ``blocks`` blocks go to one task,
    with each block they name once."""
    spark = pairs.sparkSession
    named = pairs.select((F.col("rb") / blocks).cast("long").alias("rt"), (F.col("cb") / blocks).cast("long").alias("ct"), "rb", "cb")
    nothing = F.lit(None).cast("array<double>")
    n = max(spark.sparkContext.defaultParallelism, named.select("rt", "ct").distinct().count())
    laid = named.select("rt", "ct", F.lit(0).alias("kind"), F.col("rb").alias("block"), F.col("cb").alias("other"), nothing.alias("features"))
    for kind, side, key in ((2, sides[0], "rb"), (1, sides[1], "cb")):  # columns of a tile come before its rows
        met = named.select("rt", "ct", F.col(key).alias("block")).distinct()
        laid = laid.unionByName(side.join(met, "block").select(
            "rt", "ct", F.lit(kind).alias("kind"), "block", F.lit(0).cast("long").alias("other"), "features"))

    def run(batches):
        now, pairs_, cols = None, [], []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("rt", "ct", "kind")])
            edges = np.r_[0, np.flatnonzero((np.diff(keys) != 0).any(0)) + 1, batch.num_rows]
            for at, end in zip(edges[:-1], edges[1:]):
                part = batch.slice(at, end - at)
                if not part.num_rows:
                    continue
                if now != (*keys[:2, at],):
                    now, pairs_, cols = (*keys[:2, at],), [], []
                block = part.column("block").to_numpy()
                if keys[2, at] == 0:
                    pairs_.append((block, part.column("other").to_numpy()))
                elif keys[2, at] == 1:
                    cols.append((block, _matrix(part.column("features"))))
                else:
                    rb, cb = (np.concatenate(x) for x in zip(*pairs_))
                    of, v = (np.concatenate(x) for x in zip(*cols))
                    pairs_, cols = [(rb, cb)], [(of, v)]
                    mine = _matrix(part.column("features"))
                    found = [_ends(mine[block == b] @ some.T, positive) for b in np.unique(block)
                             for against in [v[np.isin(of, cb[rb == b])]] for some in np.array_split(against, -(-len(against) // WIDE))]
                    low, high = ([x for x in e if x is not None] for e in zip(*found))
                    yield pa.RecordBatch.from_pydict({
                        "low": pa.array([min(low, default=None)], pa.float64()), "high": pa.array([max(high, default=None)], pa.float64())})

    return laid.repartition(n, "rt", "ct").sortWithinPartitions("rt", "ct", "kind", "block").mapInArrow(run, "low double, high double")


def product_extremes(rows: DataFrame, cols: DataFrame, positive: bool = True, block: int = BOXES) -> Extremes:
    """Extremes of U V^T over all cells, or over the positive ones; both 0 if there is none.

    ``rows`` and ``cols`` hold ``features`` of one length; rows without a vector, or with a null in it, are left out.
    """
    spark = rows.sparkSession
    rows, cols = (x.where("features IS NOT NULL AND size(features) > 0 AND NOT exists(features, x -> x IS NULL)") for x in (rows, cols))
    nr, nc = rows.count(), cols.count()
    if not nr or not nc:
        return Extremes(Span(0.0, 0.0), 0, 0)
    if nr < nc:  # the shorter side is sent
        rows, cols, nr, nc = cols, rows, nc, nr
    sides = [_laid(rows, nr, block), _laid(cols, nc, max(block, -(-nc // BOXES)))]
    big, small = (s.groupBy("block").applyInArrow(_box, _BOX) for s in sides)
    big = freeze(big)
    sent = spark.sparkContext.broadcast(_Boxes.of(small.toArrow()))  # at most BOXES rows

    def slices(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield _Boxes.of(batch.slice(at, SLICE))

    def longest(batches):
        for a in slices(batches):
            low, high = _ends(a.longest @ sent.value.longest.T, positive)
            yield pa.RecordBatch.from_pydict({"low": pa.array([low], pa.float64()), "high": pa.array([high], pa.float64())})

    ends = "low double, high double"
    span = _wider((np.inf, -np.inf), big.mapInArrow(longest, ends).agg(F.min("low"), F.max("high")).first())

    def hopeful(batches):
        for a in slices(batches):
            low, high = bounds(a, sent.value)
            on = (high > span[1]) | (low < span[0])
            if positive:
                on &= high > 0
            p, q = np.nonzero(on)
            yield pa.RecordBatch.from_pydict({"rb": a.block[p], "cb": sent.value.block[q], "low": low[p, q], "high": high[p, q]})

    def multiplied(table: pa.Table) -> pa.Table:
        f = _matrix(table.column("features"))
        own = table.column("is_row").to_numpy()
        low, high = _ends(f[own] @ f[~own].T, positive)
        return pa.table({"low": pa.array([low], pa.float64()), "high": pa.array([high], pa.float64())})

    left = freeze(big.mapInArrow(hopeful, "rb long, cb long, low double, high double"))
    total = -(-nr // block) * len(sent.value.block)
    opened = 0
    for width in (*FIRST, None):
        left = left.where((F.col("high") > F.lit(span[1])) | (F.col("low") < F.lit(span[0])))
        if width is None:
            chosen = left.select("rb", "cb")
        else:
            tops = left.orderBy(F.desc("high"), "rb", "cb").limit(width), left.orderBy("low", "rb", "cb").limit(width)
            chosen = freeze(tops[0].unionByName(tops[1]).select("rb", "cb").distinct())
        n = chosen.count()
        if not n:
            break
        opened += n
        if width is None:
            found = _by_tiles(sides, chosen, max(1, TILE // block), positive)
        else:
            both = [side.join(chosen, side["block"] == chosen[key]).select("rb", "cb", F.lit(key == "rb").alias("is_row"), "features")
                    for side, key in zip(sides, ("rb", "cb"))]
            found = both[0].unionByName(both[1]).groupBy("rb", "cb").applyInArrow(multiplied, ends)
        span = _wider(span, found.agg(F.min("low"), F.max("high")).first())
        if width is not None:
            left = freeze(left.join(chosen, ["rb", "cb"], "left_anti"))
    sent.unpersist()
    low, high = span
    return Extremes(Span(low, high) if low <= high else Span(0.0, 0.0), opened, total)
