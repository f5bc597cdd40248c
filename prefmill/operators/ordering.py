"""Global order without a global sort in one task.

``rank_cuts`` finds the key at given positions by counting, so a positional
split becomes a plain filter. ``running_totals`` and ``positions`` lay rows out
by range, freeze that layout, and add one offset per partition.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import freeze

FANOUT = 4096


def before(cols: list[str], key: tuple) -> Column:
    """True for rows sorting strictly before ``key`` (which may be a key prefix); nulls sort first."""
    test = F.lit(False)
    for name, value in reversed(list(zip(cols, key))):
        col = F.col(name)
        if value is None:
            test = col.isNull() & test
        else:
            test = col.isNull() | (col < value) | ((col == value) & test)
    return F.coalesce(test, F.lit(False))


def rank_cuts(df: DataFrame, cols: list[str], positions, fanout: int = FANOUT) -> tuple[int, list[tuple]]:
    """Row count, and for each 0-based position the key that splits there.

    ``positions`` is a list, or a function from the row count to such a list.
    Each key separates the rows before that position from the rest. ``cols``
    are integer columns which together are unique; a null sorts before all
    numbers, as one step below the least. Every step groups into at most
    ``fanout`` buckets per position, so only that many counts reach the driver,
    and tied values cost no more than others. ``df`` is read some times over, so
    pass a frozen table: its scans prune columns and filter.
    """
    bounds = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols],
        *[F.count(c).alias(f"n_{c}") for c in cols],
    ).first()
    n = bounds["n"]
    null = {c: (bounds[f"lo_{c}"] or 0) - 1 for c in cols if bounds[f"n_{c}"] < n}
    keys = df.select(*[F.coalesce(F.col(c), F.lit(null[c])).cast("long").alias(c) if c in null else c for c in cols])
    wanted = positions(n) if callable(positions) else positions
    cuts = ["low" if p <= 0 else "high" if p >= n else _Cut(int(p)) for p in wanted]
    for depth, name in enumerate(cols):
        for c in cuts:
            if isinstance(c, _Cut) and c.left:
                c.low, c.high = null.get(name, bounds[f"lo_{name}"]), bounds[f"hi_{name}"]
                c.high = c.low if c.high is None else c.high
        while _narrow(keys, cols[:depth], name, [c for c in cuts if isinstance(c, _Cut)], fanout):
            pass
        for c in cuts:
            if isinstance(c, _Cut) and len(c.key) == depth and (c.left or c.low is not None):
                c.key, c.low = c.key + (c.low,), None
    back = lambda key: tuple(None if c in null and v == null[c] else v for c, v in zip(cols, key))
    return n, [back(c.key) if isinstance(c, _Cut) else c for c in cuts]


@dataclass
class _Cut:
    """A cut being narrowed: ``left`` rows of the current range lie before it."""

    left: int
    key: tuple = ()
    low: int | None = None
    high: int | None = None


def _narrow(keys, prefix_cols, name, cuts, fanout) -> bool:
    """Count each open range in ``fanout`` buckets and keep the one holding the cut."""
    col = F.col(name)
    wide = [c for c in cuts if c.left and len(c.key) == len(prefix_cols) and c.low < c.high]
    if not wide:
        return False
    tests, picks = [], []
    for i, c in enumerate(wide):
        width = -(-(c.high - c.low + 1) // fanout)
        hit = reduce(and_, [F.col(p) == v for p, v in zip(prefix_cols, c.key)], col.between(c.low, c.high))
        bucket = F.floor((col - c.low) / width).cast("long")
        tests.append(hit)
        picks.append(F.when(hit, F.struct(F.lit(i).alias("cut"), bucket.alias("bucket"))))
    counted = (
        keys.where(reduce(or_, tests)).select(F.explode(F.array(*picks)).alias("p")).where("p IS NOT NULL")
        .groupBy("p.cut", "p.bucket").count().collect()
    )
    for i, c in enumerate(wide):
        width = -(-(c.high - c.low + 1) // fanout)
        for bucket, rows in sorted((r["bucket"], r["count"]) for r in counted if r["cut"] == i):
            if c.left < rows:
                c.low += bucket * width
                c.high = min(c.high, c.low + width - 1)
                break
            c.left -= rows
    return True


def is_before(cols: list[str], cut) -> Column:
    """``before`` for a cut of ``rank_cuts``, which may lie outside the rows."""
    if cut == "low":
        return F.lit(False)
    if cut == "high":
        return F.lit(True)
    return before(cols, cut)


def _laid_out(df: DataFrame, order) -> DataFrame:
    """Range-partition and sort; ``_slot`` numbers rows and names their partition."""
    laid = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    return freeze(laid).withColumn("_part", F.shiftright("_slot", 33))


def _offsets(per_part: DataFrame, names: list[str]) -> DataFrame:
    """Sums over all earlier partitions. One row per partition, hence one task."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(
        "_part", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"_before_{n}") for n in names]
    )


def positions(df: DataFrame, order, name: str = "pos") -> DataFrame:
    """Add the 0-based global position in ``order``."""
    laid = _laid_out(df, order)
    sizes = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("rows"))
    local = F.col("_slot") - F.shiftleft("_part", 33)
    return (
        laid.join(F.broadcast(_offsets(sizes, ["rows"])), "_part")
        .withColumn(name, (local + F.col("_before_rows")).cast("long"))
        .drop("_slot", "_part", "_before_rows")
    )


def running_totals(df: DataFrame, order, sums: list[str]) -> tuple[DataFrame, dict]:
    """Inclusive running sums ``cum_<name>`` in ``order``, and the grand totals."""
    laid = _laid_out(df, order)
    per_part = laid.groupBy("_part").agg(*[F.sum(n).alias(n) for n in sums])
    totals = per_part.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums]).first().asDict()
    w = Window.partitionBy("_part").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    out = laid.join(F.broadcast(_offsets(per_part, sums)), "_part")
    for n in sums:
        out = out.withColumn(f"cum_{n}", F.sum(n).over(w) + F.col(f"_before_{n}"))
    return out.drop("_slot", "_part", *[f"_before_{n}" for n in sums]), totals


def value_at(df: DataFrame, value: str, positions_of) -> tuple[int, list]:
    """Values at 0-based ascending positions, e.g. the (not interpolated) median."""
    freq = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    run, totals = running_totals(freq, [F.col(value)], ["n"])
    n = totals["n"]
    wanted = positions_of(n)
    row = run.agg(
        *[F.min(F.when(F.col("cum_n") > p, F.col(value))).alias(f"p{i}") for i, p in enumerate(wanted)]
    ).first()
    return n, list(row)
