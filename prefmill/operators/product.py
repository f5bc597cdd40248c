"""Sparse matrix products over cell tables.

``cross_product(left, right)`` computes ``L^T R`` for ``left(key, row, value)``
and ``right(key, col, value)``: the sum over a shared key. Spark partitions the
cells by key; inside a task the keys of a batch are multiplied together and
summed, so what is shuffled for the final sum are partial matrix cells, not
pairs. A key with very many cells is split over a grid of tasks by its row and
column ids.

Partial cells travel as compressed Arrow columns, one binary per block of the
result. Blocks are squares of hashed row and column ids, as many as the result
needs for ``PART_CELLS`` each, so a task has few rows and few columns and what
is summed per row or per column behind it is small.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import freeze, tasks_for
from .stream import chunks_by_cost, group_batches, ranges, starts_of

PAIR_BUDGET = 1 << 27     # multiplications one key may cost before it is split
SIDE_BUDGET = 1 << 20     # cells of either side of one key before it is split
SMALL = 1 << 21           # multiplications worth a task of their own
BATCH_CELLS = 1 << 18     # cells multiplied together in a task
BLOCK_CELLS = 1 << 21     # cells of a dense partial block
EXPAND = 1 << 20          # products expanded at once in a sparse batch
PART_CELLS = 1 << 22      # cells of a block of the result
HELD = 1 << 21            # partial cells summed before they leave a task, or are taken in
YIELD = 1 << 17           # cells of an Arrow batch
UP_TO = "sequence(0L, {} - 1L)"


def cross_product(left: DataFrame, right: DataFrame, pair_budget: int = PAIR_BUDGET,
                  tasks: int | None = None) -> DataFrame:
    """``sum_key left(key,row) * right(key,col)`` as cells ``(row, col, value)``.

    Both inputs are read twice, so pass frozen or cheap tables.
    """
    sizes = (
        left.groupBy("key").agg(F.count(F.lit(1)).alias("nl"))
        .join(right.groupBy("key").agg(F.count(F.lit(1)).alias("nr")), "key")
    )
    heavy, work = _heavy(sizes, pair_budget)
    if heavy is None:
        own = across = F.lit(0).cast("long")
    else:
        own = F.explode(F.expr(f"transform({UP_TO.format('q')}, x -> pmod(xxhash64(row), p) * q + x)"))
        across = F.explode(F.expr(f"transform({UP_TO.format('p')}, x -> x * q + pmod(xxhash64(col), q))"))
    l = _with_splits(left, heavy).select(
        "key", own.alias("part"), F.lit(True).alias("is_row"), F.lit(False).alias("is_col"),
        F.col("row").alias("id"), F.col("value").cast("double"),
    )
    r = _with_splits(right, heavy).select(
        "key", across.alias("part"), F.lit(False).alias("is_row"), F.lit(True).alias("is_col"),
        F.col("col").alias("id"), F.col("value").cast("double"),
    )
    side = _side(work, lambda: _different(left, "row") * _different(right, "col"))
    return _multiply(l.unionByName(r), False, tasks or _tasks(left, work), side)


def gram(cells: DataFrame, pair_budget: int = PAIR_BUDGET, tasks: int | None = None, columns: DataFrame | None = None,
         keep: bool = False) -> DataFrame:
    """``M^T M`` of cells ``(row, col, value)``; only one triangle is computed and moved.

    With ``columns(col, <name>)``, one row an id, every cell also has the number of its column; cells of
    other columns are left out.
    With ``keep`` the triangle is written, packed, and the cells are unpacked from there each time they are read.
    """
    cells = cells.withColumnRenamed("row", "key")
    n = cells.groupBy("key").agg(F.count(F.lit(1)).alias("nl"))
    heavy, work = _heavy(n.withColumn("nr", F.col("nl")), pair_budget)
    if heavy is None:
        part, is_row, is_col = F.lit(0).cast("long"), F.lit(True), F.lit(True)
    else:  # each cell goes to the groups of its own grid row and of its own grid column
        mine = "pmod(xxhash64(col), q)"
        part = F.explode(F.expr(
            f"array_distinct(concat(transform({UP_TO.format('q')}, x -> {mine} * q + x), "
            f"transform({UP_TO.format('q')}, x -> x * q + {mine})))"))
        is_row, is_col = F.expr(f"part div q = {mine}"), F.expr(f"part % q = {mine}")
    tagged = _with_splits(cells, heavy).withColumn("part", part).select(
        "key", "part", is_row.alias("is_row"), is_col.alias("is_col"),
        F.col("col").alias("id"), F.col("value").cast("double"))
    side = _side(work, lambda: _different(cells, "col") ** 2)
    return _multiply(tagged, True, tasks or _tasks(cells, work), side, columns, keep)


def _different(cells: DataFrame, col: str) -> float:
    return float(cells.agg(F.approx_count_distinct(col)).first()[0])


def _side(work: float, most) -> int:
    """Blocks on each side of the result, for at most ``work`` and at most ``most()`` cells."""
    if work <= PART_CELLS:
        return 1
    return max(1, math.ceil(math.sqrt(min(work, most()) / PART_CELLS)))


def _heavy(sizes: DataFrame, budget: int) -> tuple[DataFrame | None, float]:
    """Keys whose ``nl * nr`` products are too many for one task, each with a grid of
    ``p`` row parts by ``q`` column parts; and the number of all products.

    Neither side of a part has many more than ``SIDE_BUDGET`` cells; where the
    right side is short, only the left is cut. The keys are written as a table,
    so that its true size decides how it is joined.
    """
    cost = F.col("nl").cast("double") * F.col("nr")
    longest = F.greatest("nl", "nr")
    facts = sizes.agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("work"), F.max(cost).alias("most"), F.max(longest).alias("side")).first()
    if (facts["most"] or 0.0) <= budget and (facts["side"] or 0) <= SIDE_BUDGET:
        return None, facts["work"]
    side = float(SIDE_BUDGET)
    q = F.ceil(F.greatest(F.when(cost > budget, F.col("nr") / float(budget) ** 0.5).otherwise(1.0), F.col("nr") / side, F.lit(1.0))).cast("long")
    p = F.ceil(F.greatest(cost / (F.col("q") * float(budget)), F.col("nl") / side, F.lit(1.0))).cast("long")
    heavy = sizes.where((cost > budget) | (longest > SIDE_BUDGET))
    return freeze(heavy.withColumn("q", q).select("key", p.alias("p"), "q")), facts["work"]


def _with_splits(cells: DataFrame, heavy: DataFrame | None) -> DataFrame:
    if heavy is None:
        return cells
    one = F.lit(1).cast("long")
    return cells.join(heavy, "key", "left").withColumns({"p": F.coalesce("p", one), "q": F.coalesce("q", one)})


def _tasks(cells: DataFrame, work: float) -> int:
    return tasks_for(cells.sparkSession, work, SMALL, PAIR_BUDGET)


def _multiply(tagged: DataFrame, triangle: bool, tasks: int, side: int, columns: DataFrame | None = None,
              keep: bool = False) -> DataFrame:
    laid = tagged.repartition(tasks, "key", "part").sortWithinPartitions("key", "part")

    def run(batches):
        held = []
        for cols in group_batches(batches, ("key", "part"), BATCH_CELLS):
            for cells in block_product(cols, triangle):
                held.append(cells)
                if sum(len(c[0]) for c in held) >= HELD:
                    yield from _blocks_of(_summed(held), side, triangle)
                    held = []
        if held:
            yield from _blocks_of(_summed(held), side, triangle)

    packed = "part int, is_cells boolean, cells binary"
    partial = laid.mapInArrow(run, packed)
    name = None
    if columns is not None:
        name = next(c for c in columns.columns if c != "col")

        def lend(batches):
            for cols in group_batches(batches, ("col",), HELD):
                yield from _lent(cols["col"], cols[name].astype(float), side, triangle)

        numbers = columns.dropna(subset=["col"]).select(F.col("col").cast("long").alias("col"), F.col(name).cast("double").alias(name))
        partial = partial.unionByName(numbers.mapInArrow(lend, packed))
    n = side * (side + 1) // 2 if triangle else side * side
    blocks = partial.repartition(n, "part").sortWithinPartitions("part", "is_cells")
    cell = "row long, col long, value double" + (f", {name} double" if name else "")

    def whole(batches):
        """Summed cells of each block, with the numbers lent to it."""
        for part, held in _each_block(batches):
            yield part, _summed([c for is_cells, c in held if is_cells]), [c for is_cells, c in held if not is_cells]

    def as_cells(batches):
        for _, cells, lent in whole(batches):
            yield from _rows(cells, lent, triangle, name)

    if not keep:
        return blocks.mapInArrow(as_cells, cell)

    def as_packed(batches):
        for part, cells, lent in whole(batches):
            ids, numbers = (np.concatenate(x) for x in zip(*lent)) if lent else (np.zeros(0, np.int64), np.zeros(0))
            for at in range(0, len(cells[0]), HELD):
                some = tuple(c[at:at + HELD] for c in cells)
                met = np.isin(ids, np.concatenate(some[:2]))
                yield _record(part, _pack(np.diff(some[0], prepend=0), *some[1:]), _pack(ids[met], numbers[met]))

    def unpacked(batches):
        for batch in batches:
            for cells, lent in zip(batch.column("cells"), batch.column("lent")):
                delta, col, value = _unpack(cells)
                yield from _rows((np.cumsum(delta), col, value.astype(float)), [_unpack(lent)], triangle, name)

    return freeze(blocks.mapInArrow(as_packed, "part int, cells binary, lent binary")).mapInArrow(unpacked, cell)


def _record(part: int, cells: bytes, lent: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([cells], pa.binary()), pa.array([lent], pa.binary())], ["part", "cells", "lent"])


def _narrow(a: np.ndarray) -> np.ndarray:
    """The same numbers in the shortest type of whole numbers that holds them, if they are whole."""
    if not len(a):
        return a
    if a.dtype.kind == "f" and not (np.abs(a).max() < 2.0**31 and (a == np.rint(a)).all()):
        return a
    low, high = a.min(), a.max()
    kind = next((t for t in (np.int8, np.int16, np.int32) if np.iinfo(t).min <= low and high <= np.iinfo(t).max), np.int64)
    return a.astype(kind)


def _pack(*columns: np.ndarray) -> bytes:
    batch = pa.record_batch([pa.array(_narrow(c)) for c in columns], names=[str(i) for i in range(len(columns))])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(blob) -> list[np.ndarray]:
    table = pa.ipc.open_stream(blob.as_buffer()).read_all()
    return [c.to_numpy() for c in table.columns]


def _summed(parts):
    """Cells of several parts, ordered by row and column, those of one place added up."""
    row, col, value = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    if row.dtype.kind != "i" or col.dtype.kind != "i":
        raise ValueError("ids of a matrix must not be null")
    if not len(row):
        return row, col, value
    if min(row.min(), col.min()) >= 0 and max(row.max(), col.max()) < 1 << 31:
        order = np.argsort((row << 32) | col, kind="stable")
    else:
        order = np.lexsort((col, row))
    row, col, value = row[order], col[order], value[order]
    first = starts_of(row, col)
    return (row, col, value) if len(first) == len(row) else (row[first], col[first], np.add.reduceat(value, first))


def _strip(ids: np.ndarray, side: int) -> np.ndarray:
    return (((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(side)).astype(np.int64)


def _part(a, b, side: int, triangle: bool):
    return np.minimum(a, b) * side + np.maximum(a, b) if triangle else a * side + b


def _sent(parts, is_cells: bool, blobs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(parts, pa.int32()), pa.array([is_cells] * len(blobs), pa.bool_()), pa.array(blobs, pa.binary())], ["part", "is_cells", "cells"])


def _blocks_of(cells, side: int, triangle: bool):
    """Summed cells as one packed record per block."""
    row, col, value = cells
    if not len(row):
        return
    part = _part(_strip(row, side), _strip(col, side), side, triangle)
    order = np.argsort(part, kind="stable")
    edges = np.r_[starts_of(part[order]), len(part)]
    for at, end in zip(edges[:-1], edges[1:]):
        o = order[at:end]
        yield _sent([int(part[o[0]])], True, [_pack(np.diff(row[o], prepend=0), col[o], value[o])])


def _lent(ids, numbers, side: int, triangle: bool):
    """Numbers of columns as packed records for every block that has cells of them."""
    strip = _strip(ids, side)
    for s in np.unique(strip):
        blob = _pack(ids[strip == s], numbers[strip == s])
        parts = sorted({int(_part(x, s, side, triangle)) for x in range(side)})
        yield _sent(parts, False, [blob] * len(parts))


def _each_block(batches):
    """Unpacked records of one block after the other; partial cells are summed as they come."""
    now, held, rows = None, [], 0
    for batch in batches:
        for part, is_cells, blob in zip(batch.column("part").to_pylist(), batch.column("is_cells").to_pylist(), batch.column("cells")):
            if part != now:
                if held:
                    yield now, held
                now, held, rows = part, [], 0
            got = _unpack(blob)
            if not is_cells:
                held.append((False, got))
                continue
            held.append((True, (np.cumsum(got[0], dtype=np.int64), got[1].astype(np.int64), got[2].astype(float))))
            rows += len(got[0])
            if rows >= 2 * HELD:
                summed = _summed([c for cells, c in held if cells])
                held = [h for h in held if not h[0]] + [(True, summed)]
                rows = max(0, len(summed[0]) - PART_CELLS)
    if held:
        yield now, held


def _rows(cells, lent, triangle: bool, name: str | None):
    """Arrow batches of cells, those beside the diagonal both ways if it is a triangle, with the number lent to their column."""
    if name:
        ids, numbers = (np.concatenate(x) for x in zip(*lent)) if lent else (np.zeros(0, np.int64), np.zeros(0))
        order = np.argsort(ids, kind="stable")
        ids, numbers = ids[order].astype(np.int64), numbers[order].astype(float)
    for at in range(0, len(cells[0]), YIELD):
        row, col, value = (c[at:at + YIELD] for c in cells)
        row, col = row.astype(np.int64), col.astype(np.int64)
        if triangle:
            off = row != col
            row, col, value = np.r_[row, col[off]], np.r_[col, row[off]], np.r_[value, value[off]]
        out = {"row": row, "col": col, "value": value}
        if name:
            place = np.minimum(np.searchsorted(ids, col), max(len(ids) - 1, 0))
            known = ids[place] == col if len(ids) else np.zeros(len(col), bool)
            out = {n: c[known] for n, c in out.items()} | {name: pa.array(numbers[place[known]], from_pandas=True)}
        yield pa.RecordBatch.from_pydict(out)


def block_product(cols, triangle):
    """Partial product cells of one batch of whole groups."""
    group = np.zeros(len(cols["key"]), dtype=np.int64)
    group[starts_of(cols["key"], cols["part"])] = 1
    group = np.cumsum(group) - 1
    is_row, is_col = cols["is_row"].astype(bool), cols["is_col"].astype(bool)
    lg, lid, lv = group[is_row], cols["id"][is_row], cols["value"][is_row]
    rg, rid, rv = group[is_col], cols["id"][is_col], cols["value"][is_col]
    if len(lg) == 0 or len(rg) == 0:
        return
    groups = int(group[-1]) + 1
    nl, nr = np.bincount(lg, minlength=groups), np.bincount(rg, minlength=groups)
    rows, lx = np.unique(lid, return_inverse=True)
    cids, rx = np.unique(rid, return_inverse=True)
    pairs = float((nl * nr).sum())
    if groups * float(len(rows)) * len(cids) < 500.0 * pairs:
        yield from _dense(groups, lg, lx, lv, rg, rx, rv, rows, cids, triangle)
    else:
        yield from _sparse(lg, lx, lv, rx, rv, nr, rows, cids, triangle)


def _dense(groups, lg, lx, lv, rg, rx, rv, rows, cids, triangle):
    """Blocks of rows, summed over slices of groups."""
    height = max(1, min(len(rows), BLOCK_CELLS // len(cids)))
    slab = max(1, BLOCK_CELLS // (height + len(cids)))
    for at in range(0, len(rows), height):
        end = min(at + height, len(rows))
        mine = (lx >= at) & (lx < end)
        mg, mx, mv = lg[mine], lx[mine] - at, lv[mine]
        acc = np.zeros((end - at, len(cids)))
        met = np.zeros(acc.shape, bool)
        for g in range(0, groups, slab):
            h = min(g + slab, groups)
            a, b = np.zeros((h - g, end - at)), np.zeros((h - g, len(cids)))
            s = slice(*np.searchsorted(mg, (g, h)))
            np.add.at(a, (mg[s] - g, mx[s]), mv[s])
            s = slice(*np.searchsorted(rg, (g, h)))
            np.add.at(b, (rg[s] - g, rx[s]), rv[s])
            acc += a.T @ b
            ones, others = np.zeros(a.shape, np.float32), np.zeros(b.shape, np.float32)
            s = slice(*np.searchsorted(mg, (g, h)))
            ones[mg[s] - g, mx[s]] = 1
            s = slice(*np.searchsorted(rg, (g, h)))
            others[rg[s] - g, rx[s]] = 1
            met |= (ones.T @ others) > 0
        i, j = np.nonzero(met)
        if triangle:
            keep = rows[at + i] <= cids[j]
            i, j = i[keep], j[keep]
        yield rows[at + i], cids[j], acc[i, j]


def _sparse(lg, lx, lv, rx, rv, nr, rows, cids, triangle):
    """Products of slices of left cells with the right cells of their group."""
    first = np.cumsum(nr) - nr
    fan = nr[lg]
    for at, end in chunks_by_cost(fan, EXPAND):
        g, n = lg[at:end], fan[at:end]
        right = ranges(first[g], n)
        i = np.repeat(lx[at:end], n)
        j = rx[right]
        v = np.repeat(lv[at:end], n) * rv[right]
        if triangle:
            keep = rows[i] <= cids[j]
            i, j, v = i[keep], j[keep], v[keep]
        code, inv = np.unique(i * len(cids) + j, return_inverse=True)
        yield rows[code // len(cids)], cids[code % len(cids)], np.bincount(inv, v, minlength=len(code))
