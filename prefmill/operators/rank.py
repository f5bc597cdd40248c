"""Rank of a stored sparse matrix, from orthogonal triangles instead of squared Grams.

Rows are reduced to a triangle per task, triangles are joined eight at a time in
a tree, and the last one's singular values are those of the matrix (tall-skinny
QR), without squaring its condition. Where the smaller side is wider than
``start``, columns are first mixed into ``width`` random ones: the mix has the rank
of the matrix unless that reaches the width, which is then doubled. Only a triangle
of ``width`` reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import freeze, tasks_for
from .stream import chunks_by_cost, group_batches, starts_of

SLICE = 1 << 22   # numbers of a dense slice
FAN = 8           # triangles joined by a task
_TRIANGLE = "part int, width int, data binary"


@dataclass
class Rank:
    """``rank`` counts singular values above the tolerance. Unless ``exact``, it is what ``limit`` columns could show: at least that."""

    rank: int
    values: np.ndarray
    width: int
    exact: bool


def _mixed(ids: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Uniform numbers in [-1, 1) that depend on the column id, the place and the seed alone."""
    x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(width, dtype=np.uint64) * np.uint64(
        0xD1B54A32D192ED03) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -52 - 1


def _joined(triangle, rows):
    both = rows if triangle is None else np.vstack((triangle, rows))
    return np.linalg.qr(both, mode="r") if len(both) > both.shape[1] else both


def _record(part: int, triangle: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "part": pa.array([part], pa.int32()), "width": pa.array([triangle.shape[1]], pa.int32()), "data": [triangle.tobytes()]})


def _triangle(cells: DataFrame, ids: np.ndarray | None, width: int, seed: int) -> np.ndarray:
    """The last triangle of the rows of ``cells(row, col, value)``, over the sorted columns ``ids`` or ``width`` mixed ones."""

    def leaf(batches):
        found = None
        for g in group_batches(batches, ("row",), 1 << 18):
            at = np.append(starts_of(g["row"]), len(g["row"]))
            for a, b in chunks_by_cost(np.diff(at) + width, max(SLICE // max(width, 1), 1)):
                s = slice(at[a], at[b])
                line = np.repeat(np.arange(b - a), np.diff(at[a:b + 1]))
                dense = np.zeros((b - a, width))
                if ids is not None:
                    dense[line, np.searchsorted(ids, g["col"][s])] = g["value"][s]
                else:
                    cols, which = np.unique(g["col"][s], return_inverse=True)
                    step = max(SLICE // max(width, b - a), 1)
                    for w in range(0, len(cols), step):  # a wide slice, some columns at a time
                        on = (which >= w) & (which < w + step)
                        block = np.zeros((b - a, min(step, len(cols) - w)))
                        block[line[on], which[on] - w] = g["value"][s][on]
                        dense += block @ _mixed(cols[w:w + step], width, seed)
                found = _joined(found, dense)
        if found is not None:
            yield _record(TaskContext.get().partitionId(), found)

    def join(table: pa.Table) -> pa.Table:
        found = None
        for width, data in zip(table.column("width").to_pylist(), table.column("data").to_pylist()):
            found = _joined(found, np.frombuffer(data).reshape(-1, width))
        return pa.Table.from_batches([_record(table.column("part")[0].as_py() // FAN, found)])

    n = tasks_for(cells.sparkSession, cells.count() * width, 1 << 24, 1 << 30)
    level = freeze(cells.repartition(n, "row").sortWithinPartitions("row").mapInArrow(leaf, _TRIANGLE))
    while n > 1:
        n = -(-n // FAN)
        level = freeze(level.groupBy(F.floor(F.col("part") / FAN).alias("to")).applyInArrow(join, _TRIANGLE))
    got = level.first()
    return np.zeros((0, width)) if got is None else np.frombuffer(got["data"]).reshape(-1, got["width"])


def stored_rank(cells: DataFrame, start: int = 256, limit: int = 4096, tol: float | None = None, seed: int = 7) -> Rank:
    """Rank of ``cells(row, col, value)``; cells not stored, and null values, are 0, and a cell stored twice is summed.

    ``tol`` is relative to the greatest singular value, by default the longer side times
    the rounding unit. A row is held by one task: one number per column at most. An empty matrix has rank 0.
    """
    a = freeze(cells.groupBy("row", "col").agg(F.sum(F.col("value").cast("double")).alias("value")).where("value <> 0"))
    sides = [a.select(c).distinct() for c in ("row", "col")]
    m, n = (s.count() for s in sides)
    if m < n:  # rows are many, columns few
        a, m, n = a.select(F.col("col").alias("row"), F.col("row").alias("col"), "value"), n, m
        sides.reverse()
    if n == 0:
        return Rank(0, np.zeros(0), 0, True)
    tol = m * np.finfo(float).eps if tol is None else tol
    width = start
    while True:
        whole = width >= n and n <= limit
        ids = np.sort(sides[1].toArrow().column(0).to_numpy()) if whole else None  # at most ``limit`` of them
        width = n if whole else min(width, limit)
        s = np.linalg.svd(_triangle(a, ids, width, seed), compute_uv=False)
        rank = int((s > s[0] * tol).sum())
        if whole or rank < width or width == limit:
            return Rank(rank, s, width, whole or rank < width)
        width *= 2
