"""Arrow streams of rows sorted by group, cut at group boundaries."""

from __future__ import annotations

import numpy as np


def group_batches(batches, keys, budget):
    """Yield dicts of numpy columns holding whole groups, about ``budget`` rows each.

    The rows of a partition arrive sorted by ``keys``; the last, possibly
    unfinished group is held back until its end is seen.
    """
    held, rows, check = [], 0, budget
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append({n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names})
        rows += batch.num_rows
        if rows < check:
            continue
        cols = _joined(held)
        cut = _last_start(cols, keys)
        if cut == 0:  # one group larger than the budget: read on
            held, check = [cols], 2 * rows
            continue
        yield {n: c[:cut] for n, c in cols.items()}
        held, rows, check = [{n: c[cut:] for n, c in cols.items()}], rows - cut, budget
    if held:
        yield _joined(held)


def _joined(parts):
    return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}


def _last_start(cols, keys):
    last = np.ones(len(cols[keys[0]]), dtype=bool)
    for k in keys:
        last &= cols[k] == cols[k][-1]
    return int(len(last) - last.sum())


def starts_of(*sorted_cols):
    """First index of every run of equal key values."""
    n = len(sorted_cols[0])
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in sorted_cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def ranges(starts, counts):
    """Concatenated ``arange(start, start + count)`` for all pairs."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def chunks_by_cost(cost, limit):
    """Split ``range(len(cost))`` into slices whose summed cost stays near ``limit``."""
    total = np.cumsum(cost)
    at = 0
    while at < len(cost):
        base = total[at - 1] if at else 0
        end = max(int(np.searchsorted(total, base + limit, side="right")), at + 1)
        yield at, end
        at = end
