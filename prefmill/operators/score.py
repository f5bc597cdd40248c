"""Scoring users through an item matrix: ``X * M``.

Users are hashed into blocks and matrix columns into tiles; each (block, tile)
group holds all it needs, so its scores are final and never shuffled. Only the
wanted cells leave a task: the top-k unseen ones, or the cells asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import tasks_for
from .scale import Span
from .stream import chunks_by_cost, group_batches, ranges

BLOCK_ROWS = 1 << 19   # preference cells per user block
TILE_ROWS = 1 << 19    # matrix cells per column tile
SMALL = 1 << 13        # preference cells worth a task of their own
DENSE = 1 << 21        # cells of a dense scratch block
EXPAND = 1 << 20       # lookups expanded at once
ROUTE = 1 << 26        # copies of matrix cells from which rows go only where they are needed


def _sized(prefs: DataFrame, matrix: DataFrame, targets: DataFrame | None, block_rows: int, tile_rows: int):
    """User blocks and column tiles such that no group holds many more than ``block_rows`` of users' cells
    (preferences and targets) or ``tile_rows`` of the matrix, however large the tables; and the matrix cells
    that all blocks would get together."""
    n_prefs, n_matrix = prefs.count(), matrix.count()
    n_users = n_prefs + (targets.count() if targets is not None else 0)
    blocks = max(-(-n_users // block_rows), tasks_for(prefs.sparkSession, n_prefs, SMALL, block_rows))
    tiles = max(-(-n_matrix // tile_rows), 1)
    return blocks, tiles, blocks * n_matrix


def _grid(prefs: DataFrame, matrix: DataFrame, targets: DataFrame | None, block_rows: int, tile_rows: int) -> tuple[int, int]:
    """Blocks and tiles alone."""
    return _sized(prefs, matrix, targets, block_rows, tile_rows)[:2]


def _hashed(col: str, n: int):
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def _spread(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def routed(prefs: DataFrame, matrix: DataFrame, blocks: int) -> DataFrame:
    """The matrix cells of every user block whose users have a preference for their row, with ``block``."""
    asked = prefs.where("value <> 0").select(_hashed("user_id", blocks).alias("block"), F.col("item_id").alias("row")).distinct()
    return matrix.join(asked, "row")


def _groups(prefs, matrix, targets, values, blocks, tiles, wanted=False, route=False):
    """Union of the three inputs, laid out by (block, tile).

    ``side`` 0: preference (user, item, value), 1: matrix (row, col, values),
    2: wanted or hidden cell (user, item), with a value of its own if it has one.
    With ``wanted``, targets are all that is scored: a preference then goes only
    to tiles its user asks for, a matrix cell only to blocks that ask for its tile. With
    ``route``, a matrix row goes only to blocks that have its item; columns met by none of a block's
    rows are then not there, so it is for results above 0 only.
    """
    nothing = [F.lit(0.0).alias(f"v{i}") for i in range(len(values))]
    if wanted and tiles > 1:
        asked = targets.select("user_id", _hashed("item_id", tiles).alias("tile")).distinct()
        prefs = prefs.join(asked, "user_id")
        by_block = asked.select(_hashed("user_id", blocks).alias("block"), "tile").distinct()
        matrix = matrix.withColumn("tile", _hashed("col", tiles)).join(by_block, "tile")
        p_tile, m_block, m_tile = F.col("tile"), F.col("block"), F.col("tile")
    elif route:
        p_tile, m_block, m_tile = _spread(tiles).alias("tile"), F.col("block"), _hashed("col", tiles).alias("tile")
        matrix = routed(prefs, matrix, blocks)
    else:
        p_tile, m_block, m_tile = _spread(tiles).alias("tile"), _spread(blocks).alias("block"), _hashed("col", tiles).alias("tile")
    p = prefs.select(
        _hashed("user_id", blocks).alias("block"), p_tile, F.lit(0).alias("side"),
        F.col("user_id").alias("a"), F.col("item_id").alias("b"),
        F.col("value").cast("double").alias("v0"), *nothing[1:],
    )
    m = matrix.select(
        m_block, m_tile, F.lit(1).alias("side"),
        F.col("row").alias("a"), F.col("col").alias("b"),
        *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)],
    )
    both = p.unionByName(m)
    if targets is not None:
        own = F.col("value") if "value" in targets.columns else F.lit(0.0)
        both = both.unionByName(targets.select(
            _hashed("user_id", blocks).alias("block"), _hashed("item_id", tiles).alias("tile"),
            F.lit(2).alias("side"), F.col("user_id").alias("a"), F.col("item_id").alias("b"),
            own.alias("v0"), *nothing[1:],
        ))
    n = tasks_for(prefs.sparkSession, 2 * blocks * tiles, 1, 1) if blocks * tiles > 1 else 1
    return both.repartition(n, "block", "tile").sortWithinPartitions(
        "block", "tile", "side", "a", "b")


def _split(cols, width):
    side = cols["side"]
    lo, hi = np.searchsorted(side, (1, 2))
    take = lambda s: (cols["a"][s], cols["b"][s], [cols[f"v{i}"][s] for i in range(width)])
    return take(slice(0, lo)), take(slice(lo, hi)), take(slice(hi, None))


def _each_group(batches, width):
    for cols in group_batches(batches, ("block", "tile"), BLOCK_ROWS):
        key = cols["block"].astype(np.int64) * (1 << 31) + cols["tile"]
        cuts = np.flatnonzero(np.diff(key)) + 1
        for at, end in zip(np.r_[0, cuts], np.r_[cuts, len(key)]):
            yield _split({n: c[at:end] for n, c in cols.items()}, width)


def top_items(prefs: DataFrame, matrix: DataFrame, k: int, value: str = "value", hide_seen: bool = True,
              seen: DataFrame | None = None, positive: bool = True, block_rows: int = BLOCK_ROWS, tile_rows: int = TILE_ROWS,
              route: int = ROUTE) -> DataFrame:
    """Top ``k`` items per user by ``X * M``, by default among items not rated yet.

    ``prefs(user_id, item_id, value)`` lists every observed cell (value 0 where
    not positive); ``seen(user_id, item_id)`` is to be given where it does not.
    Items scoring above 0 are ranked, or all of them without ``positive``; ties
    go to the larger item id. Rows of a matrix are sent by need once all blocks
    together would get more than ``route`` cells; the result is the same.
    """
    blocks, tiles, copies = _sized(prefs, matrix, seen, block_rows, tile_rows)
    laid = _groups(prefs, matrix, seen, [value], blocks, tiles, route=positive and copies > route)
    floor = 0.0 if positive else -np.inf
    by_prefs = hide_seen and seen is None

    def run(batches):
        for (u, i, (x,)), (r, c, (m,)), (su, si, _) in _each_group(batches, 1):
            hidden = (u, i) if by_prefs else (su, si)
            for user, item, score in best_of_group(u, i, x, r, c, m, k, hidden, floor):
                yield pa.RecordBatch.from_pydict({"user_id": user, "item_id": item, "score": score})

    found = laid.mapInArrow(run, "user_id long, item_id long, score double")
    return rank_per_user(found, k)


def positive_extremes(prefs: DataFrame, matrix: DataFrame, value: str = "value", block_rows: int = BLOCK_ROWS,
                      tile_rows: int = TILE_ROWS, route: int = ROUTE) -> Span:
    """Least and greatest positive cell of ``X * M``: a group returns one row per slice, so users x items is not written."""
    blocks, tiles, copies = _sized(prefs, matrix, None, block_rows, tile_rows)
    laid = _groups(prefs, matrix, None, [value], blocks, tiles, route=copies > route)

    def run(batches):
        for (u, i, (x,)), (r, c, (m,)), _ in _each_group(batches, 1):
            for s in _score_slices(u, i, x, r, c, m):
                s = s[s > 0]
                if len(s):
                    yield pa.RecordBatch.from_pydict({"low": [float(s.min())], "high": [float(s.max())]})

    row = laid.mapInArrow(run, "low double, high double").agg(F.min("low"), F.max("high")).first()
    return Span(float(row[0] or 0.0), float(row[1] or 0.0))


def _score_slices(u, i, x, r, c, m):
    """The products of a group, a slice of users and columns at a time."""
    for _, _, scores in placed_slices(u, i, x, r, c, m):
        yield scores


def placed_slices(u, i, x, r, c, m):
    """Slices of a group's products with the users and the columns they belong to."""
    if len(u) == 0 or len(r) == 0:
        return
    users, ux = np.unique(u, return_inverse=True)
    items, rx = np.unique(r, return_inverse=True)
    cols, cx = np.unique(c, return_inverse=True)
    ix, known = _where(items, i)
    ux, ix, x = ux[known], ix[known], x[known]
    by_user, by_col = np.argsort(ux, kind="stable"), np.argsort(cx, kind="stable")
    ux, ix, x, rx, cx, m = ux[by_user], ix[by_user], x[by_user], rx[by_col], cx[by_col], m[by_col]
    width = max(1, min(len(cols), DENSE // len(items)))
    height = max(1, min(len(users), DENSE // max(len(items), width)))
    for w in range(0, len(cols), width):
        e = min(w + width, len(cols))
        s = slice(*np.searchsorted(cx, (w, e)))
        dense = np.zeros((len(items), e - w))
        dense[rx[s], cx[s] - w] = m[s]
        for h in range(0, len(users), height):
            t = min(h + height, len(users))
            s = slice(*np.searchsorted(ux, (h, t)))
            a = np.zeros((t - h, len(items)))
            a[ux[s] - h, ix[s]] = x[s]
            yield users[h:t], cols[w:e], a @ dense


def rank_per_user(scored: DataFrame, k: int) -> DataFrame:
    """Per-user top ``k`` by (score, item) descending, with ``rank`` from 1."""
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), F.desc("item_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _where(ids, wanted):
    """Positions of ``wanted`` in the sorted ``ids``, and which are there."""
    at = np.searchsorted(ids, wanted)
    return at, (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == wanted)


def best_of_group(u, i, x, r, c, m, k, hidden, floor):
    """Candidates of one group: every allowed cell scoring at least the k-th best."""
    if len(u) == 0 or len(r) == 0:
        return
    users, ux = np.unique(u, return_inverse=True)
    items, rx = np.unique(r, return_inverse=True)
    cols, cx = np.unique(c, return_inverse=True)
    ix, ix_ok = _where(items, i)
    hu, hu_ok = _where(users, hidden[0])
    hc, hc_ok = _where(cols, hidden[1])
    hu, hc = hu[hu_ok & hc_ok], hc[hu_ok & hc_ok]
    by_user = np.argsort(hu, kind="stable")
    hu, hc = hu[by_user], hc[by_user]
    order = np.argsort(cx, kind="stable")
    rx, cx, m = rx[order], cx[order], m[order]
    width = max(1, min(len(cols), DENSE // len(items)))
    height = max(1, min(len(users), DENSE // max(len(items), width)))
    for w in range(0, len(cols), width):
        e = min(w + width, len(cols))
        s = slice(*np.searchsorted(cx, (w, e)))
        dense = np.zeros((len(items), e - w))
        dense[rx[s], cx[s] - w] = m[s]
        for h in range(0, len(users), height):
            t = min(h + height, len(users))
            s = slice(*np.searchsorted(ux, (h, t)))
            a = np.zeros((t - h, len(items)))
            ok = ix_ok[s]
            a[ux[s][ok] - h, ix[s][ok]] = x[s][ok]
            score = a @ dense
            s = slice(*np.searchsorted(hu, (h, t)))
            here = (hc[s] >= w) & (hc[s] < e)
            score[hu[s][here] - h, hc[s][here] - w] = -np.inf
            least = floor
            if score.shape[1] > k:
                least = np.partition(score, score.shape[1] - k, axis=1)[:, -k][:, None]
            p, q = np.nonzero((score > floor) & (score >= least))
            if len(p):
                yield users[h + p], cols[w + q], score[p, q]


def top_by_factors(users: DataFrame, items: DataFrame, k: int, seen: DataFrame | None = None,
                   positive: bool = False) -> DataFrame:
    """Top ``k`` items per user by U V^T, the factor vectors spelled out as cells."""
    prefs = users.select("user_id", F.posexplode("features").alias("item_id", "value"))
    matrix = items.select(F.col("id").alias("col"), F.posexplode("features").alias("row", "value"))
    long = F.col("item_id").cast("long")
    return top_items(prefs.withColumn("item_id", long), matrix.withColumn("row", F.col("row").cast("long")), k,
                     hide_seen=seen is not None, seen=seen, positive=positive)


def score_cells(prefs: DataFrame, matrix: DataFrame, targets: DataFrame, values: list[str] = ("value",),
                names: list[str] = ("score",), block_rows: int = BLOCK_ROWS,
                tile_rows: int = TILE_ROWS) -> DataFrame:
    """``X * M`` at the cells ``targets(user_id, item_id)``; 0 where nothing meets.

    ``values`` are one or more value columns of ``matrix`` sharing its cells;
    each gives one column of ``names``.
    """
    values, names = list(values), list(names)
    blocks, tiles, _ = _sized(prefs, matrix, targets, block_rows, tile_rows)
    laid = _groups(prefs, matrix, targets, values, blocks, tiles, wanted=True)
    width = len(values)

    def run(batches):
        for (u, i, xs), (r, c, ms), (tu, ti, _) in _each_group(batches, width):
            if len(tu) == 0:
                continue
            out = {"user_id": tu, "item_id": ti}
            sums = [np.zeros(len(tu)) for _ in names]
            for at, end, n, user_cell, found, vals in lookups(u, i, r, c, ms, tu, ti):
                seg = np.repeat(np.arange(end - at), n)
                for d in range(width):
                    sums[d][at:end] += np.bincount(seg, xs[0][user_cell] * vals[d], minlength=end - at)
            out.update(dict(zip(names, sums)))
            yield pa.RecordBatch.from_pydict(out)

    schema = "user_id long, item_id long, " + ", ".join(f"{n} double" for n in names)
    return laid.mapInArrow(run, schema)


def lookups(u, i, r, c, ms, tu, ti):
    """For slices of wanted cells: the matrix values met by each of the user's cells.

    Yields ``(at, end, n, user_cell, found, values)`` over the wanted cells
    ``at:end``: ``n`` lookups each, laid end to end, the index of the user's
    cell and the matrix values (0 where the matrix holds no cell).
    """
    order = np.argsort(u, kind="stable")
    users, first, count = np.unique(u[order], return_index=True, return_counts=True)
    ux = np.searchsorted(users, tu)
    known = (ux < len(users)) & (users[np.minimum(ux, max(len(users) - 1, 0))] == tu) if len(users) else np.zeros(len(tu), bool)
    ux = np.where(known, ux, 0)
    n_of = np.where(known, count[ux], 0) if len(users) else np.zeros(len(tu), np.int64)
    ids = np.unique(np.concatenate((r, i)))
    cids = np.unique(np.concatenate((c, ti)))
    code = np.searchsorted(cids, c) * len(ids) + np.searchsorted(ids, r)
    by = np.argsort(code)
    code = code[by]
    ms = [m[by] for m in ms]
    ix, tx = np.searchsorted(ids, i), np.searchsorted(cids, ti)
    for at, end in chunks_by_cost(np.maximum(n_of, 1), EXPAND):
        n = n_of[at:end]
        start = first[ux[at:end]] if len(users) else np.zeros(end - at, np.int64)
        cell = order[ranges(start, n)]
        want = np.repeat(tx[at:end], n) * len(ids) + ix[cell]
        spot = np.searchsorted(code, want)
        spot_in = np.minimum(spot, max(len(code) - 1, 0))
        found = (spot < len(code)) & (code[spot_in] == want) if len(code) else np.zeros(len(want), bool)
        vals = [np.where(found, m[spot_in], 0.0) if len(code) else np.zeros(len(want)) for m in ms]
        yield at, end, n, cell, found, vals


def list_similarities(lists: DataFrame, matrix: DataFrame, value: str = "value",
                      block_rows: int = BLOCK_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """For each listed item, its matrix values with all items of the same list.

    ``lists(user_id, item_id, rank)``; adds ``sims``, an array in rank order.
    Lists are short by construction (top-k), so the arrays are too.
    """
    prefs = lists.select("user_id", "item_id", F.col("rank").cast("double").alias("value"))
    wanted = lists.select("user_id", "item_id", F.col("rank").cast("double").alias("value"))
    blocks, tiles, _ = _sized(prefs, matrix, wanted, block_rows, tile_rows)
    laid = _groups(prefs, matrix, wanted, [value], blocks, tiles, wanted=True)

    def run(batches):
        for (u, i, (rank,)), (r, c, ms), (tu, ti, (own,)) in _each_group(batches, 1):
            if len(tu) == 0:
                continue
            by = np.lexsort((rank, u))
            u, i = u[by], i[by]
            for at, end, n, cell, found, vals in lookups(u, i, r, c, ms, tu, ti):
                offsets = np.r_[0, np.cumsum(n)].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tu[at:end]), pa.array(ti[at:end]), pa.array(own[at:end].astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(vals[0]))],
                    names=["user_id", "item_id", "rank", "sims"])

    return laid.mapInArrow(run, "user_id long, item_id long, rank int, sims array<double>")
