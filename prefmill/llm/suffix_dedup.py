"""Exact substring dedup over bytes with a sparse, distributed suffix sort.

A byte goes when a string of ``width`` bytes that covers it also starts in a
document with a smaller id. Whole copies are settled first. For the rest every
window of ``width`` bytes picks an anchor; where an anchor occurs twice, the
bytes of all windows that picked it travel, once per block, to the anchor's
bucket. There the suffixes that start those windows are ordered by deep-shallow
sorting: a multikey quicksort to a shallow depth, eight bytes a digit, then blind
tries for the groups that still share their prefix. Runs of equal suffixes are
repeated strings; the smallest id of a run owns it. Only the places of windows
owned by a smaller id go back to the blocks.

An anchor in more than ``hot`` blocks is not gathered in one bucket: the bytes of
its windows travel in two parts, those with most of their other bytes before it and
those with most behind, each to the bucket of all that its windows share (33 bytes
where ``width`` is 50). They travel without their places, so a block sends a part
once however often it has it; the owners come back and the block looks up its places.

Null texts count as empty; a null doc_id comes after all others; rows with the
same id do not remove each other's bytes. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import freeze
from . import blocks
from .blocks import LAST, Block, get_arrays, put_arrays
from .kernels import combine, new_run, ranges, word_at_each_byte

GRAM = 16
SHALLOW = 3  # digits of eight bytes before the tries take over
CHUNK = 200_000  # suffixes sorted at a time
_KINDS = (np.uint32, np.int32, np.uint8, np.int32, np.int64, np.int32, np.int32)
_HOT_KINDS = (np.uint32, np.int32, np.uint8, np.int64)


def grams(block: Block, skip: np.ndarray, width: int):
    """Gram hashes of a block and the anchors of its windows, none across documents or in skipped ones."""
    n = len(block.data)
    if n < width:
        return np.zeros(0, np.uint64), (np.zeros(0, np.int64),) * 3
    at = word_at_each_byte(block.data)
    h = combine(at[:n - GRAM + 1], at[GRAM - 8:])
    ok = np.zeros(n - width + 1, bool)
    fit = np.maximum(block.size - width + 1, 0)
    fit[skip] = 0
    ok[ranges(block.start, fit)] = True
    return h, blocks.anchors(h, width - GRAM + 1, ok)


def _contexts(block: Block, lo, hi, width: int):
    """The bytes of the windows lo..hi of every anchor, and a number per different one."""
    data = block.data.tobytes()
    seen: dict[bytes, int] = {}
    which = np.fromiter((seen.setdefault(data[a:b], len(seen)) for a, b in zip(lo.tolist(), (hi + width).tolist())), np.int64, len(lo))
    return list(seen), which


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(put_arrays(*arrays))


def _unpack(payload: bytes, *kinds) -> list[np.ndarray]:
    import zstandard

    return get_arrays(zstandard.ZstdDecompressor().decompress(payload), *kinds)


def _hot_parts(h: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int):
    """The windows of hot anchors in parts: keys, first and last window.

    The windows of a part share a gram and half of what else they hold, and the key
    is of that. Equal windows have their anchor at the same place, so the same key.
    """
    reach = (width - GRAM + 1) // 2
    cut = np.clip(at - reach + 1, lo, hi + 1)  # from here on windows reach further behind the anchor than before it
    left, right = np.flatnonzero(cut > lo), np.flatnonzero(cut <= hi)
    return (np.concatenate([combine(h[at[left] - reach], h[at[left]]), combine(h[at[right] + reach], h[at[right]])]),
            np.concatenate([lo[left], cut[right]]), np.concatenate([cut[left] - 1, hi[right]]))


def _hot_contexts(block: Block, h, at, lo, hi, width: int, buckets: int):
    """Different contexts of hot anchors with their keys and buckets, and the places (context, document, first window, number)."""
    keys, lo, hi = _hot_parts(h, at, lo, hi, width)
    contexts, which = _contexts(block, lo, hi, width)
    key = np.empty(len(contexts), np.uint64)
    key[which] = keys
    doc = np.searchsorted(block.start, lo, side="right") - 1
    return contexts, key, ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64), (which, doc, lo - block.start[doc], hi - lo + 1)


def _lost_runs(lost: np.ndarray, n: np.ndarray):
    """Runs of true in rows of ``n`` flags, laid end to end: the row, the first flag and the number of flags of each."""
    row = np.repeat(np.arange(len(n)), n)
    inside = ranges(np.zeros(len(n), np.int64), n)
    edges = new_run(row, lost)
    first, ends = np.flatnonzero(edges & lost), np.flatnonzero(edges)
    stop = np.append(ends, len(lost))[np.searchsorted(ends, first, side="right")]
    return row[first], inside[first], stop - first


def deep_shallow(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order rows of big-endian digits; returns the order and, in that order, where a run of equal rows begins.

    Multikey quicksort: all rows by their first digit, then only groups of
    equals by the next, down to SHALLOW digits. What is still together goes into
    blind tries: the next branch of a trie lies at the first digit in which any
    member differs from the group's first, so digits all share are skipped unread.
    """
    n, depth = keys.shape
    order = np.argsort(keys[:, 0], kind="stable")
    begins = new_run(keys[order, 0])
    for d in range(1, min(SHALLOW, depth)):
        _split(keys[:, d], order, begins)
    if depth > SHALLOW:
        group = np.cumsum(begins) - 1
        single = np.append(np.flatnonzero(begins)[1:], n) - np.flatnonzero(begins) == 1
        left = np.flatnonzero(~single[group])
        while len(left):  # one branching node of every trie per round
            head = order[np.flatnonzero(begins)[(np.cumsum(begins) - 1)[left]]]
            differs = keys[order[left], SHALLOW:] != keys[head, SHALLOW:]
            place = np.where(differs.any(1), differs.argmax(1), depth)
            runs = np.flatnonzero(new_run(head))
            branch = np.repeat(np.minimum.reduceat(place, runs), np.diff(np.append(runs, len(left))))
            left, branch = left[branch < depth], branch[branch < depth]
            if not len(left):
                break
            digit = keys[order[left], SHALLOW + branch]
            sub = np.lexsort((digit, (np.cumsum(begins) - 1)[left]))
            order[left] = order[left][sub]
            begins[left[1:]] |= (digit[sub][1:] != digit[sub][:-1]) & (left[1:] == left[:-1] + 1)
            group = np.cumsum(begins) - 1
            starts = np.flatnonzero(begins)
            single = np.append(starts[1:], n) - starts == 1
            left = left[~single[group[left]]]
    return order, begins


def _split(digit: np.ndarray, order: np.ndarray, begins: np.ndarray) -> None:
    """Refine the groups of ``order`` by one more digit, in place; groups of one are left alone."""
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.append(starts, len(order)))
    rows = ranges(starts[sizes > 1], sizes[sizes > 1])
    if not len(rows):
        return
    group = np.repeat(np.arange((sizes > 1).sum()), sizes[sizes > 1])
    value = digit[order[rows]]
    sub = np.lexsort((value, group))
    order[rows] = order[rows][sub]
    begins[rows] |= new_run(group, value[sub])


def _digits(whole: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The windows at some places as rows of big-endian 8-byte digits."""
    keys = np.empty((len(at), -(-width // 8)), np.uint64)
    for d in range(keys.shape[1]):
        short = max(0, 8 * (d + 1) - width)
        keys[:, d] = whole[at + 8 * d] >> np.uint64(8 * short) if short else whole[at + 8 * d]
    return keys


def window_owners(anchor: np.ndarray, contexts: list[bytes], owner: np.ndarray, width: int):
    """Per context the smallest id of each of its windows, one after the other, and their number per context.

    Contexts are different; two can share a window only if they have the same anchor.
    """
    count = np.array([len(c) for c in contexts], np.int64) - width + 1
    begin = np.cumsum(count) - count
    out = np.repeat(owner, count)
    by = np.argsort(anchor, kind="stable")
    starts = np.flatnonzero(new_run(anchor[by]))
    sizes = np.diff(np.append(starts, len(by)))
    shared = by[ranges(starts[sizes > 1], sizes[sizes > 1])]
    if not len(shared):
        return out, count
    last_of_group = np.append(anchor[shared][1:] != anchor[shared][:-1], True)
    filled = np.cumsum(count[shared])
    a = 0
    while a < len(shared):
        b = int(np.searchsorted(filled, (filled[a - 1] if a else 0) + CHUNK))
        b += int(np.argmax(last_of_group[min(b, len(shared) - 1):])) + 1
        part = shared[a:b]
        a = b
        size = count[part] + width - 1
        flat = np.frombuffer(b"".join([contexts[i] for i in part.tolist()]) + b"\0" * 8, np.uint8)
        whole = word_at_each_byte(flat).byteswap()
        at, where = ranges(np.cumsum(size) - size, count[part]), ranges(begin[part], count[part])
        # all windows by their first digit; the rest of the sort takes slices that no digit crosses
        by = np.argsort(whole[at], kind="stable")
        at, where = at[by], where[by]
        heads = np.append(np.flatnonzero(new_run(whole[at])), len(at))
        lo = 0
        while lo < len(at):
            hi = int(heads[np.searchsorted(heads, min(lo + CHUNK, len(at)))])
            order, begins = deep_shallow(_digits(whole, at[lo:hi], width))
            first = np.flatnonzero(begins)
            mine = where[lo:hi][order]
            out[mine] = np.repeat(np.minimum.reduceat(out[mine], first), np.diff(np.append(first, len(order))))
            lo = hi
    return out, count


def _send(staged: blocks.Staged, masks: DataFrame, width: int) -> DataFrame:
    """(bucket, block, payload): the different contexts of repeated anchors with their places.

    The bucket -1 - b holds parts of hot anchors, each with the least id that has it in the block.
    """
    buckets = staged.buckets

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        skip, states = blocks.split_side(right)
        rows = []
        for pack in left.column("pack").to_pylist() if states else []:
            block = blocks.unpack(pack)
            h, (at, lo, hi) = grams(block, skip, width)
            state = blocks.anchor_states(h[at], states, buckets)
            keep = np.flatnonzero(state == 2)
            if len(keep):
                contexts, hot_key, bucket, (which, doc, _, _) = _hot_contexts(block, h, at[keep], lo[keep], hi[keep], width, buckets)
                least = np.full(len(contexts), LAST, np.int64)
                np.minimum.at(least, which, block.ords[doc])
                lengths = np.array([len(c) for c in contexts], np.int32)
                for b in np.unique(bucket):
                    c = np.flatnonzero(bucket == b)
                    rows.append((-1 - int(b), key[0].as_py(), _pack(
                        hot_key[c].astype(np.uint32), lengths[c], np.frombuffer(b"".join([contexts[i] for i in c.tolist()]), np.uint8), least[c])))
            keep = np.flatnonzero(state == 1)
            h, lo, hi = h[at[keep]], lo[keep], hi[keep]
            contexts, which = _contexts(block, lo, hi, width)
            doc = np.searchsorted(block.start, lo, side="right") - 1
            order = np.argsort(which, kind="stable")
            first = order[np.flatnonzero(new_run(which[order]))] if len(order) else order
            bucket = ((h[first] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            places = np.bincount(which, minlength=len(contexts))
            begin = np.cumsum(places) - places
            lengths = np.array([len(c) for c in contexts], np.int32)
            for b in np.unique(bucket):
                c = np.flatnonzero(bucket == b)
                loc = order[ranges(begin[c], places[c])]
                rows.append((int(b), key[0].as_py(), _pack(
                    h[first[c]].astype(np.uint32), lengths[c], np.frombuffer(b"".join([contexts[i] for i in c.tolist()]), np.uint8), places[c].astype(np.int32),
                    block.ords[doc[loc]], doc[loc].astype(np.int32), (lo[loc] - block.start[doc[loc]]).astype(np.int32))))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(
            zip(*rows) if rows else ((),) * 3, (pa.int32(), pa.int64(), pa.binary()))], ["bucket", "block", "payload"])

    return staged.by_block(blocks.side_rows(staged, masks)).applyInArrow(run, "bucket int, block long, payload binary")


def _resolve(sent: DataFrame, width: int) -> DataFrame:
    """(block, bucket, places): windows owned by a smaller id, as (document, first start, number) triples.

    For hot anchors, whose rows name a bucket: the owners of all windows the block sent there, as (owner, number) runs.
    """
    def hot(bucket: int, rows: pa.Table) -> pa.Table:
        seen: dict[bytes, int] = {}
        keys, which, least = [], [], []
        for payload in rows.column("payload").to_pylist():
            key, sizes, data, ords = _unpack(payload, *_HOT_KINDS)
            raw, at = data.tobytes(), 0
            mine = np.empty(len(key), np.int64)
            for i, (n, k) in enumerate(zip(sizes.tolist(), key.tolist())):
                mine[i] = c = seen.setdefault(raw[at:at + n], len(seen))
                if c == len(keys):
                    keys.append(k)
                at += n
            which.append(mine), least.append(ords)
        contexts = list(seen)
        owner = np.full(len(contexts), LAST, np.int64)
        np.minimum.at(owner, np.concatenate(which), np.concatenate(least))
        owners, count = window_owners(np.array(keys, np.uint64), contexts, owner, width)
        begin = np.cumsum(count) - count
        out = []
        for mine in which:
            got = owners[ranges(begin[mine], count[mine])]
            first = np.flatnonzero(new_run(got))
            out.append(put_arrays(got[first], np.diff(np.append(first, len(got)))))
        return pa.Table.from_arrays([rows.column("block"), pa.array([bucket] * len(out), pa.int32()), pa.array(out, pa.binary())],
                                    ["block", "bucket", "places"])

    def run(rows: pa.Table) -> pa.Table:
        if (bucket := rows.column("bucket")[0].as_py()) < 0:
            return hot(-1 - bucket, rows)
        seen: dict[bytes, int] = {}
        which, loc_ctx, anchor, row_of, ords, docs, starts = [], [], [], [], [], [], []
        for r, payload in enumerate(rows.column("payload").to_pylist()):
            h, sizes, data, places, o, d, s = _unpack(payload, *_KINDS)
            raw, at = data.tobytes(), 0
            mine = []
            for n, x in zip(sizes.tolist(), h.tolist()):
                c = seen.setdefault(raw[at:at + n], len(seen))
                if c == len(anchor):
                    anchor.append(x)
                mine.append(c)
                at += n
            which.append(np.repeat(np.array(mine, np.int64), places))
            row_of.append(np.full(len(o), r, np.int64))
            ords.append(o), docs.append(d), starts.append(s)
        loc_ctx, row_of, ords, docs, starts = (np.concatenate(x) for x in (which, row_of, ords, docs, starts))
        contexts = list(seen)
        owner = np.full(len(contexts), LAST, np.int64)
        np.minimum.at(owner, loc_ctx, ords)
        owners, count = window_owners(np.array(anchor, np.uint64), contexts, owner, width)
        begin = np.cumsum(count) - count
        # places whose windows may belong to a smaller id: all but those of a context that owns all it has
        least = np.minimum.reduceat(owners, begin) if len(begin) else owners
        loc = np.flatnonzero(least[loc_ctx] < ords)
        n = count[loc_ctx[loc]]
        place, inside, number = _lost_runs(owners[ranges(begin[loc_ctx[loc]], n)] < np.repeat(ords[loc], n), n)
        l = loc[place]
        block_of = rows.column("block").to_numpy()
        out_block, out = [], []
        by = np.argsort(row_of[l], kind="stable")
        cut = np.flatnonzero(new_run(row_of[l][by])) if len(by) else by
        for a, b in zip(cut, np.append(cut[1:], len(by))):
            i = by[a:b]
            out_block.append(int(block_of[row_of[l[i[0]]]]))
            out.append(put_arrays(docs[l[i]], (starts[l[i]] + inside[i]).astype(np.int32), number[i].astype(np.int32)))
        return pa.Table.from_arrays([pa.array(out_block, pa.int64()), pa.nulls(len(out), pa.int32()), pa.array(out, pa.binary())],
                                    ["block", "bucket", "places"])

    return sent.groupBy("bucket").applyInArrow(run, "block long, bucket int, places binary")


def _hot_places(staged: blocks.Staged, masks: DataFrame, owners: DataFrame, width: int) -> DataFrame:
    """(block, places) of the windows of hot anchors, from the owners that ``_resolve`` gave by block and bucket."""
    buckets = staged.buckets
    side = blocks.side_rows(staged, masks).withColumn("places", F.lit(None).cast("binary")).unionByName(
        owners.select("block", "bucket", F.lit(None).cast("binary").alias("payload"), "places"))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        given = right.filter(right.column("places").is_valid())
        known = dict(zip(given.column("bucket").to_pylist(), given.column("places").to_pylist()))
        out = []
        for pack in left.column("pack").to_pylist() if known else []:
            skip, states = blocks.split_side(right.filter(right.column("places").is_null()))
            block = blocks.unpack(pack)
            h, (at, lo, hi) = grams(block, skip, width)
            keep = np.flatnonzero(blocks.anchor_states(h[at], states, buckets) == 2)
            contexts, _, bucket, (which, doc, start, n) = _hot_contexts(block, h, at[keep], lo[keep], hi[keep], width, buckets)
            count = np.array([len(c) for c in contexts], np.int64) - width + 1
            begin = np.cumsum(count) - count
            owner = np.empty(int(count.sum()), np.int64)
            for b, payload in known.items():
                c = np.flatnonzero(bucket == b)
                owner[ranges(begin[c], count[c])] = np.repeat(*get_arrays(payload, np.int64, np.int64))
            place, inside, number = _lost_runs(owner[ranges(begin[which], n)] < np.repeat(block.ords[doc], n), n)
            out.append(put_arrays(doc[place].astype(np.int32), (start[place] + inside).astype(np.int32), number.astype(np.int32)))
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(out), pa.int64()), pa.array(out, pa.binary())], ["block", "places"])

    return staged.by_block(side).applyInArrow(run, "block long, places binary")


def repeats(docs: DataFrame, width: int = 50, hot: int = 1024) -> tuple[blocks.Staged, DataFrame]:
    """The staged table and (block, places) of all windows that also start in a smaller document."""
    staged = blocks.stage(docs)
    masks = freeze(blocks.repeated_anchors(staged, lambda b, skip: grams(b, skip, width), hot))
    found = freeze(_resolve(_send(staged, masks, width), width))
    places, owners = found.where("bucket IS NULL").select("block", "places"), found.where("bucket IS NOT NULL")
    if owners.limit(1).count():
        places = places.unionByName(freeze(_hot_places(staged, masks, owners, width)))
    return staged, places


def dedup(docs: DataFrame, width: int = 50, hot: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) per row; spans are the maximal removed runs [start, end), kept the bytes left."""
    staged, places = repeats(docs, width, hot)
    side = places.select("block", F.lit(0).alias("idx"), "places").unionByName(
        staged.copies.select("block", "idx", F.lit(None).cast("binary").alias("places")))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = right.column("places").to_pylist()
        idx = right.column("idx").to_pylist()
        copies = np.array([i for i, p in zip(idx, parts) if p is None], np.int64)
        got = [get_arrays(p, np.int32, np.int32, np.int32) for p in parts if p is not None]
        doc, start, n = (np.concatenate(c).astype(np.int64) if got else np.zeros(0, np.int64) for c in (zip(*got) if got else ((),) * 3))
        cols = [[] for _ in range(5)]
        for pack in left.column("pack").to_pylist():
            block = blocks.unpack(pack)
            total = len(block.data)
            at = block.start[doc] + start
            delta = np.zeros(total + 1, np.int64)
            np.add.at(delta, at, 1)
            np.add.at(delta, at + n + width - 1, -1)
            gone = np.cumsum(delta[:-1]) > 0
            whole = copies[block.size[copies] >= width]
            gone[ranges(block.start[whole], block.size[whole])] = True
            for i, (o, a, size) in enumerate(zip(block.ords.tolist(), block.start.tolist(), block.size.tolist())):
                g = gone[a:a + size]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
                row = (None if o == LAST else o, size, int(g.sum()), edge.reshape(-1, 2).tolist(), block.data[a:a + size][~g].tobytes())
                for c, x in zip(cols, row):
                    c.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return staged.by_block(side).applyInArrow(
        run, "doc_id long, n_bytes long, n_removed long, spans array<array<bigint>>, kept binary")
