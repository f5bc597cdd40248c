"""Dedup of repeated word sequences on a compacted de Bruijn graph.

Nodes are sequences of ``width - 1`` words, an edge is a window of ``width`` words
from one node to the next. A word goes when a window covering it also starts in a
document with a smaller id. Whole copies are settled first; of the rest, windows
whose anchor occurs once cannot repeat. The others meet in the bucket of their
anchor as chains of nodes. There each different edge gets its source, the
smallest (document, place) it occurs at, and edges that follow each other in
their source without a branch between are compacted into paths. Spark joins the
paths at their end nodes: where a node has one path in and one out and the source
coordinates go on, they are glued, so a long repeated span is one unitig however
many anchors it has. Occurrences of a path in later documents join their unitig
and go back to the blocks; a span counts as verified where its place advances in
step with the source.

Anchors in more than ``hot`` blocks go through an aggregate of their windows
instead (see ``blocks.hot_places``).

Words are separated by space, tab, line feed, vertical tab, form feed and
carriage return. Null texts have none; a null doc_id comes after all others; rows
with the same id do not remove each other's words. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import freeze
from . import blocks
from .blocks import LAST, Block, get_arrays, put_arrays
from .kernels import combine, mix, new_run, ranges

GRAM = 7
_KINDS = (np.uint64, np.int64, np.uint64, np.int64, np.int64, np.int32, np.int32)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_PATHS = "path long, head long, tail long, edges int, ord long, pos int, block long, doc int, start int, count int, shift int"


class Words:
    """Hashes of the words of a block, and the first word of each document."""

    def __init__(self, block: Block):
        data = block.data
        n = len(data)
        solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
        border = np.zeros(n + 1, bool)
        border[block.start] = True
        border[n] = True
        begin = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1] | border[1:-1]])[:n])
        end = np.flatnonzero(solid & (np.append(~solid[1:], True) | border[1:])) + 1 if n else begin
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
            inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE, np.uint64)]), dtype=np.uint64)
            run = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)])
            self.hash = mix((run[end] - run[begin]) * inverse[begin] ^ mix((end - begin).astype(np.uint64)))
        self.first = np.searchsorted(begin, block.start)
        self.count = np.diff(np.append(self.first, len(begin)))


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    n = max(len(h) - width + 1, 0)
    out = h[:n].copy()
    for k in range(1, width):
        out = combine(out, h[k:k + n])
    return out


def grams(block: Block, skip: np.ndarray, width: int):
    """Gram hashes over words, anchors of the windows, and the words."""
    words = Words(block)
    n = len(words.hash)
    if n < width:
        return np.zeros(0, np.uint64), (np.zeros(0, np.int64),) * 3, words
    ok = np.zeros(n - width + 1, bool)
    fit = np.maximum(words.count - width + 1, 0)
    fit[skip] = 0
    ok[ranges(words.first, fit)] = True
    h = _rolled(words.hash, GRAM)
    return h, blocks.anchors(h, width - GRAM + 1, ok), words


def _send(staged: blocks.Staged, masks: DataFrame, width: int) -> DataFrame:
    """(bucket, block, payload): the different node chains of repeated anchors with their places."""
    buckets = staged.buckets

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        skip, states = blocks.split_side(right)
        rows = []
        for pack in left.column("pack").to_pylist() if states else []:
            block = blocks.unpack(pack)
            h, (at, lo, hi), words = grams(block, skip, width)
            keep = np.flatnonzero(blocks.anchor_states(h[at], states, buckets) == 1)
            if not len(keep):
                continue
            h, lo, hi = h[at[keep]], lo[keep], hi[keep]
            raw = _rolled(words.hash, width - 1).tobytes()
            seen: dict[bytes, int] = {}
            which = np.fromiter((seen.setdefault(raw[8 * a:8 * b + 16], len(seen)) for a, b in zip(lo.tolist(), hi.tolist())), np.int64, len(lo))
            chains = list(seen)
            doc = np.searchsorted(words.first, lo, side="right") - 1
            order = np.argsort(which, kind="stable")
            first = order[np.flatnonzero(new_run(which[order]))]
            bucket = ((h[first] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            places = np.bincount(which, minlength=len(chains))
            begin = np.cumsum(places) - places
            lengths = np.array([len(c) // 8 for c in chains], np.int64)
            for b in np.unique(bucket):
                c = np.flatnonzero(bucket == b)
                loc = order[ranges(begin[c], places[c])]
                rows.append((int(b), key[0].as_py(), put_arrays(
                    h[first[c]], lengths[c], np.frombuffer(b"".join([chains[i] for i in c.tolist()]), np.uint64), places[c],
                    block.ords[doc[loc]], doc[loc].astype(np.int32), (lo[loc] - words.first[doc[loc]]).astype(np.int32))))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(
            zip(*rows) if rows else ((),) * 3, (pa.int32(), pa.int64(), pa.binary()))], ["bucket", "block", "payload"])

    return staged.by_block(blocks.side_rows(staged, masks)).applyInArrow(run, "bucket int, block long, payload binary")


def _edges(rows: pa.Table):
    """All chains of a bucket: per place its chain, row, id, document and start; nodes and begins of the chains."""
    seen: dict[bytes, int] = {}
    which, row_of, ords, docs, starts = [], [], [], [], []
    for r, payload in enumerate(rows.column("payload").to_pylist()):
        _, sizes, nodes, places, o, d, s = get_arrays(payload, *_KINDS)
        raw, at, mine = nodes.tobytes(), 0, []
        for n in (8 * sizes).tolist():
            mine.append(seen.setdefault(raw[at:at + n], len(seen)))
            at += n
        which.append(np.repeat(np.array(mine, np.int64), places))
        row_of.append(np.full(len(o), r, np.int64))
        ords.append(o), docs.append(d), starts.append(s)
    size = np.array([len(c) // 8 - 1 for c in seen], np.int64)
    nodes = np.frombuffer(b"".join(seen), np.uint64)
    return (*(np.concatenate(x) for x in (which, row_of, ords, docs, starts)), size, nodes)


def _compact(rows: pa.Table) -> pa.Table:
    """Paths of the repeated edges of a bucket, and where later documents run through them."""
    which, row_of, ords, docs, starts, size, nodes = _edges(rows)
    begin = np.cumsum(size) - size  # first edge of each chain
    inside = ranges(np.zeros(len(size), np.int64), size)
    node_at = np.repeat(begin + np.arange(len(size)), size) + inside
    src, dst = nodes[node_at], nodes[node_at + 1]
    _, edge = np.unique(combine(src, dst), return_inverse=True)
    n_edges = int(edge.max()) + 1
    # source of every chain, then of every edge
    order = np.lexsort((starts, ords, which))
    first = order[np.flatnonzero(new_run(which[order]))]
    c_ord, c_pos = np.repeat(ords[first], size), np.repeat(starts[first].astype(np.int64), size) + inside
    order = np.lexsort((c_pos, c_ord, edge))
    pick = order[np.flatnonzero(new_run(edge[order]))]
    e_ord, e_pos, e_src, e_dst = c_ord[pick], c_pos[pick], src[pick], dst[pick]
    last = np.full(len(size), -1, np.int64)
    np.maximum.at(last, which, ords)
    top = np.full(n_edges, -1, np.int64)
    np.maximum.at(top, edge, np.repeat(last, size))
    repeated = top > e_ord
    # branches among the repeated edges of the bucket
    r = np.flatnonzero(repeated)
    if not len(r):
        return pa.Table.from_arrays([pa.array([], k) for k in _ARROW], _NAMES)
    _, at_src, outs = np.unique(e_src[r], return_inverse=True, return_counts=True)
    _, at_dst, ins = np.unique(e_dst[r], return_inverse=True, return_counts=True)
    line = r[np.lexsort((e_pos[r], e_ord[r]))]
    out_of, into = np.zeros(n_edges, np.int64), np.zeros(n_edges, np.int64)
    out_of[r], into[r] = outs[at_src], ins[at_dst]
    goes_on = np.zeros(len(line), bool)
    a, b = line[:-1], line[1:]
    goes_on[1:] = (e_ord[a] == e_ord[b]) & (e_pos[a] + 1 == e_pos[b]) & (e_dst[a] == e_src[b]) & (into[a] == 1) & (out_of[b] == 1)
    number = np.cumsum(~goes_on) - 1
    heads = np.flatnonzero(~goes_on)
    tails = np.append(heads[1:], len(line)) - 1
    name = (int(rows.column("bucket")[0].as_py()) << 32) + np.arange(len(heads))
    path, shift = np.full(n_edges, -1, np.int64), np.zeros(n_edges, np.int64)
    path[line], shift[line] = name[number], np.arange(len(line)) - heads[number]
    # places in later documents, as runs along one path
    least = np.minimum.reduceat(e_ord[edge], begin)
    loc = np.flatnonzero(least[which] < ords)
    n = size[which[loc]]
    along = edge[ranges(begin[which[loc]], n)]
    place = np.repeat(np.arange(len(loc)), n)
    word = np.repeat(starts[loc].astype(np.int64), n) + ranges(np.zeros(len(n), np.int64), n)
    lost = e_ord[along] < ords[loc][place]
    along, place, word = along[lost], place[lost], word[lost]
    begins = new_run(place, path[along], word - shift[along]) if len(along) else np.zeros(0, bool)
    o = np.flatnonzero(begins)
    count = np.diff(np.append(o, len(along)))
    at = loc[place[o]]
    zeros = lambda k: np.zeros(k, np.int64)
    h, m = len(heads), len(o)
    block_of = rows.column("block").to_numpy()
    cols = (
        np.concatenate([name, path[along[o]]]), np.concatenate([e_src[line[heads]].view(np.int64), zeros(m)]),
        np.concatenate([e_dst[line[tails]].view(np.int64), zeros(m)]), np.concatenate([tails - heads + 1, zeros(m)]),
        np.concatenate([e_ord[line[heads]], ords[at]]), np.concatenate([e_pos[line[heads]], zeros(m)]),
        np.concatenate([np.full(h, -1, np.int64), block_of[row_of[at]]]), np.concatenate([zeros(h), docs[at]]),
        np.concatenate([zeros(h), word[o]]), np.concatenate([zeros(h), count]), np.concatenate([zeros(h), shift[along[o]]]))
    return pa.Table.from_arrays([pa.array(c.astype(k.to_pandas_dtype())) for c, k in zip(cols, _ARROW)], _NAMES)


_NAMES = [c.split()[0] for c in _PATHS.split(",")]
_ARROW = [pa.int64() if c.split()[1] == "long" else pa.int32() for c in _PATHS.split(",")]


def unitigs(paths: DataFrame) -> DataFrame:
    """(path, unitig_pos, unitig_edges): paths glued at nodes with one way in and one way out, along their source."""
    out_of = paths.groupBy("head").agg(F.count("*").alias("outs")).where("outs = 1").select("head")
    into = paths.groupBy("tail").agg(F.count("*").alias("ins")).where("ins = 1").select(F.col("tail").alias("head"))
    plain = out_of.join(into, "head")  # nodes that do not branch
    ends = paths.select(F.col("tail").alias("head"), F.col("ord").alias("e_ord"), (F.col("pos") + F.col("edges")).alias("e_pos"))
    glued = paths.select("path", "head", "ord", "pos").join(plain, "head").join(ends, "head").where(
        (F.col("ord") == F.col("e_ord")) & (F.col("pos") == F.col("e_pos"))).select("path", F.lit(True).alias("glued"))
    along = Window.partitionBy("ord").orderBy("pos", "path")  # no more than the windows of one document
    marked = paths.select("path", "ord", "pos", "edges").join(glued, "path", "left")
    run = marked.withColumn("run", F.sum(F.when(F.col("glued"), 0).otherwise(1)).over(along))
    whole = Window.partitionBy("ord", "run")
    return run.select("path", F.col("ord").alias("source"), "pos", F.min("pos").over(whole).alias("unitig_pos"),
                      F.sum("edges").over(whole).cast("int").alias("unitig_edges"))


def repeats(docs: DataFrame, width: int = 13, hot: int = 1024) -> tuple[blocks.Staged, DataFrame]:
    """The staged table, and per block the runs of windows that later documents share with a source."""
    staged = blocks.stage(docs)
    masks = freeze(blocks.repeated_anchors(staged, lambda b, skip: grams(b, skip, width), hot))
    graph = freeze(_send(staged, masks, width).groupBy("bucket").applyInArrow(_compact, _PATHS))
    tigs = freeze(unitigs(graph.where("block = -1")))
    runs = graph.where("block <> -1").select("path", "ord", "block", "doc", "start", "count", "shift").join(tigs, "path").where(
        "source < ord").select("block", "doc", "start", "count", "source", (F.col("pos") + F.col("shift")).alias("at"),
                               "unitig_pos", "unitig_edges")
    if masks.where(blocks.any_hot()).limit(1).count():
        def nodes(block):
            if not hasattr(block, "nodes"):
                block.nodes = _rolled(Words(block).hash, width - 1)
            return block.nodes

        places = blocks.hot_places(staged, masks, lambda b, skip: grams(b, skip, width),
                                   lambda b, w: nodes(b)[w:w + 2].tobytes(), lambda b: Words(b).first)

        def rows(batches):
            for b in batches:
                for block, p, of in zip(*(b.column(c).to_pylist() for c in ("block", "places", "sources"))):
                    d, s, n = get_arrays(p, np.int32, np.int32, np.int32)
                    source, at = get_arrays(of, np.int64, np.int32)
                    none = pa.array(np.full(len(d), -1, np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(d), block, np.int64)), pa.array(d), pa.array(s), pa.array(n), pa.array(source),
                         pa.array(at), none, none],
                        ["block", "doc", "start", "count", "source", "at", "unitig_pos", "unitig_edges"])

        runs = runs.unionByName(places.mapInArrow(rows, runs.schema))
    return staged, freeze(runs)


def dedup(docs: DataFrame, width: int = 13, hot: int = 1024) -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, longest, kept) per row.

    ``n_spans`` counts maximal spans that follow one source document in step, ``longest`` is
    the longest in words; ``kept`` is what is left, joined by one space.
    """
    staged, runs = repeats(docs, width, hot)
    side = runs.unionByName(staged.copies.select("block", F.col("idx").alias("doc"), *[
        F.lit(-1).cast(t).alias(c) for c, t in (("start", "int"), ("count", "int"), ("source", "long"), ("at", "int"),
                                                ("unitig_pos", "int"), ("unitig_edges", "int"))]))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        doc, start, count, source, at = (right.column(c).to_numpy().astype(np.int64) for c in ("doc", "start", "count", "source", "at"))
        whole = np.zeros(0, np.int64) if not len(doc) else doc[start < 0]
        real = start >= 0
        doc, start, count, source, at = (c[real] for c in (doc, start, count, source, at))
        order = np.lexsort((start, doc))
        doc, start, count, source, at = (c[order] for c in (doc, start, count, source, at))
        cols = [[] for _ in range(6)]
        for pack in left.column("pack").to_pylist():
            block = blocks.unpack(pack)
            words = Words(block)
            delta = np.zeros(len(words.hash) + 1, np.int64)
            np.add.at(delta, words.first[doc] + start, 1)
            np.add.at(delta, words.first[doc] + start + count + width - 1, -1)
            gone = np.cumsum(delta[:-1]) > 0
            copies = whole[words.count[whole] >= width]
            gone[ranges(words.first[copies], words.count[copies])] = True
            span = new_run(doc, source, start - at) if len(doc) else np.zeros(0, bool)
            if len(doc):  # a run must also go on where the one before ends
                span[1:] |= start[1:] != start[:-1] + count[:-1]
            heads = np.flatnonzero(span)
            length = np.add.reduceat(count, heads) + width - 1 if len(heads) else heads
            n_spans, longest = np.zeros(len(block.ords), np.int64), np.zeros(len(block.ords), np.int64)
            np.add.at(n_spans, doc[heads], 1)
            np.maximum.at(longest, doc[heads], length)
            n_spans[copies], longest[copies] = 1, words.count[copies]
            data = block.data.tobytes()
            for i, (o, a, n) in enumerate(zip(block.ords.tolist(), block.start.tolist(), block.size.tolist())):
                f, c = int(words.first[i]), int(words.count[i])
                g = gone[f:f + c]
                kept = b" ".join(compress(data[a:a + n].split(), (~g).tolist()) if g.any() else data[a:a + n].split())
                for col, x in zip(cols, (None if o == LAST else o, c, int(g.sum()), int(n_spans[i]), int(longest[i]), kept)):
                    col.append(x)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 5 + [pa.binary()])],
                                    ["doc_id", "n_words", "n_removed", "n_spans", "longest", "kept"])

    return staged.by_block(side).applyInArrow(
        run, "doc_id long, n_words long, n_removed long, n_spans long, longest long, kept binary")
