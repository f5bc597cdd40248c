"""Near copies by the Jaccard index of their sets of word shingles, without a miss.

Two texts link when the sets of their five-word shingles have a Jaccard index of
4/5 or more. In an order of all shingles that puts common ones last, linked
sets of n shingles share one of their first n - ceil(4 n / 5) + 1 (prefix
filtering); only these are shuffled. What is common is counted on a sample of
the texts: it sets the order, and any order finds all links. Whoever shares a
shingle is first compared with one centre per shingle, so a large group costs
its size; pairs not yet joined up by that are compared one by one. Every link is
verified on the whole sets, made again from compressed texts, which are smaller.

Equal sets are one node throughout. Words are those of ``simhash``; a text of
five words or fewer is one shingle, null texts count as empty, and texts without
words are equal. Hashes of 64 bits stand for shingles and for sets. A null doc_id
comes after all others. Extra columns pass through ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import freeze
from .simhash import LAST, _LOWER, components

WIDTH = 5
LEAST, OF = 4, 5  # the index is at least LEAST / OF
SAMPLE = 20_000  # texts that tell common shingles
COMMON = 1 << 16  # shingles known as common
MAP = 22  # bits of the map of nodes whose texts are wanted
MASKS = (0, 0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F)  # as many orders of nodes


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Different shingle hashes, ascending."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(joined)], np.uint64)
    ends = np.cumsum(np.array([len(w) for w in words]) + 1)
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    stops = (ends - 1).tolist()
    return np.unique(np.array([xxh64_intdigest(joined[a:b]) for a, b in zip(starts, stops[width - 1:])], np.uint64))


def _node(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(found.tobytes(), 1)).view(np.int64))


def _common(docs: DataFrame) -> np.ndarray:
    """The most common shingles of a sample, the most common first."""
    every = max(1, docs.count() // SAMPLE)

    def run(batches):
        for b in batches:
            found = [shingles(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["key"])

    rows = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).mapInArrow(run, "key long")
    top = rows.groupBy("key").count().where("count > 2").orderBy(F.desc("count")).limit(COMMON).collect()
    return np.array([r["key"] for r in top], np.int64).view(np.uint64)


def _prefixes(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(ord, node, n, keys): number of shingles and the first of them in the common order."""
    place = np.argsort(common)
    known = common[place]

    def run(batches):
        for b in batches:
            node, n, keys = [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(t or "")
                rank = np.zeros(len(s), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    rank = np.where(known[at] == s, len(known) - place[at], 0)
                take = len(s) - -(-LEAST * len(s) // OF) + 1 if len(s) else 0
                node.append(_node(s)), n.append(len(s))
                keys.append(s[np.lexsort((s, rank))[:take]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("ord"), pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                ["ord", "node", "n", "keys"])

    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"), "text")
    return plain.mapInArrow(run, "ord long, node long, n int, keys array<long>")


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, packed text) of ``nodes``; a map of fixed size spares most others the shuffle."""
    low = F.col("node").bitwiseAND((1 << MAP) - 1)
    words = nodes.select(F.shiftright(low, 6).alias("word"), F.expr("shiftleft(1L, cast(node & 63 as int))").alias("bit")).groupBy(
        "word").agg(F.bit_or("bit").alias("bits")).collect()
    wanted = np.zeros(1 << (MAP - 6), np.int64)
    for r in words:
        wanted[r["word"]] = r["bits"]

    def run(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for b in batches:
            node, body = [], []
            for t in b.column("text").to_pylist():
                k = _node(shingles(t or ""))
                if int(wanted[(k & ((1 << MAP) - 1)) >> 6]) >> (k & 63) & 1:
                    node.append(k), body.append(packer.compress((t or "").encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(body, pa.binary())], ["node", "body"])

    return docs.select("text").mapInArrow(run, "node long, body binary").join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    def run(batches):
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        last = None, None
        for b in batches:
            good = []
            for node, x, y in zip(b.column("b").to_pylist(), b.column("x").to_pylist(), b.column("y").to_pylist()):
                if node != last[0]:  # rows come by b
                    last = node, shingles(unpacker.decompress(y).decode("utf-8", "surrogatepass"))
                x, y = shingles(unpacker.decompress(x).decode("utf-8", "surrogatepass")), last[1]
                shared = len(np.intersect1d(x, y, assume_unique=True)) if OF * min(len(x), len(y)) >= LEAST * max(len(x), len(y)) else 0
                good.append((LEAST + OF) * shared >= LEAST * (len(x) + len(y)))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(good), b.column("b").filter(good)], ["a", "b"])

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("body").alias("x")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("body").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _ordered(a: str, b: str):
    return F.greatest(a, b).alias("a"), F.least(a, b).alias("b")


def groups(docs: DataFrame) -> DataFrame:
    """(node, first, first_node): the smallest doc_id of a node's group and the node of that document."""
    nodes = freeze(_prefixes(docs, _common(docs)).groupBy("node").agg(
        F.min("ord").alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    rows = nodes.select("node", "n", F.posexplode("keys").alias("at", "key"))
    mask = F.element_at(F.array(*map(F.lit, MASKS)), (F.col("key").bitwiseAND(3) + 1).cast("int"))
    centres = rows.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(mask)).alias("c"), F.count("*").alias("m")).where(
        "m > 1").select("key", F.col("c").bitwiseXOR(mask).alias("centre"))
    shared = freeze(rows.join(centres, "key").select("key", "node", "n", "at", "centre"))
    texts = freeze(_texts(docs, shared.select("node").distinct()))
    near = freeze(shared.where("node <> centre").select(*_ordered("node", "centre")).distinct())
    edges = freeze(_linked(near, texts))
    roots = components(edges)

    own = shared.join(roots, "node", "left").select("key", "node", "n", "at", F.coalesce("root", "node").alias("root"))
    own = freeze(own)
    apart = own.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    own = freeze(own.join(apart, "key", "left_semi"))
    a, b = (own.select("key", *[F.col(c).alias(c + k) for c in ("node", "n", "at", "root")]) for k in "ab")
    # at the first shingle that both have, no more than what follows it can be shared
    rest = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb"))
    far = a.join(b, "key").where(F.col("roota") < F.col("rootb")).where((LEAST + OF) * rest >= LEAST * (F.col("na") + F.col("nb"))).select(
        *_ordered("nodea", "nodeb")).distinct().join(near, ["a", "b"], "left_anti")
    more = freeze(_linked(freeze(far), texts))
    if more.take(1):
        roots = components(edges.unionByName(more))

    rooted = freeze(nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    best = rooted.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(
        F.min(F.struct("first", "node")).alias("w"))
    return rooted.join(best, "root", "left").select(
        "node", F.coalesce("w.first", "first").alias("first"), F.coalesce("w.node", "node").alias("first_node"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that are the first of their group; rows equal to it in id and shingles stay with it."""
    schema = docs.select("*", F.lit(0).cast("long").alias("_near_own")).schema

    def run(batches):
        for b in batches:
            own = pa.array([_node(shingles(t or "")) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, own], [*b.schema.names, "_near_own"])

    of = groups(docs).select(*[F.col(c).alias(f"_near_{c}") for c in ("node", "first", "first_node")])
    joined = docs.mapInArrow(run, schema).join(of, F.col("_near_own") == F.col("_near_node"))
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    return joined.where((own == F.col("_near_first")) & (F.col("_near_own") == F.col("_near_first_node"))).select(*docs.columns)
