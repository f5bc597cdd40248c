"""SimHash near-duplicates found by a covering code.

A fingerprint has a bit set where more than half of the text's shingle hashes
have. Fingerprints link at up to 4 differing bits. The 64 bits are cut into three
blocks, so two linked ones differ by at most one bit in some block. The anchors
of a block are the 4096 words of the binary Golay code, which covers all 23-bit
strings within 3: a fingerprint is at home at the one anchor within 3 of its
block and visits all within 3 + 1. Linked fingerprints then meet, one of them at
home, and are compared on all 64 bits. Equal fingerprints are one node
throughout; of a cluster an anchor only passes on a spanning star. Groups are
joined up by alternating star contraction over written tables.

Null texts count as empty, texts without words have fingerprint 0. A null doc_id
comes after all others when the smallest is sought. Repeated rows give repeated
result rows. Extra columns pass through ``fingerprints`` and ``keep_one``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import freeze
from .rows import packed, unpacked

LAST = (1 << 63) - 1
BLOCKS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
GOLAY = 0b101011100011  # generator polynomial, fixed value
HOMES = 2048  # fingerprints at home that one task compares with the visitors
_SHIFT = np.arange(8, dtype=np.uint64)


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash over word shingles."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.array([len(w) for w in words]) + 1)
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    stops = (ends - 1).tolist()
    if len(words) <= width:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops[width - 1:])]
    pieces = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(pieces[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprints(docs: DataFrame, name: str = "fp") -> DataFrame:
    """All columns plus the fingerprint as a signed 64-bit integer. No shuffle."""
    docs = docs.drop(name)
    schema = docs.select("*", F.lit(0).cast("long").alias(name)).schema

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t or "") for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def _code_tables():
    """Syndromes of 23-bit strings in two halves, and per syndrome the error patterns of up to 4 bits."""
    def remainder(x):
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GOLAY << (bit - 11)
        return x

    high, low = np.array([remainder(i << 12) for i in range(1 << 11)]), np.array([remainder(i) for i in range(1 << 12)])
    patterns: dict[int, list[int]] = {}
    for weight in range(5):  # lighter first: the first of a list is the way home
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            patterns.setdefault(remainder(e), []).append(e)
    table = np.full((2048, max(map(len, patterns.values()))), -1, np.int64)
    for s, found in patterns.items():
        table[s, :len(found)] = found
    return high, low, table


def anchored(fps: DataFrame) -> DataFrame:
    """(anchor, fp, home) rows: one at home and a few visits per block."""
    def run(batches):
        high, low, table = _code_tables()
        for batch in batches:
            signed = batch.column("fp").to_numpy()
            whole = signed.view(np.uint64)
            for k, (first, size) in enumerate(BLOCKS):
                x = ((whole >> np.uint64(first)) & np.uint64((1 << size) - 1)).astype(np.int64)
                errors = table[high[x >> 12] ^ low[x & 4095]]
                row, place = np.nonzero(errors >= 0)
                anchor = (k << 23) | (x[row] ^ errors[row, place])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.astype(np.int32)), pa.array(signed[row]), pa.array(place == 0)], ["anchor", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "anchor int, fp long, home boolean")


def _stars(homes: np.ndarray, visitors: np.ndarray, limit: int):
    """Edges (from, to) that connect whatever of the two is linked, at most one per fingerprint."""
    match = np.bitwise_count(homes[:, None] ^ visitors[None, :]) <= limit
    h, v = np.flatnonzero(match.any(1)), np.flatnonzero(match.any(0))
    match = match[np.ix_(h, v)]
    label = np.arange(len(h))
    while len(h):
        least = np.where(match, label[:, None], len(h)).min(0)
        new = np.minimum(label, np.where(match, least[None, :], len(h)).min(1))
        if (new == label).all():
            root = homes[h]
            return np.concatenate([root, visitors[v]]), np.concatenate([root[label], root[least]])
        label = new
    return homes[:0], homes[:0]


def links(fps: DataFrame, limit: int = 4) -> DataFrame:
    """Edges between distinct fingerprints that connect all groups linked at ``limit`` bits or fewer.

    The homes of an anchor are cut into groups of about ``HOMES`` that each see
    all its visitors; the table of counts has at most 3 x 4096 rows.
    """
    rows = freeze(anchored(fps))
    splits = rows.where("home").groupBy("anchor").agg(F.ceil(F.count("*") / HOMES).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(splits), "anchor")
    salt = F.when(F.col("home"), F.array(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))).otherwise(F.array().cast("array<int>"))
    both = rows.select("anchor", "fp", F.explode(F.concat(
        F.transform(salt, lambda s: F.struct(s.alias("part"), F.lit(True).alias("home"))),
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda s: F.struct(s.alias("part"), F.lit(False).alias("home"))),
    )).alias("x")).select("anchor", "x.part", "x.home", "fp")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = both.repartition(n, "anchor", "part").sortWithinPartitions("anchor", "part", F.desc("home"))

    def run(batches):
        group, homes = None, np.zeros(0, np.uint64)
        for b in batches:
            anchor, part = (b.column(c).to_numpy() for c in ("anchor", "part"))
            home = b.column("home").to_numpy(zero_copy_only=False)
            fp = b.column("fp").to_numpy().view(np.uint64)
            if not len(fp):
                continue
            cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
            source, target = [], []
            for a, z in zip(np.append(0, cut), np.append(cut, len(fp))):
                if (anchor[a], part[a]) != group:
                    group, homes = (anchor[a], part[a]), np.zeros(0, np.uint64)
                homes = np.append(homes, fp[a:z][home[a:z]])
                visitors = fp[a:z][~home[a:z]]
                for at in range(0, len(visitors), 512):
                    s, t = _stars(homes, visitors[at:at + 512], limit)
                    real = s != t
                    source.append(s[real])
                    target.append(t[real])
            s, t = np.concatenate(source).view(np.int64), np.concatenate(target).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(t)], ["a", "b"])

    found = placed.select("anchor", "part", "home", "fp").mapInArrow(run, "a long, b long")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each group, by alternating large and small stars.

    Each round is written to the shared folder. Minima are combined before the
    shuffle; a hub's join rows are split by adaptive execution.
    """
    def pointed(both):
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        return both.join(least, "a")

    edges = freeze(edges)
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = pointed(both).where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = freeze(large)
        p = pointed(large)
        small = p.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(p.select("a", F.col("m").alias("b")))
        edges = freeze(small.where("a <> b").distinct())
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first())
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


def groups(prints: DataFrame, limit: int = 4) -> DataFrame:
    """Per distinct fingerprint the smallest doc_id of its group and that document's fingerprint.

    ``prints`` has ``doc_id`` and ``fp``.
    """
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    nodes = freeze(prints.groupBy("fp").agg(F.min(order).alias("first")))
    roots = components(links(nodes, limit))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = freeze(rooted)
    best = rooted.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(
        F.min(F.struct("first", "fp")).alias("w"))
    return rooted.join(best, "root", "left").select(
        "fp", F.coalesce("w.first", "first").alias("first"), F.coalesce("w.fp", "fp").alias("first_fp"))


def near_duplicates(docs: DataFrame, limit: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    prints = freeze(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "fp"))
    of = groups(prints, limit).withColumnRenamed("fp", "_fp")
    joined = prints.join(of, F.col("fp") == F.col("_fp"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         F.when(F.col("first") < LAST, F.col("first")).alias("component_id"))


def keep_one(docs: DataFrame, limit: int = 4) -> DataFrame:
    """The documents that are the first of their group; rows equal to it in id and fingerprint stay with it."""
    with_fp = fingerprints(packed(docs, F.col("doc_id"), apart=("text",)), "_near_own")
    prints = freeze(fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"))
    of = groups(prints, limit).select(*[F.col(c).alias(f"_near_{c}") for c in ("fp", "first", "first_fp")])
    joined = with_fp.join(of, F.col("_near_own") == F.col("_near_fp"))
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    return joined.where((own == F.col("_near_first")) & (F.col("_near_own") == F.col("_near_first_fp"))).select(
        *unpacked(docs.columns, {"text": F.col("text")}))
