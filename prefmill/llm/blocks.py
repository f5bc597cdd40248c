"""Blocks of packed documents, and which sampled grams of them occur more than once.

The repeat finders pass over the texts several times, each time with some
small findings at hand. Texts are therefore packed once into blocks of a few
megabytes and written as a table bucketed by block: findings are shuffled to the
blocks, the texts stay where they are.

Every window of W units (bytes or words) picks the least of its K-gram hashes as
its anchor, so a window that occurs twice has an anchor that occurs twice. Only
anchors that occur twice are followed up. What is shuffled for that is five bytes
per different anchor of a block; the bucket they are sent to holds further bits
of the hash, so their number grows with the table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import freeze, scratch_path, shuffles_dropped
from .kernels import new_run, ranges, sliding_min

LAST = (1 << 63) - 1
BLOCK_BYTES = 2 << 20
BLOCKS_A_BUCKET = 8
_LOW40 = np.uint64((1 << 40) - 1)
_BYTES5 = np.arange(5, dtype=np.uint64) * np.uint64(8)


def put_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays of known kinds behind a head of their byte lengths."""
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def get_arrays(data: bytes, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(data, np.int64, len(kinds)).tolist()
    out, at = [], 8 * len(kinds)
    for kind, size in zip(kinds, sizes):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


@dataclass
class Block:
    """The documents of a block, end to end."""

    ords: np.ndarray  # doc_id, null as LAST
    data: np.ndarray  # bytes
    start: np.ndarray
    size: np.ndarray


def unpack(pack: bytes) -> Block:
    import zstandard

    ords, size, data = get_arrays(zstandard.ZstdDecompressor().decompress(pack), np.int64, np.int64, np.uint8)
    return Block(ords, data, np.cumsum(size) - size, size)


@dataclass
class Staged:
    """The bucketed table (block, ords, digests, pack) and the later exact copies (block, idx)."""

    table: DataFrame
    copies: DataFrame
    buckets: int
    name: str

    def by_block(self, side: DataFrame):
        """Every block with the rows of ``side`` (its first column is ``block``) that belong to it."""
        return self.table.select("block", "pack").groupBy("block").cogroup(side.groupBy("block"))

    def done(self) -> None:
        """Take the name out of the session's catalog; the files belong to the scratch folder."""
        self.table.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")


def stage(docs: DataFrame) -> Staged:
    """Pack and write the texts of ``docs`` (doc_id, text), and find exact copies of a smaller doc_id.

    Copies need no further search: all of their windows start in a smaller document.
    """
    spark: SparkSession = docs.sparkSession

    def run(batches):
        import hashlib
        import zstandard

        packer, seq, held, size = zstandard.ZstdCompressor(level=3), 0, [], 0
        first = TaskContext.get().partitionId() << 32

        def flush():
            data = np.frombuffer(b"".join(t for _, t in held), np.uint8)
            ords = np.array([o for o, _ in held], np.int64)
            pack = packer.compress(put_arrays(ords, np.array([len(t) for _, t in held], np.int64), data))
            digests = [hashlib.md5(t, usedforsecurity=False).digest() for _, t in held]
            return pa.RecordBatch.from_arrays(
                [pa.array([first + seq], pa.int64()), pa.array([ords.tolist()], pa.list_(pa.int64())),
                 pa.array([digests], pa.list_(pa.binary())), pa.array([pack], pa.binary())], ["block", "ords", "digests", "pack"])

        for b in batches:
            for o, t in zip(b.column("ord").to_pylist(), b.column("text").to_pylist()):
                raw = t.encode("utf-8", "surrogatepass")
                if held and size + len(raw) > BLOCK_BYTES:
                    yield flush()
                    seq, held, size = seq + 1, [], 0
                held.append((o, raw))
                size += len(raw)
        if held:
            yield flush()

    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    packed = plain.mapInArrow(run, "block long, ords array<long>, digests array<binary>, pack binary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"staged_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        packed.repartition(n, "block").write.bucketBy(n, "block").option("path", scratch_path(spark, "blocks")).option(
            "compression", "uncompressed").saveAsTable(name)
    table = spark.table(name)
    each = table.select("block", F.posexplode(F.arrays_zip("ords", "digests")).alias("idx", "d")).select(
        "block", "idx", F.col("d.ords").alias("ord"), F.col("d.digests").alias("digest"))
    firsts = each.groupBy("digest").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("first < last")
    copies = freeze(each.join(firsts, "digest").where("ord > first").select("block", "idx"))
    # a block sends one or two megabytes at most to the buckets of its anchors
    return Staged(table, copies, max(n, 16, -(-table.count() // BLOCKS_A_BUCKET)), name)


def anchors(gram_hash: np.ndarray, span: int, window_ok: np.ndarray):
    """Position of each anchor and the first and last window that picked it.

    Window i covers grams i .. i + span - 1 and counts only where ``window_ok``.
    The leftmost of equal grams is picked, so equal windows pick the same place.
    """
    low = np.uint64((1 << 24) - 1)
    n = len(gram_hash) - span + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    out = []
    step = 1 << 23
    for base in range(0, n, step):
        part = gram_hash[base:base + step + span - 1]
        least = sliding_min((part & ~low) | np.arange(len(part), dtype=np.uint64), span)
        ok = window_ok[base:base + len(least)]
        begins = new_run(least, ok)
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(least)) - 1
        good = ok[first]
        first, last = first[good], last[good]
        out.append(((least[first] & low).astype(np.int64) + base, first + base, last + base))
    return tuple(np.concatenate(c) for c in zip(*out))


def _bucketed(hashes: np.ndarray, buckets: int):
    """Distinct hashes with their bucket, and whether each occurs twice; sorted by (bucket, hash)."""
    distinct, counts = np.unique(hashes, return_counts=True)
    bucket = ((distinct >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return distinct[order], bucket[order], counts[order] > 1


def _five(h: np.ndarray) -> bytes:
    return ((h[:, None] >> _BYTES5) & np.uint64(255)).astype(np.uint8).tobytes()


def _from_five(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).reshape(-1, 5).astype(np.uint64)
    return (b << _BYTES5).sum(1, dtype=np.uint64)


def repeated_anchors(staged: Staged, grams, hot: int) -> DataFrame:
    """(block, bucket, payload): per block and bucket one byte per different anchor: 0 single, 1 repeated, 2 hot.

    ``grams(block, skip)`` gives the gram hashes and the anchors of a block without
    the documents ``skip``. Hot anchors occur in more than ``hot`` blocks.
    """
    buckets = staged.buckets

    def spread(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        skip = np.array(right.column("idx").to_pylist(), np.int64)
        for pack in left.column("pack").to_pylist():
            h, (at, _, _) = grams(unpack(pack), skip)[:2]
            distinct, bucket, often = _bucketed(h[at], buckets)
            first = np.flatnonzero(new_run(bucket)) if len(bucket) else np.zeros(0, np.int64)
            for a, b in zip(first, np.append(first[1:], len(bucket))):
                rows.append((int(bucket[a]), key[0].as_py(), _five(distinct[a:b]), np.packbits(often[a:b]).tobytes()))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(
            zip(*rows) if rows else ((),) * 4, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
            ["bucket", "block", "hashes", "often"])

    def settle(rows: pa.Table) -> pa.Table:
        parts = [_from_five(x) for x in rows.column("hashes").to_pylist()]
        sizes = [len(p) for p in parts]
        _, where, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        blocks = counts[where]
        state = ((blocks > 1) | np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(
            rows.column("often").to_pylist(), sizes)]).astype(bool)).astype(np.uint8)
        state[blocks > hot] = 2
        ends = np.cumsum(sizes)
        out = [state[e - n:e] for e, n in zip(ends, sizes)]
        keep = [i for i, x in enumerate(out) if x.any()]
        rows = rows.take(pa.array(keep, pa.int64()))
        return pa.Table.from_arrays([rows.column("block"), rows.column("bucket"),
                                     pa.array([_squeeze(out[i]) for i in keep], pa.binary())], ["block", "bucket", "payload"])

    sent = staged.by_block(staged.copies).applyInArrow(spread, "bucket int, block long, hashes binary, often binary")
    return sent.groupBy("bucket").applyInArrow(settle, "block long, bucket int, payload binary")


def _squeeze(state: np.ndarray) -> bytes:
    return np.int64(len(state)).tobytes() + np.packbits(state > 0).tobytes() + np.packbits(state > 1).tobytes()


def _states(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    bits = np.frombuffer(data, np.uint8, offset=8).reshape(2, -1)
    return np.unpackbits(bits[0], count=n) + np.unpackbits(bits[1], count=n)


def side_rows(staged: Staged, masks: DataFrame) -> DataFrame:
    """Masks and skipped documents as one table: a document i is the row with bucket -1 - i."""
    copies = staged.copies.select("block", (-1 - F.col("idx")).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("payload"))
    return masks.select("block", "bucket", "payload").unionByName(copies)


def split_side(right: pa.Table):
    """Skipped documents, and the masks by bucket."""
    bucket = np.array(right.column("bucket").to_pylist(), np.int64)
    payload = right.column("payload").to_pylist()
    return -1 - bucket[bucket < 0], {int(b): payload[i] for i, b in enumerate(bucket.tolist()) if b >= 0}


def anchor_states(hashes: np.ndarray, masks: dict, buckets: int) -> np.ndarray:
    """The state of every anchor of a block, from the masks by bucket."""
    distinct, bucket, _ = _bucketed(hashes, buckets)
    state = np.zeros(len(distinct), np.uint8)
    for b, payload in masks.items():
        a, z = np.searchsorted(bucket, [b, b + 1])
        state[a:z] = _states(payload)
    order = np.argsort(distinct, kind="stable")
    return state[order][np.searchsorted(distinct[order], hashes)]


def any_hot():
    """Whether a mask has a hot anchor: its second half is not all zero bits."""
    half = (F.octet_length("payload") - 8) / 2
    return F.length(F.replace(F.hex(F.substring("payload", (9 + half).cast("int"), half.cast("int"))), F.lit("0"), F.lit(""))) > 0


def hot_places(staged: Staged, masks: DataFrame, grams, content, starts) -> DataFrame:
    """(block, places, sources) of the windows of hot anchors that also start in a smaller document.

    ``sources`` holds the id of that document and the first place of the window in it.

    A row per block and different window (``content`` gives its bytes) goes through
    an aggregate to its smallest id and is joined back; Spark combines before the
    shuffle and can split the join. ``starts(block)`` are the first units of its documents.
    """
    buckets = staged.buckets

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        skip, states = split_side(right)
        cols = [[] for _ in range(4)]
        for pack in left.column("pack").to_pylist() if states else []:
            block = unpack(pack)
            h, (at, lo, hi) = grams(block, skip)[:2]
            keep = np.flatnonzero(anchor_states(h[at], states, buckets) == 2)
            found: dict[bytes, list[int]] = {}
            for w in ranges(lo[keep], hi[keep] - lo[keep] + 1).tolist():
                found.setdefault(content(block, w), []).append(w)
            first = starts(block)
            for window, places in found.items():
                p = np.array(places)
                doc = np.searchsorted(first, p, side="right") - 1
                ords, begin = block.ords[doc], (p - first[doc]).astype(np.int32)
                least = np.lexsort((begin, ords))[0]
                for c, x in zip(cols, (window, {"ord": int(ords[least]), "start": int(begin[least])}, key[0].as_py(), put_arrays(
                        ords, doc.astype(np.int32), begin))):
                    c.append(x)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(
            cols, (pa.binary(), pa.struct([("ord", pa.int64()), ("start", pa.int32())]), pa.int64(), pa.binary()))],
            ["window", "first", "block", "at"])

    hot = freeze(staged.by_block(side_rows(staged, masks)).applyInArrow(run, "window binary, first struct<ord: long, start: int>, block long, at binary"))
    owners = hot.groupBy("window").agg(F.min("first").alias("owner"))

    def places(batches):
        for b in batches:
            out, sources = [], []
            for owner, at in zip(b.column("owner").to_pylist(), b.column("at").to_pylist()):
                ords, doc, start = get_arrays(at, np.int64, np.int32, np.int32)
                lost = ords > owner["ord"]
                n = int(lost.sum())
                out.append(put_arrays(doc[lost], start[lost], np.ones(n, np.int32)))
                sources.append(put_arrays(np.full(n, owner["ord"], np.int64), np.full(n, owner["start"], np.int32)))
            yield pa.RecordBatch.from_arrays(
                [b.column("block"), pa.array(out, pa.binary()), pa.array(sources, pa.binary())], ["block", "places", "sources"])

    return hot.join(owners, "window").select("block", "owner", "at").mapInArrow(places, "block long, places binary, sources binary")
