"""Collocations: phrases of two to four words that occur often and whose parts prefer each other.

Texts become blocks of word numbers in one language each, cut between pieces.
Inside a block the suffixes are pointers, ordered by a multikey three-way
quicksort: all partitions of a round are split at once into less, equal and
greater than their pivots, and only equal ones look at the next word. Sizes of
equal partitions are the counts of the block. Blocks are told what is frequent
before they look deeper:

1. single words, routed by word and language: infrequent ones are abandoned, the
   others are numbered and break suffixes where they are missing;
2. pairs, routed by their two leading words: suffixes whose leading pair is
   infrequent everywhere are abandoned;
3. phrases of three and four words of what is left, routed by the whole phrase.

What is routed is one row per different phrase of a block, so a frequent word or
pair is not a large group anywhere. Every part of a frequent phrase is frequent, so
nothing is lost. Words keep their numbers, no hashes stand for phrases.

Null texts count as empty, a null lang as ``und``; ids and extra columns are
ignored, repeated rows count again. Ties rank by count, then by phrase in byte
order. An empty table gives no rows.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import freeze
from .kernels import ranges

BLOCK_WORDS = 2_000_000
NONE = -1  # no word: the end of a piece, or a word that is not frequent
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 10 + b" ")


def blocks(docs: DataFrame, size: int = BLOCK_WORDS) -> DataFrame:
    """(block, lang, words, counts, stream): different words of a block, and their places in it as packed integers.

    A task holds one open block per language and ``size`` words in all.
    """
    def run(batches):
        import zstandard

        packer, seq = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 32
        open_: dict[str, tuple[dict[bytes, int], array]] = {}
        held = 0

        def flush(lang):
            nonlocal seq, held
            words, stream = open_.pop(lang)
            held -= len(stream)
            at = np.frombuffer(stream, np.int32)
            counts = np.bincount(at[at >= 0], minlength=len(words)).astype(np.int32)
            row = ([seq], [lang], [list(words)], [counts], [packer.compress(at.tobytes())])
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (
                pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()))],
                ["block", "lang", "words", "counts", "stream"])

        for b in batches:
            for lang, raw in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                for piece in raw.translate(_FOLD).split(b"\n"):
                    found = piece.split()
                    if not found:
                        continue
                    if lang not in open_:
                        open_[lang] = ({}, array("i"))
                    words, stream = open_[lang]
                    stream.extend([words.setdefault(w, len(words)) for w in found])
                    stream.append(NONE)
                    held += len(found) + 1
                    if held > size:
                        yield flush(max(open_, key=lambda x: len(open_[x][1])))
        for lang in list(open_):
            yield flush(lang)

    plain = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return plain.mapInArrow(run, "block long, lang string, words array<string>, counts array<int>, stream binary")


def multikey_quicksort(digits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by their digits, and in that order how many digits each shares with the row before it.

    Three-way: a round splits every partition around the median of its first,
    middle and last digit; equals go on with the next digit, down to the last.
    """
    n, depth = len(digits[0]), len(digits)
    order, shared = np.arange(n), np.full(n, depth, np.int8)
    shared[:1] = 0
    start, size, d = np.array([0]), np.array([n]), np.array([0])
    matrix = np.stack(digits)
    while True:
        on = (size > 1) & (d < depth)
        start, size, d = start[on], size[on], d[on]
        if not len(start):
            return order, shared
        rows = ranges(start, size)
        taken = order[rows]
        value = matrix[np.repeat(d, size), taken]
        offset = np.cumsum(size) - size
        pivot = np.median([value[offset], value[offset + size // 2], value[offset + size - 1]], axis=0).astype(value.dtype)
        side = np.sign(value - np.repeat(pivot, size))
        split = np.empty_like(taken)
        counts = [np.add.reduceat(side == c, offset, dtype=np.int64) for c in (-1, 0, 1)]
        before = np.zeros_like(offset)
        for c, count in zip((-1, 0, 1), counts):
            split[ranges(offset + before, count)] = taken[side == c]
            before = before + count
        order[rows] = split
        less, equal, more = counts
        shared[(start + less)[less > 0]] = d[less > 0]
        shared[(start + less + equal)[more > 0]] = d[more > 0]
        start, size, d = (np.concatenate(x) for x in (
            (start, start + less, start + less + equal), (less, equal, more), (d, d + 1, d)))


def _partitions(digits: list[np.ndarray], order: np.ndarray, shared: np.ndarray, depth: int):
    """The first ``depth`` digits and the size of every partition of rows that share them."""
    first = np.flatnonzero(shared < depth)
    return [x[order[first]] for x in digits[:depth]], np.diff(np.append(first, len(order)))


def _stream(packs: pa.Table, at: np.ndarray, number: np.ndarray):
    """The word numbers of a block (NONE where infrequent), and the frequent words by number."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(packs.column("stream")[0].as_py())
    local = np.frombuffer(raw, np.int32)
    known = np.sort(number)
    table = np.full(int(max(local.max(initial=0), at.max(initial=0))) + 2, NONE, np.int32)  # the last place is that of NONE
    table[at] = np.searchsorted(known, number)
    return table[local], known


def pair_counts(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """(block, w1, w2, n): neighbours that are both frequent, counted in every block."""
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows:
            word, ids = _stream(left, right.column("a").to_numpy(), right.column("b").to_numpy())
            at = np.flatnonzero((word[:-1] >= 0) & (word[1:] >= 0))
            digits = [word[at], word[at + 1]]
            (a, b), n = _partitions(digits, *multikey_quicksort(digits), 2) if len(at) else (digits, at)
            cols = [np.full(len(n), key[0].as_py()), ids[a], ids[b], n]
        else:
            cols = [np.zeros(0, np.int64)] * 4
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], ["block", "w1", "w2", "n"])

    return blocks.select("block", "stream").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        run, "block long, w1 long, w2 long, n long")


def longer_counts(blocks: DataFrame, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """(w1, w2, w3, w4, n): phrases of three words (w4 is NONE) and of four, made of frequent pairs, counted in every block."""
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        pair, a, b = (right.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "a", "b"))
        out = [[np.zeros(0, np.int64)] for _ in range(5)]
        if left.num_rows:
            word, ids = _stream(left, a[~pair], b[~pair])
            frequent = np.sort(np.searchsorted(ids, a[pair]) << 32 | np.searchsorted(ids, b[pair]))
            both = (word[:-1] >= 0) & (word[1:] >= 0)
            found = word[:-1].astype(np.int64) << 32 | word[1:]
            place = np.searchsorted(frequent, found)
            good = np.append(both & (np.append(frequent, -1)[place] == found), [False, False])
            at = np.flatnonzero(good[:-1] & good[1:])
            if len(at):
                digits = [word[at], word[at + 1], word[at + 2],
                          np.where(good[at + 2], word[np.minimum(at + 3, len(word) - 1)], NONE)]
                order, shared = multikey_quicksort(digits)
                for depth in (3, 4):
                    words, n = _partitions(digits, order, shared, depth)
                    real = words[-1] >= 0
                    cols = [ids[w[real]] for w in words] + [np.full(int(real.sum()), NONE)] * (4 - depth) + [n[real]]
                    for c, x in zip(out, cols):
                        c.append(x)
        return pa.Table.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], ["w1", "w2", "w3", "w4", "n"])

    side = known.select("block", F.lit(False).alias("pair"), "a", "b").unionByName(
        pairs.select("block", F.lit(True).alias("pair"), F.col("w1").alias("a"), F.col("w2").alias("b")))
    return blocks.select("block", "stream").groupBy("block").cogroup(side.groupBy("block")).applyInArrow(
        run, "w1 long, w2 long, w3 long, w4 long, n long")


def phrases(docs: DataFrame, least: int = 30, size: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases (words, f) of two to four numbered words, frequent words (lang, word, f, id), and words per language (lang, n)."""
    held = freeze(blocks(docs, size))
    one = held.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x"))
    vocabulary = freeze(one.groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f")))
    common = freeze(vocabulary.where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()))
    sizes = freeze(vocabulary.groupBy("lang").agg(F.sum("f").alias("n")))
    spelt = held.select("block", "lang", F.posexplode("words").alias("at", "word"))
    known = freeze(spelt.join(common.select("lang", "word", "id"), ["lang", "word"]).select(
        "block", F.col("at").cast("long").alias("a"), F.col("id").alias("b")))
    everywhere = F.sum("n").over(Window.partitionBy("w1", "w2"))
    pairs = freeze(pair_counts(held, known).withColumn("f", everywhere).where(F.col("f") >= least).select("block", "w1", "w2", "f"))
    longer = longer_counts(held, known, pairs).groupBy("w1", "w2", "w3", "w4").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    two = pairs.groupBy("w1", "w2").agg(F.max("f").alias("f")).select(F.array("w1", "w2").alias("words"), "f")
    more = longer.select(F.filter(F.array("w1", "w2", "w3", "w4"), lambda w: w >= 0).alias("words"), "f")
    return freeze(two.unionByName(more)), common, sizes


def scored(phrases: DataFrame, common: DataFrame) -> DataFrame:
    """(words, a, score, k, l, r): every phrase at its worst cut; of equal scores at the earliest."""
    counts = phrases.unionByName(common.select(F.array("id").alias("words"), "f"))
    m = F.size("words")
    cuts = phrases.select("words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), m - 1)).alias("k")).select(
        "*", F.slice("words", 1, F.col("k")).alias("head"), F.slice("words", F.col("k") + 1, m - F.col("k")).alias("tail"))
    heads = counts.select(F.col("words").alias("head"), F.col("f").alias("l"))
    tails = counts.select(F.col("words").alias("tail"), F.col("f").alias("r"))
    ratio = F.expr("2000000BD * cast(a AS decimal(20, 0)) div cast(l + r AS decimal(20, 0))").alias("score")
    priced = cuts.join(heads, "head").join(tails, "tail").select("words", "a", ratio, "k", "l", "r")
    worst = priced.groupBy("words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    return worst.select("words", "a", "w.*")


def swallowed(phrases: DataFrame) -> DataFrame:
    """(words, longest): the largest count among the longer phrases that a phrase lies inside."""
    m = F.size("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), m - 1), lambda n: F.transform(
        F.sequence(F.lit(1), m - n + 1), lambda i: F.slice("words", i, n))))
    return phrases.where(m > 2).select(F.explode(inner).alias("words"), "f").groupBy("words").agg(F.max("f").alias("longest"))


def mine(docs: DataFrame, least: int = 30, top: int = 2000, size: int = BLOCK_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, cut): the best ``top`` phrases of every language.

    A phrase inside a longer one with four fifths of its count or more is dropped.
    """
    every, common, sizes = phrases(docs, least, size)
    held = scored(every, common).join(swallowed(every), "words", "left").where(
        F.expr("longest IS NULL OR 5BD * cast(longest AS decimal(20, 0)) < 4BD * cast(a AS decimal(20, 0))"))
    each = held.select("words", "a", "l", "r", "score", "k", F.posexplode("words").alias("at", "id"))
    named = each.join(common.select("id", "lang", "word"), "id").groupBy("words", "a", "l", "r", "score", "k").agg(
        F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
    spelt = named.withColumn("phrase", F.array_join("w.word", " "))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = spelt.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", F.col("k").cast("long").alias("cut"))
