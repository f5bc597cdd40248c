"""Exact top-k BM25 over an inverted index in shards, with block-max pruning.

Documents are cut into shards as they are read; each shard is one written row with
its postings by term, so the texts are never shuffled. Document frequencies are
summed over the shards and give every query term its global weight. Queries go in
blocks of bounded size past all shards. In a shard a query's rare terms are
added up exactly; for its frequent terms only the largest contribution per block
of documents is added at first. Documents whose bound misses the k-th best
score found so far are never scored in full (block-max WAND over blocks, for many
queries at once); the rest are. One shard in ``PILOTS`` goes first: the k-th best
score there is a bound that all other shards start from, so what they hand on
per query does not grow with their number. Each block's lists are merged by score and
written, and what was sent for the block is given up, before the next block starts.

Terms are runs of non-space bytes after A-Z are lowered and ``PUNCTUATION`` is
taken for spaces. A query is a set of (term, count in the query). Ties go to the
smaller doc_id; the query's own document is left out. Null texts count as empty;
queries without terms, or without any other document that has one of them, give
no rows. Null ids are found but are no queries. Rows sharing an id are one query,
each term with its largest count. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import freeze, scratch_path
from .blocks import LAST, Block, get_arrays, put_arrays
from .debruijn_dedup import Words
from .kernels import new_run, ranges

K1, B = 1.2, 0.75
PUNCTUATION = b".,;:!?\"'()[]"
_TABLE = bytes(32 if c in PUNCTUATION else c + 32 if 65 <= c <= 90 else c for c in range(256))
SHARD_BYTES, SHARD_DOCS = 12 << 20, 1 << 13
WORD_BYTES = 2 << 20
PART = 64  # documents of a block
PILOTS = 8
BATCH = 256  # queries multiplied together
SLACK = 1e-4  # relative, above the error of single precision sums
TINY = np.float32(1e-30)
OFTEN = 16  # a term in more than one of so many documents of a shard is frequent there
QUERY_TERMS = 2_000_000  # terms of a block of queries, which is broadcast: 16 bytes each
_SHARD = (np.int64, np.int32, np.uint64, np.int64, np.uint16, np.uint32)
_RESULT = "query_id long, doc_id long, score double"


def _words(texts):
    """Term hashes of the texts, one after the other, and their number per text; some megabytes at a time."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(texts):
        raw, size = [], 0
        while at < len(texts) and (not raw or size + len(texts[at]) <= WORD_BYTES):
            raw.append(texts[at].encode("utf-8", "surrogatepass").translate(_TABLE))
            size += len(raw[-1])
            at += 1
        sizes = np.array([len(t) for t in raw], np.int64)
        words = Words(Block(np.zeros(len(raw), np.int64), np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes))
        hashes.append(words.hash), counts.append(words.count)
    return np.concatenate(hashes), np.concatenate(counts)


def _counts(texts):
    """(term, document, count) of a set of documents, by term, then document; terms and lengths."""
    hashes, length = _words(texts)
    n = max(len(texts), 1)
    doc = np.repeat(np.arange(len(texts)), length)
    terms, which = np.unique(hashes, return_inverse=True)
    pair, tf = np.unique(which * n + doc, return_counts=True)
    return terms, pair // n, pair % n, tf, length


def index(docs: DataFrame) -> DataFrame:
    """(n_docs, n_words, pilot, shard) rows."""
    def run(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        ords, texts, size = [], [], 0

        def flush():
            terms, term, doc, tf, length = _counts(texts)
            pointer = np.searchsorted(term, np.arange(len(terms) + 1))
            body = packer.compress(put_arrays(
                np.array(ords, np.int64), length.astype(np.int32), terms, pointer, doc.astype(np.uint16), tf.astype(np.uint32)))
            return pa.RecordBatch.from_arrays(
                [pa.array([len(ords)], pa.int64()), pa.array([int(length.sum())], pa.int64()),
                 pa.array([zlib.crc32(body) % PILOTS == 0]), pa.array([body], pa.binary())],
                ["n_docs", "n_words", "pilot", "shard"])

        for b in batches:
            for o, t in zip(b.column("ord").to_pylist(), b.column("text").to_pylist()):
                if texts and (size + len(t) > SHARD_BYTES or len(texts) >= SHARD_DOCS):
                    yield flush()
                    ords, texts, size = [], [], 0
                ords.append(o), texts.append(t)
                size += len(t)
        if texts:
            yield flush()

    return _plain(docs).mapInArrow(run, "n_docs long, n_words long, pilot boolean, shard binary")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"), F.coalesce("text", F.lit("")).alias("text"))


def _open(shard: bytes):
    import zstandard

    return get_arrays(zstandard.ZstdDecompressor().decompress(shard), *_SHARD)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query, term, qtf) of the query texts."""
    def run(batches):
        for b in batches:
            ords, texts = b.column("ord").to_pylist(), b.column("text").to_pylist()
            for a in range(0, len(ords), 500):
                terms, term, doc, tf, _ = _counts(texts[a:a + 500])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(ords[a:a + 500], np.int64)[doc]), pa.array(terms[term].view(np.int64)), pa.array(tf.astype(np.int64))], ["query", "term", "qtf"])

    plain = _plain(queries.where("doc_id IS NOT NULL"))
    return plain.mapInArrow(run, "query long, term long, qtf long").groupBy("query", "term").agg(F.max("qtf").alias("qtf"))


def weighted(terms: DataFrame, shards: DataFrame, n_docs: int, buckets: int) -> DataFrame:
    """(query, term, weight): counts in the query times the inverse document frequency over all shards.

    Frequencies travel packed, a row per shard and bucket of terms.
    """
    def spread(batches):
        for b in batches:
            for shard in b.column("shard").to_pylist():
                _, _, t, pointer, _, _ = _open(shard)
                bucket = (t % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                df = np.diff(pointer)
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                parts = [order[x:y] for x, y in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(buckets), pa.int32()), pa.array([put_arrays(t[p], df[p].astype(np.int32)) for p in parts], pa.binary())],
                    ["bucket", "payload"])

    def weigh(key, left: pa.Table, right: pa.Table) -> pa.Table:
        term = left.column("term").to_numpy().view(np.uint64)
        asked, which = np.unique(term, return_inverse=True)
        df = np.zeros(len(asked), np.int64)
        for payload in right.column("payload").to_pylist():
            t, n = get_arrays(payload, np.uint64, np.int32)
            order = np.argsort(t)
            at = np.searchsorted(t[order], asked)
            at = np.minimum(at, max(len(t) - 1, 0))
            if len(t):
                df += np.where(t[order][at] == asked, n[order][at], 0)
        idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
        return pa.Table.from_arrays([left.column("query"), left.column("term"), pa.array(
            left.column("qtf").to_numpy() * idf[which] if len(which) else np.zeros(0))], ["query", "term", "weight"])

    sent = shards.select("shard").mapInArrow(spread, "bucket int, payload binary")
    asked = terms.withColumn("bucket", _bucket(F.col("term"), buckets))
    return asked.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(weigh, "query long, term long, weight double")


def _bucket(term, buckets: int):
    """The remainder of the term read as unsigned."""
    high = F.shiftrightunsigned(term, 1)
    low = term.bitwiseAND(F.lit(1))
    return ((high % buckets * 2 + low) % buckets).cast("int")


def score_shard(shard: bytes, queries, average: float, k: int):
    """(query, document, score) of the k best documents of a shard for every query.

    ``queries`` is (ids, pointer, terms, weights, least): scores below a query's
    ``least`` are of no use. They go in batches; the blocks
    of documents come by falling bounds, and a block is multiplied only with the
    queries whose bound for it still reaches their k-th best score. That is done
    in single precision, whatever comes near the k-th best again in double.
    """
    ids, pointer, terms, weights, least = queries
    ords, length, own, at, doc, tf = _open(shard)
    n = len(ords)
    out = [[], [], []]
    if n and len(own):
        count = np.diff(at)
        often = np.flatnonzero(count * OFTEN > n)
        impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / average))
        dense = np.zeros((n, len(often)))
        rows = ranges(at[often], count[often])
        dense[doc[rows], np.repeat(np.arange(len(often)), count[often])] = impact[rows]
        column = np.full(len(own), -1)
        column[often] = np.arange(len(often))
        slot = np.minimum(np.searchsorted(own, terms), len(own) - 1)
        known = own[slot] == terms
        view = (n, ords, at, doc, impact, count, column, dense, dense.astype(np.float32))
        for a in range(0, len(ids), BATCH):
            _score_batch(view, ids[a:a + BATCH], pointer[a:a + BATCH + 1], slot, known, weights, least[a:a + BATCH], k, out)
    return [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (np.int64, np.int64, np.float64))]


def _score_batch(view, ids, pointer, slot, known, weights, start, k, out):
    n, ords, at, doc, impact, count, column, dense, coarse = view
    exact, frequent = np.zeros((len(ids), n)), np.zeros((len(ids), dense.shape[1]))
    for q in range(len(ids)):
        mine = np.arange(pointer[q], pointer[q + 1])
        mine = mine[known[mine]]
        s, w = slot[mine], weights[mine]
        rare = column[s] < 0
        size = count[s[rare]]
        post = ranges(at[s[rare]], size)
        if len(post):
            exact[q] = np.bincount(doc[post], impact[post] * np.repeat(w[rare], size), n)
        exact[q, ords == ids[q]] = -np.inf
        frequent[q, column[s[~rare]]] = w[~rare]
    parts = np.arange(0, n, PART)
    narrow = frequent.astype(np.float32)
    bound = narrow @ np.maximum.reduceat(coarse, parts, axis=0).T + np.maximum.reduceat(exact, parts, axis=1)
    found = np.full((len(ids), n), -np.inf, np.float32)
    floor = np.maximum(start.astype(np.float32), TINY)  # a score is above 0
    least = floor
    for i, p in enumerate(np.argsort(-np.where(np.isfinite(bound), bound, 0).sum(0)).tolist()):
        on = np.flatnonzero(bound[:, p] >= least * (1 - SLACK))
        if len(on):
            here = slice(int(parts[p]), min(int(parts[p]) + PART, n))
            found[on, here] = narrow[on] @ coarse[here].T + exact[on, here]
        if n > k and (i in (1, 3, 7) or i % 16 == 15):
            least = np.maximum(-np.partition(-found, k - 1, axis=1)[:, k - 1], floor)
    if n > k:
        least = np.maximum(-np.partition(-found, k - 1, axis=1)[:, k - 1], floor)
    for q in range(len(ids)):
        near = np.flatnonzero(found[q] >= least[q] * (1 - SLACK))
        score = np.round(exact[q, near] + dense[near] @ frequent[q], 9)
        good = (score > 0) & (score >= start[q])
        near, score = near[good], score[good]
        best = np.lexsort((ords[near], -score))[:k]
        out[0].append(np.full(len(best), ids[q])), out[1].append(ords[near[best]]), out[2].append(score[best])


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score) of the k best documents per query, exact."""
    spark = docs.sparkSession
    shards = freeze(index(docs))
    total = shards.agg(F.sum("n_docs").alias("n"), F.sum("n_words").alias("w")).first()
    n_docs, average = total["n"] or 0, max((total["w"] or 0) / max(total["n"] or 1, 1), 1e-9)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    terms = freeze(weighted(query_terms(queries), shards, n_docs, buckets))
    n_blocks = max(1, math.ceil(terms.count() / QUERY_TERMS))
    path = scratch_path(spark, "lists")
    for b in range(n_blocks):
        got = terms.where(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == b).toArrow()  # about QUERY_TERMS rows
        ids = got.column("query").to_numpy()
        t = got.column("term").to_numpy().view(np.uint64)
        order = np.lexsort((t, ids))
        heads = np.flatnonzero(new_run(ids[order]))
        asked = (ids[order][heads], np.append(heads, len(ids)), t[order], got.column("weight").to_numpy()[order])
        with _sent(spark, (*asked, np.zeros(len(heads)))) as block:
            first = freeze(_best(_scored(shards.where("pilot"), block, average, k), k))
        known = first.where(F.col("rank") == k).select("query_id", "score").toArrow()  # a number per query of the block
        least = np.zeros(len(heads))
        least[np.searchsorted(asked[0], known.column("query_id").to_numpy())] = known.column("score").to_numpy()
        with _sent(spark, (*asked, least)) as block:
            rest = first.drop("rank").unionByName(_scored(shards.where("NOT pilot"), block, average, k))
            _best(rest, k).select(
                "query_id", "rank", F.when(F.col("doc_id") < LAST, F.col("doc_id")).alias("doc_id"), "score",
            ).write.parquet(f"{path}/queries={b}")
    return spark.read.schema("query_id long, rank int, doc_id long, score double").parquet(path).drop("queries")


@contextmanager
def _sent(spark, value):
    """A broadcast that ends with the job that needs it."""
    block = spark.sparkContext.broadcast(value)
    yield block
    block.destroy()


def _scored(shards: DataFrame, block, average: float, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                cols = score_shard(shard, block.value, average, k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "doc_id", "score"])

    return shards.select("shard").mapInArrow(run, _RESULT)


def _best(lists: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")  # k rows per shard, cut again before the shuffle
    return lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
