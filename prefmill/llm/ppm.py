"""Language-model scores by prediction by partial matching over bytes.

The model is the trie of all byte contexts of up to ``order`` bytes in the
training texts, with the count of every byte (or end of text) after each. A
symbol is coded at the longest context that knows it; each longer one costs an
escape (method C: a symbol has weight count, the escape the number of different
symbols), and symbols of a longer context are excluded from the shorter ones.
What is then unseen everywhere is uniform over the symbols left. Probabilities of
all symbols after a context sum to one, so the score is a log10 probability of the
text and its end.

The cost of a position depends on its ``order + 1`` last symbols only. Texts are
therefore staged in blocks with their different strings of that length. Strings
are counted over all blocks, brought together by their two nearest context bytes,
where all contexts of two bytes and more are at hand (shorter ones are a table of
258 x 257 counts), priced once, and the prices go back to the blocks that asked.
Rows are per block and different string, so frequent strings are no large groups.
Word counts for the base score travel the same way.

Null texts count as empty; a null doc_id is held out and stays null. Repeated
rows are learnt and scored as often as they stand. Extra columns are ignored; an
empty table gives no rows. Without any training text all symbols are uniform.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..session import freeze
from .blocks import get_arrays
from .kernels import ranges

LAST = (1 << 63) - 1
SYMBOLS = 257  # bytes and the end of a text
END, START = 256, 257  # START stands for every context place before a text
BITS = 9  # of a symbol within a string
ORDER = 4
BLOCK_BYTES = 32 << 20
STEP = 1 << 20  # symbols scored in one go
PART = 1 << 19  # symbols sorted or looked up in one go
ROWS = 256  # texts taken from Arrow in one go
STRINGS = 400_000  # different strings priced in one go, unless they share their two nearest bytes
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def symbols(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts as symbols, each behind ``order`` STARTs and before an END, and the text each symbol belongs to."""
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size + order + 1) - size - 1
    out = np.full(int((size + order + 1).sum()), START, np.int16)
    out[ranges(begin, size)] = np.frombuffer(b"".join(texts), np.uint8)
    out[begin + size] = END
    return out, np.repeat(np.arange(len(texts), dtype=np.int32), size + order + 1)


def strings(texts: list[bytes], order: int, step: int = STEP):
    """Pairs of arrays: strings that end at the symbols of the texts, nearest context first and symbol last; number of the text."""
    flat, owner = symbols(texts, order)
    for a in range(0, len(flat), step):
        z = min(a + step, len(flat))
        real = a + np.flatnonzero(flat[a:z] != START)
        key = flat[real].astype(np.int64)
        for j in range(1, order + 1):
            key |= flat[real - j].astype(np.int64) << (BITS * (order + 1 - j))
        yield key, owner[real]


def _batches(texts: list[bytes]):
    """Ranges of texts of about STEP bytes."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= STEP:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


def _merged(key: np.ndarray, n: np.ndarray, more: np.ndarray, more_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of different strings as one, their counts added; ``n`` is changed in place."""
    at = np.searchsorted(key, more)
    old = np.zeros(len(more), bool)
    inside = at < len(key)
    old[inside] = key[at[inside]] == more[inside]
    n[at[old]] += more_n[old]
    at, more, more_n = at[~old], more[~old], more_n[~old]
    return (np.insert(key, at, more), np.insert(n, at, more_n)) if len(more) else (key, n)


def _packed(packer, ords: np.ndarray, learn: np.ndarray, texts: list[bytes]) -> bytes:
    """``put_arrays`` of ids, marks, sizes and the texts end to end, compressed piece by piece."""
    size = np.array([len(t) for t in texts], np.int64)
    arrays = [x.tobytes() for x in (ords, learn, size)]
    head = np.array([*map(len, arrays), size.sum()], np.int64).tobytes()
    pieces = [head, *arrays, *texts]
    stream = packer.compressobj(size=sum(map(len, pieces)))
    return b"".join([stream.compress(p) for p in pieces] + [stream.flush()])


def _one_list(values: pa.Array) -> pa.ListArray:
    """A column of one row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def staged(docs: DataFrame, train: Column, order: int, size: int) -> DataFrame:
    """(block, ends, keys, key_counts, words, word_counts, pack): texts of about ``size`` bytes and what they ask for.

    The counts and ``ends`` (texts) are of the training texts of the block.
    """
    def run(batches):
        import zstandard

        packer, seq = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
        held: list[tuple[int, bool, bytes]] = []
        filled = 0

        def flush():
            texts = [t for *_, t in held]
            learn = np.array([x for _, x, _ in held], bool)
            key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for a, z in _batches(texts):
                for found, owner in strings(texts[a:z], order, PART):
                    key, n = _merged(key, n, *_summed(found, learn[a:z][owner].astype(np.int64)))
            number: dict[bytes, int] = {}
            counts = np.zeros(0, np.int64)
            for x, t in zip(learn, texts):
                at = np.array([number.setdefault(w, len(number)) for w in t.translate(_LOWER).split()], np.int64)
                if len(number) > len(counts):
                    counts = np.append(counts, np.zeros(len(number), np.int64))
                if x:
                    np.add.at(counts, at, 1)
            pack = _packed(packer, np.array([o for o, *_ in held], np.int64), learn, texts)
            return pa.RecordBatch.from_arrays(
                [pa.array([seq], pa.int64()), pa.array([int(learn.sum())], pa.int64()), _one_list(pa.array(key)), _one_list(pa.array(n)),
                 _one_list(pa.array(list(number), pa.string())), _one_list(pa.array(counts[:len(number)])), pa.array([pack], pa.binary())],
                ["block", "ends", "keys", "key_counts", "words", "word_counts", "pack"])

        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                for o, x, t in zip(*(part.column(c).to_pylist() for c in ("ord", "train", "text"))):
                    if held and filled + len(t) > size:
                        yield flush()
                        seq, held, filled = seq + 1, [], 0
                    held.append((o, x, t))
                    filled += len(t)
        if held:
            yield flush()

    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"), F.coalesce(train, F.lit(False)).alias("train"),
                        F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return plain.mapInArrow(run, "block long, ends long, keys array<long>, key_counts array<long>, words array<string>, "
                                 "word_counts array<long>, pack binary")


def prices(key: np.ndarray, n: np.ndarray, low: np.ndarray, order: int) -> np.ndarray:
    """log10 probability of the last symbol of every string after the others.

    ``key`` holds all strings, with their training counts ``n``, of the pairs of
    nearest bytes that occur in it; ``low`` counts symbols (257) by the nearest byte (258).
    """
    symbol, near = key & (1 << BITS) - 1, key >> BITS * order
    plain = low.sum(0)
    some = low > 0
    count, total, kinds = plain[symbol], np.full(len(key), plain.sum()), np.full(len(key), (plain > 0).sum())
    levels = [(count, total, kinds, None)]
    levels.append((low[near, symbol], low.sum(1)[near], some.sum(1)[near], (some * plain).sum(1)[near]))
    for j in range(2, order + 1):
        gram, first, which = np.unique(key >> BITS * (order + 1 - j) << BITS | symbol, return_index=True, return_inverse=True)
        c = np.bincount(which, n, len(gram))
        _, context = np.unique(gram >> BITS, return_inverse=True)
        mine = context[which]
        shorter = np.where(c > 0, levels[-1][0][first], 0)  # the same symbols one byte shorter
        levels.append((c[which], np.bincount(context, c)[mine], np.bincount(context, c > 0)[mine], np.bincount(context, shorter)[mine]))
    out, left = np.zeros(len(key)), np.ones(len(key), bool)
    excluded, excluded_kinds = np.zeros(len(key)), np.zeros(len(key))
    for count, total, kinds, shorter in reversed(levels):
        fresh = kinds - excluded_kinds
        whole = total - excluded + np.where(kinds == SYMBOLS, 0, fresh)
        hit = left & (count > 0)
        out[hit] += np.log10(count[hit] / whole[hit])
        left &= ~hit
        escape = left & (fresh > 0)
        out[escape] += np.log10(fresh[escape] / whole[escape])
        excluded, excluded_kinds = shorter, kinds
    out[left] -= np.log10(SYMBOLS - kinds[left])
    return out


def price_list(blocks: DataFrame, order: int) -> DataFrame:
    """(key, cost): every string that occurs in a block, priced by the training counts of all blocks."""
    each = blocks.select(F.explode(F.arrays_zip("keys", "key_counts")).alias("x"))
    grams = freeze(each.groupBy(F.col("x.keys").alias("key")).agg(F.sum("x.key_counts").alias("n")))
    low = np.zeros((START + 1, SYMBOLS), np.int64)
    near = grams.where("n > 0").groupBy(F.shiftright("key", BITS * order).cast("int").alias("near"),
                                        F.expr(f"cast(key & {(1 << BITS) - 1} AS int)").alias("symbol")).agg(F.sum("n").alias("n"))
    for r in near.collect():  # at most 258 x 257 rows
        low[r.near, r.symbol] = r.n
    parts = max(16, -(-grams.count() // STRINGS))
    bucket = F.pmod(F.xxhash64(F.shiftright("key", BITS * (order - 1))), F.lit(parts))

    def run(rows: pa.Table) -> pa.Table:
        key, n = rows.column("key").to_numpy(), rows.column("n").to_numpy()
        return pa.table({"key": key, "cost": prices(key, n, low, order)})

    return grams.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(run, "key long, cost double")


def score(docs: DataFrame, train: Column, order: int = ORDER, size: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes) of every row of ``docs``.

    ``train`` says which rows are learnt from (null: not). ``score`` is the log10
    probability of the text in the context model of these rows, ``base_score`` in their smoothed word counts.
    """
    blocks = freeze(staged(docs, train, order, size))
    costs = price_list(blocks, order)
    asked = blocks.select("block", F.explode("keys").alias("key")).join(costs, "key").select(
        F.col("block").alias("asker"), F.lit(False).alias("word"), "key", F.col("cost").alias("value"))
    counted = blocks.select(F.explode(F.arrays_zip("words", "word_counts")).alias("x")).groupBy(
        F.col("x.words").alias("w")).agg(F.sum("x.word_counts").alias("c")).where("c > 0")
    counted = freeze(counted)
    total, kinds = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = blocks.agg(F.coalesce(F.sum("ends"), F.lit(0))).first()[0]
    tokens, distinct = total + ends, kinds + (ends > 0)
    told = blocks.select("block", F.posexplode("words").alias("key", "w")).join(counted, "w").select(
        F.col("block").alias("asker"), F.lit(True).alias("word"), F.col("key").cast("long").alias("key"), F.col("c").cast("double").alias("value"))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        names = ["ord", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"]
        kinds_ = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        if not left.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds_], names)
        ords, learn, size, data = get_arrays(
            zstandard.ZstdDecompressor().decompress(left.column("pack")[0].as_py()), np.int64, np.bool_, np.int64, np.uint8)
        raw, ends_at = memoryview(data), np.cumsum(size).tolist()
        texts = [raw[z - n:z] for z, n in zip(ends_at, size.tolist())]
        words, asked_for = (right.filter(pc.field("word") == x) for x in (True, False))
        known, cost = (asked_for.column(c).to_numpy() for c in ("key", "value"))
        del asked_for
        by = np.argsort(known)
        known, cost = known[by], cost[by]
        scores = np.zeros(len(texts))
        for a, z in _batches(texts):
            for found, owner in strings(texts[a:z], order):
                costs = np.empty(len(found))
                for at in range(0, len(found), PART):
                    by = at + np.argsort(found[at:at + PART])
                    costs[by] = cost[np.searchsorted(known, found[by])]
                scores[a:z] += np.bincount(owner, costs, z - a)
        del known, cost
        number = {w: i for i, w in enumerate(left.column("words")[0].as_py())}
        count = np.zeros(len(number))
        count[words.column("key").to_numpy()] = words.column("value").to_numpy()
        logs = np.log10((count + 0.1) / (tokens + 0.1 * (distinct + 1)))
        base = np.full(len(texts), np.log10((ends + 0.1) / (tokens + 0.1 * (distinct + 1))))
        n, seen = np.ones(len(texts), np.int64), np.full(len(texts), int(ends > 0), np.int64)
        for i, t in enumerate(texts):
            mine = np.array([number[w] for w in bytes(t).translate(_LOWER).split()], np.int64)
            n[i] += len(mine)
            seen[i] += int((count[mine] > 0).sum())
            base[i] += logs[mine].sum()
        cols = [ords, ~learn, n, seen, np.full(len(texts), tokens), base, scores, size]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds_)], names)

    out = blocks.select("block", F.col("words").cast("array<binary>").alias("words"), "pack").groupBy("block").cogroup(
        asked.unionByName(told).groupBy("asker")).applyInArrow(
        run, "ord long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")
    return out.select(F.when(F.col("ord") < LAST, F.col("ord")).alias("doc_id"), *out.columns[1:])


def nine_of_ten(doc_id: str = "doc_id") -> Column:
    """The rows whose id, as text, has a CRC-32 that is no multiple of ten."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 != 0
