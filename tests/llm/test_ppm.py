"""Context-model scores against a model in plain dictionaries, one symbol at a time."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from prefmill.llm import ppm

SCHEMA = "doc_id long, text string, block string, words string, train string"


class Plain:
    def __init__(self, order):
        self.order, self.after = order, defaultdict(Counter)

    def contexts(self, syms, i):
        past = [ppm.START] * self.order + syms[:i]
        return [tuple(past[len(past) - j:]) for j in range(self.order, -1, -1)]

    def learn(self, raw):
        syms = [*raw, ppm.END]
        for i, s in enumerate(syms):
            for c in self.contexts(syms, i):
                self.after[c][s] += 1

    def probability(self, contexts, s):
        p, excluded = 1.0, set()
        for c in contexts:
            left = {x: n for x, n in self.after[c].items() if x not in excluded} if c in self.after else {}
            escape = len(left) if len(left) + len(excluded) < ppm.SYMBOLS else 0
            if s in left:
                return p * left[s] / (sum(left.values()) + escape)
            if left:
                p *= len(left) / (sum(left.values()) + escape)
                excluded |= set(left)
        return p / (ppm.SYMBOLS - len(excluded))

    def score(self, raw):
        syms = [*raw, ppm.END]
        return sum(math.log10(self.probability(self.contexts(syms, i), s)) for i, s in enumerate(syms))


def lower(t):
    return [w for w in bytes(c + 32 if 65 <= c <= 90 else c for c in t).split()]


def brute(rows, order):
    held = [d is None or zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    raws = [(t or "").encode() for _, t in rows]
    model, counts = Plain(order), Counter()
    for h, r in zip(held, raws):
        if not h:
            model.learn(r)
            counts.update([*lower(r), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for (d, _), h, r in zip(rows, held, raws):
        toks = [*lower(r), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks)
        out.append((d, h, len(toks), sum(counts[w] > 0 for w in toks), n, base, model.score(r), len(r)))
    return out


def result(spark, rows, **kw):
    docs = spark.createDataFrame([(d, t, "a", "b", "c") for d, t in rows], SCHEMA).repartition(3)
    return [tuple(r) for r in ppm.score(docs, ppm.nine_of_ten(), **kw).collect()]


def alike(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[7], round(r[6], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] + r[7:] for r in got] == [r[:5] + r[7:] for r in want]
    for a, b in zip(got, want):
        assert a[5:7] == pytest.approx(b[5:7], rel=1e-9, abs=1e-9)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    words = ["the", "The", "cat", "sat", "on", "mats", "été", "日本", "x" * 40, "\x00"]
    out = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30)))) for i in range(60)]
    out += [(None, "the cat"), (None, None), (70, ""), (71, None), (3, out[3][1]), (3, out[3][1]), (4, "another text of id 4"),
            (80, "".join(chr(rnd.randint(1, 0x2FF)) for _ in range(200))), (-7, "\t\n a \x0b")]
    return out


@pytest.mark.parametrize("order,size", [(4, 1 << 20), (4, 300), (2, 1000)])
def test_against_a_plain_model(spark, rows, order, size):
    alike(result(spark, rows, order=order, size=size), brute(rows, order))


def test_long_texts_are_cut_without_a_trace(spark, rows, monkeypatch):
    texts = [(t or "").encode() for _, t in rows]
    whole = [k.tolist() for k, _ in ppm.strings(texts, 4)]
    monkeypatch.setattr(ppm, "STEP", 37)
    assert sum((k.tolist() for k, _ in ppm.strings(texts, 4)), []) == sum(whole, [])


def test_nothing_to_learn(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    alike(result(spark, [(i, "a b") for i in ids]), brute([(i, "a b") for i in ids], 4))
    assert result(spark, []) == []
    got = result(spark, [(i, "a b") for i in ids])
    assert got[0][6] == pytest.approx(-4 * math.log10(257))


def test_probabilities_sum_to_one(rows):
    model = Plain(3)
    for _, t in rows[:30]:
        model.learn((t or "").encode())
    for text in (b"", b"the c", b"qq", b"th"):
        contexts = model.contexts([*text, 0], len(text))
        assert sum(model.probability(contexts, s) for s in range(ppm.SYMBOLS)) == pytest.approx(1)


def test_lists_of_strings_are_added_in_place():
    import numpy as np

    rng = np.random.default_rng(1)
    want, key, n = Counter(), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for size in (0, 5, 40, 1, 0, 60):
        found = rng.integers(0, 50, size)
        want.update(found.tolist())
        key, n = ppm._merged(key, n, *ppm._summed(found, np.ones(size, np.int64)))
    assert dict(zip(key.tolist(), n.tolist())) == want and (np.diff(key) > 0).all()


def test_a_block_of_texts_is_staged_in_little_memory(monkeypatch):
    """What a task holds beside the texts themselves is bounded by the steps, not by copies of the block."""
    import tracemalloc
    import numpy as np
    import zstandard

    from prefmill.llm.blocks import get_arrays

    texts = [b"abcd efgh" * 10_000] * 100
    ids, learn = np.arange(100), np.ones(100, bool)
    tracemalloc.start()
    try:
        pack = ppm._packed(zstandard.ZstdCompressor(level=3), ids, learn, texts)
        assert tracemalloc.get_traced_memory()[1] < 1 << 20
    finally:
        tracemalloc.stop()
    got = get_arrays(zstandard.ZstdDecompressor().decompress(pack), np.int64, np.bool_, np.int64, np.uint8)
    assert [x.tolist() for x in got[:3]] == [ids.tolist(), learn.tolist(), [90_000] * 100] and got[3].tobytes() == b"".join(texts)
