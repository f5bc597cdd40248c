"""Substring and word-window dedup against brute force, in one block and in many, with and without hot anchors."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefmill.llm import blocks, debruijn_dedup, suffix_dedup
from prefmill.llm.kernels import sliding_min, word_at_each_byte

SCHEMA = "doc_id long, text string, kept string, block long"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    passage = [" ".join(word() for _ in range(rnd.randint(14, 40))) for _ in range(5)]
    out = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 30)))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passage).split(" ")
            a = rnd.randint(0, len(p) - 1)
            parts += [" ".join(p[a:a + rnd.randint(5, 40)]), " ".join(word() for _ in range(rnd.randint(0, 9)))]
        out.append((i, rnd.choice(" \n\t").join(parts)))
    out += [(70, out[3][1]), (71, out[3][1]), (5, out[5][1]), (5, out[6][1] + " tail"), (80, None), (81, ""), (None, out[7][1]),
            (None, passage[0] + " end"), (82, "a" * 300), (83, "b" + "a" * 120 + " a"), (84, passage[1] + passage[1]), (85, "x" * 49)]
    rnd.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)


def order(d):
    return blocks.LAST if d is None else d


def brute(rows, units, width):
    first = {}
    cut = [units(t or "") for _, t in rows]
    for (d, _), u in zip(rows, cut):
        for i in range(len(u) - width + 1):
            w = tuple(u[i:i + width])
            first[w] = min(first.get(w, blocks.LAST), order(d))
    out = []
    for (d, _), u in zip(rows, cut):
        gone = [False] * len(u)
        for i in range(len(u) - width + 1):
            if first[tuple(u[i:i + width])] < order(d):
                gone[i:i + width] = [True] * width
        out.append((d, u, gone))
    return out


def key(x):
    return tuple((v is None, v) for v in x)


@pytest.mark.parametrize("hot,size", [(4096, 2 << 20), (4096, 900), (1, 900)])
def test_bytes(spark, rows, monkeypatch, hot, size):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", size)
    got = suffix_dedup.dedup(frame(spark, rows), width=20, hot=hot).collect()
    want = []
    for d, u, gone in brute(rows, lambda t: list(t.encode()), 20):
        spans, a = [], None
        for i, g in enumerate(gone + [False]):
            if g and a is None:
                a = i
            if not g and a is not None:
                spans.append([a, i])
                a = None
        want.append((d, len(u), sum(gone), tuple(map(tuple, spans)), bytes(b for b, g in zip(u, gone) if not g)))
    have = [(r.doc_id, r.n_bytes, r.n_removed, tuple(map(tuple, r.spans)), bytes(r.kept)) for r in got]
    assert sorted(have, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("hot,size", [(4096, 2 << 20), (4096, 900), (1, 900)])
def test_words(spark, rows, monkeypatch, hot, size):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", size)
    got = debruijn_dedup.dedup(frame(spark, rows), width=9, hot=hot).collect()
    want = [(d, len(u), sum(gone), " ".join(w for w, g in zip(u, gone) if not g))
            for d, u, gone in brute(rows, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), 9)]
    assert sorted([(r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in got], key=key) == sorted(want, key=key)


def test_a_long_span_over_many_anchors_is_one(spark):
    words = [f"w{i}" for i in range(400)]
    got = debruijn_dedup.dedup(frame(spark, [(1, " ".join(words)), (2, "new " + " ".join(words[50:350]) + " end")])).collect()
    row = next(r for r in got if r.doc_id == 2)
    assert (row.n_removed, row.n_spans, row.longest) == (300, 1, 300)


@pytest.mark.parametrize("hot", [4096, 2, 1])
def test_spans_do_not_depend_on_what_is_hot(spark, monkeypatch, hot):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 900)
    rnd = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    rows = [(d, " ".join([f"a{d}x{i}" for i in range(30)] + passage + [f"b{d}x{i}" for i in range(rnd.randint(1, 40))])) for d in range(12)]
    got = {r.doc_id: r for r in debruijn_dedup.dedup(frame(spark, rows), hot=hot).collect()}
    assert got[0].n_removed == got[0].n_spans == 0
    assert all((got[d].n_removed, got[d].n_spans, got[d].longest) == (60, 1, 60) for d in range(1, 12))


def test_hot_windows_travel_packed(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    rnd = random.Random(7)
    text = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    passage = text(900)
    rows = [(d, text(rnd.randint(40, 90)) + passage * (1 + d % 2) + text(rnd.randint(40, 90))) for d in range(20)]
    written = []

    def freeze(df, plain=blocks.freeze):
        out = plain(df)
        sizes = [F.octet_length(c) for c, kind in out.dtypes if kind == "binary"]
        written.append(tuple(out.select(F.lit(1).alias("n"), sum(sizes, F.lit(0)).alias("size")).agg(F.sum("n"), F.sum("size")).first()))
        return out

    for module in (blocks, suffix_dedup):
        monkeypatch.setattr(module, "freeze", freeze)
    got = suffix_dedup.dedup(frame(spark, rows), width=50, hot=2).collect()
    assert {r.doc_id: r.n_removed for r in got} == {d: sum(g) for d, _, g in brute(rows, lambda t: list(t.encode()), 50)}
    assert sum(n or 0 for n, _ in written) < 900 and sum(b or 0 for _, b in written) < 3 * sum(len(t) for _, t in rows)  # no row a window

    staged = blocks.stage(frame(spark, rows))
    masks = blocks.repeated_anchors(staged, lambda b, skip: suffix_dedup.grams(b, skip, 50), 2)
    sent = suffix_dedup._send(staged, masks, 50).where("bucket < 0").agg(F.sum(F.octet_length("payload"))).first()[0]
    assert sent < 12 * sum(len(t) for _, t in rows)


def test_parts_of_hot_anchors_hold_every_window_once():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    data[2000:2400] = data[100:500]
    block = blocks.Block(np.arange(3), data, np.array([0, 1500, 2990]), np.array([1500, 1490, 10]))
    for width in (16, 17, 20, 50):
        h, (at, lo, hi) = suffix_dedup.grams(block, np.zeros(0, np.int64), width)
        keys, first, last = suffix_dedup._hot_parts(h, at, lo, hi, width)
        windows = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
        assert sorted(windows.tolist()) == sorted(np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi)]).tolist())
        key_of = {}
        for k, a, b in zip(keys.tolist(), first.tolist(), last.tolist()):
            for w in range(a, b + 1):
                assert key_of.setdefault(data[w:w + width].tobytes(), k) == k


@pytest.mark.parametrize("operator", [suffix_dedup.dedup, debruijn_dedup.dedup])
def test_empty_table(spark, operator):
    assert operator(frame(spark, [])).count() == 0


def test_deep_shallow_sorts():
    rng = np.random.default_rng(0)
    for depth in (1, 3, 7):
        keys = rng.integers(0, 2, (500, depth)).astype(np.uint64)
        keys[:200, :min(5, depth)] = 1
        at, begins = suffix_dedup.deep_shallow(keys)
        ordered = [tuple(keys[i]) for i in at.tolist()]
        assert sorted(at.tolist()) == list(range(500)) and ordered == sorted(ordered)
        assert begins.tolist() == [i == 0 or ordered[i] != ordered[i - 1] for i in range(500)]


def test_kernels():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 99, 50)
    for w in (1, 2, 5, 16, 50):
        assert sliding_min(v, w).tolist() == [v[i:i + w].min() for i in range(50 - w + 1)]
    for n in (8, 9, 23, 64):
        d = rng.integers(0, 256, n).astype(np.uint8)
        assert word_at_each_byte(d).tolist() == [int.from_bytes(d[i:i + 8].tobytes(), "little") for i in range(n - 7)]
