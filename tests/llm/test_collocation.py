"""Phrases against plain counting, in one block and in many."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from prefmill.llm import collocation

SCHEMA = "doc_id long, text string, lang string, words string, block string, f string"


def brute(rows, least, top):
    f, size = Counter(), Counter()
    for text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = [x for x in re.split("[ \t]", piece) if x]
            size[lang or "und"] += len(w)
            f.update((lang or "und", *w[i:i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for (lang, *p), a in found.items():
        score, k = min((2000000 * a // (f[lang, *p[:k]] + f[lang, *p[k:]]), k) for k in range(1, len(p)))
        inside = any(q[0] == lang and len(q) > len(p) + 1 and 100 * b >= 80 * a and any(
            list(q[i:i + len(p)]) == p for i in range(1, len(q) - len(p) + 1)) for q, b in found.items())
        if not inside:
            out.append((lang, -score, -a, " ".join(p), f[lang, *p[:k]], f[lang, *p[k:]], size[lang], k))
    rank, result = Counter(), set()
    for lang, score, a, p, l, r, n, k in sorted(out, key=lambda x: (x[0], x[1], x[2], x[3].encode())):
        rank[lang] += 1
        if rank[lang] <= top:
            result.add((lang, rank[lang], p, -a, l, r, n, -score, k))
    return result


def result(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, la, "a", "b", "c") for i, (t, la) in enumerate(rows)], SCHEMA).repartition(3)
    return [tuple(r) for r in collocation.mine(docs, **kw).collect()]


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(12)] + ["é", "the", "x" * 300, "b\xa0c"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for _ in range(120):
        t = ""
        for _ in range(rnd.randint(0, 60)):
            t += rnd.choice(("New York city hall", "new york", *rnd.choices(words, weights, k=3))) + rnd.choice((" ", " ", "  ", "\t", ", ", ".\n", "\r"))
        rows.append((t, rnd.choice(("en", "en", "fr", None))))
    return rows + [("the end " * 500, "en"), (None, "en"), ("", None), (" \t.;!", "de"), ("und so", "und"), *rows[:4]]


@pytest.mark.parametrize("size", [2_000_000, 50])
def test_against_plain_counts(spark, corpus, size):
    got = result(spark, corpus, least=8, top=40, size=size)
    assert len(got) == len(set(got)) and len({r[0] for r in got}) == 3
    assert set(got) == brute(corpus, 8, 40)


def test_bounds_of_count_and_share(spark):
    # 30 and 29 times; a pair inside a triple with exactly four fifths of its count, and with less
    rows = [("a b", "en")] * 30 + [("c d", "en")] * 29 + [("p q r", "en")] * 32 + [("p q", "en")] * 8 + [("s t u", "en")] * 31 + [("s t", "en")] * 9
    got = {r[2]: r for r in result(spark, rows)}
    assert set(got) == {"a b", "p q r", "s t u", "s t"}
    assert got["a b"][3:] == (30, 30, 30, 341, 1000000, 1) and got["s t"][3] == 40
    assert {tuple(r) for r in got.values()} == brute(rows, 30, 2000)


def test_nothing_to_find(spark):
    assert result(spark, []) == []
    assert result(spark, [(None, None), ("", "en"), ("one two three", "en")]) == []


def test_quicksort_orders_rows_and_says_what_they_share():
    rnd = np.random.default_rng(4)
    for n, top in ((0, 1), (1, 1), (200, 3), (3000, 40), (500, 1)):
        digits = [rnd.integers(-1, top, n).astype(np.int32) for _ in range(4)]
        order, shared = collocation.multikey_quicksort(digits)
        rows = list(zip(*(d[order].tolist() for d in digits)))
        assert rows == sorted(rows) and sorted(order.tolist()) == list(range(n))
        for i in range(1, n):
            same = next((k for k in range(4) if rows[i][k] != rows[i - 1][k]), 4)
            assert shared[i] == same
