import math
import random
import re
from collections import Counter

import pytest

from prefmill.llm import bm25

TABLE = str.maketrans({**{c: " " for c in ".,;:!?\"'()[]"}, **{chr(c): chr(c + 32) for c in range(65, 91)}})


def brute(rows, k):
    words = [Counter(re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(TABLE))) for _, t in rows]
    n, avg = len(rows), sum(sum(w.values()) for w in words) / len(rows)
    df = Counter(t for w in words for t in w)
    out = {}
    queries = {}
    for (d, _), w in zip(rows, words):
        if d is not None and d % 10 == 0:
            queries.setdefault(d, Counter())
            queries[d] |= w
    for q, terms in queries.items():
        found = []
        for (d, _), w in zip(rows, words):
            s = sum(c * math.log(1 + (n - df[t] + .5) / (df[t] + .5)) * w[t] * 2.2 / (
                w[t] + 1.2 * (.25 + .75 * sum(w.values()) / avg)) for t, c in terms.items() if w[t])
            if s > 0 and d != q:
                found.append((-round(s, 6), math.inf if d is None else d))
        out[q] = sorted(found)[:k]
    return out


@pytest.mark.parametrize("docs_per_shard,terms", [(1 << 13, 2_000_000), (17, 300)])
def test_against_brute_force(spark, monkeypatch, docs_per_shard, terms):
    monkeypatch.setattr(bm25, "SHARD_DOCS", docs_per_shard)
    monkeypatch.setattr(bm25, "QUERY_TERMS", terms)
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rnd.choice(vocabulary[:int(rnd.paretovariate(0.7) * 3) + 1]) for _ in range(rnd.randint(0, 60)))) for i in range(150)]
    rows += [(None, "W1, w2! w199"), (200, None), (210, ""), (201, rows[3][1]), (202, rows[3][1]), (10, "w5 w5 other"), (220, "only here")]
    docs = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double")
    got = {}
    for r in bm25.search(docs, docs.where("doc_id % 10 = 0"), k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-round(r.score, 6), math.inf if r.doc_id is None else r.doc_id))
    want = {q: v for q, v in brute(rows, 5).items() if v}
    assert got.keys() == want.keys()
    for q in want:
        assert [d for _, d in got[q]] == [d for _, d in want[q]]
        assert all(abs(a - b) < 2e-6 for (a, _), (b, _) in zip(got[q], want[q]))


def test_more_repeats_than_16_bits(spark):
    rows = [(0, "often rare"), (1, "often " * 200_000 + "w " * 200_000), (2, "often other"), *[(i, f"w{i} x") for i in range(3, 9)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = bm25.search(docs, docs.where("doc_id = 0"), k=5).orderBy("rank").collect()
    want = brute(rows, 5)[0]
    assert [r.doc_id for r in got] == [d for _, d in want]
    assert all(abs(r.score + s) < 2e-6 for r, (s, _) in zip(got, want))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bm25.search(docs, docs).count() == 0
