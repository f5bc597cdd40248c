import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from prefmill.llm import simhash


def print_of(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints, limit=4):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= limit:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    base = [" ".join(rnd.choice("red Green blue old new tree house é ship".split()) for _ in range(60)) for _ in range(4)]
    out = []
    for i in range(120):
        words = base[i % 4].split()
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(60)] = "x"
        out.append((i, " ".join(words)))
    return out + [(None, base[0]), (None, "alone in null"), (300, None), (301, ""), (302, "A b"), (303, "a  B"), (7, out[9][1]),
                  (7, out[7][1]), (304, "z " * 4000)]


@pytest.mark.parametrize("homes", [2048, 3])
def test_groups_against_brute_force(spark, rows, monkeypatch, homes):
    monkeypatch.setattr(simhash, "HOMES", homes)
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, fp int, first int")
    prints = [print_of(t) for _, t in rows]
    group = grouped(prints)
    least = {}
    for (d, _), g in zip(rows, group):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    want = Counter((d, f"{p:016x}", least.get(g)) for (d, _), p, g in zip(rows, prints, group))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    kept = simhash.keep_one(docs).collect()
    named = [g for g in set(group) if g in least]
    assert {r.doc_id for r in kept if r.doc_id is not None} == {least[g] for g in named}
    assert len([r for r in kept if r.doc_id is None]) == len(set(group)) - len(named)


def test_golay_anchors_cover_and_meet():
    high, low, table = simhash._code_tables()
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 23, 500)
    for v in x.tolist():
        e = [int(p) for p in table[high[v >> 12] ^ low[v & 4095]] if p >= 0]
        assert e[0].bit_count() <= 3 and all(p.bit_count() == 4 for p in e[1:])
        w = v ^ (1 << int(rng.integers(0, 23)))
        home = v ^ e[0]
        assert home in {w ^ int(p) for p in table[high[w >> 12] ^ low[w & 4095]] if p >= 0}


def test_random_prints_lose_no_link(spark):
    rnd = random.Random(9)
    prints = []
    for _ in range(60):
        p = rnd.getrandbits(64)
        for _ in range(4):
            prints.append(p)
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                p ^= 1 << b
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    of = simhash.groups(spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")).collect()
    group = grouped(prints)
    assert {r.fp: r["first"] for r in of} == {s: g for s, g in zip(signed, group)}


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i + 1, i) for i in range(100)] + [(i, 200) for i in range(201, 260)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, **{i: 200 for i in range(201, 260)}}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
