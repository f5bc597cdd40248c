import random
from collections import Counter, defaultdict

import pytest

from prefmill.llm import line_dedup

LAST = line_dedup.LAST


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    tail = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    return head + tail >= max(len(a), len(b)) - 1


def brute(rows, least=8):
    first = {}
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            k = line.strip(" \t\r")
            if k:
                place = (LAST if d is None else d, i)
                first[k] = min(first.get(k, place), place)
    by = defaultdict(list)
    for k in first:
        by[len(k.split(" "))].append(k)
    dropped = {a for a in first for n in (-1, 0, 1) for b in by[len(a.split(" ")) + n]
               if first[b] < first[a] and min(len(a.split(" ")), len(b.split(" "))) >= least and near(a.split(" "), b.split(" "))}
    return [(d, "\n".join(line for i, line in enumerate((t or "").split("\n")) if not line.strip(" \t\r") or (
        first[line.strip(" \t\r")] == (LAST if d is None else d, i) and line.strip(" \t\r") not in dropped))) for d, t in rows]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    out = [(1, "a b c d e f g h i j\n\n  x y \nzz"), (2, "a b c d e X g h i j\r\nzz\nshort"), (3, "a b c d f g h i j\nshort"),
           (4, "b c d e f g h i j"), (5, None), (6, ""), (7, "a b c d e f g h i j k"), (None, "q r s t u v w x y"), (8, "q r s t u v w x y z"),
           (1, "a b c d e f g h i j\n\n  x y \nzz"), (9, "a a a a a a a a a\na a a a a a a a"), (10, "a b c d e f g h j i"),
           (11, "word " * 3000 + "end\n" + "\n" * 50), (12, "word " * 2999 + "end"), (13, "q  r s t u v w x y")]
    for i in range(150):
        words = "m n o p q r s t u v w".split()
        for _ in range(rnd.randint(0, 2)):
            kind, at = rnd.randint(0, 2), rnd.randrange(len(words))
            words[at:at + (kind != 1)] = [rnd.choice("xyz")] if kind < 2 else []
        out.append((20 + i, rnd.choice(["", "head\n"]) + " ".join(words)))
    return out


def test_against_brute_force(spark, rows):
    docs = spark.createDataFrame([(d, t, 5, "h") for d, t in rows], "doc_id long, text string, n_lines int, h string")
    got = line_dedup.dedup(docs).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(brute(rows))
    assert all(r.h == "h" for r in got)


def test_no_python_in_the_plan(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan = line_dedup.dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    assert line_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
