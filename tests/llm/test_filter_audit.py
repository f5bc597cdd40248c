"""Removal ranks against filters run one after the other over every document."""

import random
from itertools import permutations

import numpy as np

from prefmill.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, n long, mask string, digest string, part string"
LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    last = 1 << 63
    texts = [(last if d is None else d, t or "", la or "") for d, t, la in rows]
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    first = {}
    for d, t, _ in texts:
        first[t] = min(first.get(t, d), d)
    fails = []
    for d, t, _ in texts:
        w = [x for x in t.encode().split() if x]
        f = {c for c, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            any(c in "#$%&*|" for c in t), first[t] < d)) if bad}
        fails.append(f)
    out, shapley = {}, {}
    for part in {la for *_, la in texts}:
        mine = [i for i, x in enumerate(texts) if x[2] == part]
        for o in map("".join, permutations("ABCDE")):
            left = set(mine)
            for s, f in enumerate(o, 1):
                gone = {i for i in left if f in fails[i]}
                out[part, o, s] = [
                    len(left - gone), len(gone), sum(f in fails[i] for i in mine if i not in left), sum(fails[i] == {f} for i in mine),
                    sum(texts[i][0] in good for i in gone), sum(texts[i][0] in toxic for i in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                left -= gone
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, la, 5, "m", "x", "p") for d, t, la in rows], SCHEMA)
    marks = spark.createDataFrame(labels, LABELS)
    got = filter_audit.audit(filter_audit.classes(docs, marks))
    return [tuple(r[c] for c in ("part", "filter_order", "step", *filter_audit.COUNTS, "shapley")) for r in got.collect()]


def test_orders_against_plain_filters(spark):
    rnd = random.Random(3)
    words = [f"w{i}é" for i in range(400)]
    rows = []
    for i in range(60):
        t = " ".join(rnd.choice(words[:rnd.choice((5, 400))]) for _ in range(rnd.choice((3, 199, 200, 320))))
        t = t.upper() if rnd.random() < 0.2 else t
        rows.append((i, t + rnd.choice(("", "", " 5 %", "|")), rnd.choice(("en", "fr", None))))
    rows += [(100 + i, rows[i % 7][1], rnd.choice(("en", "de"))) for i in range(30)]  # copies in other languages
    rows += [(None, rows[3][1], "en"), (None, None, None), (7, rows[7][1], "en"), (7, rows[7][1], "en"), (-4, rows[9][1], "en"),
             (200, "", "en"), (201, "\t \x0b\x0c\r\n", "de"), (202, "\xa0 \x85", "de"), (203, "w " * 20000, "de")]
    labels = [(i, rnd.choice((0, 1, None)), rnd.choice((0, 1))) for i in range(0, 130, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1)]
    got = result(spark, rows, labels)
    assert len(got) == len(set(got)) == 4 * 600  # en, fr, de and the empty part
    assert set(got) == brute(rows, labels)


def test_empty_tables(spark):
    assert result(spark, [], []) == []
    got = result(spark, [(1, "x", "en")], [])
    assert len(got) == 600 and set(got) == brute([(1, "x", "en")], [])


def test_steps_are_a_min_plus_product():
    orders, position = filter_audit.positions("ABC")
    failed = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 1]], bool)
    steps = filter_audit.removal_steps(failed, position)
    assert steps[0].tolist() == [4] * 6
    assert steps[1].tolist() == [o.index("A") + 1 for o in orders]
    assert steps[2].tolist() == [min(o.index("B"), o.index("C")) + 1 for o in orders]
