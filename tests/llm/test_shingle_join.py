"""Near copies at five words and a Jaccard index of 0.8 against all pairs in plain Python."""

import random
from collections import Counter

from prefmill.llm import shingle_join, simhash


def shingled(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def firsts(rows):
    sets = [shingled(t) for _, t in rows]
    of = list(range(len(rows)))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                of[top(i)] = top(j)
    found = {}
    for i, (d, _) in enumerate(rows):
        found[top(i)] = min(found.get(top(i), 1 << 62), d)
    return Counter(found.values())


def corpus():
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randint(0, 5000)}"
    common = [word() for _ in range(30)]
    rows = []
    for _ in range(40):
        text = [word() for _ in range(rnd.randint(20, 150))] + common * (rnd.random() < 0.5)
        rows.append((len(rows), " ".join(text)))
        for _ in range(rnd.randint(0, 6)):
            near = list(text)
            for _ in range(rnd.randint(1, 5)):
                near[rnd.randrange(len(near))] = word()
            rows.append((len(rows), " ".join(near)))
    seed = [word() for _ in range(60)]
    for _ in range(60):  # a chain: each like the one before, the ends unlike
        seed[rnd.randrange(60)] = word()
        rows.append((len(rows), " ".join(seed)))
    rows += [(900, "One two"), (901, "one  TWO"), (902, None), (903, ""), (904, "one two three four five"), (905, "a b c d e f g h")]
    rnd.shuffle(rows)
    return rows


def test_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, _extra string")
    kept = shingle_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = firsts(rows)
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert Counter(r.doc_id for r in simhash.keep_one(docs).collect()) != want


def test_stage_links_at_four_fifths(spark):
    import corpus_pipeline

    words = [f"v{i}" for i in range(104)]
    rows = []
    for i, changed in enumerate(((20, 70), (20, 50, 80))):  # 5 of 100 shingles each: 90 of 110, then 85 of 115
        near = [("x" if k in changed else "") + w + str(i) for k, w in enumerate(words)]
        rows += [(2 * i, " ".join(w + str(i) for w in words)), (2 * i + 1, " ".join(near))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == [0, 2, 3]


def test_empty_table(spark):
    assert shingle_join.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0
