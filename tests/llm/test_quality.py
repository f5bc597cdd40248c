"""Quality rules against plain Python, the classifier on held-out rows."""

import random
import re

import pytest
import zstandard

from prefmill.llm import quality_classifier, quality_rules

WORD = r"[^\x20\x09-\x0D]+"


def base(text):
    words = re.findall(WORD, text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    hit = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
    lines, known, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(WORD, x):
            dup += x in known
            known.add(x)
    n, r = len(words), len(hit)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, r, n < 20 or 100 * r > 30 * n


def test_base_counts(spark):
    rnd = random.Random(3)
    texts = [None, "", " \n\t\x0b", "a b c d e f g h a b c d e f g h", "x\nx\n x\n\n\nx #*$%&|<>", "é b 漢字 " * 9]
    texts += [" ".join(rnd.choice("aa b c") for _ in range(rnd.randint(0, 90))) for _ in range(40)]
    texts += ["\n".join(rnd.choice(["one two", "three", "", "# four"]) for _ in range(30)) for _ in range(5)]
    rows = [(i if i else None, t, True) for i, t in enumerate(texts)] + [(3, texts[3], True)]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, kept boolean")).collect()
    have = sorted([(str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got])
    assert have == sorted((str(d), *base(t or "")) for d, t, _ in rows)


def test_bands():
    rnd = random.Random(1)
    packer, bands = zstandard.ZstdCompressor(level=3), quality_rules.Bands()
    parts = [a + b for a in "bdfghklmnprst" for b in ("a", "en", "io", "ur")]
    prose = lambda n: " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(n))
    kept = lambda t: quality_rules.measure(t, bands, packer)[6]
    assert kept(prose(60)) and kept(prose(3000))
    assert not kept("".join(chr(rnd.randint(33, 126)) for _ in range(10)) + " " + " ".join(
        "".join(chr(rnd.randint(33, 126)) for _ in range(40)) for _ in range(60)))
    pairs = [f"{a} {b}" for a in ("lorem", "ipsum") for b in ("dolor", "sit")]
    assert not kept(" ".join(rnd.choice(pairs) + str(rnd.randint(0, 9)) for _ in range(2000)))
    assert bands.limits(10) is None and bands.limits(256) == bands.whole[0][1:]


def test_chunks_reach_the_end():
    rnd = random.Random(2)
    packer, bands = zstandard.ZstdCompressor(level=3), quality_rules.Bands()
    parts = [a + b for a in "bdfghklmnprst" for b in ("a", "en", "io", "ur")]
    prose = " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(3000))
    noise = "".join(chr(rnd.randint(33, 126)) for _ in range(6000))
    def judged(t):
        got = quality_rules.measure(t, bands, packer)
        return got[6], got[8], got[9]
    assert judged(prose[:4096]) == (True, 2, 0)
    assert judged(prose[:2049]) == (True, 2, 0)
    assert judged(prose[:5000]) == (True, 3, 0)
    assert judged(prose[:2048] + noise[:2040]) == (False, 2, 1)
    assert judged(prose[:2048] + noise[:4088]) == (False, 3, 2)
    assert judged(prose[:2048] + noise[:2048]) == (False, 2, 1)
    assert judged(prose[:6144] + noise[:2040]) == (True, 4, 1)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.judge(docs).count() == 0
    assert quality_classifier.judge(docs, labels).count() == 0


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(8)
    good = [f"g{i}" for i in range(300)]
    rows, truth = [], {}
    for i in range(1200):
        words = [rnd.choice(good) for _ in range(rnd.randint(5, 80))]
        low, toxic = rnd.random() < .15, rnd.random() < .12
        if low:
            words = [w + rnd.choice(["***", "$$$"]) for w in words]
        if toxic:
            words[rnd.randrange(len(words))] = "vile."
            words.insert(0, rnd.choice(["nasty", "Awful"]))
        truth[i] = (low, toxic)
        rows.append((i, " ".join(words), "en", f"s{i % 5}", 0.5))
    rows += [(5000, None, None, None, 0.1), (None, "g1 g2 g3", "en", None, 0.1), (5001, "", "fr", "rare", 0.1), (7, rows[7][1], "en", "s2", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, p_low double")
    labels = spark.createDataFrame([(i, 0 if a else 1, int(b)) for i, (a, b) in truth.items() if i < 700]
                                   + [(None, 0, 1), (9999, 0, 0), (900, None, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, truth


def test_held_out_accuracy(corpus):
    docs, labels, truth = corpus
    got = quality_classifier.judge(docs, labels).collect()
    assert len(got) == 1204 and all(r.kept is not None for r in got)
    held = [r for r in got if r.doc_id is not None and 700 <= r.doc_id < 1200]
    wrong = sum(r.kept == any(truth[r.doc_id]) for r in held)
    assert wrong <= 0.05 * len(held)
    assert all(r.kept for r in got if r.doc_id is None or r.doc_id >= 5000)


def test_the_label_bound_and_no_labels(corpus):
    docs, labels, _ = corpus
    assert quality_classifier.judge(docs, labels, max_labels=50).count() == 1204
    assert quality_classifier.judge(docs, labels.limit(0)).where("NOT kept").count() == 0


def test_sparse_sites_shrink_to_their_parents(spark):
    rows = [("a", "en", 4.0)] * 60 + [("b", "en", -4.0)] * 60 + [("a", "fr", -4.0)] + [("c", "en", 4.0)]
    scored = spark.createDataFrame([(s, x, e, -5.0) for s, x, e in rows], "source string, lang string, _low double, _toxic double")
    r = {(r.source, r.lang): r for r in quality_classifier.site_rates(scored).collect()}
    assert r["a", "en"].r_low > 0.8 > 0.2 > r["b", "en"].r_low
    assert r["a", "en"].g_low < r["c", "en"].r_low < r["a", "en"].r_low
