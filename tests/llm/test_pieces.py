import math
import os
from collections import Counter

import pytest

from prefmill.llm import pieces

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")
TEXTS = ["hello world", "a", "", None, "x ▁y\n\n  ü 漢字🙂 \t\0", "the the the", " ", "no" * 3000, "z\n" * 500]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(*pieces.load())


def segmentations(v, text):
    """All ways to cut one unit, with their weights, by recursion."""
    unit = "▁" + text
    found = {unit[i:j]: v for i in range(len(unit)) for j in range(i + 1, len(unit) + 1)}
    names = {p: i for i, p in enumerate(pieces.load()[0]) if i >= v.first_byte + 256 and p in found}

    def go(at):
        if at == len(unit):
            yield (), 1.0
        for stop in range(at + 1, len(unit) + 1):
            if unit[at:stop] in names:
                i = names[unit[at:stop]]
                for rest, w in go(stop):
                    yield (i, *rest), w * math.exp(v.log_weight[i])

    all_ = dict(go(0))
    total = sum(all_.values())
    return {k: w / total for k, w in all_.items()}


def test_probabilities_and_order_without_replacement(vocabulary):
    p = segmentations(vocabulary, "tents")
    n = 20000
    got = pieces.sample_batch(vocabulary, [i * 977 + 5 for i in range(n)], ["tents"] * n, 2)
    first, pairs = Counter(), Counter()
    for samples, _ in got:
        a, b = (tuple(s[0].tolist()) for s in samples)
        assert a != b and samples[0][2] < samples[1][2]
        assert math.isclose(math.exp(samples[0][1]), p[a], rel_tol=1e-9)
        first[a] += 1
        pairs[a, b] += 1
    close = lambda seen, q: abs(seen - n * q) < 5 * math.sqrt(n * q * (1 - q)) + 3
    assert all(close(first[a], p[a]) for a in p)
    assert all(close(pairs[a, b], p[a] * p[b] / (1 - p[a])) for a in p for b in p if a != b)


def test_inclusion_scores(vocabulary):
    """1 / inclusion weights of two samples add up to the number of segmentations on average."""
    p = segmentations(vocabulary, "tents")
    n, top = 20000, sorted(p, key=p.get)[-3:]
    total = Counter()
    for samples, limit in pieces.sample_batch(vocabulary, [i * 31 + 7 for i in range(n)], ["tents"] * n, 2):
        for ids, lp, _ in samples:
            total[tuple(ids.tolist())] += math.exp(-pieces.log_inclusion(lp, limit)) / n
    assert all(abs(total[a] - 1) < 0.1 for a in top)


def test_all_segmentations_of_a_short_text(vocabulary):
    want = segmentations(vocabulary, "the")
    (samples, limit), = pieces.sample_batch(vocabulary, [3], ["the"], 50)
    assert {tuple(s[0].tolist()) for s in samples} == set(want) and limit == math.inf


def test_round_trip_and_determinism(spark):
    rows = [(i if i != 5 else None, t, "clash") for i, t in enumerate(TEXTS)] + [(1, "a", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = pieces.encode(docs, k=3).collect()
    assert all(r.decoded for r in got)
    again = pieces.encode(docs.repartition(5), k=3).collect()
    row = lambda r: (str(r.doc_id), r.sample, r.ids, r.log_prob, r.perturbed, r.log_inclusion)
    assert sorted(map(row, got)) == sorted(map(row, again))
    back = {(r.doc_id, r.sample): r.text for r in pieces.decode(spark.createDataFrame(got)).collect()}
    text = {(i if i != 5 else None): t or "" for i, t in enumerate(TEXTS)}
    assert all(t == text[d] for (d, _), t in back.items())
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert all(model.decode(r.ids) == text[r.doc_id] for r in got if "▁" not in text[r.doc_id])
    per = Counter(r.doc_id for r in got)
    assert per[2] == per[3] == 1 and per[0] == 3 and pieces.encode(docs.limit(0)).count() == 0
