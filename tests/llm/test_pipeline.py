"""The pipeline stage by stage on a small corpus, against plain Python where the stage is exact."""

import os
import random
from collections import Counter

import pytest

import corpus_pipeline
from prefmill.llm import mixing, pieces
from test_line_dedup import brute as brute_lines
from test_mixing import ident, poisson
from test_simhash import grouped, print_of

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(12)
    words = [f"g{i}" for i in range(80)]
    line = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(9, 25)))
    shared = [line() for _ in range(4)]
    rows, labels = [], []
    for i in range(300):
        text = "\n".join([line() for _ in range(rnd.randint(1, 4))] + rnd.sample(shared, rnd.randint(0, 2)))
        bad = i % 6 == 0
        if bad:
            text = " ".join(w + "***" for w in text.split())
        rows.append((i, text, "en", f"s{min(i % 7, 3)}", len(text)))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(1000 + i, rows[i + 1][1], "en", "s0", 1) for i in range(0, 30, 6)] + [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality"](spark, docs, folder)
    bad = {i for i in range(0, 300, 6)}
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & bad and ids == {r.doc_id for r in docs.collect()} - bad

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    lined = stage["lines"](spark, kept, folder)
    want = brute_lines(rows)
    assert Counter((r.doc_id, r.text) for r in lined.collect()) == Counter(want)

    prints = [print_of(t) for _, t in want]
    first = {}
    for (d, _), g in zip(want, grouped(prints)):
        first[g] = min(first.get(g, d), d)
    single = stage["near_duplicates"](spark, lined, folder)
    assert Counter(r.doc_id for r in single.collect()) == Counter(first.values())

    rate = {r.source: r.rate for r in mixing.source_rates(single, 0.7, 1.0).collect()}
    copies = Counter({r.doc_id: poisson(rate[r.source], "7", ident(r.doc_id, r.text)) for r in single.collect()})
    mixed = stage["mix"](spark, single, folder)
    assert Counter(r.doc_id for r in mixed.collect()) == +copies

    out = stage["tokens"](spark, mixed, folder).collect()
    assert all(r.decoded for r in out) and Counter(r.doc_id for r in out if r.sample == 1) == +copies
    assert all(f(spark, docs, folder).columns == docs.columns for n, f in corpus_pipeline.STAGES[:1])


def test_run_gives_the_rows_of_the_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.where("sample = 1").count() > 100 and "ids" in got.columns
