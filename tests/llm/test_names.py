"""Operators that pass a caller's columns through: every name they use inside comes back as it was."""

import pytest
from pyspark.sql import functions as F

from prefmill.llm import line_dedup, mixing, quality_classifier, simhash

NAMES = ["row", "ident", "_rate", "_source", "_n", "doc", "txt", "of_doc", "of_txt", "_keep", "_doc", "_txt", "_line_doc", "_line_text",
         "_low", "_toxic", "_site_n", "_site_source", "_site_s_low", "fp", "_near_own", "_near_fp", "_near_first", "root", "node",
         "first", "a.b", "x`y", "n", "part", "kept_too"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"line {i} of one two three four five six seven\nend {i}", "en", f"s{i % 2}") for i in range(30)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return plain.select("*", *[F.concat(F.lit(f"{k}-"), "doc_id").alias(n) for k, n in enumerate(NAMES)])


def unchanged(got, docs):
    quoted = ["`" + n.replace("`", "``") + "`" for n in ["doc_id", *NAMES]]
    rows = got.select(*quoted).distinct().collect()
    assert rows and all(r[k + 1] == f"{k}-{r[0]}" for r in rows for k in range(len(NAMES)))
    assert got.columns[:len(docs.columns)] == docs.columns


def test_mix(spark, docs):
    unchanged(mixing.mix(docs), docs)


def test_lines(spark, docs):
    unchanged(line_dedup.dedup(docs), docs)


def test_near_duplicates(spark, docs):
    unchanged(simhash.keep_one(docs), docs)


def test_classifier(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    unchanged(quality_classifier.judge(docs, labels), docs)


def test_rows_fitted_are_bounded_where_ids_repeat(spark, docs, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_classifier, "fit", lambda rows, y: seen.append(len(rows)) or (None, None))
    many = spark.range(500).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    quality_classifier.train(many, labels, max_labels=7)
    assert seen == [7]
