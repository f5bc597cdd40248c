"""Registered text queries: next to their SQL where there is some, else by rows and schema."""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from prefmill.llm.oracles import SQL
from prefmill.llm.queries import REGISTRY

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    got = REGISTRY[name](spark, FOLDER).toPandas()
    assert len(got) and difference(got, connect(FOLDER).execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(SQL) - {"pipeline"}))
def test_one_row_or_more_per_document(spark, name):
    got = REGISTRY[name](spark, FOLDER)
    ids = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in got.select("doc_id").collect()} == ids


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))
