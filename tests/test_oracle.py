"""Every registered query with SQL, at the smallest scale; the rest must give rows."""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, difference

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
QUICK = ["als_hcat", "matrix_rank", "biased_mf", "diversity_rerank", "split_by_hash", "reviews_split", "kmeans",
         "job_reviews", "job_cv_subsets", "job_block_files"]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert len(got) and difference(got, want) is None


@pytest.mark.parametrize("name", QUICK)
def test_gives_rows(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["user_id", "item_id", "score", "rank"]
