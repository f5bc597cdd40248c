import numpy as np
import pytest
from pyspark.sql import functions as F

from prefmill.operators import score


@pytest.fixture(scope="module")
def parts(spark):
    """Users of one group of items each, a few who rate all, zeros, and signed matrix cells within and across the groups."""
    rnd = np.random.default_rng(5)
    prefs = [(u, int(i), float(rnd.integers(0, 6))) for u in range(60)
             for i in (range(40) if u % 20 == 0 else rnd.choice(10, 4, replace=False) + 10 * (u % 4))]
    cells = [(i, j, float(rnd.normal())) for i in range(40) for j in range(40) if rnd.random() < .4]
    return (spark.createDataFrame(prefs, "user_id long, item_id long, value double"),
            spark.createDataFrame(cells, "row long, col long, value double"))


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 20, "tile_rows": 100}])
@pytest.mark.parametrize("hide", [True, False])
def test_same_lists(parts, sizes, hide):
    prefs, matrix = parts
    lists = [sorted(tuple(r) for r in score.top_items(prefs, matrix, 5, hide_seen=hide, route=at, **sizes)
             .select("user_id", "item_id", F.round("score", 9), "rank").collect()) for at in (0, 1 << 40)]
    assert lists[0] == lists[1] and lists[0]


def test_same_extremes(parts):
    got = [score.positive_extremes(*parts, block_rows=20, tile_rows=100, route=at) for at in (0, 1 << 40)]
    assert np.isclose(got[0].low, got[1].low) and np.isclose(got[0].high, got[1].high)


def test_fewer_cells_are_sent(parts):
    prefs, matrix = parts
    blocks = 30
    few = prefs.where("user_id % 20 <> 0")
    sent, everywhere = score.routed(few, matrix, blocks).count(), blocks * matrix.count()
    assert sent < 0.6 * everywhere
    zero = few.withColumn("value", F.lit(0.0))
    assert score.routed(zero, matrix, blocks).count() == 0
