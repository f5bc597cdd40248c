import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from prefmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(os.environ.get("TEST_CPUS", "8"))


@pytest.fixture(scope="session")
def tiny(spark):
    """Ratings with tied times, as a list and a table."""
    import random
    rnd = random.Random(5)
    rows = [(u, i, float(rnd.randint(1, 5)), rnd.randint(0, 40)) for u in range(12) for i in range(15) if rnd.random() < .6]
    return rows, spark.createDataFrame(rows, "user_id long, item_id long, rating double, ts long")
