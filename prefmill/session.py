"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import math
import tempfile
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "prefmill") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    Only a local session, where driver and executors are one process, may fall
    back to a temporary folder of this machine.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="prefmill-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, grouped by application."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/scratch-{app}/{name}-{uuid.uuid4().hex}"


_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class _Inside:
    """How many threads of a session are inside ``shuffles_dropped``, and the setting before the first."""

    def __init__(self):
        self.lock, self.n, self.before = threading.Lock(), 0, "false"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What runs inside leaves no shuffle files: they go when it has ended, not when the driver's collector finds them.

    Threads of a session may be inside together; the last one out restores the setting.
    """
    inside = spark.__dict__.setdefault("_prefmill_inside", _Inside())  # not a global: functions are sent with theirs
    with inside.lock:
        if not inside.n:
            inside.before = spark.conf.get(_DROP, "false")
            spark.conf.set(_DROP, "true")
        inside.n += 1
    try:
        yield
    finally:
        with inside.lock:
            inside.n -= 1
            if not inside.n:
                spark.conf.set(_DROP, inside.before)


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from there.

    Used where a result feeds several later steps, where a loop would let the
    plan grow, or where row placement must not change if a lost executor makes
    Spark run a stage again. Later steps read only the columns they need, and
    their joins are planned with the table's true size. What was shuffled for it is deleted.
    """
    path = scratch_path(df.sparkSession, "table")
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freezing(spark: SparkSession, name: str = "loop") -> Callable[[DataFrame], DataFrame]:
    """``freeze`` for a loop that needs only the last two results of this name: they take turns at two paths."""
    paths = [scratch_path(spark, name) for _ in range(2)]

    def write(df: DataFrame) -> DataFrame:
        paths.reverse()
        df.write.mode("overwrite").parquet(paths[0])
        return spark.read.schema(df.schema).parquet(paths[0])

    return write


ROWS_A_TASK = 1 << 20


def spread(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """``df`` laid out by ``cols`` once ``rows`` would give a shuffled task more than ``ROWS_A_TASK``, so that
    what a task sorts or hashes does not grow with the table; below that, Spark's own plan."""
    n = -(-rows // ROWS_A_TASK)
    return df.repartition(n, *cols) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def tasks_for(spark: SparkSession, work: float, small: float, large: float) -> int:
    """Tasks for a stage whose cost is computing, not bytes.

    Work is spread over all cores unless a task would get less than ``small``,
    and over more tasks once one would get more than ``large``.
    """
    cores = spark.sparkContext.defaultParallelism
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(math.ceil(work / large), min(cores, math.ceil(work / small)))
    return max(1, min(wanted, 16 * max(cores, shuffles)))
