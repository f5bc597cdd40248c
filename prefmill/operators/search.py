"""Grid search over model settings."""

from __future__ import annotations

import itertools
import math
from concurrent.futures import ThreadPoolExecutor
from time import perf_counter

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

AT_ONCE = 4       # settings whose jobs share the cluster at a time
POOL = "spark.scheduler.pool"


def grid(**axes) -> list[dict]:
    """All combinations of the given settings, first axis slowest."""
    return [dict(zip(axes, values)) for values in itertools.product(*axes.values())]


def side_by_side(spark: SparkSession, run, settings: list[dict], at_once: int = AT_ONCE) -> list:
    """Results of ``run(**setting)`` in the order of ``settings``, at most ``at_once`` running at a time.

    Jobs of a setting go to a scheduler pool of its thread, so that under fair scheduling none waits
    for another's last tasks. The first error is raised, once those begun have ended.
    """
    def one(nth: int):
        sc = spark.sparkContext
        before = sc.getLocalProperty(POOL)
        sc.setLocalProperty(POOL, f"settings-{nth % at_once}")
        try:
            return run(**settings[nth])
        finally:
            sc.setLocalProperty(POOL, before)

    if at_once < 2 or len(settings) < 2:
        return [run(**s) for s in settings]
    with ThreadPoolExecutor(min(at_once, len(settings))) as pool:
        begun = [pool.submit(inheritable_thread_target(spark)(one), nth) for nth in range(len(settings))]
        try:
            return [b.result() for b in begun]
        except BaseException:
            for b in begun:
                b.cancel()
            raise


def search(spark: SparkSession, settings: list[dict], measure, largest: bool = True, at_once: int = AT_ONCE) -> DataFrame:
    """Run ``measure(**setting) -> float or None`` for each setting, ``at_once`` of them side by side.

    One row per setting with its metric, seconds, and whether it is the best. A
    metric that cannot be taken (one class only) is null and never the best
    while another can; if none can, the first setting is.
    Data shared by the settings should be frozen before.
    """
    def timed(**s):
        began = perf_counter()
        value = measure(**s)
        return {**s, "metric": None if value is None else float(value), "seconds": perf_counter() - began}

    rows = side_by_side(spark, timed, settings, at_once)
    known = [i for i, r in enumerate(rows) if r["metric"] is not None and not math.isnan(r["metric"])]
    best = (max if largest else min)(known, key=lambda i: rows[i]["metric"]) if known else 0
    for i, r in enumerate(rows):
        r["best"] = i == best
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    schema = ", ".join(f"{c} {'double' if c == 'metric' else kinds[type(v)]}" for c, v in rows[0].items())
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema)
