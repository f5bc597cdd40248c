"""PageRank over an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import freeze, freezing, spread


def pagerank(edges: DataFrame, iters: int = 10, damping: float = 0.85) -> DataFrame:
    """Ranks ``(id, rank)`` from ``edges(src, dst)``; every node starts at 1.

    Contributions to a node are summed before the shuffle; each round's ranks
    are written, so the plan does not grow, over those of two rounds before.
    """
    given = freeze(edges)
    edges = freeze(spread(given, given.count(), "src", "dst").distinct())
    n = edges.count()
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    nodes = freeze(spread(ends, 2 * n, "id").distinct())
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    out = freeze(spread(edges, n, "src").join(degree, "src"))
    ranks, keep = nodes.withColumn("rank", F.lit(1.0)), freezing(edges.sparkSession, "ranks")
    for _ in range(iters):
        sent = spread(out, n, "src").join(ranks, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(
            F.sum(F.col("rank") / F.col("degree")).alias("got"))
        ranks = keep(nodes.join(sent, "id", "left").select(
            "id", ((1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")))
    return ranks
