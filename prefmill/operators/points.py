"""K-means over point tables."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame


def kmeans(points: DataFrame, k: int, seed: int = 1, iters: int = 20) -> DataFrame:
    """Cluster ``points(id, features)``; returns ``(id, cluster)``."""
    data = points.select("id", array_to_vector("features").alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=iters).fit(data)
    return model.transform(data).select("id", model.getPredictionCol()).withColumnRenamed(
        model.getPredictionCol(), "cluster")
