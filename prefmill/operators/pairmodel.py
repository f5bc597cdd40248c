"""Two-sided embeddings and a neural pair model on top of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from .factor import dislike_vectors, user_vectors


@dataclass
class Embeddings:
    users: DataFrame   # user_id, features (2k)
    items: DataFrame   # item_id, features (2k)


def two_sided_embeddings(prefs: DataFrame, pos_rows: DataFrame, pos_cols: DataFrame,
                         neg_rows: DataFrame, neg_cols: DataFrame, k: int) -> Embeddings:
    """Users: [X P, Y R]; items: [Q, S], for factors P Q of the positive and R S
    of the negative item matrix."""
    liking = user_vectors(prefs, pos_rows, k)
    disliking = dislike_vectors(user_vectors(prefs, neg_rows, k), neg_rows, k)
    users = liking.join(disliking.withColumnRenamed("features", "neg"), "user_id").select(
        "user_id", F.concat("features", "neg").alias("features"))
    items = pos_cols.join(neg_cols.withColumnRenamed("features", "neg"), "id").select(
        F.col("id").alias("item_id"), F.concat(F.col("features").cast("array<double>"),
                                               F.col("neg").cast("array<double>")).alias("features"))
    return Embeddings(users, items)


def pair_features(pairs: DataFrame, emb: Embeddings) -> DataFrame:
    u = emb.users.select("user_id", F.col("features").alias("_u"))
    v = emb.items.select("item_id", F.col("features").alias("_v"))
    return pairs.join(u, "user_id").join(v, "item_id").withColumn(
        "features", array_to_vector(F.concat("_u", "_v"))).drop("_u", "_v")


def fit_pair_model(train: DataFrame, emb: Embeddings, k: int, hidden: int = 128, iters: int = 20,
                   seed: int = 0) -> MultilayerPerceptronClassificationModel:
    """Network 4k -> hidden -> hidden -> 2 on (user, item) embeddings; outputs
    the chance of dislike and like."""
    data = pair_features(
        train.select("user_id", "item_id", (F.col("rating") >= 3).cast("double").alias("label")), emb)
    return MultilayerPerceptronClassifier(
        layers=[4 * k, hidden, hidden, 2], maxIter=iters, seed=seed, blockSize=128).fit(data)


def score_with(model: MultilayerPerceptronClassificationModel, pairs: DataFrame, emb: Embeddings) -> DataFrame:
    scored = model.transform(pair_features(pairs, emb))
    return scored.withColumn("score", vector_to_array("probability")[1]).select(*pairs.columns, "score")
