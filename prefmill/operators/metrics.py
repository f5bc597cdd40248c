"""Ranking and error metrics. Curves use distributed running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ordering import running_totals


def score_counts(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Positives and negatives per distinct score."""
    return scored.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.col(label)).cast("long").alias("pos"),
        F.sum(1 - F.col(label)).cast("long").alias("neg"),
    )


def threshold_counts(scored: DataFrame, score: str = "score", label: str = "label"):
    """Per distinct score, the hits and false alarms at or above it; and totals."""
    run, totals = running_totals(score_counts(scored, score, label), [F.desc("score")], ["pos", "neg"])
    return run.withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp"}), totals


def roc_auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under ROC, ties averaged; null if one class is missing. One row.

    Twice the area times P*N is ``2 N P - sum pos (2 fp - neg)``.
    """
    run, _ = threshold_counts(scored, score, label)
    p, n = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    lost = F.sum(F.col("pos").cast("double") * (2 * F.col("fp") - F.col("neg")))
    return run.agg(
        ((2 * p * n - lost) / F.nullif(2 * p * n, F.lit(0.0))).alias("auc"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
    )


def roc_curve(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    run, totals = threshold_counts(scored, score, label)
    return run.select(
        F.col("score").alias("threshold"),
        (F.col("tp") / F.nullif(F.lit(totals["pos"]), F.lit(0))).alias("tpr"),
        (F.col("fp") / F.nullif(F.lit(totals["neg"]), F.lit(0))).alias("fpr"),
    )


def pr_curve(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Precision and recall per threshold, and the end point (1, 0) without one."""
    run, totals = threshold_counts(scored, score, label)
    points = run.select(
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.nullif(F.lit(totals["pos"]), F.lit(0))).alias("recall"),
    )
    end = run.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def pr_auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the precision-recall points by trapezoids.

    Each step needs its predecessor only: tp and fp before the step are the
    running totals less the step's own counts. The curve starts at recall 0
    with the first point's precision.
    """
    run, totals = threshold_counts(scored, score, label)
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    here = F.col("tp") / (F.col("tp") + F.col("fp"))
    there = F.when(tp0 + fp0 > 0, tp0 / F.nullif(tp0 + fp0, F.lit(0))).otherwise(here)
    return run.agg(
        (F.sum(F.col("pos") * (here + there) / 2) / F.nullif(F.lit(totals["pos"]), F.lit(0))).alias("pr_auc"))


def errors(scored: DataFrame, truth: str = "rating", score: str = "score", n_all: int | None = None) -> DataFrame:
    """RMSE and MAE over the joined rows; ``rmse_all`` divides by ``n_all`` rows,
    counting those without a prediction too."""
    gap = F.col(score) - F.col(truth)
    squares = F.sum(gap * gap)
    return scored.agg(
        F.sqrt(squares / F.count(F.lit(1))).alias("rmse"),
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(squares / (F.lit(n_all) if n_all else F.count(F.lit(1)))).alias("rmse_all"),
        F.count(F.lit(1)).alias("n"),
    )


def mean_baseline(train: DataFrame, validation: DataFrame, test: DataFrame) -> DataFrame:
    """RMSE on ``test`` of always predicting the mean of train and validation.

    Only the sums of ``test`` are needed, so both sides reduce to one row each.
    """
    mean = train.select("rating").unionByName(validation.select("rating")).agg(
        F.avg("rating").alias("mean_rating")).first()["mean_rating"]
    return test.agg(
        F.lit(mean).alias("mean_rating"),
        F.sqrt(F.sum((F.col("rating") - mean) * (F.col("rating") - mean)) / F.count(F.lit(1))).alias("baseline_rmse"),
    )


def labelled(scores: DataFrame, ratings: DataFrame, threshold: float = 3) -> DataFrame:
    """Scores joined with the held-out ratings and their binary label."""
    truth = ratings.select(
        "user_id", "item_id", "rating", (F.col("rating") >= threshold).cast("int").alias("label"))
    return scores.join(truth, ["user_id", "item_id"])
