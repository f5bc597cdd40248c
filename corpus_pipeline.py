"""From raw documents to sampled token sequences, as stages over written tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from prefmill.llm import line_dedup, mixing, pieces, quality_classifier, simhash
from prefmill.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.judge(docs, labels).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each line only where it stands first; n_chars follows the text."""
    out = line_dedup.dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates: four-word shingles, fingerprints at four bits or fewer."""
    return simhash.keep_one(docs, limit=4).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought closer to each other by repetition, shuffled."""
    return mixing.mix(docs, power=0.7, budget=1.0, seed=7).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every text."""
    return pieces.encode(docs, k=2, seed=11)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]
ORACLE_SQL = None  # fitted models, seeded noise and 64-bit hashes are not in SQL's reach; tests hold it against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
