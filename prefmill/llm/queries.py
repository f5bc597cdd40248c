"""Registered queries of the text operators: each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    bm25, collocation, debruijn_dedup, filter_audit, line_dedup, mixing, pieces, ppm, quality_classifier, quality_rules,
    secret_scan, simhash, suffix_dedup)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query
def op1_randomness_battery(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every whole text, by pattern and by randomness."""
    return secret_scan.scan(documents(spark, folder), q=0.1)


@query
def op3_poisson_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The whole corpus at source shares to the power 0.7, as many characters as before."""
    return mixing.mix(documents(spark, folder), power=0.7, budget=1.0, seed=7)


@query
def op7_gumbel_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Two distinct segmentations of every whole text."""
    return pieces.encode(documents(spark, folder), k=2, seed=11)


@query
def op9_compression_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, base rules and compression verdict of every document."""
    return quality_rules.judge(documents(spark, folder))


@query
def op10_site_bayes(spark: SparkSession, folder: str) -> DataFrame:
    """Posterior of both faults and verdict for every document."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return quality_classifier.judge(documents(spark, folder), labels).select("doc_id", "p_low", "p_toxic", "kept")


@query
def op8_deletion_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its lines that occur nowhere earlier, exactly or within one word."""
    return line_dedup.dedup(documents(spark, folder), min_words=8).select("doc_id", "text", "n_lines", "n_removed")


@query
def op5_covering_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(documents(spark, folder), limit=4)


@query
def op2_deep_shallow(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document left after strings of 50 bytes of smaller documents are taken out."""
    return suffix_dedup.dedup(documents(spark, folder), width=50).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_debruijn_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document left after 13-word windows of smaller documents are taken out."""
    return debruijn_dedup.dedup(documents(spark, folder), width=13).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_blockmax_bm25(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best other documents for every document whose id is divisible by 100, as a query of its whole text."""
    docs = documents(spark, folder)
    return bm25.search(docs, docs.where("doc_id % 100 = 0"), k=10)


@query
def op13_removal_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove from every language in each of their 120 orders."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return filter_audit.audit(filter_audit.classes(documents(spark, folder), labels))


@query
def op12_multikey_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2000 collocations of every language over all whole texts."""
    return collocation.mine(documents(spark, folder), least=30, top=2000)


@query
def op11_partial_matching(spark: SparkSession, folder: str) -> DataFrame:
    """Every whole text scored by contexts of four bytes, learnt from nine of ten documents."""
    return ppm.score(documents(spark, folder), ppm.nine_of_ten(), order=4)
