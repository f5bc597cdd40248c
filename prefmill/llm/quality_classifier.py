"""Quality classifier with hierarchical empirical Bayes over sites.

A document's evidence is logistic: one weight per hashed word and per shape
feature, for two faults (low quality, toxic), fitted on at most ``max_labels``
labelled rows, chosen by the hash of their id. Sites then lend it a prior: the
rate of each fault per host (``source``) is shrunk to the global rate, the rate
per path (``source``, ``lang``) to its host's, by as many pseudo-documents as the
spread between siblings supports. The rates come from grouped sums over all
documents, each left out of its own site. A document is kept when neither fault's
posterior passes ``limit``.

Null texts count as empty, a null source or lang is a value like others, null and
repeated ids give one row each. Without labels the evidence is 0 everywhere and
everything is kept. Labels with nulls or of unknown ids are not used. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import freeze
from .rows import packed, unpacked

DIM = 1 << 19
FAULTS = ("low", "toxic")
_PUNCT = bytes.maketrans(b".,;:!?\"'()[]", b"            ")
_SHAPES = 64  # places of shape features at the begin of the hash range


def features(text: str) -> np.ndarray:
    """Hashed distinct words and binned shape measures of one text."""
    data = text.encode("utf-8", "surrogatepass")
    raw = data.split()
    words = set(data.lower().translate(_PUNCT).split())
    out = [_SHAPES + zlib.crc32(w) % (DIM - _SHAPES) for w in words]
    n = len(raw)
    if n:
        marked = sum(w[-1] in b"#$%&*<>|!" for w in raw)
        tight = set(raw)
        upper = sum(map(data.count, (b"E", b"A", b"I", b"O", b"N", b"T")))
        lower = sum(map(data.count, (b"e", b"a", b"i", b"o", b"n", b"t")))
        spread = len(tight) / n ** 0.75
        out += [
            int(10 * marked / n), 11 + min(int(4 * math.log2(1 + spread)), 15), 27 + int(10 * upper / max(upper + lower, 1)),
            38 + min(int(math.log2(n)), 15), 54 + int(8 * min(len(data) / n / 16, 1)),
        ]
    return np.unique(np.array(out, np.int32))


def fit(rows: list[np.ndarray], labels: np.ndarray, passes: int = 8, rate: float = 0.5, least: int = 6, z: float = 4.0):
    """Logistic weights (DIM x faults) and biases.

    A feature counts for a fault only if it occurs in ``least`` rows and more or
    less often with the fault than chance allows (``z`` standard errors); the
    many others would only add noise to long texts. Weights start from the
    smoothed log odds of the feature, halved, and go on by adaptive gradient steps.
    """
    faults = labels.shape[1]
    weights, bias = np.zeros((DIM, faults), np.float32), np.zeros(faults)
    if not rows:
        return weights, bias
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    total = np.bincount(flat, minlength=DIM).astype(float)
    used = np.zeros((DIM, faults), bool)
    for k in range(faults):
        share = labels[:, k].mean()
        if not 0 < share < 1:
            bias[k] = 8.0 if share else -8.0
            continue
        bad = np.bincount(flat, labels[owner, k], minlength=DIM)
        spread = np.sqrt(np.maximum(total * share * (1 - share), 1e-9))
        used[:, k] = (total >= least) & (np.abs(bad - total * share) > z * spread)
        odds = np.log((bad + 0.5) / (total - bad + 0.5)) - np.log(share / (1 - share))
        weights[:, k] = np.where(used[:, k], odds / 2, 0)
        bias[k] = np.log(share / (1 - share))
    free = (bias > -8) & (bias < 8)
    rows = [r[used[r].any(1)] for r in rows]
    squares, bias_squares = np.ones((DIM, faults), np.float32), np.ones(faults)
    order = np.random.default_rng(3)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            f = rows[i]
            w = weights[f]
            gap = (1 / (1 + np.exp(-np.clip(w.sum(0) + bias, -30, 30))) - labels[i]) * free
            g = gap * used[f]
            squares[f] += g * g
            weights[f] = w - rate * g / np.sqrt(squares[f])
            bias_squares += gap * gap
            bias -= rate * gap / np.sqrt(bias_squares)
    return weights, bias


def train(docs: DataFrame, labels: DataFrame, max_labels: int = 20000):
    """Weights from a bounded sample: features are made where the texts are, ``max_labels`` short lists reach the driver."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select(
        "doc_id", F.xxhash64("doc_id").alias("_h"), (F.col("quality") == 0).alias("low"), (F.col("toxic") == 1).alias("toxic"))
    chosen = freeze(known.orderBy("_h", "doc_id").limit(max_labels))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([features(t).tobytes() for t in b.column("text").to_pylist()], pa.binary()),
                 b.column("low"), b.column("toxic")], ["f", "low", "toxic"])

    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = text.join(chosen, "doc_id").select("text", "low", "toxic").mapInArrow(run, "f binary, low boolean, toxic boolean")
    got = found.orderBy(F.crc32("f"), "f", "low", "toxic").limit(max_labels).toArrow()  # an id can have many rows
    order = np.argsort(np.array([zlib.crc32(f) for f in got.column("f").to_pylist()], np.int64), kind="stable")
    rows = [np.frombuffer(f, np.int32) for f in got.column("f").to_pylist()]
    y = np.stack([got.column(c).to_numpy().astype(float) for c in FAULTS], 1) if len(rows) else np.zeros((0, 2))
    return fit([rows[i] for i in order], y[order])


def evidence(docs: DataFrame, weights: np.ndarray, bias: np.ndarray) -> DataFrame:
    """All columns plus ``_low`` and ``_toxic``: log odds of each fault from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))  # fixed size: DIM x 2 numbers
    schema = docs.select("*", F.lit(0.0).alias("_low"), F.lit(0.0).alias("_toxic")).schema

    def run(batches):
        w, b0 = shared.value
        for b in batches:
            odds = [w[features(t or "")].sum(0) + b0 for t in b.column("text").to_pylist()]
            odds = np.clip(np.array(odds, np.float64).reshape(-1, 2), -30, 30)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(odds[:, 0]), pa.array(odds[:, 1])], [*b.schema.names, "_low", "_toxic"])

    return docs.mapInArrow(run, schema)


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _pseudo(n: str, total: str, parent: Column) -> Column:
    """How many pseudo-documents a parent's rate is worth: by moments, from the spread of its children's rates."""
    rate = F.col(total) / F.col(n)
    noise = F.sum(parent * (1 - parent))  # expected sum of n (rate - parent)^2 if siblings did not differ
    seen = F.sum(F.col(n) * (rate - parent) * (rate - parent))
    between = F.greatest(seen - noise, F.lit(0.0)) / F.sum(n)
    within = F.max(parent * (1 - parent))
    return F.least(F.greatest(within / F.greatest(between, F.lit(1e-9)), F.lit(2.0)), F.lit(1e6))


def site_rates(scored: DataFrame) -> DataFrame:
    """Per (source, lang): documents, expected faults, and per fault the host's shrunk rate and its worth."""
    p = {f: _logistic(F.col(f"_{f}")) for f in FAULTS}
    path = scored.groupBy("source", "lang").agg(
        F.count("*").cast("double").alias("n"), *[F.sum(p[f]).alias(f"s_{f}") for f in FAULTS])
    path = freeze(path)
    host = freeze(path.groupBy("source").agg(F.sum("n").alias("hn"), *[F.sum(f"s_{f}").alias(f"h_{f}") for f in FAULTS]))
    top = host.agg(F.sum("hn").alias("n"), *[F.sum(f"h_{f}").alias(f) for f in FAULTS]).first()
    rate0 = {f: F.lit(min(max((top[f] or 0.0) / (top["n"] or 1.0), 1e-6), 1 - 1e-6)) for f in FAULTS}
    worth = host.agg(*[_pseudo("hn", f"h_{f}", rate0[f]).alias(f) for f in FAULTS]).first()
    host = host.select("source", *[((F.col(f"h_{f}") + F.lit(worth[f] or 2.0) * rate0[f]) / (F.col("hn") + F.lit(worth[f] or 2.0)))
                                   .alias(f"r_{f}") for f in FAULTS])
    both = freeze(path.join(host.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    inner = both.agg(*[_pseudo("n", f"s_{f}", F.col(f"r_{f}")).alias(f) for f in FAULTS]).first()
    return both.select(
        "source", "lang", "n", *[F.col(c + f) for f in FAULTS for c in ("s_", "r_")],
        *[F.lit(float(inner[f] or 2.0)).alias(f"m_{f}") for f in FAULTS], *[rate0[f].alias(f"g_{f}") for f in FAULTS])


def judge(docs: DataFrame, labels: DataFrame, max_labels: int = 20000, limit: float = 0.5) -> DataFrame:
    """All columns of ``docs`` plus ``p_low``, ``p_toxic`` and ``kept``.

    Two passes over the texts (site sums, then verdicts) and no shuffle of them
    where the site table is small enough to be broadcast by its written size.
    """
    weights, bias = train(docs, labels, max_labels)
    added = [f"p_{f}" for f in FAULTS] + ["kept"]
    docs = docs.drop(*added)
    slim = docs.select("source", "lang", "text")
    sites = freeze(site_rates(evidence(slim, weights, bias).drop("text"))).withColumnsRenamed(
        {c: f"_site_{c}" for c in ("source", "lang", "n", *[k + f for f in FAULTS for k in ("s_", "r_", "m_", "g_")])})
    joined = evidence(packed(docs, F.col("source"), F.col("lang"), apart=("text",)), weights, bias).join(
        sites, F.col("source").eqNullSafe(F.col("_site_source")) & F.col("lang").eqNullSafe(F.col("_site_lang")))
    out = joined
    for f in FAULTS:
        own = _logistic(F.col(f"_{f}"))
        rate = (F.col(f"_site_s_{f}") - own + F.col(f"_site_m_{f}") * F.col(f"_site_r_{f}")) / (
            F.col("_site_n") - 1 + F.col(f"_site_m_{f}"))
        rate = F.least(F.greatest(rate, F.lit(1e-6)), F.lit(1 - 1e-6))
        shift = F.log(rate / (1 - rate)) - F.log(F.col(f"_site_g_{f}") / (1 - F.col(f"_site_g_{f}")))
        out = out.withColumn(f"p_{f}", _logistic(F.col(f"_{f}") + shift))
    kept = (F.col("p_low") <= limit) & (F.col("p_toxic") <= limit)
    return out.withColumn("kept", kept).select(*unpacked(docs.columns, {"text": F.col("text")}), *added)
