"""Two-tower pair model: each side through two normalised layers, the towers summed, two outputs.

A user's and an item's embedding pass dense -> batch norm -> relu twice; both layers of a
tower share the norm's gain and shift. The sum of the towers goes through a dense
layer to the graded like and dislike of the pair; the loss is squared error.

Training is synchronous and data-parallel: pairs are dealt once to numbered
minibatches, written as one folder each, so a step reads its own folder only. A
minibatch is cut into lanes of bounded size; every lane takes its own batch moments
and gradient, gradients are summed over a tree of two levels, and Adam moves
the weights, whose size is fixed, between steps. Lanes and batches hang on hashed
ids and are summed in order, so a rerun gives the same weights.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.prefs import graded_dislike, graded_like
from ..session import freeze, scratch_path
from .pairmodel import Embeddings

LANE = 1 << 15   # pairs whose gradient one task takes at a time
EPS = 1e-5
BETAS = (0.9, 0.999)
MEMORY = 0.9     # of the running moments that scoring uses
LAYERS = [(t, i) for t in "uv" for i in (1, 2)]


@dataclass
class Towers:
    weights: dict[str, np.ndarray]
    moments: dict[str, np.ndarray]   # mean and variance per layer, two rows
    losses: list[float] = field(default_factory=list)


def start(width: int, hidden: int, seed: int = 0) -> dict[str, np.ndarray]:
    """Seeded weights: dense layers uniform within one over the root of their inputs, norms at identity."""
    rng = np.random.default_rng(seed)
    out: dict[str, np.ndarray] = {}
    for name, a, b in (("u1", width, hidden), ("u2", hidden, hidden), ("v1", width, hidden), ("v2", hidden, hidden), ("out", hidden, 2)):
        bound = a ** -0.5
        out[f"{name}.w"], out[f"{name}.b"] = rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)
    for t in "uv":
        out[f"{t}.gain"], out[f"{t}.shift"] = np.ones(hidden), np.zeros(hidden)
    return out


def forward(w: dict, u: np.ndarray, v: np.ndarray, moments: dict | None = None):
    """Outputs (n, 2), and what the way back needs. Without ``moments`` those of the rows are taken."""
    kept, total = {}, 0.0
    for t, x in (("u", u), ("v", v)):
        for i in (1, 2):
            z = x @ w[f"{t}{i}.w"] + w[f"{t}{i}.b"]
            mean, var = (z.mean(0), z.var(0)) if moments is None else moments[f"{t}{i}"]
            unit = (z - mean) / np.sqrt(var + EPS)
            y = unit * w[f"{t}.gain"] + w[f"{t}.shift"]
            kept[t, i] = (x, unit, mean, var, y > 0)
            x = np.maximum(y, 0)
        total = total + x
    kept["sum"] = total
    return total @ w["out.w"] + w["out.b"], kept


def gradients(w: dict, u: np.ndarray, v: np.ndarray, target: np.ndarray):
    """Summed squared error of some pairs, its gradient by weight, and the moments by layer."""
    out, kept = forward(w, u, v)
    gap = out - target
    g = {"out.w": kept["sum"].T @ (2 * gap), "out.b": 2 * gap.sum(0)}
    top = 2 * gap @ w["out.w"].T
    for t in "uv":
        d = top
        for i in (2, 1):
            x, unit, _, var, on = kept[t, i]
            d = d * on
            g[f"{t}.gain"] = g.get(f"{t}.gain", 0) + (d * unit).sum(0)
            g[f"{t}.shift"] = g.get(f"{t}.shift", 0) + d.sum(0)
            d = d * w[f"{t}.gain"]
            d = (d - d.mean(0) - unit * (d * unit).mean(0)) / np.sqrt(var + EPS)
            g[f"{t}{i}.w"], g[f"{t}{i}.b"] = x.T @ d, d.sum(0)
            d = d @ w[f"{t}{i}.w"].T
    return float((gap ** 2).sum()), g, {f"{t}{i}": np.stack(kept[t, i][2:4]) for t, i in LAYERS}


def _flat(parts: dict) -> np.ndarray:
    return np.concatenate([np.asarray(parts[k], float).ravel() for k in sorted(parts)])


def _shaped(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def pair_table(pairs: DataFrame, emb: Embeddings) -> DataFrame:
    """``pairs`` with the two embeddings, ``u`` and ``v``; pairs without both are left out."""
    u = emb.users.select("user_id", F.col("features").cast("array<double>").alias("u"))
    v = emb.items.select("item_id", F.col("features").cast("array<double>").alias("v"))
    return pairs.join(u, "user_id").join(v, "item_id").select(*pairs.columns, "u", "v")


def _matrix(column, n: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1)


SENT = "lane int, n long, loss double, gradient binary, moments binary"


def _lanes(w: dict):
    """Per lane: pairs, loss, summed gradient, and moments times pairs."""
    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            lane = b.column("lane").to_numpy()
            data = np.hstack([_matrix(b.column("u"), len(lane)), _matrix(b.column("v"), len(lane)), _matrix(b.column("y"), len(lane))])
            for k in np.unique(lane):
                held.setdefault(int(k), []).append(data[lane == k])
        for k in sorted(held):
            data = np.concatenate(held.pop(k))
            data = data[np.lexsort(data.T)]  # sums must not hang on the order rows are read in
            width = (data.shape[1] - 2) // 2
            loss, g, m = gradients(w, data[:, :width], data[:, width:-2], data[:, -2:])
            yield pa.RecordBatch.from_pydict({
                "lane": pa.array([k], pa.int32()), "n": pa.array([len(data)], pa.int64()), "loss": [loss],
                "gradient": [_flat(g).tobytes()], "moments": [(len(data) * _flat(m)).tobytes()]})
    return run


def _summed(rows: pa.Table):
    order = np.argsort(rows.column("lane").to_numpy())
    total = [sum(rows.column(c)[i].as_py() for i in order.tolist()) for c in ("n", "loss")]
    vectors = [np.sum([np.frombuffer(rows.column(c)[i].as_py()) for i in order.tolist()], axis=0) for c in ("gradient", "moments")]
    return (*total, *vectors)


def _branch(rows: pa.Table) -> pa.Table:
    n, loss, g, m = _summed(rows)
    return pa.table({"lane": pa.array([int(rows.column("lane").to_numpy().min())], pa.int32()), "n": pa.array([n], pa.int64()),
                     "loss": [loss], "gradient": [g.tobytes()], "moments": [m.tobytes()]})


def fit_towers(train: DataFrame, emb: Embeddings, hidden: int = 128, batch: int = 50, steps: int = 2000, rate: float = 1e-3,
               seed: int = 0, lane: int = LANE) -> Towers:
    """Weights after ``steps`` minibatches of about ``batch`` pairs.

    There are never more minibatches than steps: where ``steps * batch`` pairs do not
    reach all of them, minibatches grow until they do.
    """
    spark = train.sparkSession
    rated = train.select("user_id", "item_id", F.array(graded_like(), graded_dislike()).alias("y"))
    pairs = freeze(pair_table(rated, emb))
    n = pairs.count()
    batches = max(1, min(steps, n // batch))
    lanes = -(-n // (batches * lane)) or 1
    dealt = pairs.select(
        F.pmod(F.xxhash64("user_id", "item_id", F.lit(seed)), F.lit(batches)).cast("int").alias("batch"),
        F.pmod(F.xxhash64("item_id", "user_id", F.lit(seed)), F.lit(lanes)).cast("int").alias("lane"), "u", "v", "y")
    path = scratch_path(spark, "minibatches")
    dealt.repartition("batch", "lane").sortWithinPartitions("batch", "lane").write.partitionBy("batch").parquet(path)
    full = sorted(r["batch"] for r in dealt.select("batch").distinct().collect())  # no more than there are steps
    schema = dealt.drop("batch").schema
    w = start(len(emb.users.first()["features"]) if n else 1, hidden, seed)
    first = {k: np.zeros_like(x) for k, x in w.items()}
    second = {k: np.zeros_like(x) for k, x in w.items()}
    moments = {f"{t}{i}": np.stack([np.zeros(hidden), np.ones(hidden)]) for t, i in LAYERS}
    losses = []
    for step in range(1, steps + 1 if full else 1):
        rows = spark.read.schema(schema).parquet(f"{path}/batch={full[(step - 1) % len(full)]}").mapInArrow(_lanes(w), SENT)
        if lanes > 1:
            rows = rows.groupBy(F.pmod("lane", F.lit(int(np.ceil(lanes ** 0.5))))).applyInArrow(_branch, SENT)
        n_step, loss, g, m = _summed(rows.toArrow())
        g, m = _shaped(g / (2 * n_step), w), _shaped(m / n_step, moments)
        losses.append(loss / (2 * n_step))
        for k in w:
            first[k] = BETAS[0] * first[k] + (1 - BETAS[0]) * g[k]
            second[k] = BETAS[1] * second[k] + (1 - BETAS[1]) * g[k] ** 2
            w[k] = w[k] - rate * (first[k] / (1 - BETAS[0] ** step)) / (np.sqrt(second[k] / (1 - BETAS[1] ** step)) + 1e-8)
        for k in moments:
            moments[k] = m[k] if step == 1 else MEMORY * moments[k] + (1 - MEMORY) * m[k]
    return Towers(w, moments, losses)


def score_towers(model: Towers, pairs: DataFrame, emb: Embeddings) -> DataFrame:
    """``pairs`` with the estimated like as ``score`` and dislike as ``dislike``."""
    data = pair_table(pairs, emb)
    schema = data.drop("u", "v").withColumn("score", F.lit(0.0)).withColumn("dislike", F.lit(0.0)).schema

    def run(batches):
        for b in batches:
            out = np.zeros((0, 2)) if not b.num_rows else forward(
                model.weights, _matrix(b.column("u"), b.num_rows), _matrix(b.column("v"), b.num_rows), model.moments)[0]
            kept = [c for c in b.schema.names if c not in ("u", "v")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(out[:, 0]), pa.array(out[:, 1])],
                                             [*kept, "score", "dislike"])

    return data.mapInArrow(run, schema)
