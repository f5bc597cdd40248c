"""Jobs make what their settings share once, and score two halves in one pass."""

import numpy as np
from pyspark.sql import functions as F

from prefmill.operators import cells as C, factor, nmf, pairmodel, scale
from prefmill.operators.scale import Span
from prefmill.plans import jobs, queries as Q
from prefmill.session import freeze


def counted(monkeypatch, module, name):
    calls, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **b: (calls.append(name), real(*a, **b))[1])
    return calls


def test_neg_blend_makes_its_matrix_once_and_fits_each_setting_once(spark, tiny, monkeypatch):
    made, fits, spans = (counted(monkeypatch, m, n) for m, n in (
        (C, "binary_propagation"), (factor, "als_fit"), (factor, "product_span")))
    got = {r["metric"]: r["value"] for r in jobs.neg_blend(
        spark, tiny[1], ranks=(2,), regs=(0.1,), iters=(1, 2), nmf_ranks=(2,), nmf_rounds=(1, 2)).collect()}
    assert len(made) == 1 and len(fits) == 2
    assert len(spans) == 2 * 2 + 2 * 2  # two halves of two models by ALS and of two by NMF, however often they score
    assert 0 <= got["als_test_auc"] <= 1 and 0 <= got["nmf_test_auc"] <= 1


def test_two_halves_in_one_pass_equal_two_passes(spark):
    rng = np.random.default_rng(3)
    un, uf, vn, vf = (rng.normal(size=(5, 2)).tolist() for _ in range(4))
    uf[1] = vf[2] = None  # the far half does not know them
    table = lambda name, near, far: spark.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(zip(near, far))], f"{name} long, near array<double>, far array<double>")
    pairs = spark.range(36).select(F.expr("id div 6").alias("user_id"), (F.col("id") % 6).alias("item_id"))  # 5 is unknown to both
    halves = factor.Halves(table("user_id", un, uf), table("item_id", vn, vf), Span(0.1, 2.0), Span(0.5, 0.5))
    got = {(r["user_id"], r["item_id"]): r["score"] for r in factor.blend_pairs(pairs, halves, 2, -0.5).collect()}
    assert len(got) == 25
    for (u, v), score in got.items():
        near = np.dot(un[u], vn[v])
        far = np.dot(uf[u], vf[v]) if uf[u] and vf[v] else 0.0
        assert np.isclose(score, ((near - 0.1) / 1.9 if near > 0 else 0.0) - 0.5 * (far > 0))


def test_embeddings_multiply_the_ratings_once(spark, tiny, monkeypatch):
    r = tiny[1]
    pos = nmf.nmf_fit(freeze(scale.minmax_positive(freeze(C.item_gram(r)))), 2, 1)
    neg = Q._graded_cross_nmf(r, r, 2, 1)
    want = pairmodel.two_sided_embeddings(C.graded(r), pos.rows, pos.cols, neg.rows, neg.cols, 2)
    made = counted(monkeypatch, C, "item_gram")
    got = Q._embeddings(r, r, 2, 1)
    assert len(made) == 1  # both sides are factored from the same S
    for a, b, name in ((got.users, want.users, "user_id"), (got.items, want.items, "item_id")):
        a, b = ({x[name]: x["features"] for x in t.collect()} for t in (a, b))
        assert a.keys() == b.keys() and all(np.allclose(a[i], b[i]) for i in a)
