import numpy as np
import pyarrow as pa
import pytest

from prefmill.operators import extremes, factor
from prefmill.operators.scale import Span


def table(spark, m):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, features array<double>")


def brute(u, v, positive):
    m = (u @ v.T).ravel()
    m = m[m > 0] if positive else m
    return (m.min(), m.max()) if len(m) else (0.0, 0.0)


@pytest.mark.parametrize("positive", [False, True])
@pytest.mark.parametrize("kind,block", [("mixed", 4096), ("mixed", 3), ("sparse", 5), ("heavy", 16), ("negative", 7)])
def test_equals_brute_force(spark, kind, block, positive):
    rnd = np.random.default_rng(5)
    u, v = rnd.normal(size=(90, 4)), rnd.normal(size=(40, 4))
    if kind == "sparse":
        u, v = np.abs(u) * (rnd.random(u.shape) < 0.4), np.abs(v) * (rnd.random(v.shape) < 0.4)
    if kind == "heavy":
        u, v = np.abs(u) * rnd.pareto(1.0, (90, 1)), np.abs(v) * rnd.pareto(1.0, (40, 1))
    if kind == "negative":
        u, v = np.abs(u) + 0.1, -np.abs(v) - 0.1
    got = extremes.product_extremes(table(spark, u), table(spark, v), positive, block)
    low, high = brute(u, v, positive)
    assert np.isclose(got.span.low, low, rtol=1e-12) and np.isclose(got.span.high, high, rtol=1e-12)
    assert got.opened <= got.pairs == -(-90 // block) * -(-40 // block)


def test_bounds_hold(spark):
    rnd = np.random.default_rng(6)
    boxes, blocks = [], []
    for side in range(2):
        parts = [rnd.normal(loc=rnd.normal(size=3), scale=s, size=(5, 3)) * (rnd.random((5, 3)) < 0.7) for s in (0, 0.1, 1, 3)]
        parts += [np.abs(p) for p in parts]
        rows = [extremes._box(pa.table({"block": [i] * 5, "features": p.tolist()})) for i, p in enumerate(parts)]
        boxes.append(extremes._Boxes.of(pa.concat_tables(rows)))
        blocks.append(parts)
    low, high = extremes.bounds(*boxes)
    for i, a in enumerate(blocks[0]):
        for j, b in enumerate(blocks[1]):
            m = a @ b.T
            assert m.max() <= high[i, j]
            whole = (a >= 0).all() and (b >= 0).all()
            m = m[m > 0] if whole else m
            assert not m.size or m.min() >= low[i, j] - 1e-12


def test_few_pairs_are_opened(spark):
    """Where norms differ widely, the extremes lie in few pairs of blocks."""
    rnd = np.random.default_rng(7)
    u, v = np.abs(rnd.normal(size=(800, 4))) / (1 + np.arange(800))[:, None], np.abs(rnd.normal(size=(400, 4))) / (1 + np.arange(400))[:, None]
    got = extremes.product_extremes(table(spark, u), table(spark, v), True, 10)
    low, high = brute(u, v, True)
    assert np.isclose(got.span.low, low) and np.isclose(got.span.high, high)
    assert got.pairs == 3200 and got.opened < 0.1 * got.pairs


def test_empty_null_and_repeated(spark):
    u, none = table(spark, np.ones((3, 2))), table(spark, np.ones((0, 2)))
    assert extremes.product_extremes(u, none) == extremes.Extremes(Span(0.0, 0.0), 0, 0)
    odd = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [2.0, 2.0]), (3, [2.0, 2.0])], "id long, features array<double>")
    assert extremes.product_extremes(odd, u, block=1).span == Span(4.0, 4.0)


def test_span_is_the_same_by_bounds_and_by_all_pairs(spark):
    rnd = np.random.default_rng(10)
    u, v = table(spark, rnd.normal(size=(60, 3))), table(spark, rnd.normal(size=(50, 3)))
    few, many = factor.product_span(u, v, block=30), factor.product_span(u, v, block=5)
    assert -(-60 // 30) * -(-50 // 30) <= factor.ONE_JOB < 12 * 10
    assert np.isclose(few.low, many.low, rtol=1e-12) and np.isclose(few.high, many.high, rtol=1e-12)


@pytest.mark.parametrize("positive", [False, True])
def test_tiles_equal_brute_force_and_ship_a_block_once(spark, monkeypatch, positive):
    rnd = np.random.default_rng(11)
    u, v = rnd.normal(size=(90, 4)), rnd.normal(size=(40, 4))
    monkeypatch.setattr(extremes, "FIRST", ())
    monkeypatch.setattr(extremes, "TILE", 20)
    monkeypatch.setattr(extremes, "WIDE", 7)
    shipped, real = [], extremes._by_tiles

    def by_tiles(sides, pairs, blocks, positive):
        shipped.append((blocks, pairs.count()))
        return real(sides, pairs, blocks, positive)

    monkeypatch.setattr(extremes, "_by_tiles", by_tiles)
    got = extremes.product_extremes(table(spark, u), table(spark, v), positive, 5)
    low, high = brute(u, v, positive)
    assert shipped == [(4, got.opened)] and got.opened > 4
    assert np.isclose(got.span.low, low, rtol=1e-12) and np.isclose(got.span.high, high, rtol=1e-12)
