import numpy as np
import pytest

from prefmill.operators import bounded


def brute(u, v, k, seen, positive):
    out = {}
    for a, x in u.items():
        all_ = [(round(float(np.dot(x, y)), 9), b) for b, y in v.items() if (a, b) not in seen]
        out[a] = sorted([s for s in all_ if s[0] > 0 or not positive], reverse=True)[:k]
    return {a: r for a, r in out.items() if r}


@pytest.mark.parametrize("positive", [False, True])
@pytest.mark.parametrize("bucket,block", [(4096, 4096), (16, 8), (3, 5)])
def test_equals_brute_force(spark, positive, bucket, block):
    rnd = np.random.default_rng(8)
    v = {int(i) * 3: rnd.normal(size=4) * rnd.pareto(1.0) for i in range(120)}
    v[999], v[1002], v[1005] = v[3].copy(), v[3].copy(), np.zeros(4)     # ties and a zero vector
    u = {int(i): rnd.normal(size=4) for i in range(40)}
    u[40] = np.zeros(4)
    strong = sorted(v, key=lambda b: -np.linalg.norm(v[b]))
    seen = {(a, int(b)) for a in range(10) for b in rnd.choice(list(v), 30)} | {(11, b) for b in strong[:100]} | {(12, b) for b in v}
    users = spark.createDataFrame([(a, x.tolist()) for a, x in u.items()] + [(None, [1.0] * 4), (77, None)], "user_id long, features array<double>")
    items = spark.createDataFrame([(b, y.tolist()) for b, y in v.items()] + [(None, [9.0] * 4)], "id long, features array<double>")
    hide = spark.createDataFrame(sorted(seen) + [(0, 123456), (None, 3)], "user_id long, item_id long")
    got = bounded.top_products(users, items, 5, hide, positive, bucket, block)
    rows = {}
    for r in got.table.orderBy("user_id", "rank").collect():
        rows.setdefault(r.user_id, []).append((round(r.score, 9), r.item_id))
    assert rows == brute(u, v, 5, seen, positive)
    assert got.total == len(u) * len(v) and got.done <= got.total


def test_products_are_skipped(spark):
    """With falling norms most buckets are out of every user's reach."""
    rnd = np.random.default_rng(9)
    items = spark.createDataFrame([(i, (rnd.normal(size=4) / (1 + i)).tolist()) for i in range(600)], "id long, features array<double>")
    users = spark.createDataFrame([(i, rnd.normal(size=4).tolist()) for i in range(100)], "user_id long, features array<double>")
    got = bounded.top_products(users, items, 3, bucket=20, block=10)
    assert got.table.count() == 300 and got.done < 0.35 * got.total


def test_empty(spark):
    users = spark.createDataFrame([(1, [1.0])], "user_id long, features array<double>")
    items = spark.createDataFrame([], "id long, features array<double>")
    assert bounded.top_products(users, items, 3).table.count() == 0
    assert bounded.top_products(users.where("user_id > 5"), items, 3).table.count() == 0


def test_a_user_travels_once_a_strip_of_buckets(spark, monkeypatch):
    rnd = np.random.default_rng(12)
    u, v = ({i: rnd.normal(size=4) for i in range(n)} for n in (40, 120))
    users, items = (spark.createDataFrame([(i, x.tolist()) for i, x in m.items()], f"{c} long, features array<double>")
                    for m, c in ((u, "user_id"), (v, "id")))
    groups, real = [], bounded.tasks_for
    monkeypatch.setattr(bounded, "GROUPS", 1, raising=False)
    monkeypatch.setattr(bounded, "tasks_for", lambda spark, n, *a: groups.append(n) or real(spark, n, *a))
    got = bounded.top_products(users, items, 5, bucket=3, block=5)
    rows = {}
    for r in got.table.orderBy("user_id", "rank").collect():
        rows.setdefault(r.user_id, []).append((round(r.score, 9), r.item_id))
    assert rows == brute(u, v, 5, set(), False)
    assert len(groups) == 1 and groups[0] <= 8  # blocks of 5 users, each with all buckets it needs
