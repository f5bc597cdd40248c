import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from prefmill.llm import mixing


def uniform(*parts):
    return int(hashlib.md5(":".join(parts).encode()).hexdigest()[:13], 16) / 2.0**52


def poisson(rate, *key):
    parts = max(math.ceil(rate / 16.0), 1)
    total = 0
    for j in range(1, parts + 1):
        u, term = uniform(*key, str(j)), math.exp(-rate / parts)
        run, k = term, 0
        while u >= run and k < 100:
            k += 1
            term *= rate / parts / k
            run += term
            total += 1
    return total


def ident(doc_id, text):
    return f"{'' if doc_id is None else doc_id}:{hashlib.md5((text or '').encode()).hexdigest()}"


SCHEMA = "doc_id long, text string, source string, copy int, _n int"


def test_counts_against_plain_python(spark):
    rows = [(i, "x" * (i % 50 + 1), f"s{i % 3}" if i % 7 else "big", 9, 9) for i in range(400)]
    rows += [(None, "abc", None, 1, 1), (5000, None, "none", 1, 1), (5001, "", "none", 1, 1), (3, "xxxx", "s0", 9, 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    rates = spark.createDataFrame([("s0", 0.3), ("s1", 40.0), ("s2", 1.0), ("big", 2.5), (None, 3.0), ("none", 0.0)], "source string, rate double")
    got = mixing.mix(docs, rates=rates, seed=5)
    rate = {r.source: r.rate for r in rates.collect()}
    want = Counter()
    for d, t, s, *_ in rows:
        want[(d, t, s)] += poisson(rate[s], "5", ident(d, t))
    have = Counter((r.doc_id, r.text, r.source) for r in got.collect())
    assert have == Counter({k: n for k, n in want.items() if n})
    assert {r.copy for r in got.where("doc_id = 1").collect()} == set(range(1, want[(1, "xx", "s1")] + 1))


def test_rates_reach_the_target_shares(spark):
    docs = spark.createDataFrame([(i, "x" * 10, "a" if i % 10 else "b", 0, 0) for i in range(1000)], SCHEMA)
    rate = {r.source: r.rate for r in mixing.source_rates(docs, 0.5, 2.0).collect()}
    a, b = rate["a"] * 9000, rate["b"] * 1000
    assert math.isclose(a + b, 20000, rel_tol=1e-6) and math.isclose(a / b, 3, rel_tol=1e-6)


def test_same_rows_for_another_partitioning_and_a_shuffled_order(spark):
    docs = spark.createDataFrame([(i, f"t{i}", f"s{i % 4}", 0, 0) for i in range(300)], SCHEMA)
    one, two = (sorted((r.doc_id, r.copy, r.shuffle_key) for r in mixing.mix(docs.repartition(n)).collect()) for n in (1, 7))
    assert one == two
    order = [r.doc_id for r in mixing.mix(docs).collect()]
    assert abs(sum(a < b for a, b in zip(order, order[1:])) / len(order) - 0.5) < 0.15


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_of_one_id_draw_apart_and_spread(spark):
    docs = spark.createDataFrame([(i % 2 or None, f"text {i}", "a", 0, 0) for i in range(2000)], SCHEMA)
    got = mixing.mix(docs, rates=spark.createDataFrame([("a", 1.0)], "source string, rate double"))
    counts = Counter(r.text for r in got.collect())
    assert 1800 < sum(counts.values()) < 2200 and set(counts.values()) >= {1, 2, 3}
    assert got.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
