import pytest

from prefmill.sources import store


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(10).write.parquet(path)
    return path


def test_made_once(spark, source, tmp_path):
    made = []

    def make(n=3):
        made.append(n)
        return spark.read.parquet(source).selectExpr("id", f"id * {n} AS value")

    root = str(tmp_path / "kept")
    ask = lambda s=spark, **g: store.kept(s, "t", [source], g, lambda: make(**g), root=root)
    first = ask(n=3)
    assert ask(n=3).schema == first.schema and sorted(ask(n=3).collect()) == sorted(first.collect())
    assert ask(spark.newSession(), n=3).count() == 10  # found by another session
    assert made == [3]
    assert ask(n=4).agg({"value": "sum"}).first()[0] == 180 and made == [3, 4]  # another setting
    spark.range(5).write.mode("append").parquet(source)
    assert ask(n=3).count() == 15 and made == [3, 4, 3]  # a changed input
    store.withdraw(spark, "t", [source], {"n": 3}, root)
    assert ask(n=3).count() == 15 and made == [3, 4, 3, 3]


def test_broken_run_is_not_read(spark, source, tmp_path):
    root = str(tmp_path / "kept")

    def broken():
        return spark.read.parquet(source).selectExpr("CAST(raise_error('stop') AS INT) AS value")

    with pytest.raises(Exception, match="stop"):
        store.kept(spark, "t", [source], {}, broken, root=root)
    mark = store.fingerprint(spark, [source], {})
    spark.range(3).write.parquet(f"{root}/t/data/{mark[:16]}-half")  # data without an entry
    assert store.find(spark, root, "t", mark) is None
    assert store.kept(spark, "t", [source], {}, lambda: spark.range(4), root=root).count() == 4
