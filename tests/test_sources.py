import datetime

from prefmill.operators import graph, points
from prefmill.sources import blocks, sinks, text


def put(tmp_path, name, content, encoding="utf-8"):
    f = tmp_path / name
    f.write_bytes(content.encode(encoding))
    return str(f)


def test_ratings_with_and_without_time(spark, tmp_path):
    got = text.read_ratings(spark, put(tmp_path, "a", "1::10::4.5::978300760\n2::11::0::5\n")).collect()
    assert [tuple(r) for r in got] == [(1, 10, 4.5, 978300760)]
    got = text.read_ratings(spark, put(tmp_path, "b", "0::2::3\n0::3::1\n")).collect()
    assert sorted(tuple(r) for r in got) == [(0, 2, 3.0, None), (0, 3, 1.0, None)]


def test_items_users_tags(spark, tmp_path):
    r = text.read_items(spark, put(tmp_path, "i", '1::"Quoted" Name, The (1995)::Drama|Film-Noir\n')).first()
    assert tuple(r) == (1, '"Quoted" Name, The (1995)', ["Drama", "Film-Noir"])
    r = text.read_users(spark, put(tmp_path, "u", "1::F::1::10::48067\n")).first()
    assert (r["age"], r["occupation"], r["zip"]) == ("Under 18", "K-12 student", "48067")
    r = text.read_tags(spark, put(tmp_path, "t", "15::4973::so good!::1215184630\n")).first()
    assert tuple(r) == (15, 4973, "so good!", 1215184630)


def test_personal_ratings_drop_placeholders(spark, tmp_path):
    path = put(tmp_path, "p", "0::1::?::1400000000::One (1995)\n0::2::4::1400000000::Two\n0::3::5::1400000000\n0::4::0::1400000000\n")
    got = text.read_personal_ratings(spark, path).collect()
    assert sorted((r["item_id"], r["rating"], r["title"]) for r in got) == [(2, 4.0, "Two"), (3, 5.0, None)]


def test_titles_keep_commas_and_latin1(spark, tmp_path):
    path = put(tmp_path, "t", "1,2003,Dinosaur Planet\n2,NULL,Amélie, encore\n", "latin-1")
    got = sorted(tuple(r) for r in text.read_titles(spark, path).collect())
    assert got == [(1, 2003.0, "Dinosaur Planet"), (2, None, "Amélie, encore")]


def test_tab_files_join(spark, tmp_path):
    reg = text.read_registrations(spark, put(tmp_path, "r", "2014-03-02\tab\t1\t33.65\t-117.95\n2014-03-04\tcd\t2\t33.8\t-117.8\n"))
    clk = text.read_clicks(spark, put(tmp_path, "c", "2014-03-04\tab\t11\n"))
    r = reg.join(clk.drop("date"), "uuid").first()
    assert (r["date"], r["customer_id"], r["landing_page"]) == (datetime.date(2014, 3, 2), "1", 11)


def test_edges_rank_and_points_cluster(spark, tmp_path):
    edges = text.read_edges(spark, put(tmp_path, "e", "1 2\n1 3\n1 4\n2 1\n3 1\n4 1\n"))
    ranks = {r["id"]: r["rank"] for r in graph.pagerank(edges, 10).collect()}
    want = {i: 1.0 for i in range(1, 5)}
    for _ in range(10):
        want = {1: .15 + .85 * (want[2] + want[3] + want[4]), **{i: .15 + .85 * want[1] / 3 for i in (2, 3, 4)}}
    assert all(abs(ranks[i] - want[i]) < 1e-9 for i in want)
    pts = text.read_points(spark, put(tmp_path, "k", "0.0 0.0 0.0\n0.1 0.1 0.1\n9.0 9.0 9.0\n9.1 9.1 9.1\n"))
    from pyspark.sql import functions as F
    got = points.kmeans(pts.select(F.col("features")[0].alias("id"), "features"), 2).collect()
    assert len({r["cluster"] for r in got if r["id"] < 1}) == 1 and len({r["cluster"] for r in got}) == 2


def test_blocks_span_many_splits_and_files(spark, tmp_path):
    want, folder = [], tmp_path / "parts"
    folder.mkdir()
    item = 0
    for part in range(2):
        lines = []
        for n in (3, 0, 400, 1, 250):
            item += 3
            lines.append(f"{item}:")
            for k in range(n):
                lines.append(f"{k},{k % 5 + 1},2005-09-06")
                want.append((k, item, float(k % 5 + 1), "2005-09-06"))
        (folder / f"part{part}.txt").write_text("\n".join(lines) + "\n")
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        got = blocks.read_blocks(spark, str(folder))
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved)


def test_block_files_round_trip_with_split_items(spark, tiny, tmp_path):
    rows, df = tiny
    path = str(tmp_path / "out")
    sinks.write_blocks(df, path, piece_rows=4)
    got = blocks.read_blocks(spark, path).collect()
    assert sorted((r["user_id"], r["item_id"], r["rating"]) for r in got) == sorted(r[:3] for r in rows)


def test_reviews_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "rev")
    sinks.write_table(spark.createDataFrame([(3, "x", 1), (5, "y", 2)], "score int, summary string, other int"), path)
    df = text.read_reviews(spark, path)
    assert [tuple(r) for r in df.collect()] == [(5, "y")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Not(EqualTo(score,3))" in plan and "other" not in plan


def test_split_files_by_fold_and_role(spark, tiny, tmp_path):
    from prefmill.operators import splits
    _, df = tiny
    path = str(tmp_path / "folds")
    sinks.write_splits(splits.fold_role(splits.five_fold(df), 2), path)
    back = spark.read.parquet(path)
    assert back.count() == df.count() and {r[0] for r in back.where("role = 'test'").select("fold").distinct().collect()} == {2}
