"""Operators: golden cases, properties, and strategies against each other."""

import csv

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.operators import clusters as C
from sievework.operators import components, keyed, ranking, similarity
from sievework.operators.components import connected_components, local_roots
from sievework.operators.folders import outcomes
from sievework.operators.numbering import number_rows
from sievework.operators.report import COLUMNS, copy_ranked, report, write_folder_reports, write_report_file, write_report_folder
from sievework.operators.similarity import similar_links, similar_pairs

SF = "/root/testdata/sf0.001"


def brute(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(a) for a in range(n)]


def frame(spark, links):
    return spark.createDataFrame(links, "a long, b long")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_components_equal_union_find(spark, links):
    want = brute(31, links)
    got = {r.node: r.component for r in connected_components(frame(spark, links)).collect()}
    for i in range(31):
        assert got.get(i, i) == want[i]
    a, b = np.array(links).T
    assert local_roots(31, a, b).tolist() == want


@pytest.mark.parametrize("hub_links", [4_000_000, 0])  # 0: minima are written first
def test_components_of_long_chain_and_hub(spark, monkeypatch, hub_links):
    monkeypatch.setattr(components, "HUB_LINKS", hub_links)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(frame(spark, links)).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[1000 + i] == 1000 for i in range(1, 300))


def test_components_edge_cases(spark):
    assert connected_components(frame(spark, [])).count() == 0
    assert connected_components(frame(spark, [(None, 1), (2, None), (3, 3)])).count() == 0


@pytest.fixture(scope="module")
def emb(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def pairs_of(df):
    return sorted((r.i, r.j, round(r.sim, 9)) for r in df.collect())


def test_tiles_equal_expression_at_any_block_size(emb):
    want = pairs_of(similar_pairs(emb, 0.4, method="expression"))
    assert want
    for block in (64, 100, 2048):
        assert pairs_of(similar_pairs(emb, 0.4, block=block)) == want
    inside = similar_pairs(emb, 0.3, within="label", block=16).select("label", "i", "j").collect()
    assert sorted(inside) == sorted(similar_pairs(emb, 0.3, within="label", method="expression").select("label", "i", "j").collect())


def test_links_connect_what_pairs_connect(emb):
    a = sorted(connected_components(similar_pairs(emb, 0.35).select("i", "j")).collect())
    assert a == sorted(connected_components(similar_links(emb, 0.35, block=100)).collect())


def test_a_hot_folder_does_not_multiply_the_rows_of_others(spark):
    """One folder of 200 rows and 100 of three: blocks of 20 rows copy only the rows of the large one."""
    rng = np.random.default_rng(6)
    rows = [(i, 0 if i < 200 else i, rng.normal(size=4).tolist()) for i in range(200)] + [(200 + i, 1 + i // 3, rng.normal(size=4).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, folder long, embedding array<double>")
    df = df.withColumn("folder", F.when(F.col("vec_id") < 200, F.lit(0)).otherwise(F.col("folder")))
    tiles, _ = similarity._tiles(df, "vec_id", "embedding", "folder", 20)
    copies = {r.folder: r.n for r in tiles.groupBy("folder").agg((F.count("*") / F.count_distinct("id")).alias("n")).collect()}
    assert copies.pop(0) == 10 and set(copies.values()) == {1}
    want = sorted(similar_pairs(df, 0.8, within="folder", method="expression").select("folder", "i", "j").collect())
    assert want and sorted(similar_pairs(df, 0.8, within="folder", block=20).select("folder", "i", "j").collect()) == want


def test_similarity_edge_cases(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert pairs_of(similar_pairs(rows, 0.92)) == [(1, 2, 1.0)]
    assert similar_pairs(rows.where("false"), 0.92).count() == 0
    with pytest.raises(ValueError):
        similar_pairs(rows, 0.9, method="guess")


def test_clusters(spark):
    items = spark.createDataFrame([(i,) for i in range(7)], "vec_id long")
    rooted = C.roots(items, frame(spark, [(1, 4), (4, 2), (0, 5)]))
    numbered = C.clusters(rooted)
    assert sorted(map(tuple, numbered.collect())) == [(0, 0, 2), (1, 1, 3)]
    assert sorted((r.cluster_id, r.representative, r.members) for r in C.member_lists(rooted, numbered).collect()) == [(0, 0, [0, 5]), (1, 1, [1, 2, 4])]
    first = C.first_members(rooted)
    assert sorted(map(tuple, C.unique_items(first).collect())) == [(0, 0), (1, 1), (3, 2), (6, 3)]
    assert sorted(map(tuple, C.duplicates(rooted, numbered, first).collect())) == [(0, 5), (1, 2), (1, 4)]
    scores = spark.createDataFrame([(1, 3.0), (2, 7.0), (4, 7.0)], "vec_id long, score double")
    best = {r.root: r.representative for r in C.best_members(rooted, scores).collect()}
    assert best == {0: 0, 1: 2, 3: 3, 6: 6}
    assert {r.vec_id: r.cluster_id for r in C.cluster_of(items, rooted, numbered).collect()} == {0: 0, 1: 1, 2: 1, 3: None, 4: 1, 5: 0, 6: None}


def test_ranks_keep_input_order_on_ties(spark):
    rows = spark.createDataFrame([(0, 5.0), (1, 9.0), (2, 9.0), (3, 1.0)], "id long, final double")
    got = ranking.ranked_top(rows, 3, F.col("final"), F.col("id"))
    assert [(r.id, r.rank) for r in got.orderBy("rank").collect()] == [(1, 1), (2, 2), (0, 3)]
    assert ranking.ranked_top(rows, 0, F.col("final"), F.col("id")).count() == 0
    assert ranking.ranked_top(rows, 99, F.col("final"), F.col("id")).count() == 4
    with pytest.raises(ValueError):
        ranking.top(rows, -1, F.col("final"), F.col("id"))


def test_statistics(spark):
    rows = spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0, 10.0)], "s double")
    assert tuple(ranking.statistics(rows, "s").first()) == (4.25, 3.491060010942235, 1, 10, 3)
    assert tuple(ranking.statistics(rows.where("false"), "s").first()) == (None,) * 5


def test_output_names_and_collisions(spark):
    rows = spark.createDataFrame([(i, f"IMG{i % 5}.jpg") for i in range(1, 13)], "rank int, name string")
    names = {r.rank: r.output_name for r in ranking.output_names(rows, F.col("name")).collect()}
    assert names[3] == "03_IMG3.jpg" and names[12] == "12_IMG2.jpg"
    assert ranking.collisions(rows, F.col("name")).count() == 5


def test_numbering_is_gapless_over_partitions(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x")).repartition(13)
    got = number_rows(rows, [F.col("x")], "n", first=1).collect()
    assert len(got) == 5000 and all(r.n == r.x + 1 for r in got)


def test_keyed(spark):
    old = spark.createDataFrame([(1, "a"), (2, "a")], "k long, v string")
    new = spark.createDataFrame([(2, "b"), (3, "b")], "k long, v string")
    assert sorted(map(tuple, keyed.merged(old, new, "k").collect())) == [(1, "a"), (2, "b"), (3, "b")]
    assert [r.k for r in keyed.remaining(spark.range(1, 6).withColumnRenamed("id", "k"), old, new, "k").orderBy("k").collect()] == [4, 5]
    done = spark.createDataFrame([(True,), (False,), (True,)], "success boolean")
    assert tuple(outcomes(done).first()) == (2, 1)


SCORED = "path string, aesthetic_score double, composition_score double, final_score double, cluster_id long, selected boolean, rank int"


def test_report(spark, tmp_path):
    rows = spark.createDataFrame([('/p/a,"b".jpg', 2.675, 0.0, 9.0, 0, True, 1), ("/p/b.jpg", 1.005, None, 8.0, None, False, None), ("/p/c.jpg", 5.0, 7.0, 7.0, 3, False, None)], SCORED)
    got = [tuple(r) for r in report(rows.orderBy(F.desc("final_score"))).collect()]
    assert got[0] == ("1", 'a,"b".jpg', '/p/a,"b".jpg', "2.67", "", "9.00", "0", "yes")
    assert got[1] == ("", "b.jpg", "/p/b.jpg", "1.00", "", "8.00", "", "no")
    order = [F.col("final_score").desc()]
    write_report_file(rows, str(tmp_path / "report.csv"), order)
    with open(tmp_path / "report.csv", newline="") as f:
        lines = list(csv.reader(f))
    assert tuple(lines[0]) == COLUMNS and lines[1:] == [list(r) for r in got]
    write_report_folder(rows, f"file://{tmp_path}/report", order)
    parts = b"".join(p.read_bytes() for p in sorted((tmp_path / "report").glob("part-*")))
    assert parts.count(b"\r\n") >= 4 and set((tmp_path / "report.csv").read_bytes().split(b"\r\n")) == set(parts.split(b"\r\n"))


def test_reports_of_folders(spark, tmp_path):
    rows = [(f"/p/{k}/i{n}.jpg", float(n), None, float(n % 7), None, n < 2, n + 1 if n < 2 else None, f"/p/{k}", k, n) for k in ("a", "b/c", "") for n in range(40)]
    df = spark.createDataFrame(rows, SCORED + ", folder string, place string, item long")
    done = write_folder_reports(df.repartition(6), "folder", "place", str(tmp_path), [F.col("final_score").desc(), F.col("item")])
    assert sorted((r.folder, r.error) for r in done.collect()) == [("/p/", None), ("/p/a", None), ("/p/b/c", None)]
    for place in ("a", "b/c", ""):
        with open(tmp_path / place / "report.csv", newline="") as f:
            lines = list(csv.DictReader(f))
        assert len(lines) == 40 and [float(x["final_score"]) for x in lines] == sorted((float(n % 7) for n in range(40)), reverse=True)
    assert not [p for p in tmp_path.rglob("*.tmp")]


def test_copies(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"x")
    named = spark.createDataFrame([(str(tmp_path / "a.jpg"), "1_a.jpg"), (str(tmp_path / "none.jpg"), "2_none.jpg")], "path string, output_name string")
    got = {r.target: r.error for r in copy_ranked(named, str(tmp_path / "out")).collect()}
    assert (tmp_path / "out" / "1_a.jpg").read_bytes() == b"x" and got[str(tmp_path / "out" / "1_a.jpg")] is None and got[str(tmp_path / "out" / "2_none.jpg")]
    with pytest.raises(ValueError):
        copy_ranked(named.withColumn("output_name", F.lit("same")), str(tmp_path / "out"))
