"""Sources, cache, phases, inference, streaming, whole culls and the command line."""

import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sievework import infer
from sievework.config import CullConfig
from sievework.plans import catalogue
from sievework.plans import cull as K
from sievework.sources import images
from sievework.sources.cache import append_cache, read_cache
from sievework.sources.phases import Phases
from sievework.streaming.ingest import ingest, ingested, watch_files

SF = "/root/testdata/sf0.001"
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors cannot import test modules


@pytest.fixture
def photos(tmp_path):
    root = tmp_path / "photos"
    for name, content in {"a.jpg": b"1", "b.JPG": b"2", "c.txt": b"3", "trip/d.png": b"1", "trip/e.Jpg": b"broken", ".hidden/f.jpg": b"4", "none/g.txt": b"5"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)
    return root


def embedder():
    return lambda batch: [[float(b[0]), 1.0, 0.0, 0.0] for b in batch]


def test_discovery_and_folders(spark, photos):
    found = images.discover(spark, f"file://{photos}").orderBy("ord").collect()
    assert [r.path for r in found] == [str(photos / x) for x in (".hidden/f.jpg", "a.jpg", "b.JPG", "trip/d.png", "trip/e.Jpg")] and [r.ord for r in found] == [0, 1, 2, 3, 4]
    assert images.discover(spark, str(photos), hidden=False).count() == 4 and images.discover(spark, str(photos), (".txt",)).count() == 2
    assert images.list_files(spark, str(photos)).count() == 7
    folders = images.image_folders(images.list_files(spark, str(photos)), str(photos)).orderBy("ord").collect()
    assert [(r.rel_path, r.n) for r in folders] == [("(root)", 2), ("trip", 2)]
    with pytest.raises(NotADirectoryError):
        images.list_files(spark, str(photos / "a.jpg"))


def test_listing_does_not_read_contents(spark, photos):
    plan = images.read_files(spark, f"file://{photos}").select("path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_decode_keeps_errors_as_rows(spark, photos):
    def decoder(content):
        if content == b"broken":
            raise ValueError
        return content

    good, bad = images.split_errors(images.decode(images.read_files(spark, f"file://{photos}"), decoder))
    assert good.count() == 5 and [(r.path.rpartition("/")[2], r.error) for r in bad.collect()] == [("e.Jpg", "Failed to load")]


def test_cache_and_embedding(spark, photos, tmp_path):
    files = images.read_files(spark, f"file://{photos}").where(images.supported(F.col("path"))).select("path", "content")
    hashed = files.withColumn("content_hash", images.content_hash(F.col("content")))
    cache = f"file://{tmp_path}/cache"
    assert read_cache(spark, cache).count() == 0
    assert infer.embed_with_cache(hashed, embedder, cache).where("error IS NULL").count() == 4
    assert read_cache(spark, cache).count() == 3  # two files are equal

    def fail():
        raise AssertionError("all is cached")

    assert infer.embed_with_cache(hashed, fail, cache).count() == 4
    append_cache(read_cache(spark, cache).select("content_hash", "embedding"), cache)
    assert read_cache(spark, cache).count() == 3


def test_batches_shrink_when_memory_runs_out():
    sizes = []

    def model(batch):
        sizes.append(len(batch))
        if len(batch) > 2:
            raise MemoryError
        return [[1.0]] * len(batch)

    assert len(infer.in_batches(model, [b""] * 5, 8)) == 5 and max(s for s in sizes if s <= 2) == 2
    with pytest.raises(MemoryError):
        infer.in_batches(lambda b: (_ for _ in ()).throw(MemoryError), [b""], 4)


def test_broken_images_are_rows(spark):
    def model(batch):
        if b"broken" in batch:
            raise ValueError("not an image")
        return [[float(len(b)), 0.0] for b in batch]

    assert infer.in_batches(model, [b"a", b"broken", b"bb", b"broken"], 3) == [[1.0, 0.0], None, [2.0, 0.0], None]
    rows = spark.createDataFrame([("1", bytearray(b"a")), ("2", bytearray(b"broken"))], "content_hash string, content binary")
    got = {r.content_hash: (r.embedding, r.error) for r in infer.embed(rows, lambda: model).collect()}
    assert got == {"1": ([1.0, 0.0], None), "2": (None, infer.EMBED_FAILED)}


def test_analysis(spark):
    rows = spark.createDataFrame([("a", b"good"), ("b", b"bad"), ("c", None)], "path string, content binary")

    def make():
        def ask(image):
            if image == b"bad":
                raise OSError
            return "I give it 8/10"

        return ask

    assert {r.path: r.score for r in infer.analyze(rows, make, delay=0).collect()} == {"a": 8, "b": 5, "c": 5}
    assert {r.score for r in infer.analyze(rows, None).collect()} == {5}
    assert not infer.server_has_model("http://127.0.0.1:1", "model:7b", timeout=0.2)
    assert infer.base_name("model:7b") == "model" and infer.preview("x" * 300) == "x" * 100 and infer.preview(None) == ""
    spread = spark.range(800).select(F.concat(F.lit("p"), "id").alias("path"), F.lit(None).cast("binary").alias("content"))
    assert infer.analyze(spread, make, concurrency=4).rdd.getNumPartitions() == 4


def test_phases_resume_and_are_keyed(spark, tmp_path):
    phases, calls = Phases(spark, f"file://{tmp_path}", CullConfig().run_id("a")), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert phases.phase("discovered", build).count() == phases.phase("discovered", build).count() == 3 and len(calls) == 1
    assert {r.phase: (r.complete, r.n) for r in phases.summary().collect()}["discovered"] == (True, 3)
    assert not Phases(spark, f"file://{tmp_path}", CullConfig(target=1).run_id("a")).complete("discovered")
    phases.delete()
    assert not phases.complete("discovered")


def test_partly_written_phase_does_not_count(spark, tmp_path):
    phases = Phases(spark, f"file://{tmp_path}", "run")
    os.makedirs(tmp_path / "run" / "scored")
    assert not phases.complete("scored") and phases.phase("scored", lambda: spark.range(2)).count() == 2


def test_stream_ingests_each_file_once(spark, photos, tmp_path):
    args = (embedder, f"file://{tmp_path}/cache", f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    ingest(watch_files(spark, f"file://{photos}"), *args).awaitTermination()
    assert ingested(spark, args[2]).count() == 4
    (photos / "new.jpg").write_bytes(b"9")
    ingest(watch_files(spark, f"file://{photos}"), *args).awaitTermination()
    assert ingested(spark, args[2]).count() == 5


def test_best_representatives_and_folders(spark):
    items = spark.read.parquet(f"{SF}/embeddings.parquet")
    best = K.cull(items, CullConfig(similarity_threshold=0.4, target=20, representative="best"), catalogue.score)
    first = K.cull(items, CullConfig(similarity_threshold=0.4, target=20), catalogue.score)
    a, b = ({r.root: r.aesthetic for r in x.scored.collect()} for x in (best, first))
    assert a.keys() == b.keys() and all(a[k] >= b[k] for k in a) and any(a[k] > b[k] for k in a)
    assert [r.rank for r in best.selected.orderBy("rank").collect()] == list(range(1, 21))
    assert K.cull(items, CullConfig(), catalogue.score).clusters.count() == 0  # nothing is that similar


def test_result_does_not_depend_on_partitions(spark):
    items = spark.read.parquet(f"{SF}/embeddings.parquet")
    config = CullConfig(similarity_threshold=0.4, target=10)
    runs = [sorted((r.rank, r.vec_id) for r in K.cull(x, config, catalogue.score).selected.collect()) for x in (items, items.repartition(7))]
    assert runs[0] == runs[1]


def test_scope(spark):
    files = spark.createDataFrame([("/p/a.jpg",), ("/p/q/b.jpg",)], "path string")
    folders = spark.createDataFrame([("/p",), ("/p/q",)], "folder string")
    count = lambda scope: sorted((r.folder, r["count"]) for r in K.in_scope(files, F.col("path"), folders, scope).groupBy("folder").count().collect())
    assert count("recursive") == [("/p", 2), ("/p/q", 1)] and count("direct") == [("/p", 1), ("/p/q", 1)]


def test_empty_input(spark):
    items = spark.read.parquet(f"{SF}/embeddings.parquet").where("false")
    result = K.cull(items, CullConfig(), catalogue.score)
    assert result.selected.count() == result.scored.count() == 0
