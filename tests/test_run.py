"""Whole runs from files to copies and reports: resume, failures, scopes, pixels, and the command line."""

import base64
import csv
import json
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework import cli, infer
from sievework.config import CullConfig
from sievework.plans.run import BatchRun, CullRun, Models, NoImages, read_weights
from sievework.sources import images, pixels
from sievework.sources.shared import shared_dir
from sievework.sources.state import read_state, state_tables, write_state

#: Stand-ins in a module that workers import: an image's embedding is its mean colour, its score the height of its red; calls are counted.
MODELS = """
    import os, struct, zlib

    def _said(where, n):
        with open(os.path.join({folder!r}, where), "a") as f:
            f.write("x" * n)

    def embedder():
        def model(batch):
            _said("embedded", len(batch))
            if any(b[:4] != b"\\x89PNG" for b in batch):
                raise ValueError("not an image")
            out = []
            for b in batch:
                w, h = struct.unpack(">II", b[16:24])
                n, = struct.unpack(">I", b[33:37])
                rows = zlib.decompress(b[41:41 + n])
                px = [rows[y * (1 + 3 * w) + 1:(y + 1) * (1 + 3 * w)] for y in range(h)]
                out.append([sum(r[c::3][x] for r in px for x in range(w)) / (w * h * 255) - 0.5 for c in range(3)])
            return out
        return model

    def analyzer():
        import base64
        def ask(image):
            _said("asked", 1)
            size = struct.unpack(">II", base64.b64decode(image)[16:24])
            return "7" if max(size) <= 1024 else "size is wrong"
        return ask
"""


def image(red, green, blue, size=(8, 6)):
    return pixels.png(np.full((size[1], size[0], 3), (red, green, blue), np.uint8))


@pytest.fixture
def photos(tmp_path):
    root = tmp_path / "photos"
    colours = {
        "a.png": (250, 10, 10), "b.PNG": (250, 12, 10), "c.png": (10, 250, 10), "d[1] {x}.png": (10, 10, 250), ".cache2/e.png": (250, 250, 10),
        "trip/f.png": (240, 10, 240), "trip/g.png": (240, 12, 240), "trip/deep/h.png": (20, 240, 240), "trip/deep/i.png": (120, 10, 10),
    }
    for name, colour in colours.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(image(*colour, size=(1500, 4) if name == "c.png" else (8, 6)))
    (root / "trip/broken.png").write_bytes(b"nothing")
    (root / "notes.txt").write_bytes(b"no image")
    return root


@pytest.fixture
def models(spark, tmp_path, request):
    """The module's name and a function that counts calls."""
    name = f"models_{abs(hash(request.node.name)) % 10**8}"
    folder = tmp_path / "calls"
    folder.mkdir()
    (tmp_path / f"{name}.py").write_text(textwrap.dedent(MODELS).format(folder=str(folder)))
    spark.sparkContext.addPyFile(str(tmp_path / f"{name}.py"))
    (tmp_path / "weights.json").write_text(json.dumps({"weights": [6.0, 1.0, 0.0], "bias": 5.0}))
    return name, lambda what: (folder / what).stat().st_size if (folder / what).exists() else 0


def report(path):
    with open(path, newline="") as f:
        return list(csv.DictReader(f))


def test_run_from_files(spark, photos, models, tmp_path):
    name, calls = models
    out = tmp_path / "best"
    options = ["--embedder", f"{name}:embedder", "--weights", str(tmp_path / "weights.json"), "--threshold", "0.99"]
    assert cli.main(["cull", str(photos), str(out), *options, "--target", "3", "--use-llm", "--analyzer", f"{name}:analyzer", "--llm-candidates", "4"]) == 0
    rows = report(out / "report.csv")
    assert len(rows) == 7 and [r["selected"] for r in rows] == ["yes"] * 3 + ["no"] * 4  # nine images, two pairs of duplicates
    assert sum(r["composition_score"] == "7.00" for r in rows) == 4 == calls("asked")
    assert sorted(p.name for p in out.iterdir()) == sorted([f"{r['rank']}_{r['filename']}" for r in rows[:3]] + ["report.csv"])
    embedded = calls("embedded")
    assert cli.main(["cull", str(photos), str(tmp_path / "other"), *options, "--analyze-only", "--verbose"]) == 0
    assert [p.name for p in (tmp_path / "other").iterdir()] == ["report.csv"] and calls("embedded") - embedded <= 2  # cached; only the broken one is tried again


@pytest.mark.parametrize("last", ["discovered", "embedded", "clusters", "scored", "composed", "selected"])
def test_resume_after_each_phase(spark, photos, models, tmp_path, last):
    name, calls = models
    module = __import__(name)
    config = CullConfig(similarity_threshold=0.99, target=3, request_delay=0.0)
    use = Models(module.embedder, module.analyzer, read_weights(str(tmp_path / "weights.json")), name)

    def stop(phase, rows):
        if phase == last:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        CullRun(spark, str(photos), str(tmp_path / "best"), config, use, tell=stop).run(use_llm=True)
    before = calls("embedded"), calls("asked")
    run = CullRun(spark, str(photos), str(tmp_path / "best"), config, use, resume=True)
    assert run.phases.complete(last) and run.phases.root.startswith(f"file://{photos}/.cache/phases/")  # another process finds them
    assert run.run(use_llm=True) == 0
    after = calls("embedded") - before[0], calls("asked") - before[1]
    order = ["discovered", "embedded", "rooted", "clusters", "scored", "composed"]
    at = order.index(last) if last in order else len(order)
    assert (after[0] > 0) == (at < 1) and after[1] == (6 if at < 5 else 0)  # one of seven lies in a hidden folder, which the image source leaves out
    assert len(report(tmp_path / "best" / "report.csv")) == 7 and not run.phases.complete("discovered")


def test_other_weights_are_another_run(spark, photos, models, tmp_path):
    name, _ = models
    module, config = __import__(name), CullConfig(similarity_threshold=0.99)
    runs = [CullRun(spark, str(photos), str(tmp_path / "o"), config, Models(module.embedder, weights=w)).phases.root for w in (None, ((1.0, 0.0, 0.0), 5.0), ((2.0, 0.0, 0.0), 5.0))]
    assert len(set(runs)) == 3
    (tmp_path / "layers.json").write_text(json.dumps({"layers": [[[[1.0, 2.0], [3.0, 4.0]], [1.0, 0.0]], [[[1.0, 1.0]], [0.5]]]}))
    assert read_weights(str(tmp_path / "layers.json")) == ((4.0, 6.0), 1.5)


def test_failures_and_state(spark, photos, models, tmp_path):
    name, _ = models
    run = CullRun(spark, str(photos), str(tmp_path / "o"), CullConfig(similarity_threshold=0.99), Models(__import__(name).embedder, weights=((6.0, 1.0, 0.0), 5.0)))
    assert [(r.path.rpartition("/")[2], r.error) for r in run.failures().collect()] == [("broken.png", infer.EMBED_FAILED)]
    write_state(run.phases, str(photos), "o", f"file://{tmp_path}/state")
    state = read_state(spark, f"file://{tmp_path}/state")
    tables = state_tables(state)
    assert [r.path for r in tables["failed"].collect()] == [str(photos / "trip/broken.png")] and tables["embedded"].count() == 9 and tables["discovered"].count() == 10
    row = state.first()
    assert row.discovery_complete and row.embeddings_phase_complete and not row.dedup_complete and tables["clusters"].count() == 0
    assert read_state(spark, f"file://{tmp_path}/nowhere") is None
    (tmp_path / "bad.json").write_text("{not json")
    assert read_state(spark, f"file://{tmp_path}/bad.json") is None
    given = {"source_dir": "/s", "output_dir": "/o", "started_at": "x", "updated_at": "y", "unique_images": ["/s/b", "/s/a"], "duplicate_clusters": [{"cluster_id": 0, "representative": "/s/b", "members": ["/s/b", "/s/c"]}], "aesthetic_scores": {"/s/b": 7.5}}
    (tmp_path / "given.json").write_text(json.dumps(given, indent=2))
    tables = state_tables(read_state(spark, f"file://{tmp_path}/given.json"))
    assert [(r.path, r.ord) for r in tables["unique"].collect()] == [("/s/b", 0), ("/s/a", 1)] and tables["aesthetic"].collect()[0].score == 7.5 and tables["clusters"].collect()[0].members == ["/s/b", "/s/c"]


def test_batch(spark, photos, models, tmp_path, capsys):
    name, _ = models
    options = ["--embedder", f"{name}:embedder", "--weights", str(tmp_path / "weights.json"), "--threshold", "0.99", "--min", "1", "--ratio", "0.5"]
    assert cli.main(["batch", str(photos), str(tmp_path / "plan"), *options, "--dry-run"]) == 0
    plan = [line.split() for line in capsys.readouterr().out.splitlines()[1:]]
    assert plan == [["(root)", "4", "2"], ["trip", "3", "1"], ["trip/deep", "2", "1"], ["TOTAL", "9", "4"]] and not (tmp_path / "plan").exists()
    out = tmp_path / "direct"
    assert cli.main(["batch", str(photos), str(out), *options, "--scope", "direct"]) == 0
    found = sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file())
    assert found == ["1_a.png", "2_c.png", "report.csv", "trip/1_f.png", "trip/deep/1_i.png", "trip/deep/report.csv", "trip/report.csv"]
    assert "3 of 3 folders are done" in capsys.readouterr().out
    out = tmp_path / "recursive"
    assert cli.main(["batch", str(photos), str(out), *options]) == 0
    assert len(report(out / "report.csv")) == 7 and len(report(out / "trip/report.csv")) == 3 and len(report(out / "trip/deep/report.csv")) == 2
    root = [p.name for p in out.glob("*_*.png")]
    assert len(root) == 2 and any(x.endswith(("f.png", "e.png")) for x in root)  # the root chooses among all below it, hidden ones included


def test_batch_with_a_model_and_flat(spark, photos, models, tmp_path):
    name, calls = models
    options = ["--embedder", f"{name}:embedder", "--weights", str(tmp_path / "weights.json"), "--threshold", "0.99", "--min", "1", "--ratio", "0.1", "--scope", "direct"]
    assert cli.main(["batch", str(photos), str(tmp_path / "flat"), *options, "--flat", "--use-llm", "--analyzer", f"{name}:analyzer", "--llm-candidates", "1"]) == 0
    assert sorted(p.name for p in (tmp_path / "flat").iterdir()) == ["1_a.png", "1_f.png", "1_i.png", "report.csv"] and calls("asked") == 3
    assert sum(r["composition_score"] == "7.00" for r in report(tmp_path / "flat" / "report.csv")) == 3


def test_runs_that_cannot_begin(spark, photos, models, tmp_path, capsys):
    name, _ = models
    (tmp_path / "empty").mkdir()
    with_model = ["--embedder", f"{name}:embedder"]
    for args in (["cull", str(tmp_path / "nowhere"), "o", *with_model], ["cull", str(photos / "a.png"), "o", *with_model], ["cull", str(photos), "o", *with_model, "--target", "0"], ["cull", str(photos), "o"], ["cull", str(tmp_path / "empty"), str(tmp_path / "o"), *with_model], ["batch", str(tmp_path / "empty"), str(tmp_path / "o"), *with_model]):
        assert cli.main(args) == 1 and capsys.readouterr().err
    with pytest.raises(NoImages):
        BatchRun(spark, str(tmp_path / "empty"), str(tmp_path / "o"), CullConfig(), Models(__import__(name).embedder)).plan()
    with pytest.raises(ValueError):
        CullRun(spark, str(photos), "o", CullConfig(), Models())


def test_table_of_embeddings(spark, photos, tmp_path):
    table = f"file://{tmp_path}/table"
    spark.createDataFrame([(str(photos / "a.png"), [1.0, 0.0]), (str(photos / "c.png"), [0.0, 1.0])], "path string, embedding array<double>").write.parquet(table)
    assert cli.main(["cull", str(photos), str(tmp_path / "o"), "--embeddings", table]) == 0
    assert [r["filename"] for r in report(tmp_path / "o/report.csv")] == ["a.png", "c.png"]


def test_pixels(spark, photos):
    found = {r.path.rpartition("/")[2]: r for r in images.load_images(spark, f"file://{photos}").collect()}
    assert found["broken.png"].error == images.FAILED and found["broken.png"].data is None
    wide = found["c.png"]
    px = pixels.rgb(wide.data, wide.width, wide.height, wide.channels)
    assert px.shape == (4, 1500, 3) and (px == (10, 250, 10)).all()
    assert pixels.shrink(px).shape == (2, 1024, 3) and (pixels.shrink(px) == (10, 250, 10)).all() and pixels.shrink(px[:, :100]) is not None
    assert (pixels.rgb(bytes([7, 8]), 2, 1, 1) == [[[7] * 3, [8] * 3]]).all() and (pixels.rgb(bytes([1, 2, 3, 4]), 1, 1, 4) == [[[3, 2, 1]]]).all()
    assert pixels.encoded_size(4000, 3000) == (1024, 768) and pixels.encoded_size(800, 600) == (800, 600)
    slope = np.repeat(np.linspace(0, 255, 3000).astype(np.uint8)[None, :, None], 3, 2)
    made = pixels.shrink(np.repeat(slope, 40, 0)).astype(int)
    assert made.shape == (13, 1024, 3) and abs(made[5, :, 0] - np.linspace(0, 255, 1024)).max() <= 2
    sent = {r.path.rpartition("/")[2]: r.content for r in infer.encoded(images.load_images(spark, f"file://{photos}")).collect()}
    assert sent["broken.png"] is None and (pixels.has_jpeg() or base64.b64decode(sent["a.png"]) == image(250, 10, 10))
    assert pixels.readable((".jpg", ".heic")) == ((".jpg", ".heic") if pixels.has_heic() else (".jpg",))


def test_contents_keep_unreadable_files(spark, photos):
    rows = spark.createDataFrame([(1, str(photos / "notes.txt")), (2, f"file://{photos}/a.png"), (3, str(photos / "none.png"))], "n long, path string")
    got = {r.n: (r.content, r.error) for r in images.contents(rows).collect()}
    assert got[1] == (bytearray(b"no image"), None) and got[2][0][:4] == b"\x89PNG" and got[3] == (None, images.FAILED)


def test_shared_folder_is_named_on_a_cluster(spark, monkeypatch):
    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        shared_dir(Cluster)
    assert shared_dir(spark).startswith("file://")


def test_recursive_scope_needs_paths_and_numbers_items_anew(spark):
    from sievework.plans import cull as K

    rows = [(0, "/p/a.jpg", "/p", [1.0, 0.0]), (1, "/p/q/b.jpg", "/p/q", [1.0, 0.01]), (2, "/p/q/c.jpg", "/p/q", [0.0, 1.0])]
    items = spark.createDataFrame(rows, "vec_id long, path string, folder string, embedding array<double>")
    config = CullConfig(similarity_threshold=0.9, least=1, ratio=0.9)
    score = lambda df: K.aesthetic(df, [1.0, 2.0], 3.0)
    got = sorted((r.folder, r["rank"], r.vec_id) for r in K.cull_folders(items, config, score, "folder").selected.collect())
    assert got == [("/p", 1, 2), ("/p/q", 1, 2)]  # the root's quota counts its one direct image
    both = K.cull_folders(items, config, score, "folder").scored
    assert sorted((r.folder, r.vec_id) for r in both.collect()) == [("/p", 0), ("/p", 2), ("/p/q", 1), ("/p/q", 2)] and F is not None
