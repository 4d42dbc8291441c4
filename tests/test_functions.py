"""Golden cases of the column functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.config import CullConfig
from sievework.functions import paths as P
from sievework.functions import scores as S
from sievework.functions import vectors as V


def column(spark, values, kind, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "answer,score",
    [("8", 8), ("8/10", 8), ("Score: 7.5.", 7.5), ("10.5 then 9", 9), ("0.85", 5), ("11.5x 3", 3), ("9.5x", 9), ("score7", 5), ("-5", 5), ("1. Rule ... 7", 1), ("7_ 2", 2), ("", 5), ("0 and 12 and 10", 10), ("8é 6", 6), (None, 5)],
)
def test_parse(spark, answer, score):
    assert column(spark, [answer], "string", S.parse) == [score]


def test_quota(spark):
    cases = [(500, 0.1, 10, 1000, 50), (100, 0.1, 10, 1000, 10), (5, 0.1, 10, 1000, 5), (20000, 0.1, 10, 1000, 1000), (100, 0.29, 3, 1000, 28), (50, 0.1, 10, 5, 5)]
    for n, ratio, least, most, want in cases:
        assert column(spark, [n], "bigint", lambda x: S.quota(x, ratio, least, most)) == [want]


def test_path_order_is_by_component(spark):
    rows = spark.createDataFrame([(p,) for p in ("/s/a-b/x.jpg", "/s/a/x.jpg", "/s/a/b/x.jpg", "/s/B/x.jpg")], "p string")
    assert [r.p for r in rows.orderBy(P.parts(F.col("p"))).collect()] == ["/s/B/x.jpg", "/s/a/b/x.jpg", "/s/a/x.jpg", "/s/a-b/x.jpg"]


def test_two_decimals(spark):
    assert column(spark, [0.125, 2.675, 1.005, 0.375, 7.0], "double", S.two_decimals) == ["0.12", "2.67", "1.00", "0.38", "7.00"]


def test_clip(spark):
    got = column(spark, [0.3, 12.0, 5.5, float("nan"), None], "double", S.clip)
    assert got[:3] == [1, 10, 5.5] and math.isnan(got[3]) and got[4] is None


def test_blend(spark):
    rows = spark.createDataFrame([(8.0, 6.0), (8.0, None), (None, None), (None, 10.0)], "a double, c double")
    assert [round(r[0], 9) for r in rows.select(S.blend(F.col("a"), F.col("c"))).collect()] == [7.2, 8, 5, 7]


def test_hash_of_bytes(spark):
    assert column(spark, [bytearray(b"abc")], "binary", P.content_hash) == ["ba7816bf8f01cfea"]


def test_suffixes_and_names(spark):
    assert column(spark, ["/x/.jpg", "/x/a.JPG", "/x/a", "a.b/c"], "string", P.suffix) == ["", ".jpg", "", ""]
    assert column(spark, ["/x/a.jpg"], "string", lambda p: P.rank_name(F.lit(3), F.lit(2), P.basename(p))) == ["03_a.jpg"]
    assert column(spark, ["/a/b/c", "c", "/c"], "string", P.ancestors) == [["", "/a", "/a/b"], [], [""]]


def test_vectors(spark):
    assert column(spark, [[3.0, 4.0], [0.0, 0.0]], "array<float>", V.norm) == [5, 0]
    assert column(spark, [[3.0, 4.0]], "array<float>", V.normalize) == [[0.6, 0.8]]
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in rows.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0]


def test_layers_fold_to_one_map(spark):
    rng = np.random.default_rng(0)
    sizes = [8, 16, 4, 1]
    layers = [(rng.normal(size=(o, i)), rng.normal(size=o)) for i, o in zip(sizes, sizes[1:])]
    x = rng.normal(size=8)
    want = x
    for w, b in layers:
        want = w @ want + b
    weights, bias = V.fold_layers(layers)
    assert column(spark, [x.tolist()], "array<double>", lambda v: V.affine(v, weights, bias))[0] == pytest.approx(want[0])


def test_config():
    assert CullConfig().run_id("a") != CullConfig(target=1).run_id("a") != CullConfig(target=1).run_id("b")
    for bad in ({"similarity_threshold": 2}, {"target": -1}, {"scope": "x"}):
        with pytest.raises(ValueError):
            CullConfig(**bad)
