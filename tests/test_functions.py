import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from driftleaf.functions import series as S
from driftleaf.functions.draws import normal_draw, unit_draw
from driftleaf.functions.text import array_to_text, filter_id_from_path, parse_model_setting
from driftleaf.operators.surface import polynomial_value
from tests.conftest import frame


def test_mean_std_and_znormalise(spark, rng):
    x = rng.normal(size=(5, 65)) * 3 + 2
    rows = frame(spark, x).select(
        S.mean_std(F.col("values")).alias("ms"), S.znormalize(F.col("values")).alias("z")
    ).collect()
    for row, v in zip(rows, x):
        assert math.isclose(row["ms"]["mean"], v.mean(), rel_tol=1e-12)
        assert math.isclose(row["ms"]["std"], v.std(), rel_tol=1e-12)
        assert np.allclose(row["z"], (v - v.mean()) / v.std())


def test_constant_series_cannot_be_normalised(spark):
    row = frame(spark, [[2.0] * 8]).select(S.znormalize(F.col("values")).alias("z")).first()
    assert row["z"] is None


def test_segmentation_gives_the_remainder_to_the_last():
    assert S.segmentation(65, 2) == [(0, 32), (32, 33)]
    assert S.segmentation(10, 4) == [(0, 2), (2, 2), (4, 2), (6, 4)]


def test_lower_bound_expression(spark, rng):
    x = rng.normal(size=(20, 16))
    q = rng.normal(size=16)
    cuts = S.segmentation(16, 4)
    env = []
    for off, n in cuts:
        m, s = x[:, off : off + n].mean(1), x[:, off : off + n].std(1)
        env.append((off, n, m.min(), m.max(), s.min(), s.max()))
    want = 0.0
    for (off, n), e in zip(cuts, env):
        m, s = q[off : off + n].mean(), q[off : off + n].std()
        want += n * (max(e[2] - m, m - e[3], 0) ** 2 + max(e[4] - s, s - e[5], 0) ** 2)
    df = spark.createDataFrame(
        [([float(v) for v in q], [tuple(map(float, e[:0])) + (e[0], e[1], *map(float, e[2:])) for e in env])],
        "values array<double>, seg array<struct<off:int,len:int,min_mean:double,max_mean:double,"
        "min_std:double,max_std:double>>",
    )
    got = df.select(S.lower_bound_squared(F.col("values"), F.col("seg")).alias("lb")).first()["lb"]
    assert math.isclose(got, want, rel_tol=1e-9)
    assert want <= ((x - q) ** 2).sum(1).min()


def test_comparisons(spark):
    df = spark.createDataFrame([(1.0, 1.0 + 1e-9, 0.0), (1.0, 1.1, 1e-3)], "a double, b double, c double")
    rows = df.select(
        S.nearly_equal(F.col("a"), F.col("b")).alias("e"), S.is_zero(F.col("c")).alias("z")
    ).collect()
    assert [(r["e"], r["z"]) for r in rows] == [(True, True), (False, False)]


def test_model_setting(spark):
    df = spark.createDataFrame(
        [("v0_mlp_3_128_t",), ("v0__mlp_3_128_f",), ("v1_mlp_3_128_t",), ("v0_cnn_3_128_t",), ("",)],
        "s string",
    )
    rows = [tuple(r["m"]) for r in df.select(parse_model_setting(F.col("s")).alias("m")).collect()]
    assert rows == [
        ("mlp", 3, 128, True), ("mlp", 3, 128, False), ("mlp", 2, 256, False),
        ("mlp", 2, 256, False), ("mlp", 2, 256, False),
    ]


def test_text_helpers(spark):
    df = spark.createDataFrame([([1.5, -2.0], "/a/b/filter_17_data.csv")], "v array<double>, p string")
    row = df.select(
        array_to_text(F.col("v")).alias("t"), filter_id_from_path(F.col("p")).alias("id")
    ).first()
    assert row["t"] == "1.500000 -2.000000"
    assert row["id"] == 17


def test_draws_are_functions_of_their_keys(spark):
    rows = spark.range(200).select(
        unit_draw("s", F.col("id"), F.lit(3)).alias("u"), normal_draw("s", F.col("id")).alias("n")
    ).collect()
    want = int(hashlib.md5(b"s:0:3").hexdigest()[:13], 16) / 16**13
    assert rows[0]["u"] == want
    u = np.array([r["u"] for r in rows])
    n = np.array([r["n"] for r in rows])
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.08
    assert abs(n.mean()) < 0.25 and abs(n.std() - 1) < 0.2


def test_polynomial_value(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 2.0)], "c array<double>, x double")
    assert df.select(polynomial_value(F.col("c"), F.col("x")).alias("v")).first()["v"] == 17.0
