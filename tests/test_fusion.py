"""Calibration, fusion, borders and region signals against numpy on made maps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import calibration, fusion, grid, guards, routes, signals


def rows(maps, normal, g=0, name="v"):
    return [(g, i, r, c, float(m[r, c]), int(normal[i])) for i, m in enumerate(maps) for r in range(m.shape[0]) for c in range(m.shape[1])]


@pytest.fixture(scope="module")
def two(spark):
    r = np.random.default_rng(3)
    v, t = r.gamma(2, 1, (6, 5, 7)), r.gamma(2, 1, (6, 5, 7))
    normal = np.array([1, 1, 1, 0, 0, 1])
    made = [(0, i, a, b, float(v[i, a, b]), float(t[i, a, b]), int(normal[i])) for i in range(6) for a in range(5) for b in range(7)]
    return v, t, normal, spark.createDataFrame(made, "g int, img int, r int, c int, v double, t double, normal int")


def table(df, column, shape):
    out = np.full(shape, np.nan)
    for x in df.select("img", "r", "c", column).collect():
        out[x["img"], x["r"], x["c"]] = x[column]
    return out


@pytest.mark.parametrize("border, mode", [("edge", "edge"), ("symmetric", "symmetric"), ("mirror", "reflect")])
@pytest.mark.parametrize("reach", [1, 2])
def test_borders(two, border, mode, reach):
    v, _, _, df = two
    got = table(grid.bordered_stencil(df, ["img"], (5, 7), reach, border, {"sum": ("sum", "v"), "low": ("min", "v")}), "sum", v.shape)
    wide = np.pad(v, ((0, 0), (reach, reach), (reach, reach)), mode=mode)
    want = sum(wide[:, i : i + 5, j : j + 7] for i in range(2 * reach + 1) for j in range(2 * reach + 1))
    assert np.allclose(got, want)


def z_of(x, normal):
    own = x[normal == 1]
    c = np.median(own)
    return (x - c) / np.median(np.abs(own - c))


def test_gates(two):
    v, t, normal, df = two
    zv, zt = z_of(v, normal), z_of(t, normal)
    assert np.allclose(table(fusion.calibrated(df, ["g"], ["v", "t"], "normal"), "z_t", v.shape), zt)
    share = lambda x: x / (x.max(axis=(1, 2), keepdims=True) + 1e-8)
    text = np.clip(0.4 + 0.4 * (1 / (1 + share(np.abs(zv - zt))) - 0.5), 0.2, 0.8)
    got = fusion.agreement_gated(df, ["g"], ["img"], "v", "t", "normal")
    assert np.allclose(table(got, "fused", v.shape), (1 - text) * zv + text * zt)
    dist = [np.abs(z - z[normal == 1].mean(axis=0)) for z in (zv, zt)]
    w = np.clip(0.6 + 0.4 * np.clip(share(dist[1]) - share(dist[0]), -2, 2), 0.3, 0.9)
    assert np.allclose(table(fusion.normal_reference_gated(df, ["g"], ["img"], "v", "t", "normal"), "fused", v.shape), w * zv + (1 - w) * zt)

    def sd(z):
        wide = np.pad(z, ((0, 0), (1, 1), (1, 1)), mode="symmetric")
        cells = np.stack([wide[:, i : i + 5, j : j + 7] for i in range(3) for j in range(3)])
        return cells.std(axis=0)

    w = np.clip(0.6 - 0.4 * np.clip(share(sd(zv)) - share(sd(zt)), -2, 2), 0.3, 0.9)
    got = fusion.uncertainty_weighted(df, ["g"], ["img"], (5, 7), "v", "t", "normal", window=3)
    assert np.allclose(table(got, "weight", v.shape), w, atol=1e-6)


def test_annealed():
    assert fusion.annealed(0.6, 0.4, 0.5) == (0.6, 0.4)
    base, alpha = fusion.annealed(0.6, 0.4, 0.9)
    assert np.isclose(base, 0.88) and np.isclose(alpha, 0.12)


def test_ensemble(spark):
    df = spark.createDataFrame([(1.0, 3.0), (float("nan"), 3.0), (None, float("inf"))], "a double, b double")
    assert [r["fused"] for r in fusion.ensemble(df, {"a": 0.75, "b": 0.25}).collect()] == [1.5, 3.0, None]


def test_safe_router(two):
    v, t, normal, df = two
    own = df.withColumn("t", F.when(F.col("img") == 4, F.col("t") * 0.01).otherwise(F.col("t")))
    got = fusion.safe_router(own, ["g"], ["img"], (5, 7), "v", "t", "normal").cache()
    weight = table(got, "weight", v.shape)
    assert weight.min() == 0 and 0 < weight.max() <= 0.35
    # Turning maps over turns results over; the order of rows does not matter.
    turned = fusion.safe_router(own.withColumn("c", 6 - F.col("c")).orderBy(F.rand(1)), ["g"], ["img"], (5, 7), "v", "t", "normal")
    assert np.allclose(table(turned, "weight", v.shape)[:, :, ::-1], weight)
    flat = own.withColumn("v", F.lit(1.0))
    assert table(fusion.safe_router(flat, ["g"], ["img"], (5, 7), "v", "t", "normal"), "weight", v.shape).max() == 0


def test_rank_preserving(spark):
    ref = spark.createDataFrame([(x,) for x in (0.1, 0.11, 0.2, 0.19)], "x double")
    stats = calibration.rank_preserving_stats(ref, [], "x")
    got = calibration.with_stats(spark.createDataFrame([(-2.0,), (0.1,), (0.4,), (100.0,)], "x double"), stats, [])
    out = [r[0] for r in got.select(calibration.rank_preserving("x").alias("p"), "x").orderBy("x").collect()]
    assert out == sorted(set(out)) and 0 < out[0] and out[-1] < 1


def test_region_signals(spark):
    cells = [(0, r, c, 1.0 if (r, c) in ((4, 4), (4, 5), (5, 4), (5, 5)) else 0.25, 0.5) for r in range(12) for c in range(12)]
    df = spark.createDataFrame(cells, "img int, r int, c int, s double, t double")
    own = df.where("s > 0.5").withColumn("root", F.lit(52))
    shape = signals.shape_signals(own, ["img"], (12, 12)).first()
    assert (shape["area"], shape["edge"], shape["large"], shape["edge_gap"], shape["compactness"]) == (4, False, False, 4, 1.0)
    assert signals.boundary(own, ["img"]).first()["crossings"] == 8
    stable = signals.spatial_stability(df, own, ["img"], "s").first()["stability"]
    assert np.isclose(stable, 0.35 * 0 + 0.35 * 1 + 0.3 * 4 / 5)
    seen = signals.view_consistency(own.withColumn("u", F.lit(1.0)), ["img"], "s", ["t", "u"]).first()
    assert np.isclose(seen["augmentation"], 0.75) and np.isclose(seen["prompt"], 1 - 0.25 / 0.75)
    alone = signals.view_consistency(own, ["img"], "s", []).first()
    assert (alone["augmentation"], alone["prompt"]) == (0.5, 0.5)


def test_guards_and_routes(spark, tmp_path):
    with pytest.raises(ValueError):
        guards.assert_role("visa", ("mpdd",))
    with pytest.raises(FileNotFoundError):
        guards.require_manifest(spark, f"{tmp_path}/none.json")
    (tmp_path / "m.json").write_text('{"frozen": true}')
    assert guards.require_manifest(spark, f"{tmp_path}/m.json").first()["frozen"]
    routes.register(routes.Route("shift", lambda q, b, by=0.0: q.withColumn("score", F.col("x") + by), settings={"by": 1.0}))
    q, y = spark.createDataFrame([(1, 2.0)], "id int, x double"), spark.createDataFrame([(1, 1)], "id int, y int")
    assert routes.evaluate("shift", q, q, y, "id", lambda s: s).first()["score"] == 3.0
    assert routes.evaluate("shift", q, q, y, "id", lambda s: s, by=5.0).first()["score"] == 7.0
    with pytest.raises(ValueError):
        routes.evaluate("shift", q, q, y, "id", lambda s: s, control=True)
    with pytest.raises(KeyError):
        routes.spec("none")
