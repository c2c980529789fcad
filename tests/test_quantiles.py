"""Exact quantiles by ranges."""

import numpy as np

from orrery.operators import calibration


def test_quantiles(spark):
    r, rows, want = np.random.default_rng(6), [], {}
    probs = {"a": 0.5, "b": 0.01, "c": 0.99, "d": 0.25, "e": 0.0, "f": 1.0}
    for key, x in (("many", r.normal(size=30_001)), ("ties", r.integers(0, 3, 20_000).astype(float)), ("few", r.normal(size=4)), ("one", np.array([2.5])), ("far", np.append(r.random(15_000), 1e12))):
        rows += [(key, float(v)) for v in x] + [(key, None)]
        want[key] = np.quantile(x, list(probs.values()))
    df = spark.createDataFrame([*rows, ("none", None)], "g string, v double").repartition(7)
    got = calibration.quantiles(df, ["g"], "v", probs)
    # The plan holds no aggregate that keeps a key's values together.
    assert "percentile(" not in got._jdf.queryExecution().toString()
    out = {t[0]: t[1:] for t in got.collect()}
    assert out.pop("none") == (None,) * len(probs)
    assert out.keys() == want.keys() and all(np.allclose(out[k], want[k], rtol=1e-12, atol=0) for k in want)
    # A sketch too coarse to hit: the counts tell, and all values stand for the range.
    coarse = {t[0]: t[1:] for t in calibration.quantiles(df, ["g"], "v", probs, accuracy=3).collect()}
    assert all(np.allclose(coarse[k], want[k], rtol=1e-12, atol=0) for k in want)
    whole = calibration.quantiles(df.where("g = 'many'"), [], "v", {"a": 0.5}).collect()
    assert np.isclose(whole[0]["a"], want["many"][0])


def test_router_statistics_of_many_rows(spark):
    """What the safe router calibrates with, where quantiles are found in narrow ranges, and no aggregate holds a key's values."""
    x = np.random.default_rng(7).normal(size=20_000)
    got = calibration.rank_preserving_stats(spark.createDataFrame([(1, float(v)) for v in x], "g int, v double"), ["g"], "v")
    assert "percentile(" not in got._jdf.queryExecution().toString() and "median(" not in got._jdf.queryExecution().toString()
    r, q = got.collect()[0], np.quantile(x, [0.25, 0.75, 0.01, 0.99])
    scale = max(1.4826 * np.median(np.abs(x - np.median(x))), (q[1] - q[0]) / 1.349)
    assert np.allclose([r["center"], r["scale"], r["lower"], r["upper"]], [np.median(x), scale, q[2], q[3]], rtol=1e-12)
