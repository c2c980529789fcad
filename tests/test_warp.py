"""Resampling of maps: identity, whole shifts, and bilinear weights in numpy."""

import numpy as np
import pytest

from orrery.operators import warp

SHAPE = (5, 7)


def frame(spark, maps):
    rows = [(k, r * 7 + c, float(m[r, c]), float(-m[r, c])) for k, m in enumerate(maps) for r in range(5) for c in range(7)]
    return spark.createDataFrame(rows, "id int, p int, s double, t double").repartition(3)


def numbers(df):
    return {(x["id"], x["p"]): x for x in df.collect()}


def test_identity_and_shifts(spark):
    maps = np.random.default_rng(0).random((3, *SHAPE))
    df = frame(spark, maps)
    same = numbers(warp.inverse_warp(df, ["id"], SHAPE, [[1, 0, 0], [0, 1, 0]], ["s", "t"]))
    assert all(x["valid"] and x["s"] == maps[k, p // 7, p % 7] and x["t"] == -x["s"] for (k, p), x in same.items()) and len(same) == 105
    moved = numbers(warp.inverse_warp(df, ["id"], SHAPE, [[1, 0, 28.0], [0, 1, -14.0]], ["s"], stride=14.0))
    for (k, p), x in moved.items():
        r, c = p // 7 - 1, p % 7 + 2
        assert x["valid"] == (0 <= r < 5 and 0 <= c < 7) and x["s"] == (maps[k, r, c] if x["valid"] else None)
    edge = numbers(warp.inverse_warp(df, ["id"], SHAPE, [[1, 0, 2], [0, 1, -1]], ["s"], edge=True))
    assert all(x["valid"] and x["s"] == maps[k, max(p // 7 - 1, 0), min(p % 7 + 2, 6)] for (k, p), x in edge.items())


@pytest.mark.parametrize("rows", [0, 200_000])
def test_bilinear(spark, monkeypatch, rows):
    monkeypatch.setattr(warp, "BROADCAST_ROWS", rows)
    maps = np.random.default_rng(1).random((2, *SHAPE))
    got = numbers(warp.inverse_warp(frame(spark, maps), ["id"], SHAPE, [[0.8, 0.3, 0.1], [-0.2, 0.9, 0.7]], ["s"]))
    for (k, p), v in got.items():
        r, c = p // 7, p % 7
        x, y = 0.8 * c + 0.3 * r + 0.1, -0.2 * c + 0.9 * r + 0.7
        inside = 0 <= x <= 6 and 0 <= y <= 4
        assert v["valid"] == inside
        if inside:
            i, j = int(y), int(x)
            i2, j2, a, b = min(i + 1, 4), min(j + 1, 6), y - i, x - j
            want = (1 - a) * ((1 - b) * maps[k, i, j] + b * maps[k, i, j2]) + a * ((1 - b) * maps[k, i2, j] + b * maps[k, i2, j2])
            assert v["s"] == pytest.approx(want)


def test_missing_cells_and_empty(spark):
    df = frame(spark, np.ones((1, *SHAPE)))
    got = numbers(warp.inverse_warp(df.where("p <> 8"), ["id"], SHAPE, [[1, 0, 0.5], [0, 1, 0]], ["s"]))
    assert not got[0, 7]["valid"] and got[0, 7]["s"] is None and got[0, 9]["s"] == 1.0 and len(got) == 34
    assert warp.inverse_warp(df.limit(0), ["id"], SHAPE, [[1, 0, 0], [0, 1, 0]], ["s"]).count() == 0
