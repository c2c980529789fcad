"""Wavelet energies and neighbour descriptors against plain loops."""

import numpy as np
import pytest

from orrery.operators import grid, wavelets

RNG = np.random.default_rng(3)


def turned(i, n):
    while not 0 <= i < n:
        i = -1 - i if i < 0 else 2 * n - 1 - i
    return i


def test_box_mean_against_loops():
    x = RNG.random((5, 6))
    for size in (1, 2, 3, 6, 9):
        want = [[np.mean([x[turned(r + i, 5), turned(c + j, 6)] for i in range(-(size // 2), size - size // 2) for j in range(-(size // 2), size - size // 2)]) for c in range(6)] for r in range(5)]
        assert np.allclose(wavelets.box_mean(x[None], size)[0], want)


def test_bands_keep_energy_and_find_directions():
    x = RNG.random((2, 8, 8))
    for shift in (0, 3):  # undecimated: a shifted image has shifted bands
        for a, b in zip(wavelets.bands(x, 2), wavelets.bands(np.roll(x, shift, axis=1), 2), strict=True):
            assert all(np.allclose(np.roll(p, shift, axis=1), q) for p, q in zip(a, b, strict=True))
    rows = np.broadcast_to(np.arange(8.0)[:, None] % 2, (8, 8))
    (_, _, _), (h, v, d) = wavelets.bands(rows, 2)
    assert np.allclose(np.abs(h), 1) and not v.any() and not d.any()
    lone = wavelets.bands(np.eye(1, 64).reshape(8, 8), 1)[0]  # a pixel is in four cells of each band, each with weight a half
    assert all(np.isclose((b * b).sum(), 1) for b in lone)


def test_haar_energies(spark):
    images = RNG.integers(0, 256, (3, 3, 8, 8)).astype(float)
    data = [(f"i{k}", x.ravel().tolist(), 1) for k, x in enumerate(images)] + [("none", None, 1)]
    df = spark.createDataFrame(data, "id string, pixels array<double>, r int")
    got = {(x["id"], x["r"], x["c"]): x["vec"] for x in wavelets.haar_energies(df, (3, 8, 8), 2, 4, colour=True).collect()}
    planes = wavelets.colour_planes(*images.transpose(1, 0, 2, 3))
    assert planes.shape == (3, 3, 8, 8) and np.allclose(planes[:, 1], images[:, 0] - images[:, 1])
    want = wavelets.describe(planes, 2, 4)
    assert want.shape == (3, 2, 2, 24) and len(got) == 12 and all(np.allclose(got[f"i{k}", r, c], want[k, r, c]) for k in range(3) for r in (0, 1) for c in (0, 1))
    flat = wavelets.describe(np.ones((1, 1, 8, 8)), 1, 4)[0, 0, 0]  # nothing but the floor
    assert np.allclose(flat[:3], np.log(1e-8)) and flat[5] == 0
    assert wavelets.haar_energies(df.limit(0), (3, 8, 8), 2, 4).count() == 0
    with pytest.raises(ValueError, match="divide"):
        wavelets.haar_energies(df, (3, 8, 8), 2, 3)


@pytest.fixture(scope="module")
def maps():
    x = RNG.normal(size=(2, 5, 4, 3))
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


@pytest.fixture(scope="module")
def cells(spark, maps):
    return spark.createDataFrame([(m, r, c, maps[m, r, c].tolist()) for m in range(2) for r in range(5) for c in range(4)], "m int, r int, c int, vec array<double>").repartition(4)


@pytest.mark.parametrize("reach", [1, 2])
def test_neighbour_contrast(cells, maps, reach):
    got = {(x["m"], x["r"], x["c"]): x["contrast"] for x in grid.neighbour_contrast(cells, ["m"], reach).collect()}
    offsets = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if i or j]
    for (m, r, c), said in got.items():
        assert said == pytest.approx(np.mean([1 - maps[m, r, c] @ maps[m, np.clip(r + i, 0, 4), np.clip(c + j, 0, 3)] for i, j in offsets]))
    assert len(got) == 40 and grid.neighbour_contrast(cells.limit(0), ["m"]).count() == 0


def test_context_descriptors(cells, maps):
    wide = np.pad(maps, [(0, 0), (1, 1), (1, 1), (0, 0)], mode="reflect")
    near = {(i, j): wide[:, 1 + i : 6 + i, 1 + j : 5 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)}
    mean = (sum(near.values()) - maps) / 8
    for kind, want in (("mean", [maps, mean]), ("sides", [maps, near[-1, 0], near[1, 0], near[0, -1], near[0, 1]])):
        want = np.concatenate(want, axis=-1)
        want /= np.linalg.norm(want, axis=-1, keepdims=True)
        for x in grid.context_descriptor(cells, ["m"], kind).collect():
            assert np.allclose(x["descriptor"], want[x["m"], x["r"], x["c"]])
    with pytest.raises(ValueError, match="kind"):
        grid.context_descriptor(cells, ["m"], "all")
