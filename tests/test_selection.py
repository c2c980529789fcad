"""Greedy selection, anchored graphs and coupled steps against brute force."""

from itertools import combinations

import numpy as np
import pytest

from orrery.operators import anchored, knn, selectors

RNG = np.random.default_rng(11)
VECS = "id long, vec array<double>"


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rows(spark, m, first=0):
    return spark.createDataFrame([(first + k, v.tolist()) for k, v in enumerate(m)], VECS).repartition(3)


def half(x, y):
    return 0.5 * ((x[:, None] - y[None]) ** 2).sum(2)


@pytest.mark.parametrize("brought", [3, 256])
def test_covering(spark, monkeypatch, brought):
    monkeypatch.setattr(selectors, "BROUGHT", brought)
    a, b = RNG.integers(0, 4, (40, 3)).astype(float), RNG.integers(0, 3, (40, 2)).astype(float)  # many ties
    a[30:35], b[30:35] = a[5], b[5]
    df = spark.createDataFrame([(k, x.tolist(), y.tolist()) for k, (x, y) in enumerate(zip(a, b, strict=True))], "id long, a array<double>, b array<double>").repartition(4)
    got = [(r["id"], r["place"], r["gap"]) for r in selectors.covering(df, ["a", "b"], [2.0, 0.5], 12, 7).orderBy("place").collect()]
    bad = lambda s: np.round(np.maximum(half(a, a[s]).min(1) / 2, half(b, b[s]).min(1) / 0.5), 9)
    want = [(7, 0, None)]
    while len(want) < 12:
        gap = bad([i for i, _, _ in want])
        gap[[i for i, _, _ in want]] = -1
        want.append((int(gap.argmax()), len(want), gap.max()))
    assert got == want


def test_covering_takes_all_rows_of_a_small_table(spark):
    df = rows(spark, np.ones((3, 2)))
    assert sorted(r["id"] for r in selectors.covering(df, ["vec"], [0.0], 9, 1).collect()) == [0, 1, 2]
    assert selectors.covering(df, ["vec"], [1.0], 9, 55).count() == 0 and selectors.covering(df.limit(0), ["vec"], [1.0], 2, 0).count() == 0
    assert selectors.scales(df, ["vec"], 1) == [0.0]
    with pytest.raises(ValueError, match="start"):
        selectors.scales(df, ["vec"], 55)


@pytest.mark.parametrize(("na", "nb", "keep"), [(6, 5, 3), (4, 3, 3), (5, 2, 4), (3, 3, 9)])
def test_complementary(na, nb, keep):
    for seed in range(20):
        rng = np.random.default_rng(seed)
        a, b, corr = np.round(rng.random(na), 1), np.round(rng.random(nb), 1), np.round(rng.uniform(-1, 1, (na, nb)), 1)
        ca, cb = [], []
        while len(ca) < na and len(cb) < nb and (len(ca) < keep or len(cb) < keep):
            open_a = [(a[i] - 0.5 * max((abs(corr[i, j]) for j in cb), default=0), 0, -i) for i in range(na) if i not in ca and len(ca) < keep]
            open_b = [(b[j] - 0.5 * max((abs(corr[i, j]) for i in ca), default=0), -1, -j) for j in range(nb) if j not in cb and len(cb) < keep]
            _, side, at = max(open_a + open_b)
            (cb if side else ca).append(-at)
        for mine, n in ((ca, na), (cb, nb)):
            mine += [i for i in range(n) if i not in mine][: max(0, keep - len(mine))]
        assert selectors.complementary(a, b, corr, 0.5, keep) == (sorted(ca), sorted(cb))


def test_constant_channels_repeat_nothing():
    assert selectors.complementary([1, 0.9], [0.8, 0.1], np.full((2, 2), np.nan), 5.0, 1) == ([0], [0])


@pytest.mark.parametrize("block", [4, 4096])
def test_nearest_of_each_image_and_subsets(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "BLOCK", block)
    q, b, image = RNG.random((9, 4)), RNG.random((14, 4)), np.arange(14) % 3 + 5
    bank = spark.createDataFrame([(k, v.tolist(), int(i)) for k, (v, i) in enumerate(zip(b, image, strict=True))] + [(99, [0.0] * 4, None)], VECS + ", image int")
    near = knn.nearest_per(rows(spark, q), bank, "image")
    got = {(r["query"], r["image"]): r["dist"] for r in near.collect()}
    d = {i: half(q, b[image == i]).min(1) for i in (5, 6, 7)}
    assert len(got) == 27 and all(got[k, i] == pytest.approx(d[i][k]) for k in range(9) for i in d)
    said = {tuple(r["images"]): r["coverage"] for r in selectors.subset_coverage(near, [5, 6, 7]).collect()}
    for n in (1, 2, 3):
        for s in combinations((5, 6, 7), n):
            assert said[s] == pytest.approx(np.min([d[i] for i in s], axis=0).mean())
    lost = {tuple(r["images"]): r["coverage"] for r in selectors.subset_coverage(near, [5, 8], (1, 2)).collect()}
    assert lost[(8,)] is None and lost[(5, 8)] == pytest.approx(d[5].mean())
    assert selectors.subset_coverage(near.limit(0), [5]).count() == 0


def test_forces_and_coupled_step(spark):
    q, b = unit(RNG.normal(size=(10, 5))), unit(RNG.normal(size=(30, 5)))
    b[3] = b[4]
    got = {r["query"]: r for r in anchored.forces(rows(spark, q), rows(spark, b), 8, 1.0).collect()}
    for k, v in enumerate(q):
        order = sorted(range(30), key=lambda i: (round(half(v[None], b[i : i + 1])[0, 0], 9), i))[:8]
        anchor = b[order[0]]
        w = np.array([b[i] @ v if j == 0 or (round(b[i] @ anchor, 9) > round(anchor @ v, 9) and b[i] @ v > 0) else 0 for j, i in enumerate(order)])
        assert got[k]["stiffness"] == pytest.approx(w.sum() + 1) and np.allclose(got[k]["force"], w.sum() * v - w @ b[order]) and got[k]["edges"] == (w > 0).sum()
    assert anchored.forces(rows(spark, q), rows(spark, b).limit(0)).count() == 0

    p, r = RNG.normal(size=(2, 4)), RNG.normal(size=(2, 3))  # rows need not be orthogonal
    f, g, s, t = RNG.normal(size=(6, 4)), RNG.normal(size=(6, 3)), RNG.random(6) + 0.5, RNG.random(6) + 0.5
    schema = "id long, stiffness_a double, force_a array<double>, stiffness_b double, force_b array<double>"
    data = [(k, float(s[k]), f[k].tolist(), float(t[k]), g[k].tolist()) for k in range(6)] + [(6, 0.0, f[0].tolist(), 1.0, g[0].tolist()), (7, 1.0, None, 1.0, g[0].tolist())]
    said = {x["id"]: x for x in anchored.coupled_step(spark.createDataFrame(data, schema), p, r, 0.7).collect()}
    for k in range(6):
        joint = np.hstack([p, -r])
        z = np.linalg.solve(np.diag([s[k]] * 4 + [t[k]] * 3) + 0.7 * joint.T @ joint, -np.concatenate([f[k], g[k]]))
        e = joint @ z
        assert np.allclose(said[k]["step_a"], z[:4]) and np.allclose(said[k]["step_b"], z[4:]) and said[k]["conflict"] == pytest.approx(np.linalg.norm(e))
        assert said[k]["work"] == pytest.approx(np.sqrt(s[k] * z[:4] @ z[:4] + t[k] * z[4:] @ z[4:] + 0.7 * e @ e))
    assert said[6]["work"] is None and said[7]["step_a"] is None
