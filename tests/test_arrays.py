"""Array operators against plain numpy."""

import itertools

import numpy as np

from orrery.operators import arrays


def test_haar():
    a = np.arange(64.0).reshape(8, 8)
    low, planes = arrays.haar(a)
    assert np.isclose((a**2).sum(), (low**2).sum() + sum((p**2).sum() for p in planes))
    assert len(arrays.haar_details(a, 2)) == 6 and all(d.shape == (8, 8) for d in arrays.haar_details(a, 2))


def test_affine():
    r = np.random.default_rng(0)
    src, m = r.normal(size=(40, 2)) * 5, np.array([[1.1, 0.2, 3], [-0.1, 0.9, -2]])
    dst = src @ m[:, :2].T + m[:, 2]
    dst[:8] += 50
    got, share = arrays.ransac_affine(src, dst, reach=0.01)
    assert np.allclose(got, m) and share == 0.8
    assert arrays.ransac_affine(src[:2], dst[:2]) == (None, 0.0)


def test_transport():
    c, a, b = np.abs(np.arange(4.0)[:, None] - np.arange(3.0)[None]), np.full(4, 0.25), np.full(3, 1 / 3)
    plan = arrays.semi_relaxed_ot(c, a, b, 0.1, 1e6)
    assert np.allclose(plan.sum(1), a) and np.allclose(plan.sum(0), b, atol=1e-3)


def test_transport_on_a_line():
    r = np.random.default_rng(3)
    for n, m, far in ((1, 1, 0), (30, 12, 0), (40, 55, 1e3), (7, 1, -3)):
        x, y = np.round(r.random(n), 1) + far, np.round(r.random(m), 1) + far
        c = np.abs(x[:, None] - y[None])
        want = (arrays.semi_relaxed_ot(c, np.full(n, 1 / n), np.full(m, 1 / m), 0.05, 0.5) * c).sum()
        assert np.isclose(arrays.semi_relaxed_line_cost(x, y, 0.05, 0.5, cells=64), want, rtol=1e-8, atol=1e-10)
    # 60,000 by 20,000 points: the matrix would take 10 GB in each of 2000 rounds.
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert 0 < arrays.semi_relaxed_line_cost(r.random(60_000), r.random(20_000), 0.05, 0.5, rounds=20) < 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_assignment():
    r = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 5), (6, 6)):
        cost = r.random((n, m))
        best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        got = arrays.assignment(cost)
        assert len(set(got)) == n and np.isclose(cost[np.arange(n), got].sum(), best)


def test_merge():
    assert arrays.merged([{1, 2, 3}, {2, 3, 4}, {9}]) == [(0, {1, 2, 3, 4}), (2, {9})]


def test_aupro():
    m = np.linspace(0, 0.5, 40_000).reshape(200, 200)
    mask = np.zeros((200, 200), dtype=bool)
    mask[:2, :5] = True
    apart = np.where(mask, 0.9, m)
    assert 0.995 < arrays.aupro([apart], [[mask]]) <= 1.0
    assert arrays.aupro([m], [[]]) is None
    assert arrays.aupro([1 - apart], [[mask]]) < 0.05
    # Two normal cells: each threshold is the lower one, so the curve is a line from no overlap to all of it.
    assert np.isclose(arrays.aupro([np.array([[0.9, 0.8], [0.1, 0.2]])], [[np.array([[True, True], [False, False]])]]), 0.15)
