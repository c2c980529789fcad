"""Matching by candidates and prices against the whole cost matrix."""

import numpy as np

from orrery.operators import arrays, matching


def test_sparse_assignment():
    r = np.random.default_rng(4)
    for n in (1, 2, 7, 40):
        cost = r.integers(0, 6, (n, n)).astype(float)  # with many ties
        row, col = np.divmod(np.arange(n * n), n)
        match, u, v = matching.sparse_assignment(n, row, col, cost.ravel(), np.zeros(n))
        assert sorted(match) == list(range(n))
        assert np.isclose(cost[np.arange(n), match].sum(), cost[np.arange(n), arrays.assignment(cost)].sum())
        assert (cost - np.array(u)[:, None] - np.array(v)[None]).min() > -1e-9


def test_cheapest_matching(spark, monkeypatch):
    """In blocks of some rows and with one candidate a row and block, so that most pairs are priced in; copies are ties."""
    monkeypatch.setattr(matching, "BLOCK", 16)
    monkeypatch.setattr(matching, "NEAR", 1)
    r, sides, want = np.random.default_rng(5), [], {}
    for cell, n in ((0, 50), (1, 1), (-(1 << 63), 30)):
        x, y = r.normal(size=(2, n, 4))
        x[: n // 3] = x[0]
        sides.append([[(cell, i, v.tolist()) for i, v in enumerate(s)] for s in (x, y)])
        cost = ((x[:, None] - y[None]) ** 2).sum(2)
        want[cell] = cost[np.arange(n), arrays.assignment(cost)].sum()
    rows, cols = (spark.createDataFrame([t for s in sides for t in s[k]], "cell long, at long, vec array<double>") for k in (0, 1))
    got = {c: v for c, v in matching.cheapest_matching(rows, cols).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[c], want[c]) for c in want)
