"""Transport against numpy, in one block and in many."""

import numpy as np
import pytest

from orrery.operators import transport


def frame(spark, problems):
    rows = [(k, i, j, float(c[i, j])) for k, c in problems.items() for i in range(c.shape[0]) for j in range(c.shape[1])]
    return spark.createDataFrame(rows, "k string, i int, j int, c double").repartition(5)


def shares(c, eps, iters, alpha=1.0, damp=1.0, rho=None):
    b = np.zeros(c.shape[1])
    rho = np.full(c.shape[1], 1 / c.shape[1]) if rho is None else rho / rho.sum()
    soft = lambda: np.exp(-c / eps + b - (-c / eps + b).max(axis=1, keepdims=True))
    for _ in range(iters):
        p = soft()
        mass = (p / p.sum(axis=1, keepdims=True)).mean(axis=0)
        b = b + damp * (-alpha * (np.log(mass) - b - np.log(rho)) - b)
    p = soft()
    return p / p.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("rows", [3, 256])
def test_balanced_to_tolerance(spark, monkeypatch, rows):
    monkeypatch.setattr(transport, "ROWS", rows)
    rng = np.random.default_rng(1)
    problems = {"a": rng.random((10, 10)), "b": rng.random((7, 4))}
    got = {(x["k"], x["row"], x["col"]): x for x in transport.plan(frame(spark, problems), ["k"], "i", "j", "c", 0.2, 300, 1e-7).collect()}
    for k, c in problems.items():
        p = np.array([[got[k, i, j]["share"] for j in range(c.shape[1])] for i in range(c.shape[0])])
        assert np.allclose(p.sum(axis=1), 1) and np.abs(p.mean(axis=0) - 1 / c.shape[1]).max() < 1e-6
        assert np.allclose(p, shares(c, 0.2, 2000), atol=1e-6) and got[k, 0, 1]["c"] == c[0, 1]


def test_small_eps_does_not_overflow(spark):
    c = np.abs(np.arange(8)[:, None] - np.arange(8)[None]) * 1.0
    got = transport.plan(frame(spark, {"x": c}), ["k"], "i", "j", "c", 0.001, 5, 1e-9).collect()
    p = np.zeros((8, 8))
    for x in got:
        p[x["row"], x["col"]] = x["share"]
    assert np.allclose(p, np.eye(8))


def test_soft_columns_masses_and_premium(spark):
    rng = np.random.default_rng(2)
    c, rho = rng.random((9, 5)), np.array([5.0, 1, 1, 1, 2])
    df = frame(spark, {"x": c})
    mass = spark.createDataFrame([("x", j, float(r)) for j, r in enumerate(rho)], "k string, j int, rho double")
    got = {x["row"]: x for x in transport.capacity_premium(df, ["k"], "i", "j", "c", 0.1, 0.4, mass, iterations=25, tol=-1).collect()}
    pressed, free = shares(c, 0.1, 25, 0.4 / 0.5, 0.5, rho), shares(c, 0.1, 0)
    for i in range(9):
        assert got[i]["cost"] == pytest.approx((pressed * c).sum(axis=1)[i]) and got[i]["premium"] == pytest.approx(((pressed - free) * c).sum(axis=1)[i])


def test_coupled(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random((6, 6)), rng.random((6, 6))
    one, two = transport.coupled(frame(spark, {"x": a}), frame(spark, {"x": b}), ["k"], "i", "j", "c", 0.3, 0.1, 2, iterations=8, tol=-1)
    pa, pb = shares(a, 0.3, 8) / 6, shares(b, 0.3, 8) / 6
    for _ in range(2):
        m = (pa + pb) / 2
        pa, pb = (shares(np.clip(c + 0.1 * 0.5 * (np.log(p) - np.log(m)), 0, 50), 0.3, 8) / 6 for c, p in ((a, pa), (b, pb)))
    for got, p, c in ((one, pa, a), (two, pb, b)):
        for x in got.collect():
            assert x["share"] == pytest.approx(6 * p[x["row"], x["col"]], abs=1e-9) and x["c"] == c[x["row"], x["col"]]


def test_missing_costs_and_empty(spark):
    df = frame(spark, {"x": np.ones((3, 3))})
    with pytest.raises(Exception, match="every row and column"):
        transport.plan(df.where("i <> 1 or j <> 1"), ["k"], "i", "j", "c").collect()
    assert transport.plan(df.limit(0), ["k"], "i", "j", "c").count() == 0
