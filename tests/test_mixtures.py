"""Mixtures against numpy, in one block and in many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import mixtures

RNG = np.random.default_rng(5)
BINS = {7: np.concatenate([RNG.normal(0, 1, (60, 3)), RNG.normal(4, 0.5, (40, 3))]), 8: RNG.normal(1, 2, (30, 3)), 9: RNG.normal(0, 1, (5, 3))}
SCHEMA = "id long, bin int, vec array<double>, start int, cell string"


def frame(spark, bins):
    return spark.createDataFrame([(100 * b + i, b, v.tolist(), i % 2, "x") for b, x in bins.items() for i, v in enumerate(x)], SCHEMA).repartition(4)


def plain(x, start, k, steps, reg):
    """Expectation and maximisation in one loop; the log-likelihoods of all steps too."""
    k = min(k, max(1, len(x) // 10))
    resp, lls = np.eye(k)[start % k], []
    for step in range(steps + 1):
        n = resp.sum(0)
        w, m = n / len(x), resp.T @ x / n[:, None]
        v = np.stack([(resp[:, [j]] * (x - m[j]) ** 2).sum(0) / n[j] for j in range(k)]) + reg
        joint = np.log(w) - 0.5 * (((x[:, None] - m) ** 2) / v + np.log(2 * np.pi * v)).sum(2)
        ll = np.logaddexp.reduce(joint, axis=1)
        resp = np.exp(joint - ll[:, None])
        lls.append(ll.mean())
    return w, m, v, lls


@pytest.mark.parametrize("block", [8, 1024])
def test_steps(spark, monkeypatch, block):
    monkeypatch.setattr(mixtures, "ROWS", block)
    rows = frame(spark, BINS)
    model = mixtures.fit(rows, "bin", F.col("start"), 2, 1e-4, 4, tol=-1)
    got = {r["cell"]: r for r in model.collect()}
    said = {r["id"]: r for r in mixtures.score(rows, "bin", model).collect()}
    for b, x in BINS.items():
        w, m, v, lls = plain(x, np.arange(len(x)) % 2, 2, 4, 1e-4)
        assert np.allclose(got[b]["w"], w) and np.allclose(got[b]["mean"], m.ravel()) and np.allclose(got[b]["var"], v.ravel())
        assert (np.diff(lls) > -1e-9).all() and got[b]["ll"] == pytest.approx(lls[-2])
        joint = np.log(w) - 0.5 * (((x[:, None] - m) ** 2) / v + np.log(2 * np.pi * v)).sum(2)
        ll = np.logaddexp.reduce(joint, axis=1)
        p = np.exp(joint - ll[:, None])
        for i in range(len(x)):
            assert said[100 * b + i]["nll"] == pytest.approx(-ll[i]) and said[100 * b + i]["entropy"] == pytest.approx(-(p[i] * np.log(np.maximum(p[i], 1e-12))).sum(), abs=1e-9)


def test_keys_stop_on_their_own(spark):
    model = {r["cell"]: r for r in mixtures.fit(frame(spark, BINS), "bin", (F.col("vec")[0] > 2).cast("int"), 2, steps=12, tol=1e-2).collect()}
    assert all(r["done"] for r in model.values()) and len(model[9]["w"]) == 1 and sorted(model[7]["w"]) == pytest.approx([0.4, 0.6], abs=0.02)


def test_nulls_unknown_keys_repeats_and_empty(spark):
    same = frame(spark, {7: np.ones((40, 3))})
    model = mixtures.fit(same, "bin", F.lit(None).cast("int"), 2, steps=3)
    assert [r["w"] for r in model.collect()] == [[1.0]]  # a component without rows is left out
    odd = spark.createDataFrame([(1, 7, None, 0, "x"), (2, None, [0.0] * 3, 0, "x"), (3, 5, [0.0] * 3, 0, "x"), (4, 7, [1.0] * 3, 0, "x")], SCHEMA)
    got = {r["id"]: r for r in mixtures.score(odd, "bin", model).collect()}
    assert set(got) == {3, 4} and got[3]["nll"] is None and got[4]["entropy"] == pytest.approx(0)
    none = mixtures.fit(same.limit(0), "bin", F.col("start"))
    assert none.count() == 0 and mixtures.score(same.limit(0), "bin", none).count() == 0
