"""Bootstrap replicates and rank tests against numpy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import bootstrap


def made(n=400, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    # Few distinct scores: ties run across ranges.
    return [(int(k * 7 - 900), "x" if k % 3 else "yé", int(y[k]), float(np.round(rng.normal() + y[k], 1)), float(np.round(rng.normal(), 0))) for k in range(n)]


def metrics(y, s, w):
    """Average precision with equal scores one threshold, and the share of pairs in order."""
    pos, neg = (w * y).sum(), (w * (1 - y)).sum()
    ap = area = 0.0
    for t in np.unique(s):
        at, above = s == t, s >= t
        ap += (w * y)[at].sum() * (w * y)[above].sum() / max(w[above].sum(), 1)
        area += (w * y)[at].sum() * ((w * (1 - y))[s < t].sum() + (w * (1 - y))[at].sum() / 2)
    return (ap / pos if pos else None), (area / (pos * neg) if pos and neg else None)


def test_weights():
    w = bootstrap.weights(np.arange(-5000, 15_000), 200)
    assert (w[:, 0] == 1).all()
    drawn = w[:, 1:]
    assert abs(drawn.mean() - 1) < 0.01 and abs(drawn.var() - 1) < 0.02
    # Neither replicates nor rows go together.
    assert np.abs(np.corrcoef(drawn[:, :50].T) - np.eye(50)).max() < 0.05
    assert np.abs(np.corrcoef(drawn[:40]) - np.eye(40)).max() < 0.35
    assert abs(drawn.sum(axis=0).std() / math.sqrt(len(drawn)) - 1) < 0.2


def test_weight_column(spark):
    rows = spark.range(-50, 50).crossJoin(spark.range(0, 21).withColumnRenamed("id", "r"))
    got = {(a, b): c for a, b, c in rows.select("id", "r", bootstrap.weight(F.col("id"), F.col("r"))).collect()}
    want = bootstrap.weights(np.arange(-50, 50), 20)
    assert all(want[a + 50, b] == c for (a, b), c in got.items())


@pytest.mark.parametrize("replicates, chunk", [(1, 1 << 21), (25, 200), (25, 1 << 21)])
def test_metric_replicates(spark, monkeypatch, replicates, chunk):
    monkeypatch.setattr(bootstrap, "CELLS", chunk)
    rows = made()
    df = spark.createDataFrame(rows + [(None, "x", 1, 0.5, 0.5), (1, "x", None, 0.5, 0.5), (2, "x", 1, None, 0.5)], "id long, cat string, y int, a double, b double").repartition(5)
    got = {(r["cat"], r["replicate"]): r for r in bootstrap.metric_replicates(df, ["cat"], "id", "y", ("a", "b"), replicates).collect()}
    assert len(got) == 2 * (replicates + 1)
    for cat in ("x", "yé"):
        own = [r for r in rows if r[1] == cat]
        ids, y, a, b = (np.array([r[k] for r in own]) for k in (0, 2, 3, 4))
        w = bootstrap.weights(ids, replicates)
        for k in range(replicates + 1):
            r = got[cat, k]
            for s, x in ((a, "a"), (b, "b")):
                ap, area = metrics(y, s, w[:, k])
                assert r[f"ap_{x}"] == pytest.approx(ap, abs=1e-9) and r[f"auroc_{x}"] == pytest.approx(area, abs=1e-9)


def test_one_class_and_empty(spark):
    schema = "id long, cat string, y int, a double, b double"
    got = bootstrap.metric_replicates(spark.createDataFrame([(1, "x", 0, 0.1, 0.2), (2, "x", 0, 0.3, 0.2)], schema), ["cat"], "id", "y", ("a", "b"), 3).collect()
    assert len(got) == 4 and all(r["ap_a"] is None and r["auroc_b"] is None for r in got)
    empty = bootstrap.metric_replicates(spark.createDataFrame([], schema), ["cat"], "id", "y", ("a", "b"), 3)
    assert empty.count() == 0 and empty.columns == ["cat", "replicate", "ap_a", "ap_b", "auroc_a", "auroc_b"]


def test_clusters(spark):
    got = spark.createDataFrame([(1, 7, r, 0.1 * r, 0.0, 0.0, 0.0) for r in range(5)] + [(2, 7, r, 1.0, 0.5, None, 0.0) for r in range(5)], "number long, cfg long, replicate int, ap_a double, ap_b double, auroc_a double, auroc_b double")
    plain = {r["replicate"]: r for r in bootstrap.macro_deltas(got, ["cfg"]).collect()}
    assert plain[3]["dap"] == pytest.approx((0.3 + 0.5) / 2) and plain[3]["dauroc"] == pytest.approx(0.0)
    w = {k: bootstrap.weights(np.array([k]), 1_000_010)[0] for k in (1, 2)}
    for r in bootstrap.macro_deltas(got, ["cfg"], cluster="number").collect():
        k = r["replicate"]
        a, b = (1, 1) if k == 0 else (w[1][k + 1_000_003], w[2][k + 1_000_003])
        want = (a * 0.1 * k + b * 0.5) / (a + b) if a + b else None
        assert r["dap"] == (pytest.approx(want) if want is not None else None)


def test_means_and_interval(spark):
    rows = made(150)
    df = spark.createDataFrame(rows, "id long, cat string, y int, a double, b double").repartition(3)
    got = bootstrap.mean_replicates(df, ["cat"], "id", "a", 40)
    by = {(r["cat"], r["replicate"]): r["mean"] for r in got.collect()}
    own = [r for r in rows if r[1] == "x"]
    w = bootstrap.weights(np.array([r[0] for r in own]), 40)
    want = (w * np.array([r[3] for r in own])[:, None]).sum(axis=0) / w.sum(axis=0)
    assert [by["x", k] for k in range(41)] == pytest.approx(list(want))
    told = {r["cat"]: r for r in bootstrap.interval(got, ["cat"], "mean").collect()}["x"]
    assert told["observed"] == pytest.approx(want[0]) and told["lo"] == pytest.approx(np.percentile(want[1:], 2.5)) and told["p_positive"] == pytest.approx((want[1:] > 0).mean())


def test_signed_rank(spark):
    rng = np.random.default_rng(2)
    cases = {"ties": [1, -1, 2, 2, -2, 3, 0, 5], "none": [0, 0], "up": [1, 2, 3, 4, 5], "down": [-1, -2], "many": list(np.round(rng.normal(0.3, 1, 80), 2))}
    df = spark.createDataFrame([(k, float(d)) for k, ds in cases.items() for d in ds], "k string, d double")
    got = {r["k"]: r for r in bootstrap.signed_rank(df, ["k"], "d").collect()}
    assert "none" not in got
    for k, ds in cases.items():
        d = np.array([x for x in ds if x])
        if not len(d):
            continue
        size = np.abs(d)
        rank = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
        w = rank[d > 0].sum()
        assert got[k]["n"] == len(d) and got[k]["w"] == pytest.approx(w)
        if len(d) <= 12:
            sums = [sum(r for r, b in zip(rank, bits, strict=True) if b) for bits in itertools.product((0, 1), repeat=len(d))]
            p = np.mean([s >= w for s in sums])
        else:
            z = (w - rank.sum() / 2) / math.sqrt((rank**2).sum() / 4)
            p = math.erfc(z / math.sqrt(2)) / 2
        assert got[k]["p_value"] == pytest.approx(p, abs=1e-6)


def test_exact_and_normal_agree(spark):
    d = [(float(k) * (-1) ** (k % 3 == 0),) for k in range(1, 46)]
    df = spark.createDataFrame(d, "d double")
    exact, normal = bootstrap.signed_rank(df, [], "d").first(), bootstrap.signed_rank(df, [], "d", exact=10).first()
    assert exact["p_value"] == pytest.approx(normal["p_value"], rel=0.1)
