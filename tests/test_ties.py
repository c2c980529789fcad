"""Nearest rows with ties against numpy, over several blocks."""

import numpy as np
import pytest

from orrery.operators import knn


@pytest.mark.parametrize("block", [7, 4096])
def test_ties(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "BLOCK", block)
    rng = np.random.default_rng(0)
    q, b = rng.integers(0, 3, (12, 4)).astype(float), rng.integers(0, 3, (40, 4)).astype(float)
    b[20:30] = b[3]  # repeated rows
    rows = lambda m: spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "id long, vec array<double>")
    for tol in (1e-6, 0.5):
        got = {r["query"]: r for r in knn.nearest_with_ties(rows(q), rows(b), tol).collect()}
        assert len(got) == 12
        for k, v in enumerate(q):
            d = np.sqrt(((b - v) ** 2).sum(axis=1))
            assert got[k]["dist"] == pytest.approx(d.min()) and got[k]["bank"] == int(np.flatnonzero(np.isclose(d, d.min()))[0])
            assert got[k]["ties"] == (d <= d.min() + tol).sum()


def test_empty_bank(spark):
    rows = spark.createDataFrame([(1, [0.0])], "id long, vec array<double>")
    assert knn.nearest_with_ties(rows, rows.limit(0)).count() == 0
