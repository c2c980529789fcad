"""Operators on small made inputs with known results."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import vectors as fv
from orrery.operators import align, grid, guards, knn, linalg, metrics, regions
from orrery.sources import tables as src
from orrery.streaming import events as ev


def vectors(spark, x, **cols):
    rows = [(i, [float(v) for v in row], *[c[i] for c in cols.values()]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id long, vec array<double>" + "".join(f", {k} long" for k in cols))


def test_knn(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 7)
    r = np.random.default_rng(0)
    q, b = r.normal(size=(20, 5)), r.normal(size=(30, 5))
    b[9] = b[3]
    d = 0.5 * ((q[:, None] - b[None]) ** 2).sum(2)
    got = {(r["query"], r["place"]): r["bank"] for r in knn.knn_join(vectors(spark, q), vectors(spark, b), 3).collect()}
    for i in range(20):
        want = sorted(range(30), key=lambda j: (round(d[i, j], 9), j))[:3]
        assert [got[i, k + 1] for k in range(3)] == want
    own = vectors(spark, b, img=[i % 2 for i in range(30)])
    for r in knn.knn_join(own, own, other="img").collect():
        assert r["query"] % 2 != r["bank"] % 2


def test_alignment(spark):
    a = spark.createDataFrame([("A#1", 1), ("b\\2", 2)], "id string, x int")
    b = spark.createDataFrame([("B/2", 20), (" a-1", 10)], "id string, y int")
    assert sorted((r["x"], r["y"]) for r in align.strict_join(a, b, "id").collect()) == [(1, 10), (2, 20)]
    with pytest.raises(Exception, match="one to one"):
        align.strict_join(a, b.union(b.limit(1)), "id").collect()
    with pytest.raises(Exception, match="one to one"):
        align.strict_join(a, b.where("y = 20"), "id").collect()


def test_guards(spark):
    df = spark.createDataFrame([(1, 1.0), (1, float("nan")), (2, float("inf")), (3, None), (4, 9.0)], "id long, v double")
    r = guards.report(df, ["id"], ["v"], {"v": (0, 5)}).first()
    assert (r["n"], r["repeated_ids"], r["not_finite"]) == (5, 1, 3) and r["out_of_range"] == 4
    with pytest.raises(ValueError):
        guards.without_labels(df.withColumn("gt_sp", F.lit(1)))
    with pytest.raises(Exception, match="bad"):
        guards.checked(df, F.col("id") < 4, "bad").collect()


def test_metrics(spark):
    df = spark.createDataFrame([("a", 0, 0.1), ("a", 0, 0.2), ("a", 1, 0.8), ("a", 1, 0.9), ("b", 1, 0.5), ("b", 0, 0.5), ("c", 0, 1.0)], "g string, y int, s double")
    assert {r["g"]: r["f1_max"] for r in metrics.f1_max(df, ["g"], "s", "y").collect()}["a"] == 1.0
    assert {r["g"]: r["auroc"] for r in metrics.auroc(df, ["g"], "s", "y").collect()} == {"a": 1.0, "b": 0.5, "c": None}
    assert {r["g"]: r["ap"] for r in metrics.average_precision(df, ["g"], "s", "y").collect()} == {"a": 1.0, "b": 0.5, "c": None}
    cal = spark.createDataFrame([(0.1, 1), (0.2, 1), (0.3, 1), (0.4, 1), (0.5, 0), (0.05, 0)], "s double, ref int")
    assert sorted(r["p"] for r in metrics.conformal_p(cal, [], "s", "ref").where("ref = 0").collect()) == [0.2, 1.0]


def cells(spark, a):
    h, w = a.shape
    return spark.createDataFrame([(0, r * w + c, r, c, float(a[r, c])) for r in range(h) for c in range(w)], "m int, p int, r int, c int, s double")


def test_regions(spark):
    a = np.zeros((16, 16))
    a[2:5, 2:5], a[8:10, 8:10], a[14, 1] = 0.9, 0.7, 0.95
    got = regions.region_stats(regions.connected_regions(cells(spark, a), ["m"], F.col("s") > 0.5), ["m"]).collect()
    assert sorted(r["area"] for r in got) == [1, 4, 9] and max(r["peak"] for r in got) == 0.95
    stats = spark.createDataFrame([(0, 1, 10, 0.9), (0, 2, 5, 0.8), (0, 3, 2, 0.7)], "m int, root int, area long, mean_s double")
    taken = {r["root"]: r["taken"] for r in regions.greedy_budget(stats, ["m"], F.col("mean_s"), "area", 12).collect()}
    assert taken == {1: 1, 2: 0, 3: 1}


def test_grid(spark):
    a = np.arange(20.0).reshape(4, 5)
    got = {r["p"]: r["v"] / r["n"] for r in grid.stencil(cells(spark, a), ["m"], 1, {"v": ("sum", "s"), "n": ("count", "s")}).collect()}
    for r in range(4):
        for c in range(5):
            assert abs(got[r * 5 + c] - a[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2].mean()) < 1e-9


def test_linear_algebra(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 6)) @ np.diag([5, 3, 1, 0.1, 0.05, 0.01])
    df = vectors(spark, x)
    n, total, gram = linalg.moments(df)
    assert n == 60 and np.allclose(total, x.sum(0)) and np.allclose(gram, x.T @ x)
    res = {r["id"]: r["residual"] for r in linalg.pca_residual(df, df, 0.99).collect()}
    c = x - x.mean(0)
    u = np.linalg.svd(c, full_matrices=False)[2]
    share = np.cumsum(np.linalg.svd(c)[1] ** 2) / (c**2).sum()
    u = u[: int(np.searchsorted(share, 0.99) + 1)]
    assert np.allclose([res[i] for i in range(60)], np.linalg.norm(c - c @ u.T @ u, axis=1))
    far = linalg.farthest_first(df, 5).orderBy("place").collect()
    chosen = [0]
    for _ in range(4):
        d = ((x[:, None] - x[chosen][None]) ** 2).sum(2).min(1)
        chosen.append(int(d.argmax()))
    assert [r["id"] for r in far] == chosen
    exact = {r["query"]: r["dist"] for r in knn.knn_join(df, df.where("id < 30")).collect()}
    pruned = {r["query"]: r["dist"] for r in linalg.pivot_knn(df, df.where("id < 30"), 4).collect()}
    assert all(abs(exact[i] - pruned[i]) < 1e-9 for i in exact)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 2.0])], "a array<double>, b array<double>")
    r = df.select(fv.normalised(F.col("a")).alias("n"), fv.dot(F.col("a"), F.col("b")).alias("d"), fv.sq_l2(F.col("a"), F.col("b")).alias("s"), fv.quantised(F.col("a")).alias("q"), fv.norm(fv.fused(F.col("a"), F.col("b"))).alias("f")).first()
    assert r["n"] == [0.6, 0.8] and r["d"] == 8 and r["s"] == 13 and r["q"]["codes"] == [95, 127] and abs(r["f"] - 1) < 1e-12
    with pytest.raises(Exception, match="zero vector"):
        spark.createDataFrame([([0.0, 0.0],)], "a array<double>").select(fv.normalised(F.col("a"))).collect()


def test_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"bolt": {"0": {"1": ["a.png"], "2": ["a.png", "b.png"]}}}))
    got = src.read_manifest(spark, str(tmp_path / "m.json")).collect()
    assert sorted((r["category"], r["seed"], r["shot"], r["ord"], r["path"]) for r in got) == [("bolt", 0, 1, 0, "a.png"), ("bolt", 0, 2, 0, "a.png"), ("bolt", 0, 2, 1, "b.png")]
    maps = np.arange(24.0).reshape(2, 3, 4)
    np.savez(tmp_path / "x.npz", maps=maps)
    read = src.read_arrays(spark, str(tmp_path), "maps")
    assert read.count() == 2 and src.to_cells(read, ["item"], "values", 4).where("item = 1 and r = 2 and c = 3").first()["s"] == 23.0
    src.write_scores(read.select("item"), str(tmp_path / "out"), ["item"], {"made_by": "test"})
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    src.write_report(read.select("item"), str(tmp_path / "csv"))
    assert src.read_report(spark, str(tmp_path / "csv"), "item long").count() == 2


def test_stream(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    cal = rows.groupBy(F.col("event_type").alias("cat")).agg(F.avg("value").alias("center"), F.lit(1.0).alias("scale"))
    ev.run_once(ev.windowed_scores(ev.event_stream(spark, str(tmp_path / "in")), cal), str(tmp_path / "out"), str(tmp_path / "check"))
    got, last = spark.read.parquet(str(tmp_path / "out")), rows.agg(F.max("ts")).first()[0]
    want = rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").count().where(F.col("w.end") <= F.lit(last) - F.expr("interval 1 hour"))
    assert got.count() == want.count() and got.agg(F.sum("n")).first()[0] == want.agg(F.sum("count")).first()[0]


def test_more_sources(spark, tmp_path):
    for seed in (0, 1):
        d = tmp_path / "runs" / f"main_seed_{seed}_shot_2"
        d.mkdir(parents=True)
        (d / "r.csv").write_text("category,ap\nbolt,0.5\nmacro_mean,0.25\n")
    runs = src.read_runs(spark, str(tmp_path / "runs"), "category string, ap double")
    got = src.macro_rows(runs).collect()
    assert sorted((r["method"], r["seed"], r["shot"], r["ap"]) for r in got) == [("main", 0, 2, 0.25), ("main", 1, 2, 0.25)]
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r["a"] for r in src.read_lines(spark, str(tmp_path / "a.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{"a":\n')
    with pytest.raises(Exception, match="not JSON"):
        src.read_lines(spark, str(tmp_path / "b.jsonl"), "a int").collect()
    df = spark.createDataFrame([("x", 1), ("y", 2)], "unit string, v int")
    src.write_partial(df, str(tmp_path / "part"), "unit")
    src.write_partial(df.where("unit = 'y'").withColumn("v", F.lit(9)), str(tmp_path / "part"), "unit")
    assert sorted(r["v"] for r in spark.read.json(str(tmp_path / "part")).collect()) == [1, 9]
    img = tmp_path / "img" / "bolt" / "test" / "crack"
    img.mkdir(parents=True)
    (img / "001.png").write_bytes(b"x")
    r = src.index_images(spark, str(tmp_path / "img")).first()
    assert (r["category"], r["defect"], r["stem"]) == ("bolt", "crack", "001")


def test_every_pair_of_dimensions(spark, sf):
    import numpy as np

    import __spark_entry__  # noqa: F401  (fills the catalogue)
    from orrery.plans.kit import CATALOG, table

    x = np.array([r["embedding"] for r in table(spark, sf, "embeddings").select("embedding").collect()], dtype=float)
    for name, want, first in (("gram_matrix_all", x.T @ x, 0), ("covariance_all", np.cov(x.T, bias=True), 0), ("channel_corr_all", np.corrcoef(x.T), 1)):
        rows = [tuple(r) for r in CATALOG[name].run(spark, sf).collect()]
        assert sorted(r[:2] for r in rows) == [(i, j) for i in range(64) for j in range(i + first, 64)]
        assert all(abs(v - want[i, j]) < 2e-6 for i, j, v in rows), name


def test_midpoint_bank_score(spark, sf):
    import numpy as np

    from orrery.plans.kit import CATALOG, table

    rows = sorted((r["vec_id"], r["label"], r["embedding"]) for r in table(spark, sf, "embeddings").collect())
    ids, labels, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], dtype=float)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    near = lambda q, b: (0.5 * ((q[:, None] - b[None]) ** 2).sum(2)).min(1)
    ref = ids % 5 == 0
    mids = [(x[i] + x[j]) / 2 for i in np.flatnonzero(ref) for j in np.flatnonzero(ref) if ids[i] < ids[j] and labels[i] == labels[j] and (ids[i] * 7919 + ids[j]) % 13 == 0]
    cell = ids // 64 * 16 + ids // 16 % 4 * 4 + ids % 8 // 2
    grid = lambda own: {c: x[own & (cell == c)].mean(0) for c in set(cell[own])}
    q, b = grid(~ref), grid(ref)
    coarse = dict(zip(q, near(unit(np.array(list(q.values()))), unit(np.array(list(b.values())))), strict=True))
    plain, fine = near(x[~ref], x[ref]), near(x[~ref], np.concatenate([x[ref], unit(np.array(mids))]))
    want = {i: min(d, coarse[c]) for i, d, c in zip(ids[~ref], fine, cell[~ref], strict=True)}
    got = {r["vec_id"]: r["score"] for r in CATALOG["midpoint_bank_score"].run(spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in want)
    assert (fine < plain - 1e-9).any() and any(coarse[c] < d for d, c in zip(fine, cell[~ref], strict=True))


def test_midpoints_of_one_label(spark, tmp_path, monkeypatch):
    """One large label in several units, rows without a label, rows that are or nearly are each other's opposite (their
    midpoint has no direction, or one that only the sum itself tells)."""
    import duckdb
    import numpy as np
    import pandas as pd

    from orrery.operators import knn
    from __spark_entry__ import CATALOG

    monkeypatch.setattr(knn, "SIDE", 16, raising=False)
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 8)).astype(np.float32)
    x[65], x[650] = -x[0], -x[0] + np.float32(1e-3) * x[1]
    pd.DataFrame({"vec_id": range(3000), "embedding": list(x), "label": [None if i % 35 == 30 else 1 if i % 50 else 2 for i in range(3000)]}).astype({"label": "Int32"}).to_parquet(tmp_path / "embeddings.parquet")
    embeddings = duckdb.read_parquet(str(tmp_path / "embeddings.parquet"))  # noqa: F841
    want = dict(duckdb.sql(CATALOG["midpoint_bank_score"].sql.replace("range(64)", "range(8)")).fetchall())
    got = {t["vec_id"]: t["score"] for t in CATALOG["midpoint_bank_score"].run(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in want)


def test_midpoints_are_not_made(spark):
    """600 rows of one key have 179,700 midpoints; what meets the queries are the rows, once a side."""
    import numpy as np
    from pyspark.sql import functions as F

    from orrery.operators import knn

    x = np.random.default_rng(7).normal(size=(600, 4))
    bank = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").withColumn("key", F.lit(1))
    units = knn._packed_units(bank, "key", "key").collect()
    assert sum(len(u["vecs_a"]) + len(u["vecs_b"]) for u in units) == 2 * x.nbytes
    got = {t["query"]: t["dist"] for t in knn.nearest_midpoint(bank.where("id < 20"), bank.where("id >= 20"), "key", "key").collect()}
    i, j = np.triu_indices(580, 1)
    mids = x[20:][i] + x[20:][j]
    all_ = np.concatenate([x[20:], mids / np.linalg.norm(mids, axis=1, keepdims=True)])
    assert all(abs(got[k] - (0.5 * ((all_ - x[k]) ** 2).sum(1)).min()) < 1e-9 for k in range(20))


@pytest.mark.parametrize("cross", [0, 40, 10**6])
def test_pairs_by_bounds(monkeypatch, cross):
    """Single pairs and whole rows of pairs find the same largest product, from any value to beat; no pair, no change."""
    import numpy as np

    from orrery.operators import knn

    monkeypatch.setattr(knn, "CROSS", cross)
    r = np.random.default_rng(6)
    q, a, b = (r.normal(size=(n, 5)) for n in (40, 30, 35))
    q[:3] = -abs(q[:3]) * 9  # all products below 0
    a, b = abs(a), abs(b)
    unit = knn._Unit(np.arange(30), a, np.arange(35) - 3, b)
    sums = a[:, None] + b[None]
    value = np.where(np.arange(30)[:, None] < np.arange(35)[None] - 3, (q[:, None, None] * (sums / np.linalg.norm(sums, axis=2, keepdims=True))).sum(3), -np.inf)
    most = value.max((1, 2))
    for start in (np.full(40, -np.inf), most - 0.2, np.zeros(40), most + 0.1):
        for off in (1e-9, 0.01):  # products that are not exact
            best = start.copy()
            unit.better(q, *(q @ s.T + r.uniform(-off, off, (40, len(s))) for s in (a, b)), best, np.full(40, off))
            assert np.allclose(best, np.maximum(start, most), atol=1e-9)


def test_banded_search(spark, monkeypatch):
    """Several blocks a side, band and whole in one search, no row for a pair; a query far from any cell has no band."""
    import numpy as np

    from orrery.operators import knn

    monkeypatch.setattr(knn, "BLOCK", 8)
    r = np.random.default_rng(8)
    sides = [[(i, int(r.integers(0, 8)) if i else 20, int(r.integers(0, 8)), r.normal(size=4).tolist()) for i in range(n)] for n in (30, 21)]
    sides[1][0] = (0, 3, 3, [0.5] * 4)
    q, b = (spark.createDataFrame(s, "id long, row long, col long, vec array<double>") for s in sides)
    got = {t["id"]: (t["dw"], t["dg"]) for t in knn.banded(q, b).collect()}
    for i, row, col, vec in sides[0]:
        d = {(x[1], x[2], x[0]): 0.5 * ((np.array(vec) - np.array(x[3])) ** 2).sum() for x in sides[1]}
        near = [v for (y, x, _), v in d.items() if abs(y - row) <= 1 and abs(x - col) <= 1]
        assert np.isclose(got[i][1], min(d.values())) and (np.isclose(got[i][0], min(near)) if near else got[i][0] is None)
    assert got[0][0] is None
