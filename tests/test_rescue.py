"""Proposals, evidence, decisions and residuals of staged rescue against plain loops over arrays."""

from collections import deque

import numpy as np
import pytest

from orrery.operators import regions, rescue

L = rescue.Limits(min_area=3, max_share=0.3, text_above=0.6, third_above=0.7, visual_low=0.5, visual_high=2.5, margin=1, large=0.25, outline_area=3, rescue_share=0.08, reliability=0.3, background=0.9)
SHAPE = (14, 12)


def flood(mask, reach8=True):
    label, k = np.zeros(mask.shape, int), 0
    for at in zip(*np.nonzero(mask), strict=True):
        if label[at]:
            continue
        k += 1
        label[at], todo = k, deque([at])
        while todo:
            r, c = todo.popleft()
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    if (a or b) and (reach8 or not (a and b)) and 0 <= r + a < mask.shape[0] and 0 <= c + b < mask.shape[1] and mask[r + a, c + b] and not label[r + a, c + b]:
                        label[r + a, c + b] = k
                        todo.append((r + a, c + b))
    return label, k


def made(seed, n=6, blur=2):
    rng = np.random.default_rng(seed)
    out = rng.random((n, *SHAPE))
    for _ in range(blur):
        out = sum(np.roll(np.roll(out, a, 1), b, 2) for a in (-1, 0, 1) for b in (-1, 0, 1)) / 9
    out = (out - out.mean()) / out.std()
    return np.round(out, 6)


def frame(spark, **maps):
    rows = []
    n = next(iter(maps.values())).shape[0]
    for k in range(n):
        for r in range(SHAPE[0]):
            for c in range(SHAPE[1]):
                rows.append((k, r * SHAPE[1] + c, r, c, *[None if np.isnan(m[k, r, c]) else float(m[k, r, c]) for m in maps.values()]))
    return spark.createDataFrame(rows, "id int, p int, r int, c int, " + ", ".join(f"{m} double" for m in maps)).repartition(3)


def brute_found(v, t, q):
    out = []
    size = v.size
    branches = [("text", t, L.text_above), ("third", q, L.third_above), ("visual", np.clip(v, 0.5, 1.5), 0.5)]
    for name, m, above in branches:
        if name == "third" and not np.isfinite(m).all():
            continue
        label, k = flood(m > above)
        for i in range(1, k + 1):
            mask = label == i
            r, c = np.nonzero(mask)
            fill = mask.sum() / ((np.ptp(r) + 1) * (np.ptp(c) + 1))
            if L.min_area <= mask.sum() <= int(size * L.max_share) and fill >= L.min_compactness:
                out.append([mask, fill, m[mask].max(), {name}])
    done, left = [], out
    while left:
        own, rest = left[0], []
        for other in left[1:]:
            if (own[0] & other[0]).sum() / (own[0] | other[0]).sum() > L.overlap:
                own = [own[0] | other[0], own[1], own[2], own[3] | other[3]]
            else:
                rest.append(other)
        done.append(own)
        left = rest
    return sorted(done, key=lambda x: (-len(x[3]), -x[2]))


@pytest.mark.parametrize("seed", [1, 2])
def test_candidates_and_rescue(spark, seed):
    v, t, q = made(seed) * 0.8, made(seed + 10), made(seed + 20)
    t = 0.6 * t + 0.5 * v
    if seed == 2:
        q[1, 3, 4] = np.nan
    cells = frame(spark, v=v, t=t, q=q, a=t * 0.9, b=t * 1.2)
    got = rescue.candidate_regions(cells, ["id"], SHAPE, "v", "t", "q", L).collect()
    by = {}
    for x in got:
        by.setdefault((x["id"], x["root"]), []).append(x)
    total = 0
    for k in range(len(v)):
        want = brute_found(v[k], t[k], q[k])
        total += len(want)
        assert len({i for j, i in by if j == k}) == len(want)
        for i, (mask, fill, _, names) in enumerate(want):
            own = by[k, i + 1]
            assert {(x["r"], x["c"]) for x in own} == set(zip(*map(np.ndarray.tolist, np.nonzero(mask)), strict=True))
            assert own[0]["compactness"] == pytest.approx(fill) and own[0]["branches"] == ",".join(sorted(names))
    assert total > 15
    fused, said = rescue.rescue(cells, ["id"], SHAPE, "v", "t", "q", L, augmented=["a"], prompts=["a", "b"])
    said = {(x["id"], x["root"]): x for x in said.collect()}
    assert len(said) == total
    add = np.zeros(v.shape)
    budget = int(SHAPE[0] * SHAPE[1] * L.rescue_share)
    for k in range(len(v)):
        used = 0
        own = sorted((x for (j, _), x in said.items() if j == k and x["place"] is not None), key=lambda x: x["place"])
        for x in own:
            mask = brute_found(v[k], t[k], q[k])[x["root"] - 1][0]
            if x["reason"] in ("budget_clipped", "rescue_applied", "text_not_exceeding"):
                assert (x["reason"] == "budget_clipped") == (used + mask.sum() > budget)
            if x["reason"] == "rescue_applied":
                gap = np.where(mask, np.clip(t[k] - v[k], 0, x["allowed"]), 0)
                add[k][gap > 0] = gap[gap > 0]
                used += (gap > 0).sum()
    for x in fused.collect():
        assert x["residual"] == pytest.approx(add[x["id"], x["p"] // SHAPE[1], x["p"] % SHAPE[1]], abs=1e-9)
        assert x["fused"] == pytest.approx(v[x["id"], x["p"] // SHAPE[1], x["p"] % SHAPE[1]] + x["residual"])
    if seed == 1:
        assert {"rescue_applied", "budget_clipped"} <= {x["reason"] for x in said.values()}


def test_merging_grows_in_order():
    """What is taken up counts for those behind it; what was passed over begins again."""
    line = lambda a, b: {"at": set(range(a, b)), "compactness": 1.0, "peak": float(b), "from": {"text"}}
    a, b, c = line(0, 10), {**line(5, 15), "from": {"third"}}, {**line(9, 20), "from": {"visual"}}
    first = rescue.merged([a, b, c], 0.3)
    assert [(len(x["at"]), sorted(x["from"])) for x in first] == [(15, ["text", "third"]), (11, ["visual"])]
    other = rescue.merged([c, a, b], 0.3)
    assert [(len(x["at"]), x["peak"]) for x in other] == [(15, 20.0), (10, 10.0)]
    assert rescue.merged([], 0.3) == []


def test_outlines():
    square = (np.array([3, 3, 4, 4]), np.array([5, 6, 5, 6]))
    diagonal = (np.array([2, 3]), np.array([2, 3]))
    ring = tuple(np.array(x) for x in zip(*[(r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)], strict=True))
    # A square has 8 sides and one outline, two corners touching are two outlines, a ring has a hole.
    assert rescue.outline_lengths([square, diagonal, ring]).tolist() == [9, 10, 12 + 4 + 2]


def test_labels():
    rng = np.random.default_rng(0)
    for reach8 in (True, False):
        maps = rng.random((5, 20, 17)) < 0.45
        of, r, c = np.nonzero(maps)
        got = regions.label_maps(of, r, c, reach8)
        want = np.concatenate([flood(m, reach8)[0][m] + 1000 * k for k, m in enumerate(maps)])
        assert len(np.unique(got)) == len(np.unique(want)) == len({*zip(got.tolist(), want.tolist(), strict=True)})
    assert len(regions.label_maps(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int))) == 0
    n = 4000  # a snake: labels travel far
    assert len(np.unique(regions.label_maps(np.zeros(n, int), np.arange(n), np.zeros(n, int)))) == 1


def test_connected_regions_over_batches(spark):
    """Maps larger than a batch, and many in one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        maps = made(5, 4) > 0.1
        rows = [(f"m{k}", int(r * SHAPE[1] + c), int(r), int(c)) for k, m in enumerate(maps) for r, c in zip(*np.nonzero(m), strict=True)]
        df = spark.createDataFrame(rows, "id string, p int, r int, c int").repartition(2)
        from pyspark.sql import functions as F

        got = regions.connected_regions(df, ["id"], F.lit(True)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for k, m in enumerate(maps):
        label = flood(m)[0]
        own = {x["p"]: x["root"] for x in got if x["id"] == f"m{k}"}
        for i in range(1, label.max() + 1):
            ps = [int(r * SHAPE[1] + c) for r, c in zip(*np.nonzero(label == i), strict=True)]
            assert {own[p] for p in ps} == {min(ps)}


def test_evidence_without_extras(spark):
    v, t = made(3) * 0.8, made(13)
    cells = frame(spark, v=v, t=t)
    found = rescue.candidate_regions(cells, ["id"], SHAPE, "v", "t", None, L)
    got = rescue.evidence(cells, found, ["id"], SHAPE, "t").collect()
    assert got and all(x["augmentation"] == 0.5 and x["prompt"] == 0.5 and x["agreement"] in (0.0, 0.6) for x in got)


def test_empty(spark):
    cells = frame(spark, v=made(1) * 0, t=made(1) * 0, q=made(1) * 0)
    fused, said = rescue.rescue(cells.limit(0), ["id"], SHAPE, "v", "t", "q", L)
    assert fused.count() == 0 and said.count() == 0
    fused, said = rescue.rescue(cells, ["id"], SHAPE, "v", "t", "q", L)
    assert said.count() == 0 and fused.where("fused <> 0 or rescued").count() == 0 and fused.count() == 6 * 14 * 12


def test_scaled_like(spark):
    v, t = made(4), made(14) * 5 + 3
    got = rescue.scaled_like(frame(spark, v=v, t=t), "v", ["t"]).collect()
    q = lambda m: np.percentile(m, [25, 50, 75])
    want = (t - q(t)[1]) * ((q(v)[2] - q(v)[0] + 1e-8) / (q(t)[2] - q(t)[0] + 1e-8)) + q(v)[1]
    for x in got:
        assert x["t"] == pytest.approx(want[x["id"], x["r"], x["c"]])
