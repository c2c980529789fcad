"""Greedy selection of rows, channels and reference images by how well they cover, and how little they repeat."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.knn import half_sq
from orrery.sources.shared import dropped, written

#: Rows that one pass brings to the driver, whatever the table's size.
BROUGHT = 256


def scales(rows: DataFrame, views: Sequence[str], start: int, sample: int = 64) -> list[float]:
    """Per view the median half squared distance of row ``start`` to ``sample`` rows (those with the smallest
    multiplicative hash of their id): a bounded sample that sets units only, not what is selected from."""
    first = rows.where(F.col("id") == start).first()
    if first is None:
        raise ValueError("no row has the id to start from")
    near = rows.orderBy((F.col("id") * 2654435761) % 4294967296, "id").limit(sample).collect()
    return [float(np.median(half_sq(np.array([first[v]], float), np.array([r[v] for r in near], float)))) for v in views]


def covering(rows: DataFrame, views: Sequence[str], units: Sequence[float], k: int, start: int) -> DataFrame:
    """id, place, gap: ``k`` rows from ``start`` on, each the one that is covered worst by those before it.

    How badly a row is covered is its largest distance, over the ``views`` (vector columns), to the nearest selected row:
    half the squared distance, in ``units`` of the view. Ties (at nine digits) go to the smaller id; equal rows can be
    selected once nothing else is left; fewer than ``k`` rows are all selected.

    A pass over the table lowers every row's distances by the rows selected since the last one, and brings the worst
    ``BROUGHT`` rows to the driver. There rows are selected one after the other, for as long as the worst of those
    brought is no better than the best row that was left behind: distances only fall, so the choice is the same as with
    one pass a row. Ids must be unique and not null, vectors not null.
    """
    spark = rows.sparkSession
    units = [max(float(u), 1e-8) for u in units]
    own = rows.select(F.col("id").cast("long").alias("id"), *[F.col(v).cast("array<double>").alias(v) for v in views])
    first = own.where(F.col("id") == start).first()
    if first is None:
        return spark.createDataFrame([], "id long, place int, gap double")
    state, path = own.withColumn("err", F.expr(f"array_repeat(double('infinity'), {len(views)})")), None
    chosen, new = [(start, 0, None)], [first]
    fields = ", ".join(f"{v} array<double>" for v in views)

    def worst(err: np.ndarray) -> np.ndarray:
        return np.round((err / units).max(axis=1), 9)

    while len(chosen) < k:
        picks = [np.array([r[v] for r in new], float) for v in views]
        gone = np.array([i for i, _, _ in chosen])

        def lowered(frames, picks=picks, gone=gone):
            for pdf in frames:
                pdf = pdf[~np.isin(pdf["id"], gone)]
                if len(pdf):
                    near = np.stack([half_sq(np.stack(list(pdf[v])), p).min(axis=1) for v, p in zip(views, picks, strict=True)], axis=1)
                    err = np.minimum(np.stack(list(pdf["err"])), near)
                    yield pdf.assign(err=list(err), gap=worst(err))

        moved, new_path = written(state.drop("gap").mapInPandas(lowered, f"id long, {fields}, err array<double>, gap double"), "covering")
        top = moved.orderBy(F.col("gap").desc(), "id").limit(BROUGHT + 1).collect()
        if path:
            dropped(spark, path)
        state, path = moved, new_path
        if not top:
            break
        bound = (-top[BROUGHT]["gap"], top[BROUGHT]["id"]) if len(top) > BROUGHT else None
        top = top[:BROUGHT]
        err, left, new = np.array([r["err"] for r in top]), np.ones(len(top), bool), []
        while left.any() and len(chosen) < k:
            gap = worst(err)
            gap[~left] = -1
            at = min(np.flatnonzero(gap == gap.max()), key=lambda i: top[i]["id"])
            if bound and (-gap[at], top[at]["id"]) > bound:
                break
            chosen.append((top[at]["id"], len(chosen), float(gap[at])))
            new.append(top[at])
            left[at] = False
            for j, v in enumerate(views):
                err[:, j] = np.minimum(err[:, j], half_sq(np.array([r[v] for r in top], float), np.array([top[at][v]], float))[:, 0])
    if path:
        dropped(spark, path)
    return spark.createDataFrame(chosen, "id long, place int, gap double")


def complementary(a: Sequence[float], b: Sequence[float], corr: np.ndarray, weight: float, keep: int) -> tuple[list[int], list[int]]:
    """``keep`` channels of each of two encoders, in ascending order.

    One channel is taken at a time, of the encoder whose best is better: its quality less ``weight`` times its largest
    absolute correlation with a channel that was taken of the other. Ties go to the first encoder, then to the smaller
    channel; a correlation that is not finite (a constant channel) counts as none. Once one encoder has no channel left,
    the other's are taken in order. All inputs are of the size of the channels.
    """
    value = np.concatenate([np.asarray(a, float), np.asarray(b, float)])
    side = np.repeat([0, 1], [len(a), len(b)])
    strength = np.zeros((len(value), len(value)))
    strength[: len(a), len(a) :] = np.abs(np.nan_to_num(np.asarray(corr, float), nan=0.0, posinf=0.0, neginf=0.0))
    strength += strength.T
    repeated, free, taken = np.zeros(len(value)), np.ones(len(value), bool), np.zeros(2, int)
    while free[side == 0].any() and free[side == 1].any() and (taken < keep).any():
        at = int(np.where(free & (taken < keep)[side], value - weight * repeated, -np.inf).argmax())
        free[at] = False
        taken[side[at]] += 1
        repeated = np.maximum(repeated, strength[at])
    for s in (0, 1):
        free[np.flatnonzero(free & (side == s))[: max(0, keep - taken[s])]] = False
    got = np.flatnonzero(~free)
    return [int(i) for i in got[side[got] == 0]], [int(i) - len(a) for i in got[side[got] == 1]]


def subset_coverage(near: DataFrame, images: Sequence[int], sizes: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """images, coverage: for every subset of ``images`` of these sizes, the mean over queries of the distance to the nearest
    row of its images. ``near`` has a row for each query and image (query, image, dist). The distances of a query are read
    once for all subsets; a subset of which a query has no distance has none itself (null).
    """
    images = list(images)
    sets = [s for n in sizes for s in combinations(range(len(images)), n)]
    one = near.groupBy("query").agg(*[F.min(F.when(F.col("image") == i, F.col("dist"))).alias(f"d{k}") for k, i in enumerate(images)])

    def run(frames):
        total, n = np.zeros(len(sets)), 0
        for pdf in frames:
            d = pdf[[f"d{k}" for k in range(len(images))]].to_numpy(float)
            d = np.where(np.isnan(d), np.inf, d)
            total += np.array([d[:, list(s)].min(axis=1).sum() for s in sets])
            n += len(d)
        if n:
            yield pd.DataFrame({"set": np.arange(len(sets)), "total": total, "n": n})

    named = F.element_at(F.array(*[F.array(*[F.lit(images[i]).cast("long") for i in s]) for s in sets]), F.col("set") + 1)
    mean = F.sum("total") / F.sum("n")
    got = one.mapInPandas(run, "set int, total double, n long").groupBy("set").agg(mean.alias("coverage"))
    return got.select(named.alias("images"), F.when(F.col("coverage") < float("inf"), F.col("coverage")).alias("coverage"))
