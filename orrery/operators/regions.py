"""Connected regions of score maps, their statistics, and greedy selection under a budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def label_maps(of: np.ndarray, r: np.ndarray, c: np.ndarray, reach8: bool = True) -> np.ndarray:
    """Number of each cell's region, for cells of many maps (``of`` numbers the map): cells that touch, by sides or also by
    corners, have one region. Neighbours are found by sorted places; regions are joined by their smallest number, again
    and again, with the way to it shortened each time."""
    n = len(r)
    if not n:
        return np.zeros(0, np.int64)
    r, c = r - r.min() + 1, c - c.min() + 1
    wide, high = int(c.max()) + 2, int(r.max()) + 2
    place = (of.astype(np.int64) * high + r) * wide + c
    order = np.argsort(place, kind="stable")
    at = place[order]
    one, other = [], []
    for step in (1, wide, wide - 1, wide + 1) if reach8 else (1, wide):
        k = np.minimum(np.searchsorted(at, at + step), n - 1)
        hit = np.flatnonzero(at[k] == at + step)
        one.append(order[hit])
        other.append(order[k[hit]])
    a, b = np.concatenate(one), np.concatenate(other)
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def label_grid(r: np.ndarray, c: np.ndarray, p: np.ndarray, reach8: bool = True) -> np.ndarray:
    """Smallest position ``p`` of each cell's region in one map."""
    return _smallest(label_maps(np.zeros(len(r), np.int64), r, c, reach8), p)


def _smallest(label: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = np.full(len(p), np.iinfo(np.int64).max)
    np.minimum.at(out, label, p)
    return out[label]


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``keys``, in parts that divide no key."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        new = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
        new[0] = not held or bool((pdf[keys].iloc[0] != held[-1][keys].iloc[-1]).any())
        if (starts := np.flatnonzero(new)).size:
            if held or starts[-1]:
                yield pd.concat([*held, pdf.iloc[: starts[-1]]], ignore_index=True)
            held, pdf = [], pdf.iloc[starts[-1] :]
        held.append(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


def connected_regions(cells: DataFrame, keys: list[str], active: Column, reach8: bool = True) -> DataFrame:
    """Active cells with ``root``, the smallest position of their region. A map must fit in memory; many are labelled at
    a time."""
    own = cells.where(active)
    kind = own.schema["p"].dataType
    schema = StructType([*own.schema.fields, StructField("root", kind)])

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, keys):
            of = np.cumsum((pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy())
            p = pdf["p"].to_numpy()
            yield pdf.assign(root=_smallest(label_maps(of, pdf["r"].to_numpy(), pdf["c"].to_numpy(), reach8), p).astype(p.dtype))

    return own.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(label, schema)


def region_stats(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Area, peak, mean, box and centre of every region."""
    size = lambda c: (F.max(c) - F.min(c) + 1).cast("int")
    return regions.groupBy(*keys, "root").agg(
        F.count("*").alias("area"), F.max("s").alias("peak"), F.avg("s").alias("mean_s"), size("r").alias("height"), size("c").alias("width"),
        F.avg("r").alias("row_c"), F.avg("c").alias("col_c"),
    )


def greedy_budget(stats: DataFrame, keys: list[str], order: Column, size: str, budget: int) -> DataFrame:
    """Regions by ``order`` from the largest; one that would overrun the budget is passed over and uses none of it."""
    items = F.sort_array(F.collect_list(F.struct((-order).alias("o"), F.col("root"), F.col(size).cast("long").alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<root: int, taken: int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["n"] <= budget
        mark = F.struct(x["root"].cast("int").alias("root"), fits.cast("int").alias("taken"))
        return F.struct(F.when(fits, acc["used"] + x["n"]).otherwise(acc["used"]).alias("used"), F.concat(acc["out"], F.array(mark)).alias("out"))

    folded = stats.groupBy(*keys).agg(items.alias("items")).select(*keys, F.explode(F.aggregate("items", start, step)["out"]).alias("x"))
    return folded.select(*keys, F.col("x.root").alias("root"), F.col("x.taken").alias("taken"))
