"""Signals of regions: which look like background, and how far the branches bear them out.

``cells`` are the cells of all maps (keys, r, c, branches), ``regions`` the cells of regions with ``root`` besides. All
results are one row a region.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators import grid


def _clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def shape_signals(regions: DataFrame, keys: list[str], shape: tuple[int, int], margin: int = 4, large: float = 0.1) -> DataFrame:
    """area, edge (the box comes within ``margin`` of the border), large (more than that share of the map), edge_gap and
    compactness (area over box)."""
    h, w = shape
    lo_r, hi_r, lo_c, hi_c = F.min("r"), F.max("r"), F.min("c"), F.max("c")
    return regions.groupBy(*keys, "root").agg(
        F.count("*").alias("area"),
        ((lo_r < margin) | (hi_r >= h - margin) | (lo_c < margin) | (hi_c >= w - margin)).alias("edge"),
        (F.count("*") > h * w * large).alias("large"),
        F.least(lo_r, h - 1 - hi_r, lo_c, w - 1 - hi_c).alias("edge_gap"),
        (F.count("*") / ((hi_r - lo_r + 1) * (hi_c - lo_c + 1))).alias("compactness"),
    )


def boundary(regions: DataFrame, keys: list[str]) -> DataFrame:
    """crossings: how often a step between neighbouring cells leaves the region. That is the number of points of its
    outline midway between cells (ends that close an outline are not counted twice)."""
    own = regions.select(*keys, "root", "r", "c")
    steps = own.select(*keys, "root", "r", "c", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))])).alias("s"))
    to = steps.select(*keys, "root", (F.col("r") + F.col("s.a")).alias("r"), (F.col("c") + F.col("s.b")).alias("c"))
    left = to.join(own, [*keys, "root", "r", "c"], "left_anti")
    area = own.groupBy(*keys, "root").agg(F.count("*").alias("area"))
    return area.join(left.groupBy(*keys, "root").agg(F.count("*").alias("crossings")), [*keys, "root"])


def fragmented(area: str, crossings: str, most: float = 3.0, least_area: int = 16) -> Column:
    """Outline over the perimeter of a circle as large; small regions always are."""
    return (F.col(area) < least_area) | (F.col(crossings) / (2 * F.sqrt(3.141592653589793 * F.col(area))) > most)


def scattered(peak: Column, mean: Column, area: Column, ratio: float = 0.5) -> Column:
    return F.when(area < 4, False).when(peak <= 0, True).otherwise(peak / F.greatest(mean, F.lit(1e-8)) < ratio)


def spatial_stability(cells: DataFrame, regions: DataFrame, keys: list[str], value: str, around: int = 3, fill: str | None = None) -> DataFrame:
    """stability: .35 concentration, .35 compactness, .30 contrast of the peak with the cells up to ``around`` steps away
    (steps go along rows and columns). ``fill``: a column of the regions that has their compactness."""
    size = regions.groupBy(*keys, "root").agg(
        F.count("*").alias("area"), F.max(value).alias("peak"), F.avg(value).alias("mean"),
        (F.first(fill) if fill else F.count("*") / ((F.max("r") - F.min("r") + 1) * (F.max("c") - F.min("c") + 1))).alias("compactness"),
    )
    offsets = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-around, around + 1) for b in range(-around, around + 1) if 0 < abs(a) + abs(b) <= around]
    own = regions.select(*keys, "root", "r", "c")
    near = own.select(*keys, "root", "r", "c", F.explode(F.array(*offsets)).alias("s")).select(*keys, "root", (F.col("r") + F.col("s.a")).alias("r"), (F.col("c") + F.col("s.b")).alias("c")).distinct()
    ring = near.join(own, [*keys, "root", "r", "c"], "left_anti").join(cells.select(*keys, "r", "c", value), [*keys, "r", "c"])
    got = size.join(ring.groupBy(*keys, "root").agg(F.avg(value).alias("outside")), [*keys, "root"], "left")
    contrast = F.when(F.col("outside").isNull(), 0.5).when(F.col("outside") > 0, _clip(F.col("peak") / F.col("outside"), 0, 5) / 5).otherwise(1.0)
    concentration = _clip((F.col("peak") / F.greatest(F.col("mean"), F.lit(1e-8)) - 1) / 3)
    score = _clip(0.35 * concentration + 0.35 * _clip(F.col("compactness") / 0.5) + 0.3 * contrast)
    return got.select(*keys, "root", F.when((F.col("area") < 4) | (F.col("peak") <= 0), 0.0).otherwise(score).alias("stability"))


def view_consistency(regions: DataFrame, keys: list[str], value: str, views: list[str]) -> DataFrame:
    """augmentation: mean over views of the smaller over the larger of the region's means in the value and the view; .5
    without views. prompt: 1 less the coefficient of variation of the views' means; .5 with fewer than two."""
    own = regions.groupBy(*keys, "root").agg(F.avg(value).alias("m"), *[F.avg(v).alias(f"v{k}") for k, v in enumerate(views)])
    mine, means = F.col("m"), [F.col(f"v{k}") for k in range(len(views))]
    ratio = [F.least(mine, v) / F.greatest(mine, v, F.lit(1e-8)) for v in means]
    augmentation = F.lit(0.5) if not views else F.when(mine <= 0, 0.0).otherwise(_clip(reduce(Column.__add__, ratio) / len(views)))
    prompt = F.lit(0.5)
    if len(views) > 1:
        mean = reduce(Column.__add__, means) / len(views)
        sd = F.sqrt(reduce(Column.__add__, [(v - mean) * (v - mean) for v in means]) / len(views))
        prompt = F.when(mean <= 0, 0.0).otherwise(_clip(1 - sd / F.greatest(mean, F.lit(1e-8))))
    return own.select(*keys, "root", augmentation.alias("augmentation"), prompt.alias("prompt"))


def background_risk(shapes: DataFrame, means: DataFrame, keys: list[str], shape: tuple[int, int], mean: str, reference: str) -> DataFrame:
    """risk: .3 nearness to the border, .3 area (full at a twentieth of the map), .4 likeness of the region's mean to the
    mean of the normal references. ``shapes`` of shape_signals, ``means`` with both means of each region."""
    h, w = shape
    got = shapes.join(means, [*keys, "root"])
    edge = _clip(1 - F.col("edge_gap") / max(h, w) * 10)
    like = F.when(F.col(reference).isNull(), 0.0).when(F.col(reference) > 0, _clip(1 - F.abs(F.col(mean) / F.col(reference) - 1))).otherwise(F.when(F.col(mean) > 0, 0.0).otherwise(1.0))
    return got.select(*keys, "root", _clip(0.3 * edge + 0.3 * _clip(F.col("area") / (h * w) / 0.05) + 0.4 * like).alias("risk"))


def first_reason(checks: list[tuple[str, Column]], kept: str = "kept") -> Column:
    """Name of the first check that holds."""
    out = F
    for name, holds in checks:
        out = out.when(holds, F.lit(name))
    return out.otherwise(F.lit(kept))
