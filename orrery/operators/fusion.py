"""Fusion of a visual and a text branch: score maps as rows (keys, r, c and a column for each branch).

Weights never look at labels, but for ``normal`` columns, which say which maps are known to be normal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators import calibration as cal
from orrery.operators import grid


def _clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def calibrated(df: DataFrame, keys: list[str], branches: list[str], normal: str) -> DataFrame:
    """``df`` with z_<branch>: value less median over the bare deviation, both of normal maps, by key."""
    for b in branches:
        stats = cal.raw_deviation_stats(df.where(F.col(normal) == 1), keys, b).select(*keys, F.col("center").alias(f"__c_{b}"), F.col("scale").alias(f"__s_{b}"))
        df = cal.with_stats(df, stats, keys)
    return df.withColumns({f"z_{b}": cal.robust_z(b, f"__c_{b}", f"__s_{b}") for b in branches}).drop(*[f"__{k}_{b}" for k in "cs" for b in branches])


def _share_of_peak(x: Column, image: list[str]) -> Column:
    return x / (F.max(x).over(Window.partitionBy(*image)) + 1e-8)


def _blend(df: DataFrame, weight: Column, visual: str, text: str) -> DataFrame:
    return df.withColumn("weight", weight).withColumn("fused", F.col("weight") * F.col(f"z_{visual}") + (1 - F.col("weight")) * F.col(f"z_{text}"))


def uncertainty_weighted(df: DataFrame, keys: list[str], image: list[str], shape: tuple[int, int], visual: str, text: str, normal: str, window: int = 7, base: float = 0.6, temperature: float = 1.0) -> DataFrame:
    """The visual weight falls where the visual branch varies more around a cell than the text branch does (each by its
    image's largest deviation)."""
    z = calibrated(df, keys, [visual, text], normal)
    z = z.withColumns({f"__q_{b}": F.col(f"z_{b}") * F.col(f"z_{b}") for b in (visual, text)})
    sums = {f"__{k}{b}": ("sum", c) for b in (visual, text) for k, c in (("a", f"z_{b}"), ("b", f"__q_{b}"))}
    z = grid.bordered_stencil(z, image, shape, window // 2, "symmetric", sums)
    n = float(window * window)
    sd = {b: F.sqrt(F.greatest(F.col(f"__b{b}") / n - (F.col(f"__a{b}") / n) ** 2, F.lit(0.0))) for b in (visual, text)}
    z = z.withColumns({f"u_{b}": sd[b] for b in (visual, text)}).drop(*sums, *[f"__q_{b}" for b in (visual, text)])
    apart = (_share_of_peak(F.col(f"u_{visual}"), image) - _share_of_peak(F.col(f"u_{text}"), image)) / temperature
    return _blend(z, _clip(base - (1 - base) * _clip(apart, -2, 2), 0.3, 0.9), visual, text)


def normal_reference_gated(df: DataFrame, keys: list[str], image: list[str], visual: str, text: str, normal: str, base: float = 0.6, temperature: float = 1.0) -> DataFrame:
    """The visual weight rises where the text branch is farther from the normal maps' mean at the cell."""
    z = calibrated(df, keys, [visual, text], normal)
    place = [*keys, "r", "c"]
    mean = z.where(F.col(normal) == 1).groupBy(*place).agg(*[F.avg(f"z_{b}").alias(f"__m_{b}") for b in (visual, text)])
    z = z.join(mean, place).withColumns({f"__d_{b}": F.abs(F.col(f"z_{b}") - F.col(f"__m_{b}")) for b in (visual, text)})
    apart = (_share_of_peak(F.col(f"__d_{text}"), image) - _share_of_peak(F.col(f"__d_{visual}"), image)) / temperature
    out = _blend(z, _clip(base + (1 - base) * _clip(apart, -2, 2), 0.3, 0.9), visual, text)
    return out.drop(*[f"__{k}_{b}" for k in "md" for b in (visual, text)])


def annealed(base: float, alpha: float, visual_ap: float, above: float = 0.8, factor: float = 0.3) -> tuple[float, float]:
    """Base weight and swing, tamed where the visual branch alone is already good."""
    if visual_ap <= above:
        return base, alpha
    text = (1 - base) * factor
    return (1 - text) / ((1 - text) + text), alpha * factor


def agreement_gated(df: DataFrame, keys: list[str], image: list[str], visual: str, text: str, normal: str, base: float = 0.6, alpha: float = 0.4, temperature: float = 1.0, visual_ap: float = 0.0) -> DataFrame:
    """The text weight follows the branches' agreement at a cell, 1 / (1 + difference over the image's largest)."""
    base, alpha = annealed(base, alpha, visual_ap)
    z = calibrated(df, keys, [visual, text], normal)
    agreement = 1 / (1 + temperature * _share_of_peak(F.abs(F.col(f"z_{visual}") - F.col(f"z_{text}")), image))
    return _blend(z, 1 - _clip(1 - base + alpha * (agreement - 0.5), 0.2, 0.8), visual, text)


def two_stage(df: DataFrame, keys: list[str], anchor: str, inner: list[str], normal: str, alpha: float = 0.7) -> DataFrame:
    """The mean of the inner branches, standardised like the anchor, blended with it and brought back to its scale."""
    own = df.withColumn("__inner", sum((F.col(b) for b in inner), F.lit(0.0)) / len(inner))
    for b, c in ((anchor, "a"), ("__inner", "i")):
        stats = cal.quartile_stats(own.where(F.col(normal) == 1), keys, b).select(*keys, F.col("center").alias(f"__c{c}"), F.col("scale").alias(f"__s{c}"))
        own = cal.with_stats(own, stats, keys)
    z = alpha * cal.robust_z(anchor, "__ca", "__sa") + (1 - alpha) * cal.robust_z("__inner", "__ci", "__si")
    return own.withColumn("fused", z * F.col("__sa") + F.col("__ca")).drop("__inner", "__ca", "__sa", "__ci", "__si")


def ensemble(df: DataFrame, weights: dict[str, float], anchor: str | None = None, anchor_ap: float = 0.0, above: float = 0.8, factor: float = 0.3) -> DataFrame:
    """Weighted mean of the finite branches; where the anchor alone is good, the others' weights shrink. A row without a
    finite branch is null."""
    own = {b: w * (factor if anchor and b != anchor and anchor_ap > above else 1.0) for b, w in weights.items()}
    ok = {b: F.col(b).isNotNull() & ~F.isnan(b) & (F.abs(F.col(b)) < float("inf")) for b in own}
    total = sum((F.when(ok[b], F.lit(w)).otherwise(0.0) for b, w in own.items()), F.lit(0.0))
    value = sum((F.when(ok[b], F.col(b) * w).otherwise(0.0) for b, w in own.items()), F.lit(0.0))
    return df.withColumn("fused", F.when(total > 0, value / total))


def best_branch(df: DataFrame, raw: dict[str, str], mode: str = "max", temperature: float = 1.0) -> DataFrame:
    """``raw`` names each branch's z. max: raw value of the branch with the largest z; softmax: mean of raw values by
    softmax of z; top2: mean of the raw values of the two largest z."""
    both = F.array(*[F.struct(F.col(z).alias("z"), F.col(b).alias("raw")) for b, z in raw.items()])
    if mode == "softmax":
        peak = F.greatest(*[F.col(z) for z in raw.values()])
        e = {b: F.exp((F.col(z) - peak) / temperature) for b, z in raw.items()}
        return df.withColumn("fused", sum((F.col(b) * e[b] for b in raw), F.lit(0.0)) / sum(e.values(), F.lit(0.0)))
    order = F.sort_array(both, asc=False)
    if mode == "max":
        return df.withColumn("fused", order[0]["raw"])
    return df.withColumn("fused", (order[0]["raw"] + order[1]["raw"]) / 2)


def safe_router(
    df: DataFrame, keys: list[str], image: list[str], shape: tuple[int, int], visual: str, text: str, reference: str, tolerance: float = 3.0,
    disagreement: float = 0.05, margin: float = 0.05, concentration: float = 0.1, most: float = 0.35,
) -> DataFrame:
    """Cells of the visual branch with help of the text branch where that is safe: both inside the support of the
    references, apart by ``disagreement``, text surer by ``margin`` bits and no less concentrated over the map. Weights
    are smoothed 3 x 3 and then gated again. Columns p_<branch>, weight (of text) and fused; keys whose calibration is
    degenerate keep the visual branch."""
    for b in (visual, text):
        stats = cal.rank_preserving_stats(df.where(F.col(reference) == 1), keys, b)
        df = cal.with_stats(df, stats.select(*keys, *[F.col(c).alias(f"__{c}_{b}") for c in ("center", "scale", "upper", "degenerate")]), keys)
        df = df.withColumn(f"p_{b}", cal.rank_preserving(b, f"__center_{b}", f"__scale_{b}"))
    over = Window.partitionBy(*image)
    sure = {}
    for b in (visual, text):
        mass = F.col(f"p_{b}") / F.sum(f"p_{b}").over(over)
        df = df.withColumn(f"__mass_{b}", mass).withColumn(f"__sure_{b}", 1 + F.sum(F.when(F.col(f"__mass_{b}") > 0, F.col(f"__mass_{b}") * F.log(f"__mass_{b}")).otherwise(0.0)).over(over) / F.log(F.lit(float(shape[0] * shape[1]))))
        sure[b] = cal.upper_support(b, tolerance, f"__upper_{b}", f"__scale_{b}")
    gain = cal.binary_entropy(F.col(f"p_{visual}")) - cal.binary_entropy(F.col(f"p_{text}"))
    allowed = (
        ~sure[visual][1] & ~sure[text][1] & (F.col(f"__sure_{text}") + concentration >= F.col(f"__sure_{visual}"))
        & (F.abs(F.col(f"p_{visual}") - F.col(f"p_{text}")) >= disagreement) & (gain >= margin) & ~F.col(f"__degenerate_{visual}") & ~F.col(f"__degenerate_{text}")
    )
    strength = _clip((gain - margin) / max(1 - margin, 1e-12), 0, 1)
    df = df.withColumn("__ok", allowed).withColumn("__w", F.when(allowed, most * strength * sure[text][2]).otherwise(0.0))
    df = grid.bordered_stencil(df, image, shape, 1, "edge", {"__sum": ("sum", "__w")})
    df = df.withColumn("weight", F.when(F.col("__ok"), _clip(F.col("__sum") / 9, 0, most)).otherwise(0.0))
    df = df.withColumn("fused", (1 - F.col("weight")) * F.col(f"p_{visual}") + F.col("weight") * F.col(f"p_{text}"))
    return df.drop(*[c for c in df.columns if c.startswith("__")])
