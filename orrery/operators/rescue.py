"""Staged rescue: regions that several branches propose, evidence for each, and a bounded residual under a budget.

``cells`` are the cells of all maps: keys, p (the place, row by row), r, c, and columns of scores for the visual branch
(the anchor), the text branch and, if there is one, a third. Nothing takes labels or masks. Proposals of one map are
merged in order, so a map must fit in memory; evidence, decisions and residuals are joins and aggregates over regions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from orrery.operators import regions, signals


@dataclass(frozen=True)
class Limits:
    """Thresholds of the three stages. They must be these for equal results."""

    # Proposals.
    min_area: int = 16
    max_share: float = 0.05
    min_compactness: float = 0.1
    text_above: float = 1.5
    third_above: float = 1.2
    visual_low: float = 0.5
    visual_high: float = 2.0
    overlap: float = 0.3
    # Regions that look like background.
    margin: int = 4
    large: float = 0.10
    peak_ratio: float = 0.5
    outline: float = 3.0
    outline_area: int = 16
    lone_text: float = 1.0
    lone_third: float = 0.8
    lone_visual: float = 0.5
    # Evidence.
    signal: float = 0.5
    reliability: float = 0.55
    agreement: float = 0.3
    background: float = 0.60
    augmentation: float = 0.4
    prompt: float = 0.4
    # Residual and budget.
    residual: float = 0.12
    rescue_share: float = 0.01
    scaled: bool = True


#: Weights of the five signals of reliability (fixed values).
WEIGHTS = {"excess": 0.25, "stability": 0.15, "augmentation": 0.20, "prompt": 0.20, "agreement": 0.20}


def outline_lengths(of: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Points of each region's outlines halfway between it and what surrounds it: one for each side at which it is left,
    and the first of each closed outline once more. Cells that touch by corners have outlines of their own; holes have
    one each, through which corners do connect. Regions (rows and columns of cells) do not touch the map's border."""
    sides, inside, outside = [], [], []
    for k, (r, c) in enumerate(of):
        own = np.zeros((np.ptp(r) + 3, np.ptp(c) + 3), dtype=bool)
        own[r - r.min() + 1, c - c.min() + 1] = True
        sides.append((own[1:] != own[:-1]).sum() + (own[:, 1:] != own[:, :-1]).sum())
        for to, cells in ((inside, own), (outside, ~own)):
            to.append(np.stack([np.full(cells.sum(), k), *np.nonzero(cells)]))
    out = np.array(sides, dtype=np.int64) - 1
    for cells, reach8 in ((np.concatenate(inside, axis=1), False), (np.concatenate(outside, axis=1), True)):
        label = regions.label_maps(*cells, reach8)
        out += np.bincount(cells[0][label == np.arange(len(label))], minlength=len(of))
    return out


def proposals(r: np.ndarray, c: np.ndarray, branches: list[tuple[str, np.ndarray, float]], size: int, limits: Limits) -> list[dict]:
    """Regions of each branch's cells above its threshold, in the order of branches and first places, that are neither
    too small, too large nor too loose. Cells are in the order of their places."""
    most, out = max(int(size * limits.max_share), limits.min_area), []
    on = [np.flatnonzero(s > above) for _, s, above in branches]
    of, at = np.repeat(np.arange(len(on)), [len(x) for x in on]), np.concatenate(on)
    label = regions.label_maps(of, r[at], c[at])
    order = np.argsort(label, kind="stable")  # a region's label is its first cell
    for own in np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if len(order) else ():
        (name, s, _), cells = branches[of[own[0]]], at[own]
        fill = len(cells) / ((np.ptp(r[cells]) + 1) * (np.ptp(c[cells]) + 1))
        if limits.min_area <= len(cells) <= most and len(cells) > 1 and fill >= limits.min_compactness:
            out.append({"at": set(cells.tolist()), "compactness": fill, "peak": float(s[cells].max()), "from": {name}})
    return out


def merged(found: list[dict], overlap: float) -> list[dict]:
    """Each region takes up those behind it that overlap with what it has grown to; its compactness and peak stay those
    it began with. Then by branches and peak, the most first."""
    left, out = list(found), []
    while left:
        own, rest = {**left[0], "at": set(left[0]["at"]), "from": set(left[0]["from"])}, []
        for other in left[1:]:
            both = len(own["at"] & other["at"])
            if both / max(len(own["at"]) + len(other["at"]) - both, 1) > overlap:
                own["at"] |= other["at"]
                own["from"] |= other["from"]
            else:
                rest.append(other)
        out.append(own)
        left = rest
    return sorted(out, key=lambda x: (-len(x["from"]), -x["peak"]))


def candidate_regions(cells: DataFrame, keys: list[str], shape: tuple[int, int], visual: str, text: str, third: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """Cells of the merged proposals (a cell may be in several): keys, root (1, 2, ... in order), p, r, c, compactness,
    branches (names, comma-joined), outline, visual, text, third. A third branch with a value missing in a map is left
    out there."""
    own = cells.select(*keys, "p", "r", "c", F.col(visual).cast("double").alias("visual"), F.col(text).cast("double").alias("text"), (F.col(third).cast("double") if third else F.lit(None).cast("double")).alias("third"))
    kinds = [f for f in own.schema.fields if f.name in (*keys, "p", "r", "c")]
    number = lambda n: StructField(n, DoubleType())
    schema = StructType([*kinds, StructField("root", IntegerType()), number("compactness"), StructField("branches", StringType()), StructField("outline", IntegerType()), *map(number, ("visual", "text", "third"))])

    def propose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p", ignore_index=True)
        r, c, v = (pdf[x].to_numpy() for x in ("r", "c", "visual"))
        branches = [("text", pdf["text"].to_numpy(), limits.text_above)]
        if np.isfinite(pdf["third"].to_numpy(dtype=float)).all():
            branches.append(("third", pdf["third"].to_numpy(), limits.third_above))
        else:
            pdf["third"] = np.nan
        # What the visual branch has above normal, however much, stands for a weak response.
        branches.append(("visual", np.clip(v, limits.visual_low, (limits.visual_low + limits.visual_high) / 2), limits.visual_low))
        found = merged(proposals(r, c, branches, shape[0] * shape[1], limits), limits.overlap)
        at = [np.array(sorted(x["at"])) for x in found]
        if not found:
            return pdf.iloc[:0].assign(root=0, compactness=0.0, branches="", outline=0)[schema.names]
        n = [len(x) for x in at]
        each = {"root": np.arange(1, len(found) + 1), "compactness": [x["compactness"] for x in found], "branches": [",".join(sorted(x["from"])) for x in found], "outline": outline_lengths([(r[x], c[x]) for x in at])}
        return pdf.iloc[np.concatenate(at)].assign(**{k: np.repeat(v, n) for k, v in each.items()})[schema.names]

    return own.groupBy(*keys).applyInPandas(propose, schema)


def background_reason(found: DataFrame, keys: list[str], shape: tuple[int, int], limits: Limits = Limits()) -> DataFrame:
    """keys, root, area, reason: the first of edge, large, scattered, fragmented and isolated that holds, or kept."""
    peaks = found.groupBy(*keys, "root").agg(
        F.max("text").alias("__t"), F.avg("text").alias("__m"), F.max("third").alias("__q"), F.max("visual").alias("__v"), F.first("outline").alias("__o")
    )
    own = signals.shape_signals(found, keys, shape, limits.margin, limits.large).join(peaks, [*keys, "root"])
    area = F.col("area")
    ragged = (area < limits.outline_area) | (F.col("__o") / (2 * F.sqrt(F.lit(np.pi) * area)) > limits.outline)
    alone = (F.col("__t") > limits.lone_text) & ~F.coalesce(F.col("__q") > limits.lone_third, F.lit(False)) & (F.col("__v") <= limits.lone_visual)
    checks = [("edge", F.col("edge")), ("large", F.col("large")), ("scattered", signals.scattered(F.col("__t"), F.col("__m"), area, limits.peak_ratio)), ("fragmented", ragged), ("isolated", alone)]
    return own.select(*keys, "root", "area", signals.first_reason(checks).alias("reason"))


def evidence(
    cells: DataFrame, found: DataFrame, keys: list[str], shape: tuple[int, int], text: str, center: str | None = None, scale: str | None = None, augmented: list[str] = (),
    prompts: list[str] = (), reference: str | None = None, limits: Limits = Limits(),
) -> DataFrame:
    """One row a region: excess over the normal range, stability, augmentation, prompt, agreement of the branches,
    reliability (their weighted mean), risk of being background and peak, the visual branch's. ``center``, ``scale``,
    ``augmented``, ``prompts`` and ``reference`` (the mean of normal maps) are columns of the cells."""
    at = [*keys, "p"]
    given = lambda c, default: (F.col(c) if c else F.lit(default)).cast("double")
    views = [F.col(c).alias(f"__view{k}") for k, c in enumerate([*augmented, *prompts])]
    more = cells.select(*at, given(center, 0.0).alias("__center"), F.greatest(given(scale, 1.0), F.lit(1e-8)).alias("__scale"), given(reference, None).alias("__ref"), *views)
    own = found.join(more, at)
    z = (F.col("text") - F.col("__center")) / F.col("__scale")
    clip = signals._clip
    excess = clip(0.5 * F.avg((z > 1).cast("double")) + 0.5 * clip(F.asinh(F.percentile(F.greatest(z, F.lit(0.0)), 0.5)) / 3))
    missing = F.max(F.col("third").isNull().cast("int")) == 1
    says, third = F.avg("text") > limits.signal, F.avg("third") > limits.signal
    agreement = F.when(~says, 0.0).when(missing, 0.6).when(third, 0.9).otherwise(0.3)
    base = own.groupBy(*keys, "root").agg(excess.alias("excess"), agreement.alias("agreement"), F.max("visual").alias("peak"), F.avg("text").alias("__mean"), F.avg("__ref").alias("__ref"))
    stable = signals.spatial_stability(cells.select(*keys, "r", "c", F.col(text).cast("double").alias("text")), found, keys, "text", fill="compactness")
    names = [f"__view{k}" for k in range(len(views))]
    by_view = signals.view_consistency(own, keys, "text", names[: len(augmented)]).select(*keys, "root", "augmentation")
    by_prompt = signals.view_consistency(own, keys, "text", names[len(augmented) :]).select(*keys, "root", "prompt")
    risk = signals.background_risk(signals.shape_signals(found, keys, shape), base, keys, shape, "__mean", "__ref")
    out = base
    for part in (stable, by_view, by_prompt, risk):
        out = out.join(part, [*keys, "root"])
    reliability = sum((w * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    return out.select(*keys, "root", *WEIGHTS, reliability.alias("reliability"), "risk", "peak")


def evidence_reason(limits: Limits = Limits()) -> Column:
    """The first test of ``evidence`` that a region fails, or passed."""
    return signals.first_reason(
        [
            ("reliability_too_low", F.col("reliability") < limits.reliability), ("branches_disagree", F.col("agreement") < limits.agreement),
            ("background_risk", F.col("risk") > limits.background), ("augmentation_unstable", F.col("augmentation") < limits.augmentation),
            ("prompts_disagree", F.col("prompt") < limits.prompt), ("visual_confident_normal", F.col("peak") < limits.visual_low),
            ("visual_confident_anomaly", F.col("peak") > limits.visual_high),
        ],
        kept="passed",
    )


def decisions(found: DataFrame, told: DataFrame, keys: list[str], shape: tuple[int, int], limits: Limits = Limits()) -> DataFrame:
    """One row a region that is no background: reason, allowed residual and order. ``told`` has evidence, reason and
    area. Regions come by reliability, the most first; one whose area would overrun the map's budget is passed over,
    and one that is rescued uses as much of it as it has cells where text exceeds the anchor."""
    allowed = limits.residual * (F.col("reliability") if limits.scaled else F.lit(1.0))
    above = found.groupBy(*keys, "root").agg(F.sum((F.col("text") > F.col("visual")).cast("long")).alias("cells"))
    own = told.join(above, [*keys, "root"]).withColumn("allowed", allowed).withColumn("cells", F.when(F.col("allowed") > 0, F.col("cells")).otherwise(0))
    item = F.struct((-F.col("reliability")).alias("o"), "root", "reason", F.col("area").cast("long").alias("area"), F.col("cells").cast("long").alias("cells"), "allowed")
    budget = int(shape[0] * shape[1] * limits.rescue_share)
    empty = F.array().cast("array<struct<root: int, reason: string, place: int, allowed: double>>")
    start = F.struct(F.lit(0).cast("long").alias("used"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        reason = F.when(x["reason"] != "passed", x["reason"]).when(acc["used"] + x["area"] > budget, "budget_clipped").when(x["cells"] == 0, "text_not_exceeding").otherwise("rescue_applied")
        mark = F.struct(x["root"].alias("root"), reason.alias("reason"), F.size(acc["out"]).alias("place"), x["allowed"].alias("allowed"))
        used = acc["used"] + F.when(reason == "rescue_applied", x["cells"]).otherwise(0)
        return F.struct(used.alias("used"), F.concat(acc["out"], F.array(mark)).alias("out"))

    folded = own.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return folded.select(*keys, F.inline(F.aggregate("items", start, step)["out"]))


def scaled_like(cells: DataFrame, anchor: str, branches: list[str], exact: bool = True) -> DataFrame:
    """``cells`` with each branch moved and stretched to the anchor's median and interquartile range over all maps.
    ``exact`` quantiles hold all distinct values of the table; without it they are approximate ones of bounded size."""
    names = [anchor, *branches]
    at = [0.25, 0.5, 0.75]
    quantiles = [(F.percentile(c, F.array(*map(F.lit, at))) if exact else F.percentile_approx(c, at, 100_000)).alias(f"__q{k}") for k, c in enumerate(names)]
    own = cells.crossJoin(F.broadcast(cells.agg(*quantiles)))  # one row
    middle = lambda k: F.get(f"__q{k}", F.lit(1))
    width = lambda k: F.get(f"__q{k}", F.lit(2)) - F.get(f"__q{k}", F.lit(0)) + 1e-8
    moved = {c: (F.col(c) - middle(k + 1)) * (width(0) / width(k + 1)) + middle(0) for k, c in enumerate(branches)}
    return own.withColumns(moved).drop(*[f"__q{k}" for k in range(len(names))])


def rescue(
    cells: DataFrame, keys: list[str], shape: tuple[int, int], visual: str, text: str, third: str | None = None, limits: Limits = Limits(), **columns
) -> tuple[DataFrame, DataFrame]:
    """Fused cells (keys, p, fused, residual, rescued) and the decision of each candidate region (keys, root, area,
    reason, place, allowed; place is null where the region looked like background). ``columns`` go to ``evidence``.
    Where rescued regions overlap, the one that came last says the residual. Image scores are not touched. Cells of the
    regions are kept by the executors (persist), which make them anew if they are lost."""
    found = candidate_regions(cells, keys, shape, visual, text, third, limits).persist()  # used by all that follows
    looks = background_reason(found, keys, shape, limits)
    kept = found.join(looks.where("reason = 'kept'").select(*keys, "root", "area"), [*keys, "root"])
    told = evidence(cells, kept, keys, shape, text, limits=limits, **columns).withColumn("reason", evidence_reason(limits))
    told = told.join(looks.select(*keys, "root", "area"), [*keys, "root"])
    said = decisions(kept, told, keys, shape, limits)
    used = said.where("reason = 'rescue_applied'").select(*keys, "root", "place", "allowed")
    gap = F.col("text") - F.col("visual")
    on = kept.join(used, [*keys, "root"]).where(gap > 0).groupBy(*keys, "p").agg(F.max_by(F.least(gap, F.col("allowed")), F.col("place")).alias("residual"))
    own = cells.select(*keys, "p", F.col(visual).cast("double").alias("visual")).join(on, [*keys, "p"], "left")
    add = F.coalesce("residual", F.lit(0.0))
    fused = own.select(*keys, "p", (F.col("visual") + add).alias("fused"), add.alias("residual"), F.col("residual").isNotNull().alias("rescued"))
    background = looks.where("reason <> 'kept'").select(*keys, "root", "area", "reason", F.lit(None).cast("int").alias("place"), F.lit(None).cast("double").alias("allowed"))
    return fused, background.unionByName(said.join(looks.select(*keys, "root", "area"), [*keys, "root"]).select(background.columns))


@dataclass(frozen=True)
class Selective:
    """Thresholds of the selective rescue (fixed values, as above)."""

    text_reliability: float = 0.50
    gap: float = 0.10
    image_ambiguity: float = 1.00
    pixel_ambiguity: float = 1.50
    min_cells: int = 4
    max_share: float = 0.25
    images: bool = False
    pixels: bool = True
    image_residual: float = 0.05
    pixel_residual: float = 0.15


def selective_rescue(images: DataFrame, cells: DataFrame, keys: list[str], shape: tuple[int, int], limits: Selective = Selective()) -> tuple[DataFrame, DataFrame]:
    """Images (keys, score, residual, decision) and cells (keys, p, fused, residual, allowed) after text has helped where
    the anchor is unsure. ``images`` has visual, text, visual_reliability and text_reliability, ``cells`` p, r, c,
    visual, text and text_reliability. Help is bounded and never takes away; cells get it in regions, joined by sides,
    of a size between the limits."""
    gap = F.col("text") - F.col("visual")
    wants = F.lit(limits.pixels) & (F.col("text_reliability") >= limits.text_reliability) & (F.col("visual") <= limits.pixel_ambiguity) & (gap >= limits.gap)
    own = cells.select(*keys, "p", "r", "c", "visual", "text", "text_reliability")
    on = regions.connected_regions(own, keys, wants, reach8=False).select(*keys, "p", "root")
    most = max(int(shape[0] * shape[1] * limits.max_share), 1)
    fit = on.groupBy(*keys, "root").agg(F.count("*").alias("n")).where(F.col("n").between(limits.min_cells, most)).select(*keys, "root")
    allowed = on.join(fit, [*keys, "root"]).select(*keys, "p", F.lit(True).alias("allowed"))
    add = F.when(F.col("allowed"), F.greatest(F.least(gap, F.lit(limits.pixel_residual)), F.lit(0.0))).otherwise(0.0)
    fused = own.join(allowed, [*keys, "p"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))
    fused = fused.select(*keys, "p", (F.col("visual") + add).alias("fused"), add.alias("residual"), "allowed")
    some = fused.where("allowed").groupBy(*keys).agg(F.max(F.col("residual") > 0).alias("__any"))
    able = F.col("text_reliability") >= limits.text_reliability
    chance = F.lit(limits.images) & able & (F.abs("visual") <= limits.image_ambiguity) & (gap >= limits.gap)
    help_ = F.when(chance, F.greatest(F.least(gap, F.lit(limits.image_residual)), F.lit(0.0))).otherwise(0.0)
    sure = (F.col("visual_reliability") >= F.col("text_reliability")) & (F.abs("visual") > limits.image_ambiguity)
    used = (F.col("residual") > 0) | F.coalesce("__any", F.lit(False))
    decision = F.when(used, "text_rescue_applied").when(sure, "visual_confident").when(~able & F.col("__any").isNull(), "text_ineligible").otherwise("no_rescue_opportunity")
    told = images.join(some, keys, "left").withColumn("residual", help_).withColumn("decision", decision)
    return told.select(*keys, (F.col("visual") + F.col("residual")).alias("score"), "residual", "decision"), fused
