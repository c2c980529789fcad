"""Calibration of scores by normal references: statistics are one small table by key, which rows are joined with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.sources.shared import written


def with_stats(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of ``stats`` for its keys (of the one row, without keys)."""
    return df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats.limit(1)))


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """keys, and each name's exact quantile (interpolated between the two rows around it; nulls left out). No task holds or
    orders all values of a key: a sketch gives a narrow range around each quantile, values below and inside it are counted,
    and only those inside are ordered. Where the counts show that a range misses its quantile (few rows, say), all values
    of that key stand for it. The steps' small tables are written, so joins with them need no shuffle of the rows."""
    own, names, off = df.select(*keys, F.col(value).cast("double").alias("__v")), list(probs), 2 / accuracy
    edges = [min(max(p + d, 0.0), 1.0) for p in probs.values() for d in (-off, off)]
    sketch = written(own.groupBy(*keys).agg(F.percentile_approx("__v", edges, accuracy).alias("__e"), F.count("__v").alias("__n")), "sketch")[0]
    v, e = F.col("__v"), F.col("__e")
    counts = [F.count_if(x).alias(f"__{c}{k}") for k in range(len(names)) for c, x in (("b", v < e[2 * k]), ("i", (v >= e[2 * k]) & (v <= e[2 * k + 1])))]
    counted = with_stats(sketch, with_stats(own, sketch, keys).groupBy(*keys).agg(*counts), keys)
    asked = []
    for k, p in enumerate(probs.values()):
        at = (F.col("__n") - 1) * F.lit(float(p))
        ok = (F.col(f"__b{k}") <= F.floor(at)) & (F.col(f"__b{k}") + F.col(f"__i{k}") > F.ceil(at))
        whole = lambda x, other: F.when(ok, x).otherwise(other)  # noqa: E731,B023
        asked.append(F.struct(F.lit(k).alias("k"), at.alias("at"), whole(e[2 * k], F.lit(float("-inf"))).alias("lo"), whole(e[2 * k + 1], F.lit(float("nan"))).alias("hi"), whole(F.col(f"__b{k}"), F.lit(0)).alias("below")))
    asked = written(counted.select(*keys, F.array(*asked).alias("__a")), "asked")[0]
    near = with_stats(own, asked, keys).select(*keys, "__v", F.explode(F.filter("__a", lambda t: (v >= t["lo"]) & (v <= t["hi"]))).alias("__t"))
    runs = near.groupBy(*keys, F.col("__t.k").alias("__k"), "__v").agg(F.count("*").alias("__c"), F.first("__t").alias("__t"))
    upto = F.col("__t.below") + F.sum("__c").over(Window.partitionBy(*keys, "__k").orderBy("__v"))
    at, low, high = F.col("__t.at"), F.floor("__t.at"), F.ceil("__t.at")
    found = runs.withColumn("__upto", upto).groupBy(*keys, "__k").agg(*[F.min(F.when(F.col("__upto") > x, v)).alias(n) for n, x in (("__l", low), ("__h", high))], F.first(at).alias("__at"))
    between = (F.ceil("__at") - F.col("__at")) * F.col("__l") + (F.col("__at") - F.floor("__at")) * F.col("__h")
    each = F.when(F.col("__l") == F.col("__h"), F.col("__l")).otherwise(between)
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("__k") == k, each)).alias(n) for k, n in enumerate(names)])
    every = sketch.select(*keys).join(wide, keys, "left") if keys else wide
    return written(every, "quantiles")[0]


def robust_stats(reference: DataFrame, keys: list[str], value: str, factor: float = 1.4826, floor: float = 1e-6) -> DataFrame:
    """center (median) and scale (median absolute deviation times ``factor``, ``floor`` at least)."""
    return _deviations(reference, keys, value, quantiles(reference, keys, value, {"center": 0.5}), factor, floor)


def _deviations(reference: DataFrame, keys: list[str], value: str, med: DataFrame, factor: float, floor: float) -> DataFrame:
    """``med`` (keys, center, ...) with scale."""
    off = with_stats(reference.select(*keys, F.col(value).alias("__x")), med.select(*keys, "center"), keys).withColumn("__off", F.abs(F.col("__x") - F.col("center")))
    scale = quantiles(off, keys, "__off", {"scale": 0.5})
    return with_stats(med, scale, keys).withColumn("scale", F.greatest(F.col("scale") * factor, F.lit(floor)))


def raw_deviation_stats(reference: DataFrame, keys: list[str], value: str, least: float = 1e-8) -> DataFrame:
    """center (median) and scale: the bare median absolute deviation, 1 where that is under ``least``."""
    got = robust_stats(reference, keys, value, 1.0, 0.0)
    return got.withColumn("scale", F.when(F.col("scale") < least, 1.0).otherwise(F.col("scale")))


def quartile_stats(reference: DataFrame, keys: list[str], value: str, more: float = 1e-8) -> DataFrame:
    """center (median) and scale (distance of the quartiles, and ``more``)."""
    q = lambda p: F.percentile(value, F.lit(p))
    return reference.groupBy(*keys).agg(F.median(value).alias("center"), (q(0.75) - q(0.25) + more).alias("scale"))


def rank_preserving_stats(
    reference: DataFrame, keys: list[str], value: str, least: float = 1e-6, floor_share: float = 0.05, lower: float = 0.01, upper: float = 0.99
) -> DataFrame:
    """center, scale, lower and upper support, and ``degenerate``: the scale is the floor. The scale is the largest of
    the robust deviation, the quartiles' distance over 1.349, and a floor (``floor_share`` of the range, ``least``)."""
    probs = {"center": 0.5, "__q1": 0.25, "__q3": 0.75, "lower": lower, "upper": upper}
    robust = _deviations(reference, keys, value, quantiles(reference, keys, value, probs), 1.4826, 0.0)
    span = reference.groupBy(*keys).agg(F.greatest(F.lit(least), (F.max(value) - F.min(value)) * floor_share).alias("floor"))
    both = with_stats(robust, written(span, "span")[0], keys).withColumn("quartiles", (F.col("__q3") - F.col("__q1")) / 1.349)
    spread = F.greatest("scale", "quartiles")
    return both.select(*keys, "center", F.greatest(spread, F.col("floor")).alias("scale"), "lower", "upper", (spread <= F.col("floor")).alias("degenerate"))


def robust_z(value: str, center: str = "center", scale: str = "scale") -> Column:
    return (F.col(value) - F.col(center)) / F.col(scale)


def logistic(z: Column, temperature: float = 1.0, clip: float = 50.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z / temperature, F.lit(clip)), F.lit(-clip))))


def rank_preserving(value: str, center: str = "center", scale: str = "scale") -> Column:
    """Strictly increasing, in (0, 1)."""
    return F.lit(0.5) + F.atan(robust_z(value, center, scale)) / 3.141592653589793


def upper_support(value: str, tolerance: float = 3.0, upper: str = "upper", scale: str = "scale") -> tuple[Column, Column, Column]:
    """Excess over the upper support in scales, whether that is more than ``tolerance``, and the confidence left."""
    excess = F.greatest(F.col(value) - F.col(upper), F.lit(0.0)) / F.col(scale)
    return excess, excess > tolerance, 1 / (1 + excess)


def binary_entropy(p: Column, edge: float = 1e-6) -> Column:
    """In bits."""
    x = F.greatest(F.least(p, F.lit(1 - edge)), F.lit(edge))
    return -(x * F.log2(x) + (1 - x) * F.log2(1 - x))
