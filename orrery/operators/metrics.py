"""Ranking metrics as DataFrame plans; ties are handled by grouping equal scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Ranges that a table without keys is cut into, so that no task orders all of it.
RANGES = 64


def running(df: DataFrame, keys: list[str], order: list[Column], by: str, sums: dict[str, str], ranges: int = RANGES) -> DataFrame:
    """``df`` with running sums (name: column) in ``order``, whose first part is ``by`` from the top, and all_<name>, the
    totals. With keys, each is a window; without, rows fall into ranges of ``by`` between quantiles, each range starts
    from the totals of those above it, and no task holds more than a range (or the rows of one value)."""
    totals = lambda w: {f"all_{n}": F.sum(c).over(w) for n, c in sums.items()}
    if keys:
        part = Window.partitionBy(*keys)
        ordered = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(c).over(ordered) for n, c in sums.items()} | totals(part))
    edges = sorted(set(df.select(F.col(by).cast("double").alias("x")).approxQuantile("x", [k / ranges for k in range(1, ranges)], 1 / (4 * ranges))))
    bounds = F.array(*[F.lit(e) for e in edges]).cast("array<double>")
    own = df.withColumn("__range", -F.size(F.filter(bounds, lambda e: e < F.col(by))))
    # One row a range.
    small = own.groupBy("__range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    above = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = small.select("__range", *[F.coalesce(F.sum(n).over(above), F.lit(0)).alias(f"__b_{n}") for n in sums], *[F.sum(n).over(whole).alias(f"all_{n}") for n in sums])
    ordered = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = own.withColumns({n: F.sum(c).over(ordered) for n, c in sums.items()}).join(F.broadcast(before), "__range")
    return out.withColumns({n: F.col(n) + F.col(f"__b_{n}") for n in sums}).drop("__range", *[f"__b_{n}" for n in sums])


def _by_score(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """One row a distinct score with cumulative counts from the top; the rows shuffled are distinct scores only."""
    own = df.groupBy(*keys, score).agg(F.sum(label).alias("tp"), F.count("*").alias("n"))
    got = running(own, keys, [F.col(score).desc()], score, {"ctp": "tp", "cn": "n"})
    return got.select(*keys, score, "tp", "n", "ctp", "cn", F.col("all_ctp").alias("pos"), F.col("all_cn").alias("all"))


def auroc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve, ties one half; null where one class is missing."""
    own = _by_score(df, keys, score, label)
    above = F.col("cn") - F.col("ctp") - (F.col("n") - F.col("tp"))
    wins = F.sum(F.col("tp") * (F.col("all") - F.col("pos") - above - (F.col("n") - F.col("tp")) / 2))
    pairs = F.max(F.col("pos") * (F.col("all") - F.col("pos")))
    return own.groupBy(*keys).agg((wins / F.when(pairs > 0, pairs)).alias("auroc"))


def average_precision(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Sum over distinct thresholds of recall gained times precision; null without positives."""
    own = _by_score(df, keys, score, label)
    return own.groupBy(*keys).agg(F.sum(F.when(F.col("pos") > 0, F.col("tp") / F.col("pos") * F.col("ctp") / F.col("cn"))).alias("ap"))


def f1_max(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    own = _by_score(df, keys, score, label)
    return own.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("pos") > 0, 2 * F.col("ctp") / (F.col("cn") + F.col("pos")))), F.lit(0.0)).alias("f1_max"))


def conformal_p(df: DataFrame, keys: list[str], score: str, reference: str) -> DataFrame:
    """``df`` with p = (1 + references at or above the score) / (references + 1).

    References are counted once a distinct score and cumulated over scores, then joined by the next reference score, so
    neither references nor queries are paired.
    """
    refs = df.where(F.col(reference) == 1).groupBy(*keys, score).agg(F.count("*").alias("k"))
    marks = refs.select(*keys, score, "k").unionByName(df.where(F.col(reference) == 0).select(*keys, score).distinct().withColumn("k", F.lit(0).cast("long")))
    own = marks.groupBy(*keys, score).agg(F.sum("k").alias("k"))
    told = running(own, keys, [F.col(score).desc()], score, {"above": "k"}).select(*keys, score, ((1 + F.col("above")) / (F.col("all_above") + 1)).alias("p"))
    return df.join(told, [*keys, score])


def auroc_against(df: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """AUROC of each group's positives against the negatives of all: negatives are counted once for each score."""
    marks = df.groupBy(score).agg(F.sum(1 - F.col(label)).alias("neg"))
    told = running(marks, [], [F.col(score).desc()], score, {"at_least": "neg"})
    below = told.select(score, (F.col("all_at_least") - F.col("at_least") + F.col("neg") / 2).alias("wins"), F.col("all_at_least").alias("negatives"))
    own = df.where(F.col(label) == 1).groupBy(group, score).agg(F.count("*").alias("k"))
    got = own.join(below, score).groupBy(group).agg(F.sum(F.col("k") * F.col("wins")).alias("w"), F.sum("k").alias("k"), F.max("negatives").alias("negatives"))
    return got.select(group, (F.col("w") / (F.col("k") * F.col("negatives"))).alias("auroc"))
