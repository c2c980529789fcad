"""Bootstrap of ranking metrics and means, with replicate weights that rows carry rather than copies.

A replicate gives each row a weight, a Poisson(1) number drawn from a hash of (row id, replicate): resampling with
replacement without anyone drawing for anyone else, so weights are the same wherever a row is, in every configuration
that has it (paired) and in both arms. Each class keeps its own weights, so classes are resampled apart (stratified).
Replicate 0 weighs all rows 1: what was observed.

Rows are sorted into ranges by (cell, arm, score) once. One pass gives each range's weight sums, arrays of one number a
replicate; their running sums tell each range where it starts; a second pass adds up average precision and AUROC from
there. No row is copied for a replicate, equal scores are one threshold, and no task holds more than a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Modulus of the hash, a prime, and its multipliers: products stay within 64 bits in any engine.
PRIME, STEP, TURN, AGAIN = 2_147_483_647, 48_271, 69_621, 16_807
#: Where the distribution function of Poisson(1) reaches 0, 1, 2, ... on the scale of the hash.
BOUNDS = [int(PRIME * p) for p in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)]
#: Numbers of a weight matrix that are made at a time.
CELLS = 1 << 21


def weight(row: Column, replicate: Column) -> Column:
    """Weight of a row (a whole number) in a replicate; 1 in replicate 0."""
    p = F.lit(PRIME).cast("long")
    a = (F.pmod(row.cast("long"), p) * STEP + 11) % p
    b = (a + replicate.cast("long") * TURN) % p
    c = (b * b % p * AGAIN + a) % p
    h = (c * c + replicate.cast("long")) % p
    drawn = sum((F.when(h >= x, 1).otherwise(0) for x in BOUNDS), F.lit(0))
    return F.when(replicate == 0, 1).otherwise(drawn)


def weights(rows: np.ndarray, replicates: int) -> np.ndarray:
    """``weight`` of all rows in replicates 0 to ``replicates``: rows x (replicates + 1)."""
    p, k = np.int64(PRIME), np.arange(replicates + 1, dtype=np.int64)
    a = (rows.astype(np.int64) % p * STEP + 11) % p
    b = (a[:, None] + k * TURN) % p
    c = (b * b % p * AGAIN + a[:, None]) % p
    h = (c * c + k) % p
    out = np.searchsorted(np.array(BOUNDS), h, side="right")
    out[:, 0] = 1
    return out


def weight_sql(row: str, replicate: str) -> str:
    """The same as SQL text."""
    a = f"((({row}) % {PRIME} + {PRIME}) % {PRIME} * {STEP} + 11) % {PRIME}"
    b = f"(({a}) + ({replicate}) * {TURN}) % {PRIME}"
    c = f"((({b}) * ({b})) % {PRIME} * {AGAIN} + ({a})) % {PRIME}"
    h = f"((({c}) * ({c})) + ({replicate})) % {PRIME}"
    return f"CASE WHEN ({replicate}) = 0 THEN 1 ELSE " + " + ".join(f"CASE WHEN {h} >= {x} THEN 1 ELSE 0 END" for x in BOUNDS) + " END"


def _chunks(n: int, replicates: int) -> Iterator[slice]:
    step = max(1, CELLS // (replicates + 1))
    return (slice(lo, min(lo + step, n)) for lo in range(0, n, step))


def _range_sums(replicates: int):
    """Summed weights of positives and of all rows, for each range, cell and arm that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def given() -> pa.RecordBatch:
            cols = [[k[i] for k in held] for i in range(3)] + [[v.tobytes() for v in held.values()]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["part", "cell", "arm", "sums"])

        for batch in batches:
            cell = batch.column("cell").dictionary_encode()
            names, part, arm = cell.dictionary.to_pylist(), batch.column("part").to_numpy(), batch.column("arm").to_numpy()
            y, row = batch.column("y").to_numpy(), batch.column("row").to_numpy()
            codes, group = np.unique(np.stack([part, cell.indices.to_numpy(), arm], axis=1), axis=0, return_inverse=True)
            order = np.argsort(group, kind="stable")
            for at in _chunks(len(order), replicates):
                own = order[at]
                w, g = weights(row[own], replicates), group[own]
                first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                both = np.stack([np.add.reduceat(w * y[own, None], first), np.add.reduceat(w, first)], axis=1)
                for k, sums in zip(g[first], both, strict=True):
                    key = (int(codes[k, 0]), names[codes[k, 1]], int(codes[k, 2]))
                    held[key] = held[key] + sums if key in held else sums
            if len(held) * (replicates + 1) > CELLS:
                yield given()
        if held:
            yield given()

    return run


def _starts(replicates: int):
    """Each range's sums of the ranges above it, and the sums of all."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.sort_values("part")
        parts, first = np.unique(own["part"].to_numpy(), return_index=True)
        sums = np.add.reduceat(np.stack([np.frombuffer(b, np.int64) for b in own["sums"]]), first)
        above = np.cumsum(sums, axis=0) - sums
        total = sums.sum(axis=0).tobytes()
        return pd.DataFrame({"part": parts, "cell": own["cell"].iloc[0], "arm": own["arm"].iloc[0], "above": [a.tobytes() for a in above], "total": total})

    return run


def _ties(score: np.ndarray, y: np.ndarray, row: np.ndarray, replicates: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Weights of positives and of all rows for runs of equal scores (sorted), some runs at a time, none divided."""
    kept = None
    for at in _chunks(len(score), replicates):
        s, w = score[at], weights(row[at], replicates)
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        pos, n = np.add.reduceat(w * y[at, None], first), np.add.reduceat(w, first)
        if kept is not None and kept[0] == s[0]:
            pos[0] += kept[1]
            n[0] += kept[2]
        elif kept is not None:
            yield kept[1][None], kept[2][None]
        kept = (s[-1], pos[-1], n[-1])
        if len(pos) > 1:
            yield pos[:-1], n[:-1]
    if kept is not None:
        yield kept[1][None], kept[2][None]


def _parts_of_metrics(replicates: int):
    """What each range adds to average precision and to the pairs that AUROC counts."""
    out = pa.schema([("cell", pa.string()), ("arm", pa.int64()), ("ap", pa.list_(pa.float64())), ("lost", pa.list_(pa.float64())), ("total", pa.list_(pa.int64()))])

    def run(rows: pa.Table, starts: pa.Table) -> pa.Table:
        made = []
        for start in starts.to_pylist():
            own = rows.filter(pc.and_(pc.equal(rows["cell"], start["cell"]), pc.equal(rows["arm"], start["arm"]))).sort_by([("score", "descending")])
            above, total = (np.frombuffer(start[c], np.int64).reshape(2, -1).copy() for c in ("above", "total"))
            ap, lost = np.zeros(replicates + 1), np.zeros(replicates + 1)
            for pos, n in _ties(own["score"].to_numpy(), own["y"].to_numpy(), own["row"].to_numpy(), replicates):
                at_pos, at_n = above[0] + np.cumsum(pos, axis=0), above[1] + np.cumsum(n, axis=0)
                ap += (pos * at_pos / np.maximum(at_n, 1)).sum(axis=0)
                lost += (pos * ((at_n - n) - (at_pos - pos) + (n - pos) / 2)).sum(axis=0)
                above = np.stack([at_pos[-1], at_n[-1]])
            made.append({"cell": start["cell"], "arm": start["arm"], "ap": ap.tolist(), "lost": lost.tolist(), "total": total.ravel().tolist()})
        return pa.Table.from_pylist(made, schema=out)

    return run


def metric_replicates(df: DataFrame, cells: list[str], row: str, label: str, arms: tuple[str, str], replicates: int) -> DataFrame:
    """cells, replicate, ap_a, ap_b, auroc_a, auroc_b: both arms' metrics of each cell in every replicate; null where a
    class has no weight. Rows without a label, id or either score are left out."""
    own = df.where(F.col(label).isNotNull() & F.col(row).isNotNull() & F.col(arms[0]).isNotNull() & F.col(arms[1]).isNotNull())
    both = F.array(*[F.struct(F.lit(k).cast("long").alias("arm"), F.col(a).cast("double").alias("score")) for k, a in enumerate(arms)])
    cell = F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("cell")
    rows = own.select(cell, F.col(row).cast("long").alias("row"), F.col(label).cast("long").alias("y"), F.inline(both))
    ranged = rows.repartitionByRange("cell", "arm", F.desc("score")).withColumn("part", F.spark_partition_id().cast("long"))
    sums = ranged.mapInArrow(_range_sums(replicates), "part long, cell string, arm long, sums binary")
    starts = sums.groupBy("cell", "arm").applyInPandas(_starts(replicates), "part long, cell string, arm long, above binary, total binary")
    schema = "cell string, arm long, ap array<double>, lost array<double>, total array<long>"
    parts = ranged.groupBy("part").cogroup(starts.groupBy("part")).applyInArrow(_parts_of_metrics(replicates), schema)
    n = replicates + 1
    each = parts.select("cell", "arm", "total", F.posexplode(F.arrays_zip("ap", "lost")).alias("replicate", "x"))
    pos = F.get("total", F.col("replicate"))
    each = each.select("cell", "arm", "replicate", "x.*", pos.alias("pos"), (F.get("total", F.col("replicate") + n) - pos).alias("neg"))
    pick = lambda c, k: F.sum(F.when(F.col("arm") == k, F.col(c)))
    p, q = F.max("pos"), F.max("neg")
    ap = lambda k: F.when(p > 0, pick("ap", k) / p)
    auroc = lambda k: F.when((p > 0) & (q > 0), 1 - pick("lost", k) / (p * q))
    got = each.groupBy("cell", "replicate").agg(ap(0).alias("ap_a"), ap(1).alias("ap_b"), auroc(0).alias("auroc_a"), auroc(1).alias("auroc_b"))
    names = F.from_json("cell", own.select(*cells).schema)
    return got.select(*[names[c].alias(c) for c in cells], "replicate", "ap_a", "ap_b", "auroc_a", "auroc_b")


def macro_deltas(got: DataFrame, config: list[str], cluster: str | None = None, salt: int = 1_000_003) -> DataFrame:
    """replicate, dap, dauroc: the mean over configurations of the mean over their cells of arm a less arm b; cells
    without the metric are left out. ``cluster`` (a number) weighs cells by weights of its own, so that whole categories
    are resampled too."""
    w = F.lit(1) if cluster is None else F.when(F.col("replicate") == 0, 1).otherwise(weight(F.col(cluster), F.col("replicate") + salt))
    own = got.select(*config, "replicate", w.alias("w"), (F.col("ap_a") - F.col("ap_b")).alias("ap"), (F.col("auroc_a") - F.col("auroc_b")).alias("auroc"))

    def mean(c: str) -> Column:
        has = F.sum(F.when(F.col(c).isNotNull(), F.col("w")))
        return F.when(has > 0, F.sum(F.col("w") * F.col(c)) / has)

    per = own.groupBy(*config, "replicate").agg(mean("ap").alias("dap"), mean("auroc").alias("dauroc"))
    return per.groupBy("replicate").agg(F.avg("dap").alias("dap"), F.avg("dauroc").alias("dauroc"))


def interval(deltas: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """observed (replicate 0), and of the other replicates mean, median, lo, hi and p_positive."""
    drawn = F.when(F.col("replicate") > 0, F.col(value))
    tail = (1 - level) / 2
    return deltas.groupBy(*keys).agg(
        F.max(F.when(F.col("replicate") == 0, F.col(value))).alias("observed"), F.avg(drawn).alias("mean"), F.percentile(drawn, F.lit(0.5)).alias("median"),
        F.percentile(drawn, F.lit(tail)).alias("lo"), F.percentile(drawn, F.lit(1 - tail)).alias("hi"), F.avg(F.when(drawn > 0, 1.0).when(drawn.isNotNull(), 0.0)).alias("p_positive"),
    )


def mean_replicates(df: DataFrame, keys: list[str], row: str, value: str, replicates: int) -> DataFrame:
    """keys, replicate, mean: weighted means of ``value`` by key, from sums that tasks make of what they read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).dictionary_encode()
            code, order = key.indices.to_numpy(), np.argsort(key.indices.to_numpy(), kind="stable")
            x, row_ = batch.column(2).to_numpy(), batch.column(1).to_numpy()
            names, found = key.dictionary.to_pylist(), []
            for at in _chunks(len(order), replicates):
                own = order[at]
                w, g = weights(row_[own], replicates), code[own]
                first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                found += zip([names[k] for k in g[first]], np.add.reduceat(w * x[own, None], first).tolist(), np.add.reduceat(w, first).tolist(), strict=True)
            cols = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.list_(pa.float64())), pa.array(cols[2], pa.list_(pa.int64()))], ["cell", "s", "w"])

    own = df.where(F.col(value).isNotNull() & F.col(row).isNotNull())
    cell = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("cell")
    sums = own.select(cell, F.col(row).cast("long").alias("row"), F.col(value).cast("double").alias("x")).mapInArrow(run, "cell string, s array<double>, w array<long>")
    each = sums.select("cell", F.posexplode(F.arrays_zip("s", "w")).alias("replicate", "z"))
    got = each.groupBy("cell", "replicate").agg((F.sum("z.s") / F.when(F.sum("z.w") > 0, F.sum("z.w"))).alias("mean"))
    names = F.from_json("cell", own.select(*keys).schema)
    return got.select(*[names[c].alias(c) for c in keys], "replicate", "mean")


def signed_rank(df: DataFrame, keys: list[str], delta: str, exact: int = 50) -> DataFrame:
    """Wilcoxon's signed-rank test that differences lie above zero: n (differences other than zero), w (summed ranks of
    the positive ones, ties sharing their mean rank), p_value. The null distribution is counted to the end for up to
    ``exact`` differences a key, by adding one rank after the other; beyond that it is the normal one with ties
    corrected. Ranks come from counts of distinct sizes, so that repeated differences are one row."""
    from pyspark.sql.window import Window

    own = df.where(F.col(delta).isNotNull() & (F.col(delta) != 0))
    sizes = own.groupBy(*keys, F.abs(delta).alias("__size")).agg(F.count("*").alias("__k"), F.sum((F.col(delta) > 0).cast("long")).alias("__up"))
    before = F.coalesce(F.sum("__k").over(Window.partitionBy(*keys).orderBy("__size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("__double_rank", 2 * before + F.col("__k") + 1)  # twice the mean rank is a whole number
    few = F.when(F.col("__k") <= exact, F.array_repeat(F.col("__double_rank"), F.col("__k").cast("int")))
    summed = ranked.groupBy(*keys).agg(
        F.sum("__k").alias("n"), F.sum(F.col("__up") * F.col("__double_rank")).alias("w2"), F.sum(F.col("__k") * F.col("__double_rank") * F.col("__double_rank")).alias("squares"),
        F.sum(F.col("__k") * F.col("__double_rank")).alias("all2"),
        F.collect_list(F.when(F.col("__double_rank") <= 4 * exact, few)).alias("lists"),
    )
    none = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    ways = F.aggregate(F.flatten("lists"), F.array(F.lit(1.0)), lambda acc, r: F.zip_with(F.concat(acc, none(r)), F.concat(none(r), acc), lambda a, b: a + b))
    reach = F.aggregate(F.slice(ways, F.col("w2").cast("int") + 1, F.size(ways)), F.lit(0.0), lambda a, b: a + b)
    z = (F.col("w2") - F.col("all2") / 2) / F.sqrt(F.col("squares") / 4)
    # The normal tail by its continued approximation of error below 1e-7 (Abramowitz and Stegun 26.2.17).
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / F.lit(2.5066282746310002) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    p = F.when(F.col("n") <= exact, reach / F.pow(F.lit(2.0), F.col("n"))).otherwise(F.when(z >= 0, tail).otherwise(1 - tail))
    return summed.select(*keys, "n", (F.col("w2") / 2).alias("w"), p.alias("p_value"))
