"""Cheapest one-to-one matching of two equally many sets of vectors by squared distance, exact, for many groups at a time.

No task holds a group's costs. A small linear programme over candidate pairs (the nearest of each row and column) is
solved by group; its prices are then tried on every pair, in blocks spread over the cluster: pairs that would lower the
cost become candidates, and it ends when there is none, which proves the matching cheapest among all pairs. A group's
task holds its candidates only, some dozens a row.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.knn import BLOCK, half_sq
from orrery.sources.shared import dropped, written

#: Candidates of a row and block of columns in a round; how far below zero a pair's reduced cost must be to count; pairs up
#: to that share of the mean cost above zero come along, as prices that move will want them next.
NEAR, TOL, SLACK = 16, 1e-11, 0.03


def sparse_assignment(n: int, row: np.ndarray, col: np.ndarray, cost: np.ndarray, prices: np.ndarray) -> tuple[list[int], list[float], list[float]]:
    """Column of each row in a cheapest perfect matching of the given pairs (there must be one), and the rows' and
    columns' prices, which no given pair's cost is below. Starts from ``prices`` of columns; shortest augmenting paths
    after some rounds in which rows outbid each other."""
    order = np.lexsort((cost, row))
    ptr = np.searchsorted(row[order], np.arange(n + 1)).tolist()
    own = [list(zip(col[order[a:b]].tolist(), cost[order[a:b]].tolist(), strict=True)) for a, b in zip(ptr, ptr[1:], strict=False)]
    v, owner, match, u = prices.tolist(), [-1] * n, [-1] * n, [0.0] * n
    free, left = list(range(n)), 20 * n
    while free and left:
        left -= 1
        i = free.pop()
        one = two = float("inf")
        at = -1
        for j, c in own[i]:
            x = c - v[j]
            if x < one:
                one, two, at = x, one, j
            elif x < two:
                two = x
        u[i] = two if two < float("inf") else one
        if two < float("inf"):
            v[at] -= two - one
        before, owner[at], match[i] = owner[at], i, at
        if before >= 0:
            match[before] = -1
            if two > one:
                free.append(before)
            else:  # a tie: the one that was outbid waits for its path
                free.insert(0, before)
    for s in (i for i in range(n) if match[i] < 0):
        u[s] = min(c - v[j] for j, c in own[s])
        dist, back, done, heap, i, d = {}, {}, {}, [], s, 0.0
        while True:
            less = d - u[i]
            for j, c in own[i]:
                if j not in done:
                    x = less + c - v[j]
                    if x < dist.get(j, float("inf")):
                        dist[j], back[j] = x, i
                        heapq.heappush(heap, (x, j))
            while heap[0][1] in done:
                heapq.heappop(heap)
            d, j = heapq.heappop(heap)
            if owner[j] < 0:
                break
            done[j] = d
            i = owner[j]
        for k, x in done.items():
            v[k] += x - d
            u[owner[k]] += d - x
        u[s] += d
        while True:
            i = back[j]
            owner[j], match[i], j = i, j, match[i]
            if i == s:
                break
    return match, u, v


def _blocks(side: DataFrame, name: str) -> DataFrame:
    by = F.expr(f"at div {BLOCK}").alias(name)
    return side.groupBy("cell", by).agg(F.collect_list(F.struct("at", "price", "vec")).alias(f"{name}_rows"))


def _cheaper(q: DataFrame, b: DataFrame) -> DataFrame:
    """cell, row, col, c, below: of each block of columns the at most ``NEAR`` pairs of a row of lowest reduced cost, as far
    as that is below the slack; ``below`` where it is below zero."""

    def search(frames):
        for pdf in frames:
            for cell, qs, bs in zip(pdf["cell"], pdf["q_rows"], pdf["b_rows"], strict=True):
                bv, bi, bp = np.stack([r["vec"] for r in bs]), np.array([r["at"] for r in bs]), np.array([r["price"] for r in bs])
                m = min(NEAR, len(bi))
                for i in range(0, len(qs), 512):
                    part = qs[i : i + 512]
                    c = 2 * half_sq(np.stack([r["vec"] for r in part]), bv)
                    x = c - bp - np.array([r["price"] for r in part])[:, None]
                    at = np.argpartition(x, m - 1, axis=1)[:, :m]
                    low = np.take_along_axis(x, at, 1)
                    ok = low < SLACK * c.mean()
                    rows = np.repeat([r["at"] for r in part], m).reshape(at.shape)
                    yield pd.DataFrame({"cell": cell, "row": rows[ok], "col": bi[at][ok], "c": np.take_along_axis(c, at, 1)[ok], "below": low[ok] < -TOL})

    return q.join(b, "cell").repartition("cell", "q", "b").select("cell", "q_rows", "b_rows").mapInPandas(search, "cell long, row long, col long, c double, below boolean")


def cheapest_matching(rows: DataFrame, cols: DataFrame) -> DataFrame:
    """cell, cost of the cheapest matching. Both sides are (cell long, at, vec array<double>), ``at`` counting from 0 in
    each cell, as many on either side."""
    spark = rows.sparkSession
    found, (x, x_path), (y, y_path) = None, written(rows, "rows"), written(cols, "cols")
    # Before there are prices every pair is a candidate: the nearest columns of each row, nearest rows of each column.
    fresh = lambda side, price: _blocks(side.withColumn("price", F.lit(price)), "q" if price else "b")
    ahead = _cheaper(fresh(x, 1e300), fresh(y, 0.0)).drop("below")
    behind = _cheaper(fresh(y, 1e300), fresh(x, 0.0)).select("cell", F.col("col").alias("row"), F.col("row").alias("col"), "c")
    # A pair of equal places for each row, so that a matching exists.
    same = x.join(y.withColumnRenamed("vec", "other"), ["cell", "at"]).select("cell", F.col("at").alias("row"), F.col("at").alias("col"), F.aggregate(F.zip_with("vec", "other", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, z: s + z).alias("c"))
    found, path = written(ahead.union(behind).union(same).groupBy("cell", "row", "col").agg(F.min("c").alias("c")), "pairs")
    paths, prices = [path], x.select("cell", "at", F.lit(0.0).alias("v"))
    schema = "cell long, at long, u double, v double, match long"

    def solve(key, pairs: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        v = before.sort_values("at")["v"].to_numpy(float)
        match, u, v = sparse_assignment(len(v), pairs["row"].to_numpy(), pairs["col"].to_numpy(), pairs["c"].to_numpy(), v)
        return pd.DataFrame({"cell": key[0], "at": np.arange(len(v)), "u": u, "v": v, "match": match})

    while True:
        got, state_path = written(found.groupBy("cell").cogroup(prices.groupBy("cell")).applyInPandas(solve, schema), "prices")
        priced = [side.join(got.select("cell", "at", F.col(c).alias("price")), ["cell", "at"]) for side, c in ((x, "u"), (y, "v"))]
        more, path = written(_cheaper(_blocks(priced[0], "q"), _blocks(priced[1], "b")), "pairs")
        paths += [state_path, path]
        if more.where("below").isEmpty():
            break
        # Pairs keep the cost they were first given, so that none comes back by its last digit.
        found, prices = found.union(more.drop("below")).dropDuplicates(["cell", "row", "col"]), got.select("cell", "at", "v")
        found, path = written(found, "pairs")
        paths.append(path)
    ends = got.select("cell", F.col("at"), F.col("match"))
    pairs = x.join(ends, ["cell", "at"]).join(y.select("cell", F.col("at").alias("match"), F.col("vec").alias("other")), ["cell", "match"])
    cost = pairs.groupBy("cell").agg(F.sum(F.aggregate(F.zip_with("vec", "other", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, z: s + z)).alias("cost"))
    out = written(cost, "matching")[0]
    for p in [x_path, y_path, *paths]:
        dropped(spark, p)
    return out
