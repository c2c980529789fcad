"""Linear algebra over vector tables: Gram sums on executors, small dense solves on the driver, projections back on
executors. What reaches the driver has the size of dimension squared, never of the rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.knn import knn_join


def _matrix(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in s]) if len(s) else np.zeros((0, 0))


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sum and Gram matrix of ``vec``; each partition sends one small matrix."""

    def part(frames):
        n, total, gram = 0, None, None
        for pdf in frames:
            if len(pdf):
                x = _matrix(pdf["vec"])
                total = x.sum(0) if total is None else total + x.sum(0)
                gram = x.T @ x if gram is None else gram + x.T @ x
                n += len(x)
        if n:
            yield pd.DataFrame({"i": np.repeat(np.arange(len(total) + 1), len(total)), "j": np.tile(np.arange(len(total)), len(total) + 1), "v": np.concatenate([total, gram.ravel()]), "n": n})

    own = rows.select("vec").mapInPandas(part, "i int, j int, v double, n long")
    got = own.groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("i", "j").toPandas()
    d = int(got["j"].max()) + 1
    v = got["v"].to_numpy().reshape(d + 1, d)
    return int(got["n"].iloc[0]), v[0], v[1:]


def mapped(rows: DataFrame, f, schema: str) -> DataFrame:
    """``id`` and what ``f`` makes of the matrix of vectors."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        for pdf in frames:
            if len(pdf):
                yield pd.DataFrame(dict(zip(names, f(_matrix(pdf["vec"])), strict=True)) | {"id": pdf["id"].to_numpy()})[["id", *names]]

    return rows.select(F.col("id").cast("long").alias("id"), "vec").mapInPandas(run, "id long, " + schema)


def pca_residual(bank: DataFrame, queries: DataFrame, explained: float) -> DataFrame:
    n, total, gram = moments(bank)
    mean = total / n
    values, vectors = np.linalg.eigh(gram / n - np.outer(mean, mean))
    order = np.argsort(values)[::-1]
    share = np.cumsum(values[order]) / values.sum()
    u = vectors[:, order[: int(np.searchsorted(share, explained) + 1)]]
    return mapped(queries, lambda x: [np.linalg.norm((x - mean) - (x - mean) @ u @ u.T, axis=1)], "residual double")


def ridge_residual(bank: DataFrame, queries: DataFrame, split: int, ridge: float) -> DataFrame:
    """How far the later dimensions are from their ridge regression on the first ``split``."""
    _, _, gram = moments(bank)
    w = np.linalg.solve(gram[:split, :split] + ridge * np.eye(split), gram[:split, split:])
    return mapped(queries, lambda x: [np.linalg.norm(x[:, split:] - x[:, :split] @ w, axis=1)], "residual double")


def shared_subspace(bank: DataFrame, queries: DataFrame, split: int, rank: int) -> DataFrame:
    """Cosine of the two encoders' projections on their leading shared directions."""
    n, total, gram = moments(bank)
    mean = total / n
    cov = gram / n - np.outer(mean, mean)
    u, _, vt = np.linalg.svd(cov[:split, split:])
    a, b = u[:, :rank], vt[:rank].T

    def project(x):
        p, q = (x[:, :split] - mean[:split]) @ a, (x[:, split:] - mean[split:]) @ b
        return [(p * q).sum(1) / np.maximum(np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1), 1e-12)]

    return mapped(queries, project, "alignment double")


def farthest_first(rows: DataFrame, k: int) -> DataFrame:
    """k rows, each the farthest from those before it, from the smallest id on; one pass of the table a row."""
    own = rows.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    first = own.orderBy("id").first()
    if first is None:
        return rows.sparkSession.createDataFrame([], "id long, place int, gap double")
    chosen = [(first["id"], 0, 0.0)]
    anchors = [np.array(first["vec"])]
    for place in range(1, k):
        a = np.stack(anchors)
        far = mapped(own, lambda x, a=a: [np.round(((x[:, None] - a[None]) ** 2).sum(2).min(1), 9)], "gap double")
        top = far.orderBy(F.col("gap").desc(), "id").first()
        if top is None or top["gap"] <= 0:
            break
        chosen.append((top["id"], place, float(top["gap"])))
        anchors.append(np.array(own.where(F.col("id") == top["id"]).first()["vec"]))
    return rows.sparkSession.createDataFrame(chosen, "id long, place int, gap double")


def pivot_knn(queries: DataFrame, bank: DataFrame, pivots: int) -> DataFrame:
    """Exact nearest bank row with bank rows skipped that the triangle inequality rules out.

    Pivots are a few bank rows; |d(q, p) - d(x, p)| bounds d(q, x) from below, so rows whose bound exceeds the query's
    best pivot distance are dropped before the distance is computed.
    """
    own = bank.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    ids = [r["id"] for r in farthest_first(own, pivots).collect()]
    p = np.stack([np.array(r["vec"]) for r in own.where(F.col("id").isin(ids)).orderBy("id").collect()])
    bring = lambda df: mapped(df, lambda x: [list(x), list(np.sqrt(((x[:, None] - p[None]) ** 2).sum(2)))], "vec array<double>, to array<double>")
    q, b = bring(queries), bring(own)
    blocks = b.groupBy(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-own.count() // 4096)))).alias("k")).agg(F.collect_list(F.struct("id", "vec", "to")).alias("rows")).drop("k")
    asked = q.groupBy(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-queries.count() // 4096)))).alias("k")).agg(F.collect_list(F.struct("id", "vec", "to")).alias("asked")).drop("k")

    def search(frames):
        for pdf in frames:
            for qs, bs in zip(pdf["asked"], pdf["rows"], strict=True):
                bv, bt, bi = np.stack([r["vec"] for r in bs]), np.stack([r["to"] for r in bs]), np.array([r["id"] for r in bs])
                out = []
                for r in qs:
                    keep = np.abs(bt - r["to"]).max(1) <= r["to"].min() + 1e-9
                    if keep.any():
                        d = 0.5 * ((bv[keep] - r["vec"]) ** 2).sum(1)
                        out.append((r["id"], bi[keep][d.argmin()], d.min()))
                yield pd.DataFrame(out, columns=["query", "bank", "dist"])

    found = asked.crossJoin(blocks).mapInPandas(search, "query long, bank long, dist double")
    return found.groupBy("query").agg(F.min("dist").alias("dist"))


def kmeans(bank: DataFrame, queries: DataFrame, k: int, rounds: int = 10) -> DataFrame:
    """Lloyd's rounds from farthest-first seeds; each round sends k sums a partition."""
    own = bank.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    ids = [r["id"] for r in farthest_first(own, k).collect()]
    c = np.stack([np.array(r["vec"]) for r in own.where(F.col("id").isin(ids)).orderBy("id").collect()])
    near = lambda x, c: ((x[:, None] - c[None]) ** 2).sum(2)
    for _ in range(rounds):

        def sums(frames, c=c):
            total, n = np.zeros_like(c), np.zeros(len(c))
            for pdf in frames:
                if len(pdf):
                    x = _matrix(pdf["vec"])
                    at = near(x, c).argmin(1)
                    np.add.at(total, at, x)
                    n += np.bincount(at, minlength=len(c))
            yield pd.DataFrame({"k": np.arange(len(c)), "n": n, "v": list(total)})

        got = own.select("vec").mapInPandas(sums, "k int, n double, v array<double>").collect()
        n, total = np.zeros(len(c)), np.zeros_like(c)
        for r in got:
            n[r["k"]] += r["n"]
            total[r["k"]] += np.array(r["v"])
        new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if np.allclose(new, c, atol=1e-12):
            break
        c = new
    return mapped(queries, lambda x: [near(x, c).argmin(1), np.sqrt(near(x, c).min(1))], "part int, dist double")


def local_linear(queries: DataFrame, bank: DataFrame, k: int, ridge: float) -> DataFrame:
    """Residual of each query's ridge reconstruction from its k nearest bank rows."""
    near = knn_join(queries, bank, k)
    b = bank.select(F.col("id").alias("bank"), F.col("vec").cast("array<double>").alias("bv"))
    own = near.join(b, "bank").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "bv"))).alias("near"))
    own = own.join(queries.select(F.col("id").alias("query"), F.col("vec").cast("array<double>").alias("qv")), "query")

    def solve(frames):
        for pdf in frames:
            out = []
            for q, rows in zip(pdf["qv"], pdf["near"], strict=True):
                a, q = np.stack([r["bv"] for r in rows]), np.asarray(q)
                w = np.linalg.solve(a @ a.T + ridge * np.eye(len(a)), a @ q)
                out.append(np.linalg.norm(q - w @ a))
            yield pd.DataFrame({"id": pdf["query"], "residual": np.array(out, dtype=float)})

    return own.select("query", "qv", "near").mapInPandas(solve, "id long, residual double")


def logistic(rows: DataFrame, rounds: int = 15, ridge: float = 1e-3) -> DataFrame:
    """Newton's method for logistic regression of y on vec (standardised, with a constant); probabilities back."""
    n, total, gram = moments(rows)
    mean = total / n
    sd = np.sqrt(np.maximum(np.diag(gram) / n - mean**2, 1e-12))
    z = lambda x: np.concatenate([(x - mean) / sd, np.ones((len(x), 1))], axis=1)
    w = np.zeros(len(mean) + 1)
    for _ in range(rounds):

        def part(frames, w=w):
            grad, hess = np.zeros(len(w)), np.zeros((len(w), len(w)))
            for pdf in frames:
                if len(pdf):
                    x = z(_matrix(pdf["vec"]))
                    p = 1 / (1 + np.exp(-x @ w))
                    grad += x.T @ (p - pdf["y"].to_numpy())
                    hess += (x * (p * (1 - p))[:, None]).T @ x
            yield pd.DataFrame({"g": [grad], "h": [hess.ravel()]})

        got = rows.select("vec", "y").mapInPandas(part, "g array<double>, h array<double>").collect()
        grad, hess = sum(np.array(r["g"]) for r in got), sum(np.array(r["h"]) for r in got).reshape(len(w), -1)
        step = np.linalg.solve(hess + ridge * n * np.eye(len(w)), grad + ridge * n * w)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return mapped(rows, lambda x: [1 / (1 + np.exp(-z(x) @ w))], "p double")
