"""Gaussian mixtures with diagonal covariances, one for each value of a key (a spatial bin, say), all fitted at once.

Rows are gathered into blocks of one key and written once. In each step every block gives its share of the sufficient
statistics (weights, sums, sums of squares by component and dimension, log-likelihood), which add up to those of the
key wherever its rows are; so no key is held by one task. The model is a table with one row a key, of the size of
components times dimensions, that each step writes; keys that have converged take no part in later steps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.sources.shared import dropped, written

#: Rows of a block; bytes of a model that is sent to every executor, beyond which it is joined.
ROWS, BROADCAST_BYTES = 1024, 64 << 20


def _blocks(rows: DataFrame, key: str, carried: list[Column]) -> DataFrame:
    """key, n (rows of the key), rows (of the block)."""
    own = rows.where(F.col(key).isNotNull() & F.col("vec").isNotNull()).select(F.col(key).alias("cell"), *carried, F.col("vec").cast("array<double>").alias("vec"))
    own = own.join(own.groupBy("cell").agg(F.count("*").alias("n")), "cell")
    fields = [c for c in own.columns if c not in ("cell", "n")]
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.ceil(F.col("n") / ROWS))
    return own.groupBy("cell", "n", part.alias("part")).agg(F.collect_list(F.struct(*fields)).alias("rows")).drop("part")


def _joint(x: np.ndarray, row) -> np.ndarray:
    """Logarithm of weight times density, by row and component."""
    w, d = np.asarray(row["w"], float), x.shape[1]
    mean, var = np.asarray(row["mean"], float).reshape(len(w), d), np.asarray(row["var"], float).reshape(len(w), d)
    return np.log(w) - 0.5 * np.stack([((x - m) ** 2 / v + np.log(2 * np.pi * v)).sum(axis=1) for m, v in zip(mean, var, strict=True)], axis=1)


def _likelihood(joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = joint.max(axis=1, keepdims=True)
    ll = top[:, 0] + np.log(np.exp(joint - top).sum(axis=1))
    return ll, np.exp(joint - ll[:, None])


def _statistics(share):
    """``share`` gives the log-likelihood of a block's rows and their responsibilities."""

    def run(frames):
        for pdf in frames:
            for row in pdf.to_dict("records"):
                x = np.stack([np.asarray(r["vec"], float) for r in row["rows"]])
                ll, resp = share(x, row)
                k, d = resp.shape[1], x.shape[1]
                yield pd.DataFrame({
                    "cell": [row["cell"]] * (k * d), "k": np.repeat(np.arange(k), d), "p": np.tile(np.arange(d), k), "rows": np.where(np.arange(k * d) == 0, len(x), 0),
                    "n": np.repeat(resp.sum(axis=0), d), "s": (resp.T @ x).ravel(), "ss": (resp.T @ (x * x)).ravel(), "ll": np.where(np.arange(k * d) == 0, ll.sum(), 0.0),
                })

    return run


def _model(parts: DataFrame, reg: float) -> DataFrame:
    """One row a key: w, mean and var by component (then dimension), ll (mean log-likelihood under the model before)."""
    sums = parts.groupBy("cell", "k", "p").agg(*[F.sum(c).alias(c) for c in ("rows", "n", "s", "ss", "ll")])
    mean = F.col("s") / F.col("n")
    one = F.struct("k", "p", "n", mean.alias("m"), (F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)) + reg).alias("v"))
    got = sums.groupBy("cell").agg(F.sort_array(F.collect_list(F.when(F.col("n") > 1e-12, one))).alias("a"), F.sum("rows").alias("rows"), F.sum("ll").alias("ll"))
    heads = F.transform(F.filter("a", lambda x: x["p"] == 0), lambda x: x["n"] / F.col("rows"))
    return got.select("cell", heads.alias("w"), F.transform("a", lambda x: x["m"]).alias("mean"), F.transform("a", lambda x: x["v"]).alias("var"), (F.col("ll") / F.col("rows")).alias("ll"))


def _met(blocks: DataFrame, model: DataFrame, size: int) -> DataFrame:
    return blocks.join(F.broadcast(model) if size <= BROADCAST_BYTES else model, "cell")


def fit(rows: DataFrame, key: str, start: Column, components: int = 4, reg: float = 1e-4, steps: int = 100, tol: float = 1e-3) -> DataFrame:
    """The mixture of each key's rows (``vec``): cell (the key), w, mean, var, ll, done.

    ``start`` numbers the component that a row begins in (null: 0), modulo the key's number of components, which is
    ``components`` but no more than a tenth of the key's rows, and at least one. Components without rows are left out.
    ``ll`` is the mean log-likelihood before the last step; a key is done when it moved by less than ``tol``. Rows whose
    key or vector is null take no part; an empty table gives an empty model. The result is a table that was written.
    """
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    blocks, held = written(_blocks(rows, key, [F.coalesce(start, F.lit(0)).cast("long").alias("start")]), "mixture-rows")
    schema = f"cell {kind}, k int, p int, rows long, n double, s double, ss double, ll double"

    def begun(x, row):
        k = min(components, max(1, row["n"] // 10))
        return np.zeros(len(x)), np.eye(k)[np.array([r["start"] for r in row["rows"]]) % k]

    model, path = written(_model(blocks.mapInPandas(_statistics(begun), schema), reg).withColumn("done", F.lit(False)), "mixture")
    try:
        for step in range(steps):
            told = model.agg(F.sum(F.size("mean") * 16), F.sum((~F.col("done")).cast("int"))).first()
            if not told[1]:
                break
            active = model.where("not done")
            parts = _met(blocks, active, told[0]).mapInPandas(_statistics(lambda x, row: _likelihood(_joint(x, row))), schema)
            old = active.select("cell", F.col("ll").alias("before"))
            done = F.lit(step > 0) & (F.abs(F.col("ll") - F.col("before")) < tol)
            moved = _model(parts, reg).join(old, "cell").select("cell", "w", "mean", "var", "ll", done.alias("done"))
            model, new = written(moved.unionByName(model.where("done")), "mixture")
            dropped(spark, path)
            path = new
    finally:
        dropped(spark, held)
    return model


def score(rows: DataFrame, key: str, model: DataFrame) -> DataFrame:
    """id, nll (minus the log-density of ``vec``) and entropy (of the components' responsibilities, natural logarithm);
    both null where the key has no model. Rows whose key or vector is null are left out."""
    kind = rows.schema["id"].dataType.simpleString()
    size = model.agg(F.coalesce(F.sum(F.size("mean") * 16), F.lit(0))).first()[0]

    def run(frames):
        for pdf in frames:
            for row in pdf.to_dict("records"):
                ll, resp = _likelihood(_joint(np.stack([np.asarray(r["vec"], float) for r in row["rows"]]), row))
                yield pd.DataFrame({"id": [r["id"] for r in row["rows"]], "nll": -ll, "entropy": -(resp * np.log(np.maximum(resp, 1e-12))).sum(axis=1)})

    blocks = _blocks(rows, key, [F.col("id")])
    known = _met(blocks, model, size).mapInPandas(run, f"id {kind}, nll double, entropy double")
    rest = blocks.join(model.select("cell"), "cell", "left_anti").select(F.explode("rows.id").alias("id"))
    return known.unionByName(rest.withColumns({"nll": F.lit(None).cast("double"), "entropy": F.lit(None).cast("double")}))
