"""Anchored graphs of queries and bank rows, and the coupled step of two encoders.

A query's edges go to those of its nearest bank rows that are more like the nearest of all (the anchor) than the query
is, weighted by their likeness to the query. Moving the query under these springs has a closed form.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import vectors as fv
from orrery.operators.knn import knn_join


def forces(queries: DataFrame, bank: DataFrame, prefix: int = 64, steadiness: float = 1.0) -> DataFrame:
    """query, stiffness, force, edges of each query (``id``, unit ``vec``), given bank rows of the same form.

    Of the ``prefix`` nearest bank rows those count whose cosine with the anchor is above the anchor's with the query (at
    nine digits) and whose own with the query is above zero; the anchor always does. Stiffness is the weights' sum plus
    ``steadiness``; the force is the weights' sum times the query less the weighted sum of its rows. ``edges`` counts
    positive weights. Without bank rows there are no results.
    """
    near = knn_join(queries, bank, prefix).select("query", "bank", "place")
    rows = near.join(bank.select(F.col("id").alias("bank"), F.col("vec").cast("array<double>").alias("bv")), "bank")
    rows = rows.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "bv"))).alias("near"))
    rows = rows.join(queries.select(F.col("id").cast("long").alias("query"), F.col("vec").cast("array<double>").alias("vec")), "query")

    def run(frames):
        for pdf in frames:
            out = []
            for query, vec, rows in zip(pdf["query"], pdf["vec"], pdf["near"], strict=True):
                b = np.stack([r["bv"] for r in rows])
                like = b @ vec
                kept = (np.round(b @ b[0], 9) > np.round(like[0], 9)) & (like > 0)
                kept[0] = True
                w = np.where(kept, like, 0.0)
                out.append((query, w.sum() + steadiness, w.sum() * vec - w @ b, int((w > 0).sum())))
            yield pd.DataFrame(out, columns=["query", "stiffness", "force", "edges"])

    return rows.select("query", "vec", "near").mapInPandas(run, "query long, stiffness double, force array<double>, edges long")


def push(force: Column, stiffness: Column) -> Column:
    """Length of the step that the force takes; null where the stiffness is not positive."""
    return F.when(stiffness > 0, fv.norm(force) / stiffness)


def coupled_step(pairs: DataFrame, of_a: np.ndarray, of_b: np.ndarray, weight: float) -> DataFrame:
    """``pairs`` (id, stiffness_a, force_a, stiffness_b, force_b) to id, step_a, step_b, work, conflict.

    The steps minimise ``a |x|^2 + 2 f.x + b |y|^2 + 2 g.y + weight |P x - Q y|^2``, where P (``of_a``) and Q (``of_b``)
    map both encoders to a common space of low rank. With e = P x - Q y, both steps follow from e alone, and e from one
    system of the rank's size: ``(1 + weight (P P' / a + Q Q' / b)) e = Q g / b - P f / a``. Work is the square root of
    the quadratic terms, conflict the length of e. Null where a stiffness is not positive or anything is null.
    """
    p, q = np.asarray(of_a, float), np.asarray(of_b, float)
    pp, qq, one = p @ p.T, q @ q.T, np.eye(len(p))
    good = (F.col("stiffness_a") > 0) & (F.col("stiffness_b") > 0) & F.col("force_a").isNotNull() & F.col("force_b").isNotNull()

    def run(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            a, b = pdf["stiffness_a"].to_numpy()[:, None], pdf["stiffness_b"].to_numpy()[:, None]
            f, g = np.stack(list(pdf["force_a"])), np.stack(list(pdf["force_b"]))
            system = one + weight * (pp / a[:, :, None] + qq / b[:, :, None])
            e = np.linalg.solve(system, (g @ q.T / b - f @ p.T / a)[:, :, None])[:, :, 0]
            x, y = -(f + weight * e @ p) / a, -(g - weight * e @ q) / b
            e = x @ p.T - y @ q.T
            work = np.sqrt(a[:, 0] * (x * x).sum(axis=1) + b[:, 0] * (y * y).sum(axis=1) + weight * (e * e).sum(axis=1))
            yield pd.DataFrame({"id": pdf["id"], "step_a": list(x), "step_b": list(y), "work": work, "conflict": np.linalg.norm(e, axis=1)})

    own = pairs.select(F.col("id").cast("long").alias("id"), "stiffness_a", "force_a", "stiffness_b", "force_b")
    done = own.where(good).mapInPandas(run, "id long, step_a array<double>, step_b array<double>, work double, conflict double")
    rest = own.where(~F.coalesce(good, F.lit(False))).select("id")
    return done.unionByName(rest, allowMissingColumns=True)
