"""Queries of array operators; rows only, as SQL has no counterpart. Tests hold the operators to numpy."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators import arrays, matching, regions
from orrery.plans.kit import frame, spark_sql, table
from orrery.plans.vectors import _r


@frame("haar_residual", "A22 A23")
def haar_residual(spark, sf_dir):
    maps = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.expr("if(vec_id % 5 = 0, 1, 0)").alias("ref"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("values"))
    return arrays.haar_residual(maps, 8).select(F.col("id").alias("vec_id"), "p", _r(F.col("v")).alias("v"))


@frame("affine_ransac", "V27 V28")
def affine_ransac(spark, sf_dir):
    cells = spark_sql(spark, sf_dir, "SELECT CAST(label AS BIGINT) AS label, CAST(r AS DOUBLE) AS x, CAST(c AS DOUBLE) AS y, r + s AS u, c - s AS v FROM @cells WHERE s > 0.3")
    return arrays.affine_by_group(cells, "label").select("label", F.size("map").alias("n_parameters"), _r(F.col("inliers")).alias("inliers"))


@frame("semi_ot", "L17")
def semi_ot(spark, sf_dir):
    sides = spark_sql(spark, sf_dir, "SELECT CAST(label AS BIGINT) AS label, CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END AS side, peak AS v FROM @img")
    return arrays.semi_ot_cost(sides, "label").select("label", _r(F.col("cost")).alias("cost"))


_AUPRO = (
    "WITH RECURSIVE m AS (SELECT vec_id, label, p, r, c, s FROM @cells WHERE m = 1), "
    "w AS (SELECT vec_id, p, p AS root FROM m UNION SELECT b.vec_id, b.p, w.root FROM w JOIN m x ON w.vec_id = x.vec_id AND w.p = x.p JOIN m b ON b.vec_id = x.vec_id AND abs(b.r - x.r) <= 1 AND abs(b.c - x.c) <= 1 WHERE w.root < b.p), "
    "a AS (SELECT m.label, m.vec_id, l.root, m.s FROM m JOIN (SELECT vec_id, p, min(root) AS root FROM w GROUP BY vec_id, p) l ON m.vec_id = l.vec_id AND m.p = l.p), "
    "n AS (SELECT label, list(s ORDER BY s) AS v, count(*) AS n FROM @cells WHERE m = 0 GROUP BY label), "
    "t AS (SELECT label, k, n, v[CAST(floor((1 - 0.3 * k / 300) * (n - 1)) AS BIGINT) + 1] AS t FROM n, (SELECT unnest(range(1, 301)) AS k)), "
    "f AS (SELECT t.label, k, count(*) / CAST(any_value(n) AS DOUBLE) AS x FROM t JOIN @cells c ON c.label = t.label AND c.m = 0 AND c.s >= t.t GROUP BY t.label, k), "
    "o AS (SELECT label, k, avg(y) AS y FROM (SELECT a.label, k, vec_id, root, avg(CASE WHEN s >= t THEN 1e0 ELSE 0e0 END) AS y FROM a JOIN t ON a.label = t.label GROUP BY a.label, k, vec_id, root) q GROUP BY label, k), "
    "g AS (SELECT label, 0 AS k, 0e0 AS x, 0e0 AS y FROM n UNION ALL SELECT f.label, f.k, x, y FROM f JOIN o ON f.label = o.label AND f.k = o.k), "
    "s AS (SELECT label, x, y, lag(x) OVER (PARTITION BY label ORDER BY k) AS x0, lag(y) OVER (PARTITION BY label ORDER BY k) AS y0 FROM g), "
    "e AS (SELECT label, sum(CASE WHEN x > x0 AND x0 < 0.3 THEN (least(x, 0.3) - x0) * (2 * y0 + (y - y0) * (least(x, 0.3) - x0) / (x - x0)) / 2 ELSE 0 END) + max(0.3 - least(x, 0.3)) FILTER (WHERE x = mx) * max(y) FILTER (WHERE x = mx) AS area "
    "FROM (SELECT *, max(x) OVER (PARTITION BY label) AS mx FROM s) s GROUP BY label) "
    "SELECT CAST(l.label AS BIGINT) AS label, @r(CASE WHEN l.label IN (SELECT label FROM a) THEN area / 0.3 END) AS aupro FROM (SELECT DISTINCT label FROM @cells) l LEFT JOIN e ON e.label = l.label"
)


@frame("aupro_official", "E06 E08", _AUPRO)
def aupro_official(spark, sf_dir):
    cells = spark_sql(spark, sf_dir, "SELECT CAST(label AS BIGINT) AS label, vec_id, p, s, m FROM @cells")

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        maps, masks = [], []
        for _, own in pdf.sort_values(["vec_id", "p"]).groupby("vec_id"):
            mask = own["m"].to_numpy() > 0
            p = own["p"].to_numpy()[mask]
            root = regions.label_grid(p // 8, p % 8, p)
            maps.append(own["s"].to_numpy())
            masks.append([np.isin(own["p"].to_numpy(), p[root == k]) for k in np.unique(root)])
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "aupro": [arrays.aupro(maps, masks)]}).astype({"aupro": float})

    return cells.groupBy("label").applyInPandas(score, "label long, aupro double").select("label", F.when(~F.isnan("aupro"), _r(F.col("aupro"))).alias("aupro"))


@frame("chain_assignment", "L23 M03")
def chain_assignment(spark, sf_dir):
    """The first half of a label's rows (by id) matched with the second at the least sum of squared distances."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label"), "vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    # Rows without label are a label of their own; -2^63 stands for it, which no int is.
    rows = rows.withColumn("cell", F.coalesce("label", F.lit(-(1 << 63)).cast("long")))
    n = rows.groupBy("cell").agg(F.max("label").alias("label"), F.expr("count(*) div 2").alias("n"))
    placed = rows.select("cell", "vec", (F.row_number().over(Window.partitionBy("cell").orderBy("vec_id")) - 1).cast("long").alias("at")).join(n.select("cell", "n"), "cell")
    first, second = placed.where("at < n"), placed.where("at >= n and at < 2 * n").withColumn("at", F.expr("at - n"))
    cost = matching.cheapest_matching(first.select("cell", "at", "vec"), second.select("cell", "at", "vec"))
    return n.join(cost, "cell", "left").select("label", _r(F.coalesce("cost", F.lit(0.0))).alias("cost"))
