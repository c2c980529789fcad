"""Selection of rows, channels and images, and anchored graphs, over the two halves of ``embeddings`` as two encoders."""

import numpy as np
from pyspark.sql import functions as F

from orrery.functions import vectors as fv
from orrery.operators import anchored, knn, linalg, selectors
from orrery.plans.kit import VIEWS, frame, table
from orrery.plans.vectors import _cov, _r

PICKS, KEEP, WEIGHT, PREFIX, RANK = 12, 6, 0.05, 16, 8

_UNIT = "list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"
_HALVES = "SELECT vec_id, label, {a} AS a, {b} AS b FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[])[1:32] AS u, CAST(embedding AS DOUBLE[])[33:64] AS w FROM {{embeddings}}) h"
#: For the oracle only: unit vectors of both halves.
VIEWS["halves"] = ("", _HALVES.format(a=_UNIT.format(v="u"), b=_UNIT.format(v="w")))


def _two(spark, sf_dir):
    u, w = F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), fv.normalised(u).alias("a"), fv.normalised(w).alias("b"), fv.fused(u, w).alias("ab"))


@frame(
    "covering_three_views", "C03",
    "WITH RECURSIVE r AS (SELECT vec_id AS id, a, b, list_concat(list_transform(a, lambda x: x / sqrt(2e0)), list_transform(b, lambda x: x / sqrt(2e0))) AS ab FROM @halves WHERE vec_id % 5 = 0), "
    "p AS MATERIALIZED (SELECT x.id, y.id AS other, 0.5 * power(list_distance(x.a, y.a), 2) AS da, 0.5 * power(list_distance(x.b, y.b), 2) AS db, 0.5 * power(list_distance(x.ab, y.ab), 2) AS dab FROM r x CROSS JOIN r y), "
    "s AS (SELECT median(da) AS ua, median(db) AS ub, median(dab) AS uab FROM (SELECT * FROM p WHERE id = 0 ORDER BY (other * 2654435761) % 4294967296, other LIMIT 64) t), "
    "c AS (SELECT 0 AS place, CAST([0] AS BIGINT[]) AS chosen, CAST(NULL AS DOUBLE) AS gap UNION ALL SELECT place + 1, list_append(chosen, id), gap FROM ("
    "SELECT place, chosen, id, gap, row_number() OVER (ORDER BY gap DESC, id) AS k FROM (SELECT place, chosen, id, round(greatest(min(da) / any_value(ua), min(db) / any_value(ub), min(dab) / any_value(uab)), 9) AS gap "
    f"FROM c CROSS JOIN p CROSS JOIN s WHERE place < {PICKS - 1} AND list_contains(chosen, other) AND NOT list_contains(chosen, id) GROUP BY place, chosen, id) t) u WHERE k = 1) "
    "SELECT chosen[place + 1] AS vec_id, place, @r(gap) AS gap FROM c",
)
def covering_three_views(spark, sf_dir):
    bank, views = _two(spark, sf_dir).where("id % 5 = 0"), ["a", "b", "ab"]
    got = selectors.covering(bank, views, selectors.scales(bank, views, 0), PICKS, 0)
    return got.select(F.col("id").alias("vec_id"), "place", _r(F.col("gap")).alias("gap"))


@frame(
    "complementary_channels", "C18",
    "WITH RECURSIVE q AS MATERIALIZED (SELECT CAST(p AS INT) AS ch, CAST(p // 32 AS INT) AS side, stddev_pop(x) AS v FROM @dims GROUP BY p), "
    "k AS MATERIALIZED (SELECT CAST(x.p AS INT) AS ch, CAST(y.p AS INT) AS other, abs(corr(x.x, y.x)) AS rho FROM @dims x JOIN @dims y ON x.vec_id = y.vec_id AND x.p // 32 <> y.p // 32 GROUP BY x.p, y.p), "
    "c AS (SELECT 0 AS step, CAST([] AS INT[]) AS chosen UNION ALL SELECT step + 1, list_append(chosen, ch) FROM (SELECT step, chosen, ch, row_number() OVER (ORDER BY worth DESC, ch) AS place FROM ("
    f"SELECT step, chosen, q.ch, any_value(v) - {WEIGHT} * max(CASE WHEN list_contains(chosen, other) THEN rho ELSE 0 END) AS worth FROM c CROSS JOIN q JOIN k ON k.ch = q.ch "
    f"WHERE step < {2 * KEEP} AND NOT list_contains(chosen, q.ch) AND len(list_filter(chosen, lambda x: x // 32 = side)) < {KEEP} GROUP BY step, chosen, q.ch) t) u WHERE place = 1), "
    f"l AS (SELECT unnest(chosen) AS ch FROM c WHERE step = {2 * KEEP}) SELECT CAST(ch // 32 AS INT) AS encoder, CAST(ch % 32 AS INT) AS channel FROM l",
)
def complementary_channels(spark, sf_dir):
    n, total, gram = linalg.moments(table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("vec")))
    cov = _cov(n, total, gram)
    sd = np.sqrt(np.diag(cov))
    got = selectors.complementary(sd[:32], sd[32:], cov[:32, 32:] / np.outer(sd[:32], sd[32:]), WEIGHT, KEEP)
    return spark.createDataFrame([(s, c) for s in (0, 1) for c in got[s]], "encoder int, channel int")


@frame(
    "facility_coverage", "C07 V54",
    "WITH d AS MATERIALIZED (SELECT x.vec_id, y.label, min(0.5 * power(list_distance(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 2)) AS d FROM {embeddings} x CROSS JOIN {embeddings} y WHERE y.vec_id % 5 = 0 GROUP BY x.vec_id, y.label), "
    "l AS (SELECT DISTINCT label FROM d), s AS (SELECT [label] AS images FROM l UNION ALL SELECT [x.label, y.label] FROM l x JOIN l y ON x.label < y.label UNION ALL SELECT [x.label, y.label, z.label] FROM l x JOIN l y ON x.label < y.label JOIN l z ON y.label < z.label), "
    "m AS (SELECT images, vec_id, min(d) AS d FROM s JOIN d ON list_contains(images, d.label) GROUP BY images, vec_id) SELECT array_to_string(images, ' ') AS images, @r(avg(d)) AS coverage FROM m GROUP BY images",
)
def facility_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("image"), F.col("embedding").alias("vec"))
    bank = rows.where("id % 5 = 0")
    images = [r["image"] for r in bank.select("image").distinct().orderBy("image").collect()]
    got = selectors.subset_coverage(knn.nearest_per(rows, bank, "image"), images)
    return got.select(F.array_join("images", " ").alias("images"), _r(F.col("coverage")).alias("coverage"))


_ANCHORED = (
    "n{v} AS (SELECT * FROM (SELECT q.vec_id, q.{v} AS q, b.{v} AS b, list_dot_product(q.{v}, b.{v}) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(0.5 * power(list_distance(q.{v}, b.{v}), 2), 9), b.vec_id) AS k FROM @halves q CROSS JOIN @halves b WHERE q.vec_id % 5 <> 0 AND b.vec_id % 5 = 0) t WHERE k <= "
    + str(PREFIX)
    + "), e{v} AS (SELECT n.vec_id, n.q, n.b, CASE WHEN n.k = 1 OR (round(list_dot_product(t.b, n.b), 9) > round(t.s, 9) AND n.s > 0) THEN n.s ELSE 0 END AS w FROM n{v} n JOIN n{v} t ON t.vec_id = n.vec_id AND t.k = 1), "
    "x{v} AS (SELECT vec_id, q, w, unnest(range(32)) AS p, unnest(q) AS qx, unnest(b) AS bx FROM e{v}), "
    "f{v} AS MATERIALIZED (SELECT vec_id, p, sum(w) + 1 AS a, sum(w) * any_value(qx) - sum(w * bx) AS f, sum(CASE WHEN w > 0 THEN 1 ELSE 0 END) AS edges FROM x{v} GROUP BY vec_id, p)"
)


def _forces(spark, sf_dir, view):
    rows = _two(spark, sf_dir).select("id", F.col(view).alias("vec"))
    return anchored.forces(rows.where("id % 5 <> 0"), rows.where("id % 5 = 0"), PREFIX)


@frame(
    "anchored_forces", "V52 V53",
    f"WITH {_ANCHORED.format(v='a')} SELECT vec_id, CAST(any_value(edges) AS BIGINT) AS edges, @r(any_value(a)) AS stiffness, @r(sqrt(sum(f * f)) / any_value(a)) AS score FROM fa GROUP BY vec_id",
)
def anchored_forces(spark, sf_dir):
    return _forces(spark, sf_dir, "a").select(F.col("query").alias("vec_id"), "edges", _r(F.col("stiffness")).alias("stiffness"), _r(anchored.push(F.col("force"), F.col("stiffness"))).alias("score"))


@frame(
    "coupled_forces", "L09",
    # Both maps keep the first channels, so every channel is a problem of its own, solved here by Cramer's rule.
    f"WITH {_ANCHORED.format(v='a')}, {_ANCHORED.format(v='b')}, j AS (SELECT x.vec_id, x.p, x.a, x.f, y.a AS b, y.f AS g, CASE WHEN x.p < {RANK} THEN 1e0 ELSE 0e0 END AS l FROM fa x JOIN fb y ON y.vec_id = x.vec_id AND y.p = x.p), "
    "s AS (SELECT *, -((b + l) * f + l * g) / ((a + l) * (b + l) - l * l) AS x, -((a + l) * g + l * f) / ((a + l) * (b + l) - l * l) AS y FROM j) "
    "SELECT vec_id, @r(sqrt(sum(a * x * x + b * y * y + l * (x - y) * (x - y)))) AS work, @r(sqrt(sum(l * (x - y) * (x - y)))) AS conflict FROM s GROUP BY vec_id",
)
def coupled_forces(spark, sf_dir):
    a, b = (_forces(spark, sf_dir, v).select(F.col("query").alias("id"), F.col("stiffness").alias(f"stiffness_{v}"), F.col("force").alias(f"force_{v}")) for v in ("a", "b"))
    got = anchored.coupled_step(a.join(b, "id"), np.eye(RANK, 32), np.eye(RANK, 32), 1.0)
    return got.select(F.col("id").alias("vec_id"), _r(F.col("work")).alias("work"), _r(F.col("conflict")).alias("conflict"))
