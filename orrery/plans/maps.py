"""Calibration, fusion, grid and region operators over score maps."""

from pyspark.sql import functions as F

from orrery.operators import grid, regions
from orrery.plans.kit import both, frame, spark_sql

# Calibration and fusion of two branches.
both("robust_calibration", "B01 B03 G23 X15", "SELECT event_id, @r(zv) AS z_visual, @r(zt) AS z_text, @r(1 / (1 + exp(-greatest(least(zv, 50), -50)))) AS p_visual FROM @z")
both("calibration_table", "B01 B16", "SELECT cat, @r(cv) AS center_visual, @r(sv) AS scale_visual, @r(ct) AS center_text, @r(st) AS scale_text FROM @cal")
_RP = "WITH q AS (SELECT cat, @q(vis; 0.25) AS q1, @q(vis; 0.75) AS q3, @q(vis; 0.01) AS lo, @q(vis; 0.99) AS hi, max(vis) - min(vis) AS span FROM @ev WHERE ref = 1 GROUP BY cat), s AS (SELECT q.cat, lo, hi, c.cv, greatest(c.sv, (q3 - q1) / 1.349, greatest(0.000001, 0.05 * span)) AS scale FROM q JOIN @cal c ON q.cat = c.cat)"
both("rank_preserving_calibration", "B04 B07 X16", _RP + " SELECT z.event_id, @r(0.5 + atan((z.vis - s.cv) / s.scale) / 3.141592653589793) AS score FROM @z z JOIN s ON z.cat = s.cat")
both("support_evidence", "B05 B13", _RP + " SELECT z.event_id, @r(greatest(z.vis - s.hi, 0) / s.scale) AS excess, CASE WHEN greatest(z.vis - s.hi, 0) / s.scale > 3 THEN 1 ELSE 0 END AS outside, @r(1 / (1 + greatest(z.vis - s.hi, 0) / s.scale)) AS confidence FROM @z z JOIN s ON z.cat = s.cat")
both("grouped_reference_calibration", "G11 B07 B08 B19 X17", "WITH g AS (SELECT cat, user_id, median(vis) AS m, count(*) AS n FROM @ev WHERE ref = 1 GROUP BY cat, user_id), c AS (SELECT cat, median(m) AS center, count(*) AS k FROM g GROUP BY cat), s AS (SELECT g.cat, median(abs(m - center)) * 1.4826 AS sd FROM g JOIN c ON g.cat = c.cat GROUP BY g.cat) SELECT c.cat, @r(center) AS center, CAST(k AS BIGINT) AS sources, @r((k * sd + 2 * 0.2) / (k + 2)) AS shrunken_scale, @r(k / CAST(k + 2 AS DOUBLE)) AS reliability, CASE WHEN k < 2 THEN 1 ELSE 0 END AS degenerate FROM c JOIN s ON c.cat = s.cat")
both("per_view_tail_calibration", "B02", "SELECT cat, @r(median(t)) AS tail_center FROM (SELECT cat, user_id, @q(vis; 0.99) AS t FROM @ev WHERE ref = 1 GROUP BY cat, user_id) v GROUP BY cat")
both("signed_evidence", "B18", "SELECT event_id, @r(asinh(zv)) AS evidence FROM @z")
both("prompt_stability", "B14", "SELECT cat, CASE WHEN count(*) >= 2 AND (max(m) - min(m)) / nullif(avg(m), 0) <= 2 THEN 1 ELSE 0 END AS stable FROM (SELECT cat, shot, avg(abs(zv)) AS m FROM @z GROUP BY cat, shot) t GROUP BY cat")
both("reference_stats", "G22 B09", "SELECT label, @r(median(s)) AS med, @r(@q(s; 0.75) - @q(s; 0.25)) AS iqr, @r(@q(s; 0.95)) AS q95 FROM @cells WHERE vec_id % 5 = 0 GROUP BY label")
both("per_pixel_z_score", "B11", "WITH q AS (SELECT p, median(s) AS med FROM @cells WHERE m = 0 GROUP BY p), d AS (SELECT c.p, greatest(median(abs(c.s - q.med)), 0.00000001) AS mad, any_value(q.med) AS med FROM @cells c JOIN q ON c.p = q.p WHERE c.m = 0 GROUP BY c.p) SELECT c.vec_id, c.p, @r((c.s - d.med) / d.mad) AS z FROM @cells c JOIN d ON c.p = d.p")
both("robust01_map", "X22 X23", "WITH q AS (SELECT vec_id, @q(s; 0.01) AS lo, @q(s; 0.99) AS hi FROM @cells GROUP BY vec_id) SELECT c.vec_id, c.p, @r(CASE WHEN hi > lo THEN least(greatest((s - lo) / (hi - lo), 0), 1) ELSE 0 END) AS v FROM @cells c JOIN q ON c.vec_id = q.vec_id")
both("minmax_map", "", "SELECT vec_id, p, @r((s - min(s) OVER w) / nullif(max(s) OVER w - min(s) OVER w, 0)) AS v FROM @cells WINDOW w AS (PARTITION BY vec_id)")
both("sanitize_finite", "P17 P18", "SELECT event_id, @r(least(greatest(coalesce(CASE WHEN vis > 95 THEN NULL ELSE vis END, min(vis) OVER (PARTITION BY cat)) / 100, 0.000001), 0.999999)) AS p FROM @ev")
_P = "(SELECT event_id, cat, shot, seed, zv, zt, 1 / (1 + exp(-greatest(least(zv, 30), -30))) AS pv, 1 / (1 + exp(-greatest(least(zt, 30), -30))) AS pt FROM @z)"
_E = "(-(x * ln(x) + (1 - x) * ln(1 - x)) / ln(2))"
_ent = lambda p: _E.replace("x", f"least(greatest({p}, 0.000001), 0.999999)").replace("eleast", "exp")
both("binary_entropy", "X14 R04", f"SELECT event_id, @r({_ent('pv')}) AS u_visual, @r({_ent('pt')}) AS u_text FROM {_P} t")
both("pair_features", "R03", f"SELECT event_id, @r(abs(pv - pt)) AS disagreement, @r(1 - abs(pv - pt)) AS agreement FROM {_P} t")
both("confidence_router", "R01 R02", f"SELECT event_id, @r(w) AS w_visual, @r(w * pv + (1 - w) * pt) AS score, CASE WHEN w > 0.6 THEN 'visual' WHEN w < 0.4 THEN 'text' ELSE 'blend' END AS decision FROM (SELECT event_id, pv, pt, least(greatest(1 / (1 + exp(({_ent('pv')}) - ({_ent('pt')}))), 0.1), 0.9) AS w FROM {_P} t) u")
both("safe_router_gates", "R08", f"SELECT event_id, CASE WHEN abs(zv) < 3 AND abs(zt) < 3 AND abs(pv - pt) >= 0.05 AND ({_ent('pv')}) - ({_ent('pt')}) >= 0.05 THEN 'text_allowed' WHEN abs(zv) >= 3 THEN 'visual_outside' WHEN abs(zt) >= 3 THEN 'text_outside' ELSE 'visual_default' END AS decision FROM {_P} t")
both("fixed_weight_grid", "R06 R34 R35", "SELECT cat, CAST(w AS DOUBLE) AS w, @r(avg(w * zv + (1 - w) * zt)) AS mean_score FROM @z CROSS JOIN (SELECT 0.3 AS w UNION ALL SELECT 0.5 UNION ALL SELECT 0.7) g GROUP BY cat, w")
both("weighted_ensemble", "R13 R15 R32", "SELECT event_id, @r((0.6 * CASE WHEN abs(zv) < 50 THEN zv ELSE 0 END + 0.4 * CASE WHEN abs(zt) < 50 THEN zt ELSE 0 END) / nullif(0.6 * CASE WHEN abs(zv) < 50 THEN 1 ELSE 0 END + 0.4 * CASE WHEN abs(zt) < 50 THEN 1 ELSE 0 END, 0)) AS score FROM @z")
both("max_z_select", "R17", "SELECT event_id, CASE WHEN zv >= zt THEN 'visual' ELSE 'text' END AS branch, @r(greatest(zv, zt)) AS score FROM @z")
both("softmax_mix", "R17", "SELECT event_id, @r((zv * exp(zv - greatest(zv, zt)) + zt * exp(zt - greatest(zv, zt))) / (exp(zv - greatest(zv, zt)) + exp(zt - greatest(zv, zt)))) AS score FROM @z")
both("discrete_gate", "R23", "SELECT event_id, CAST(CASE WHEN abs(zv) < 1.5 THEN 0.85 WHEN abs(zv) < 2.5 THEN 0.7 ELSE 0.5 END AS DOUBLE) AS w FROM @z")
both("continuous_gate", "R24 R20", "SELECT event_id, @r(0.35 + 0.55 / (1 + exp(greatest(least(abs(zv) - 2, 30), -30)))) AS w FROM @z")
both("agreement_gate", "R25 R21", "SELECT event_id, @r(CASE WHEN (zv > 1) = (zt > 1) THEN 0.6 ELSE 0.45 END) AS w, @r(1 / (1 + abs(zv - zt))) AS agreement FROM @z")
_RESCUE = "SELECT event_id, cat, zv + CASE WHEN zt > q95 AND zv < 3 THEN least(greatest(zt - q95, 0), 2) ELSE 0 END AS score, CASE WHEN zt <= q95 THEN 'no_support' WHEN zv >= 3 THEN 'visual_sure' ELSE 'rescued' END AS reason FROM @z z JOIN (SELECT e.cat AS k, @q((txt - ct) / st; 0.95) AS q95 FROM @ev e JOIN @cal c ON e.cat = c.cat WHERE ref = 1 GROUP BY e.cat) q ON z.cat = q.k"
both("local_rescue", "R14 P20", f"SELECT event_id, @r(score) AS score, reason FROM ({_RESCUE}) t")
both("rescue_reason_counts", "R14 G19", f"SELECT cat, reason, CAST(count(*) AS BIGINT) AS n FROM ({_RESCUE}) t GROUP BY cat, reason")
both("spatial_concentration", "R05", "SELECT vec_id, @r(1 + sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END) / ln(64)) AS concentration FROM (SELECT vec_id, s / sum(s) OVER (PARTITION BY vec_id) AS q FROM @cells) t GROUP BY vec_id")
both("oracle_fusion", "R27 R28 R29", "SELECT vec_id, p, @r(CASE WHEN m = 1 THEN greatest(s, o) ELSE least(s, o) END) AS v FROM (SELECT vec_id, p, m, s, sqrt(s) / 3 AS o FROM @cells) t")
both("oracle_headroom", "R27 D06", "SELECT label, @r(avg(CASE WHEN m = 1 THEN greatest(s, sqrt(s) / 3) END) - avg(CASE WHEN m = 1 THEN s END)) AS lift FROM @cells GROUP BY label")
both("minimum_ablation", "R33 R07", "SELECT cat, v.name AS variant, @r(avg(CASE v.name WHEN 'raw_visual' THEN vis WHEN 'raw_text' THEN txt WHEN 'z_visual' THEN zv WHEN 'z_text' THEN zt ELSE (zv + zt) / 2 END)) AS mean_score FROM @z CROSS JOIN (SELECT 'raw_visual' AS name UNION ALL SELECT 'raw_text' UNION ALL SELECT 'z_visual' UNION ALL SELECT 'z_text' UNION ALL SELECT 'half') v GROUP BY cat, v.name")
both("combined_reliability", "R38 R39", "SELECT event_id, @r(rel) AS reliability, @r((1 - rel) * (0.5 + 0.5 * bg)) AS risk FROM (SELECT event_id, (0.5 * pv + 0.5 * (1 - abs(pv - pt))) AS rel, abs(pt) AS bg FROM " + _P + " t) u")

# Stencils, as joins by offset in the oracle and as windows over rows and columns in Spark.
_NEAR = "SELECT a.vec_id, a.p, {what} FROM @cells a JOIN @cells b ON a.vec_id = b.vec_id AND b.r BETWEEN a.r - {n} AND a.r + {n} AND b.c BETWEEN a.c - {n} AND a.c + {n}{more} GROUP BY a.vec_id, a.p"


def _near(what: str, n: int, more: str = "") -> str:
    return _NEAR.replace("{what}", what).replace("{n}", str(n)).replace("{more}", more)


def _cells(spark, sf_dir):
    return spark_sql(spark, sf_dir, "SELECT vec_id, p, r, c, s, m, label FROM @cells")


def _r(x):
    return F.round(x, 6) + F.lit(0.0)


@frame("stencil_mean", "", _near("@r(avg(b.s)) AS v", 1))
def stencil_mean(spark, sf_dir):
    return grid.stencil(_cells(spark, sf_dir), ["vec_id"], 1, {"v": ("sum", "s"), "n": ("count", "s")}).select("vec_id", "p", _r(F.col("v") / F.col("n")).alias("v"))


@frame("stencil_std7", "", _near("@r(stddev_pop(b.s)) AS v", 3))
def stencil_std7(spark, sf_dir):
    cells = _cells(spark, sf_dir).withColumn("q", F.col("s") * F.col("s"))
    got = grid.stencil(cells, ["vec_id"], 3, {"a": ("sum", "s"), "b": ("sum", "q"), "n": ("count", "s")})
    mean = F.col("a") / F.col("n")
    return got.select("vec_id", "p", _r(F.sqrt(F.greatest(F.col("b") / F.col("n") - mean * mean, F.lit(0.0)))).alias("v"))


@frame("ring_context", "A04 A16", _near("@r(avg(b.s)) AS v", 2, " AND (abs(a.r - b.r) > 1 OR abs(a.c - b.c) > 1)"))
def ring_context(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    inner = grid.stencil(cells, ["vec_id"], 1, {"si": ("sum", "s"), "ni": ("count", "s")})
    outer = grid.stencil(inner, ["vec_id"], 2, {"so": ("sum", "s"), "no": ("count", "s")})
    return outer.select("vec_id", "p", _r((F.col("so") - F.col("si")) / (F.col("no") - F.col("ni"))).alias("v"))


both("block_pool", "A08 A26", "SELECT vec_id, r // 2 AS br, c // 2 AS bc, @r(avg(s)) AS v, @r(stddev_pop(s)) AS sd FROM @cells GROUP BY vec_id, r // 2, c // 2")


@frame("top_hat", "A17", "WITH e AS (" + _near("min(b.s) AS s, a.r, a.c", 1).replace("GROUP BY a.vec_id, a.p", "GROUP BY a.vec_id, a.p, a.r, a.c") + ") SELECT x.vec_id, x.p, @r(any_value(x.s) - max(e.s)) AS v FROM @cells x JOIN e ON x.vec_id = e.vec_id AND e.r BETWEEN x.r - 1 AND x.r + 1 AND e.c BETWEEN x.c - 1 AND x.c + 1 GROUP BY x.vec_id, x.p")
def top_hat(spark, sf_dir):
    eroded = grid.stencil(_cells(spark, sf_dir), ["vec_id"], 1, {"low": ("min", "s")})
    opened = grid.stencil(eroded, ["vec_id"], 1, {"open": ("max", "low")})
    return opened.select("vec_id", "p", _r(F.col("s") - F.col("open")).alias("v"))


@frame("dilate_ring_contrast", "A05 A29 M12", "WITH d AS (" + _near("max(b.m) AS d, any_value(a.m) AS m, any_value(a.s) AS s", 1, " AND abs(a.r - b.r) + abs(a.c - b.c) <= 1") + ") SELECT vec_id, @r(avg(CASE WHEN m = 1 THEN s END) - avg(CASE WHEN m = 0 AND d = 1 THEN s END)) AS contrast FROM d GROUP BY vec_id")
def dilate_ring_contrast(spark, sf_dir):
    near = grid.dilate(_cells(spark, sf_dir), ["vec_id"], "m", "d")
    return near.groupBy("vec_id").agg(_r(F.avg(F.when(F.col("m") == 1, F.col("s"))) - F.avg(F.when((F.col("m") == 0) & (F.col("d") == 1), F.col("s")))).alias("contrast"))


both("bilinear_resize", "A06 A10 A31", "WITH t AS (SELECT DISTINCT p AS i, greatest((p + 0.5) / 2 - 0.5, 0) AS x FROM @cells WHERE p < 16), w AS (SELECT i, CAST(floor(x) AS INT) AS k0, least(CAST(floor(x) AS INT) + 1, 7) AS k1, CAST(x - floor(x) AS DOUBLE) AS f FROM t) SELECT a.vec_id, y.i AS row_i, x.i AS col_i, @r(sum(a.s * (CASE WHEN a.r = y.k0 THEN 1 - y.f ELSE 0 END + CASE WHEN a.r = y.k1 THEN y.f ELSE 0 END) * (CASE WHEN a.c = x.k0 THEN 1 - x.f ELSE 0 END + CASE WHEN a.c = x.k1 THEN x.f ELSE 0 END))) AS v FROM @cells a JOIN w y ON a.r IN (y.k0, y.k1) JOIN w x ON a.c IN (x.k0, x.k1) GROUP BY a.vec_id, y.i, x.i")
both("gaussian_blur", "A07", "WITH k AS (SELECT a.i AS i, b.i AS j, exp(-(a.i - b.i) * (a.i - b.i) / 2.0) AS w FROM (SELECT DISTINCT p AS i FROM @cells WHERE p < 8) a CROSS JOIN (SELECT DISTINCT p AS i FROM @cells WHERE p < 8) b), h AS (SELECT vec_id, r, k.i AS c, sum(s * w) / sum(w) AS s FROM @cells JOIN k ON c = k.j GROUP BY vec_id, r, k.i) SELECT vec_id, k.i AS r, c, @r(sum(s * w) / sum(w)) AS v FROM h JOIN k ON r = k.j GROUP BY vec_id, k.i, c")
both("affinity_smoothing", "A09", "WITH e AS (SELECT a.vec_id, a.p, b.p AS q, exp(-abs(a.s - b.s) / 0.1) AS w FROM @cells a JOIN @cells b ON a.vec_id = b.vec_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1), s1 AS (SELECT e.vec_id, e.p, 0.5 * any_value(a.s) + 0.5 * sum(e.w * b.s) / sum(e.w) AS s FROM e JOIN @cells a ON e.vec_id = a.vec_id AND e.p = a.p JOIN @cells b ON e.vec_id = b.vec_id AND e.q = b.p GROUP BY e.vec_id, e.p), s2 AS (SELECT e.vec_id, e.p, 0.5 * any_value(a.s) + 0.5 * sum(e.w * b.s) / sum(e.w) AS s FROM e JOIN @cells a ON e.vec_id = a.vec_id AND e.p = a.p JOIN s1 b ON e.vec_id = b.vec_id AND e.q = b.p GROUP BY e.vec_id, e.p) SELECT vec_id, p, @r(s) AS v FROM s2")
both("map_flip", "A28", "SELECT a.vec_id, a.p, @r(abs(a.s - b.s)) AS gap FROM @cells a JOIN @cells b ON a.vec_id = b.vec_id AND a.r = b.r AND a.c = 7 - b.c")
both("gradient_magnitude", "", "SELECT vec_id, p, @r(sqrt(power(coalesce(lead(s) OVER (PARTITION BY vec_id, r ORDER BY c) - lag(s) OVER (PARTITION BY vec_id, r ORDER BY c), 0), 2) + power(coalesce(lead(s) OVER (PARTITION BY vec_id, c ORDER BY r) - lag(s) OVER (PARTITION BY vec_id, c ORDER BY r), 0), 2))) AS g FROM @cells")

# Regions: connected cells above a threshold; the root is the smallest position.
_CC = "WITH RECURSIVE a AS (SELECT vec_id, p, r, c, s, m FROM @cells WHERE s > 0.12), w AS (SELECT vec_id, p, p AS root FROM a UNION SELECT b.vec_id, b.p, w.root FROM w JOIN a x ON w.vec_id = x.vec_id AND w.p = x.p JOIN a b ON b.vec_id = x.vec_id AND abs(b.r - x.r) <= 1 AND abs(b.c - x.c) <= 1 WHERE w.root < b.p), l AS (SELECT vec_id, p, min(root) AS root FROM w GROUP BY vec_id, p), g AS (SELECT l.vec_id, l.p, l.root, a.r, a.c, a.s, a.m FROM l JOIN a ON l.vec_id = a.vec_id AND l.p = a.p)"


def _regions(spark, sf_dir):
    return regions.connected_regions(_cells(spark, sf_dir), ["vec_id"], F.col("s") > 0.12)


@frame("connected_components", "M01 M02 M18 M31", _CC + " SELECT vec_id, p, root FROM g")
def connected_components(spark, sf_dir):
    return _regions(spark, sf_dir).select("vec_id", "p", "root")


_FEATURES = "CAST(count(*) AS BIGINT) AS area, @r(max(s)) AS peak, @r(avg(s)) AS mean_s, CAST(max(r) - min(r) + 1 AS INT) AS height, CAST(max(c) - min(c) + 1 AS INT) AS width, @r(avg(CAST(r AS DOUBLE))) AS row_c, @r(avg(CAST(c AS DOUBLE))) AS col_c"


@frame("region_features", "M02 M19", _CC + f" SELECT vec_id, root, {_FEATURES} FROM g GROUP BY vec_id, root")
def region_features(spark, sf_dir):
    got = regions.region_stats(_regions(spark, sf_dir), ["vec_id"])
    return got.select("vec_id", "root", "area", *[_r(F.col(c)).alias(c) for c in ("peak", "mean_s")], "height", "width", *[_r(F.col(c)).alias(c) for c in ("row_c", "col_c")])


@frame("region_filter", "M01 M10 P20", _CC + " SELECT vec_id, root FROM g GROUP BY vec_id, root HAVING count(*) BETWEEN 4 AND 16")
def region_filter(spark, sf_dir):
    return regions.region_stats(_regions(spark, sf_dir), ["vec_id"]).where("area between 4 and 16").select("vec_id", "root")


@frame("proposal_label_iou", "M21 E22", _CC + " SELECT vec_id, root, @r(sum(m) / CAST(count(*) AS DOUBLE)) AS overlap, CASE WHEN sum(m) >= 0.05 * count(*) THEN 1 ELSE 0 END AS hit FROM g GROUP BY vec_id, root")
def proposal_label_iou(spark, sf_dir):
    own = _regions(spark, sf_dir).groupBy("vec_id", "root").agg((F.sum("m") / F.count("*")).alias("o"))
    return own.select("vec_id", "root", _r(F.col("o")).alias("overlap"), (F.col("o") >= 0.05).cast("int").alias("hit"))


@frame("region_rerank", "M22 X22", _CC + ", f AS (SELECT vec_id, root, @q(s; 0.9) AS p90 FROM g GROUP BY vec_id, root) SELECT g.vec_id, g.p, @r(g.s * exp(ln(1.5) * (2 * f.p90 - 1))) AS v FROM g JOIN f ON g.vec_id = f.vec_id AND g.root = f.root")
def region_rerank(spark, sf_dir):
    own = _regions(spark, sf_dir)
    p90 = own.groupBy("vec_id", "root").agg(F.percentile("s", 0.9).alias("p90"))
    return own.join(p90, ["vec_id", "root"]).select("vec_id", "p", _r(F.col("s") * F.exp(F.log(F.lit(1.5)) * (2 * F.col("p90") - 1))).alias("v"))


@frame("region_pool", "M27 M24", _CC + " SELECT vec_id, p, @r(avg(s) OVER (PARTITION BY vec_id, root)) AS v FROM g")
def region_pool(spark, sf_dir):
    own = _regions(spark, sf_dir)
    mean = own.groupBy("vec_id", "root").agg(F.avg("s").alias("v"))
    return own.join(mean, ["vec_id", "root"]).select("vec_id", "p", _r(F.col("v")).alias("v"))


@frame("greedy_budget", "R12", _CC + ", f AS (SELECT vec_id, root, count(*) AS area, row_number() OVER (PARTITION BY vec_id ORDER BY round(avg(s), 9) DESC, root) AS k FROM g GROUP BY vec_id, root), b AS (SELECT vec_id, root, k, area, CASE WHEN area <= 12 THEN area ELSE 0 END AS used, CASE WHEN area <= 12 THEN 1 ELSE 0 END AS taken FROM f WHERE k = 1 UNION ALL SELECT f.vec_id, f.root, f.k, f.area, CASE WHEN b.used + f.area <= 12 THEN b.used + f.area ELSE b.used END, CASE WHEN b.used + f.area <= 12 THEN 1 ELSE 0 END FROM b JOIN f ON f.vec_id = b.vec_id AND f.k = b.k + 1) SELECT vec_id, root, taken FROM b")
def greedy_budget(spark, sf_dir):
    stats = regions.region_stats(_regions(spark, sf_dir), ["vec_id"])
    return regions.greedy_budget(stats, ["vec_id"], order=F.round("mean_s", 9), size="area", budget=12).select("vec_id", "root", "taken")


@frame("conformal_regions", "H05 M24 M25", _CC + ", f AS (SELECT vec_id, root, max(s) AS peak FROM g GROUP BY vec_id, root) SELECT a.vec_id, a.root, @r((1 + count(b.peak)) / CAST((SELECT count(*) FROM f WHERE vec_id % 5 = 0) + 1 AS DOUBLE)) AS p FROM f a LEFT JOIN f b ON b.vec_id % 5 = 0 AND b.peak >= a.peak WHERE a.vec_id % 5 <> 0 GROUP BY a.vec_id, a.root")
def conformal_regions(spark, sf_dir):
    stats = regions.region_stats(_regions(spark, sf_dir), ["vec_id"]).withColumn("ref", F.expr("if(vec_id % 5 = 0, 1, 0)"))
    from orrery.operators.metrics import conformal_p

    return conformal_p(stats, [], "peak", "ref").where("ref = 0").select("vec_id", "root", _r(F.col("p")).alias("p"))
