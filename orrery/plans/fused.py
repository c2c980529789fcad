"""Fusion, border and region-signal operators as queries; the oracles are written from the formulas, not from the plans."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators import calibration, fusion, grid, regions, signals
from orrery.plans.kit import VIEWS, frame, spark_sql

#: Two branches: a map, and the same turned by half; maps of labels 3, 7 and 9 are not known to be normal.
VIEWS["pair"] = (
    "SELECT a.vec_id, a.label, a.vec_id % 3 AS g, a.p, a.r, a.c, a.m, a.s AS v, b.s AS t, CASE WHEN a.label IN (3, 7, 9) THEN 0 ELSE 1 END AS ref "
    "FROM @cells a JOIN @cells b ON a.vec_id = b.vec_id AND b.p = 63 - a.p",
    None,
)
SHAPE, KEYS, IMAGE = (8, 8), ["g"], ["g", "vec_id"]


def _pair(spark, sf_dir):
    """Rows of @pair. Its join of cells is one of vectors: cell p of one meets cell 63 - p of the other."""
    return spark_sql(
        spark, sf_dir,
        "SELECT vec_id, label, vec_id % 3 AS g, p, p div 8 AS r, p % 8 AS c, CASE WHEN label IN (3, 7, 9) AND (vec_id * 7 + p) % 11 = 0 THEN 1 ELSE 0 END AS m, "
        "abs(CAST(x AS DOUBLE)) AS v, abs(CAST(get(other, 63 - p) AS DOUBLE)) AS t, CASE WHEN label IN (3, 7, 9) THEN 0 ELSE 1 END AS ref "
        "FROM (SELECT vec_id, label, other, posexplode(embedding) AS (p, x) FROM (SELECT a.vec_id, a.label, a.embedding, b.embedding AS other FROM {embeddings} a JOIN {embeddings} b ON a.vec_id = b.vec_id) w) y WHERE 63 - p BETWEEN 0 AND size(other) - 1",
    )


def _r(x):
    return F.round(x, 6) + F.lit(0.0)


def _told(df, *columns):
    return df.select("vec_id", "p", *[_r(F.col(c)).alias(c) for c in columns])


_AT = {
    "edge": "least(greatest({x}, 0), 7)",
    "symmetric": "CASE WHEN {x} < 0 THEN -1 - {x} WHEN {x} > 7 THEN 15 - {x} ELSE {x} END",
    "mirror": "CASE WHEN {x} < 0 THEN -{x} WHEN {x} > 7 THEN 14 - {x} ELSE {x} END",
}


def _around(source: str, value: str, n: int, border: str, what: str, keep: str = "") -> str:
    """Aggregate over the square around each cell of a continued map, by looking every cell of it up."""
    r, c = (_AT[border].replace("{x}", f"(a.{x} + d{x})") for x in "rc")
    return (
        f"SELECT a.vec_id, a.p, {what}{keep} FROM {source} a, (SELECT unnest(range({-n}, {n + 1})) AS dr) i, (SELECT unnest(range({-n}, {n + 1})) AS dc) j, "
        f"{source} b WHERE b.vec_id = a.vec_id AND b.r = {r} AND b.c = {c} GROUP BY a.vec_id, a.p"
    ).replace("{v}", value)


def _bordered(name, operators, n, border, what, make):
    @frame(name, operators, _around("@cells", "s", n, border, what))
    def run(spark, sf_dir):
        cells = spark_sql(spark, sf_dir, "SELECT vec_id, p, r, c, s, s * s AS q FROM @cells")
        got = grid.bordered_stencil(cells, ["vec_id"], SHAPE, n, border, {"a": ("sum", "s"), "b": ("sum", "q")})
        return got.select("vec_id", "p", _r(make(F.col("a") / float((2 * n + 1) ** 2), F.col("b") / float((2 * n + 1) ** 2))).alias("v"))


_bordered("stencil_mean_edge", "A01", 1, "edge", "@r(avg(b.s)) AS v", lambda a, b: a)
_bordered("stencil_mean_mirror", "A03", 1, "mirror", "@r(avg(b.s)) AS v", lambda a, b: a)
_bordered("stencil_std_symmetric", "A02", 3, "symmetric", "@r(stddev_pop(b.s)) AS v", lambda a, b: F.sqrt(F.greatest(b - a * a, F.lit(0.0))))

_Z = (
    "WITH n AS (SELECT g, median(v) AS cv, median(t) AS ct FROM @pair WHERE ref = 1 GROUP BY g), "
    "d AS (SELECT x.g, any_value(cv) AS cv, any_value(ct) AS ct, median(abs(v - cv)) AS sv, median(abs(t - ct)) AS st FROM @pair x JOIN n ON x.g = n.g WHERE ref = 1 GROUP BY x.g), "
    "z AS (SELECT vec_id, p, r, c, x.g, ref, (v - cv) / CASE WHEN sv < 0.00000001 THEN 1 ELSE sv END AS zv, (t - ct) / CASE WHEN st < 0.00000001 THEN 1 ELSE st END AS zt FROM @pair x JOIN d ON x.g = d.g)"
)
_CLIP = "least(greatest({x}, {a}), {b})"


def _clip(x, a, b):
    return _CLIP.replace("{x}", x).replace("{a}", str(a)).replace("{b}", str(b))


def _gate(weight: str, more: str = "", source: str = "z") -> str:
    return f"{_Z}{more} SELECT vec_id, p, @r(w) AS weight, @r(w * zv + (1 - w) * zt) AS fused FROM (SELECT *, {weight} AS w FROM {source}) q"


_RANGE = " (max({x}) OVER (PARTITION BY vec_id) + 0.00000001)"


@frame("raw_deviation_z", "B10 B12", _Z + " SELECT vec_id, p, @r(zv) AS z_v, @r(zt) AS z_t FROM z")
def raw_deviation_z(spark, sf_dir):
    return _told(fusion.calibrated(_pair(spark, sf_dir), KEYS, ["v", "t"], "ref"), "z_v", "z_t")


@frame(
    "uncertainty_weighted", "R19 A02 W19",
    _gate(
        _clip("0.6 - 0.4 * " + _clip(f"uv /{_RANGE.replace('{x}', 'uv')} - ut /{_RANGE.replace('{x}', 'ut')}", -2, 2), 0.3, 0.9),
        ", u AS (" + _around("z", "", 3, "symmetric", "stddev_pop(b.zv) AS uv, stddev_pop(b.zt) AS ut, any_value(a.zv) AS zv, any_value(a.zt) AS zt") + ")", "u",
    ),
)
def uncertainty_weighted(spark, sf_dir):
    return _told(fusion.uncertainty_weighted(_pair(spark, sf_dir), KEYS, IMAGE, SHAPE, "v", "t", "ref"), "weight", "fused")


@frame(
    "normal_reference_gate", "R20",
    _gate(
        _clip("0.6 + 0.4 * " + _clip(f"dt /{_RANGE.replace('{x}', 'dt')} - dv /{_RANGE.replace('{x}', 'dv')}", -2, 2), 0.3, 0.9),
        ", mu AS (SELECT g, p, avg(zv) AS mv, avg(zt) AS mt FROM z WHERE ref = 1 GROUP BY g, p), u AS (SELECT z.*, abs(zv - mv) AS dv, abs(zt - mt) AS dt FROM z JOIN mu ON z.g = mu.g AND z.p = mu.p)", "u",
    ),
)
def normal_reference_gate(spark, sf_dir):
    return _told(fusion.normal_reference_gated(_pair(spark, sf_dir), KEYS, IMAGE, "v", "t", "ref"), "weight", "fused")


def _agree(base, alpha):
    return _gate("1 - " + _clip(f"{1 - base} + {alpha} * (1 / (1 + abs(zv - zt) /{_RANGE.replace('{x}', 'abs(zv - zt)')}) - 0.5)", 0.2, 0.8))


@frame("agreement_weighted", "R21", _agree(0.6, 0.4))
def agreement_weighted(spark, sf_dir):
    return _told(fusion.agreement_gated(_pair(spark, sf_dir), KEYS, IMAGE, "v", "t", "ref"), "weight", "fused")


@frame("agreement_annealed", "R22", _agree(0.88, 0.12))
def agreement_annealed(spark, sf_dir):
    return _told(fusion.agreement_gated(_pair(spark, sf_dir), KEYS, IMAGE, "v", "t", "ref", visual_ap=0.9), "weight", "fused")


@frame(
    "two_stage_fusion", "R18 B09",
    "WITH x AS (SELECT *, (t + s2) / 2 AS i FROM (SELECT *, sqrt(v) AS s2 FROM @pair) y), q AS (SELECT g, median(v) AS cv, @q(v; 0.75) - @q(v; 0.25) + 0.00000001 AS sv, median(i) AS ci, @q(i; 0.75) - @q(i; 0.25) + 0.00000001 AS si FROM x WHERE ref = 1 GROUP BY g) "
    "SELECT vec_id, p, @r((0.7 * (v - cv) / sv + 0.3 * (i - ci) / si) * sv + cv) AS fused FROM x JOIN q ON x.g = q.g",
)
def two_stage_fusion(spark, sf_dir):
    own = _pair(spark, sf_dir).withColumn("s2", F.sqrt("v"))
    return _told(fusion.two_stage(own, KEYS, "v", ["t", "s2"], "ref"), "fused")


@frame("ensemble_safe", "R16 R15", "SELECT vec_id, p, @r((0.6 * v + CASE WHEN t > 0.2 THEN 0 ELSE 0.4 * 0.3 * t END) / (0.6 + CASE WHEN t > 0.2 THEN 0 ELSE 0.4 * 0.3 END)) AS fused FROM @pair")
def ensemble_safe(spark, sf_dir):
    own = _pair(spark, sf_dir).withColumn("t", F.when(F.col("t") > 0.2, F.lit(float("nan"))).otherwise(F.col("t")))
    return _told(fusion.ensemble(own, {"v": 0.6, "t": 0.4}, "v", 0.9), "fused")


@frame(
    "best_branch", "R17",
    _Z.replace("ref, (v", "ref, v, t, (v") + " SELECT vec_id, p, @r(CASE WHEN zv > zt OR (zv = zt AND v >= t) THEN v ELSE t END) AS top, @r((v + t) / 2) AS top2, @r((v * exp(zv - greatest(zv, zt)) + t * exp(zt - greatest(zv, zt))) / (exp(zv - greatest(zv, zt)) + exp(zt - greatest(zv, zt)))) AS mixed FROM z",
)
def best_branch(spark, sf_dir):
    own, raw = fusion.calibrated(_pair(spark, sf_dir), KEYS, ["v", "t"], "ref"), {"v": "z_v", "t": "z_t"}
    for mode, name in (("max", "top"), ("top2", "top2"), ("softmax", "mixed")):
        own = fusion.best_branch(own, raw, mode).withColumnRenamed("fused", name)
    return _told(own, "top", "top2", "mixed")


def _entropy(x):
    return f"(-({_clip(x, 0.000001, 0.999999)} * log2({_clip(x, 0.000001, 0.999999)}) + (1 - {_clip(x, 0.000001, 0.999999)}) * log2(1 - {_clip(x, 0.000001, 0.999999)})))"


_SUPPORT = "greatest(1.4826 * s{b}, q{b} / 1.349, greatest(0.000001, 0.05 * w{b}))"
_ROUTER = (
    "WITH n AS (SELECT g, median(v) AS cv, median(t) AS ct, @q(v; 0.75) - @q(v; 0.25) AS qv, @q(t; 0.75) - @q(t; 0.25) AS qt, max(v) - min(v) AS wv, max(t) - min(t) AS wt, @q(v; 0.99) AS uv, @q(t; 0.99) AS ut FROM @pair WHERE ref = 1 GROUP BY g), "
    "d AS (SELECT x.g, median(abs(v - cv)) AS sv, median(abs(t - ct)) AS st FROM @pair x JOIN n ON x.g = n.g WHERE ref = 1 GROUP BY x.g), "
    f"k AS (SELECT n.*, {_SUPPORT.replace('{b}', 'v')} AS kv, {_SUPPORT.replace('{b}', 't')} AS kt FROM n JOIN d ON n.g = d.g), "
    "e AS (SELECT vec_id, x.g, p, r, c, 0.5 + atan((v - cv) / kv) / pi() AS pv, 0.5 + atan((t - ct) / kt) / pi() AS pt, greatest(v - uv, 0) / kv AS ev, greatest(t - ut, 0) / kt AS et FROM @pair x JOIN k ON x.g = k.g), "
    "h AS (SELECT *, pv / sum(pv) OVER (PARTITION BY vec_id) AS qv, pt / sum(pt) OVER (PARTITION BY vec_id) AS qt FROM e), "
    "o AS (SELECT *, 1 + sum(qv * ln(qv)) OVER (PARTITION BY vec_id) / ln(64) AS fv, 1 + sum(qt * ln(qt)) OVER (PARTITION BY vec_id) / ln(64) AS ft FROM h), "
    f"a AS (SELECT *, {_entropy('pv')} - {_entropy('pt')} AS gain FROM o), "
    "ok AS (SELECT *, ev <= 3 AND et <= 3 AND ft + 0.1 >= fv AND abs(pv - pt) >= 0.05 AND gain >= 0.05 AS ok FROM a), "
    "w AS (SELECT *, CASE WHEN ok THEN 0.35 * least(greatest((gain - 0.05) / 0.95, 0), 1) / (1 + et) ELSE 0 END AS w FROM ok), "
    "sm AS (" + _around("w", "", 1, "edge", "sum(b.w) / 9 AS sw, any_value(a.ok) AS ok, any_value(a.pv) AS pv, any_value(a.pt) AS pt") + ") "
    "SELECT vec_id, p, @r(w) AS weight, @r((1 - w) * pv + w * pt) AS fused FROM (SELECT *, CASE WHEN ok THEN least(sw, 0.35) ELSE 0 END AS w FROM sm) q"
)


@frame("safe_router_v2", "R08 B04 B05 R05 A01", _ROUTER)
def safe_router_v2(spark, sf_dir):
    return _told(fusion.safe_router(_pair(spark, sf_dir), KEYS, IMAGE, SHAPE, "v", "t", "ref"), "weight", "fused")


@frame("rank_preserving_stats", "B04 B06", _ROUTER.split(", e AS")[0].replace("WITH n", "WITH n") + " SELECT g, @r(cv) AS center, @r(kv) AS scale, @r(uv) AS upper FROM k")
def rank_preserving_stats(spark, sf_dir):
    got = calibration.rank_preserving_stats(_pair(spark, sf_dir).where("ref = 1"), KEYS, "v")
    return got.select("g", *[_r(F.col(c)).alias(c) for c in ("center", "scale", "upper")])


# Regions above a threshold; their root is their smallest position.
_ROOTS = (
    "WITH RECURSIVE a AS (SELECT vec_id, p, r, c, v, t FROM @pair WHERE v > 0.12), "
    "w AS (SELECT vec_id, p, p AS root FROM a UNION SELECT b.vec_id, b.p, w.root FROM w JOIN a x ON w.vec_id = x.vec_id AND w.p = x.p JOIN a b ON b.vec_id = x.vec_id AND abs(b.r - x.r) <= 1 AND abs(b.c - x.c) <= 1 WHERE w.root < b.p), "
    "l AS (SELECT a.*, w.root FROM a JOIN (SELECT vec_id, p, min(root) AS root FROM w GROUP BY vec_id, p) w ON a.vec_id = w.vec_id AND a.p = w.p)"
)


def _regions(spark, sf_dir):
    cells = spark_sql(spark, sf_dir, "SELECT vec_id, p, r, c, v, t FROM @pair")
    return cells, regions.connected_regions(cells, ["vec_id"], F.col("v") > 0.12)


@frame(
    "region_shape_signals", "M05 M06",
    _ROOTS + " SELECT vec_id, CAST(root AS INT) AS root, count(*) AS area, CAST(min(r) < 1 OR max(r) >= 7 OR min(c) < 1 OR max(c) >= 7 AS INT) AS edge, CAST(count(*) > 6.4 AS INT) AS large FROM l GROUP BY vec_id, root",
)
def region_shape_signals(spark, sf_dir):
    got = signals.shape_signals(_regions(spark, sf_dir)[1], ["vec_id"], SHAPE, margin=1)
    return got.select("vec_id", F.col("root").cast("int").alias("root"), "area", F.col("edge").cast("int").alias("edge"), F.col("large").cast("int").alias("large"))


@frame(
    "region_boundary", "M08",
    _ROOTS + " SELECT vec_id, CAST(root AS INT) AS root, area, crossings, CAST(area < 16 OR crossings / (2 * sqrt(pi() * area)) > 3 AS INT) AS fragmented FROM ("
    "SELECT l.vec_id, l.root, count(DISTINCT l.p) AS area, count(*) - count(o.p) AS crossings FROM l, (SELECT unnest([[0, 1], [1, 0], [0, -1], [-1, 0]]) AS s) k "
    "LEFT JOIN l o ON o.vec_id = l.vec_id AND o.root = l.root AND o.r = l.r + s[1] AND o.c = l.c + s[2] GROUP BY l.vec_id, l.root) q",
)
def region_boundary(spark, sf_dir):
    got = signals.boundary(_regions(spark, sf_dir)[1], ["vec_id"])
    return got.select("vec_id", F.col("root").cast("int").alias("root"), "area", "crossings", signals.fragmented("area", "crossings").cast("int").alias("fragmented"))


@frame(
    "region_stability", "M12",
    _ROOTS + ", o AS (SELECT DISTINCT l.vec_id, l.root, x.p, x.v FROM l JOIN @pair x ON x.vec_id = l.vec_id AND abs(x.r - l.r) + abs(x.c - l.c) <= 3 WHERE NOT EXISTS (SELECT 1 FROM l i WHERE i.vec_id = l.vec_id AND i.root = l.root AND i.p = x.p)), "
    "y AS (SELECT vec_id, root, avg(v) AS outside FROM o GROUP BY vec_id, root), "
    "x AS (SELECT vec_id, root, count(*) AS n, max(v) AS peak, avg(v) AS mean, CAST(count(*) AS DOUBLE) / ((max(r) - min(r) + 1) * (max(c) - min(c) + 1)) AS fill FROM l GROUP BY vec_id, root) "
    "SELECT x.vec_id, CAST(x.root AS INT) AS root, @r(CASE WHEN n < 4 THEN 0 ELSE 0.35 * least(greatest((peak / mean - 1) / 3, 0), 1) + 0.35 * least(fill / 0.5, 1) + 0.3 * CASE WHEN outside IS NULL THEN 0.5 ELSE least(peak / outside, 5) / 5 END END) AS stability "
    "FROM x LEFT JOIN y ON x.vec_id = y.vec_id AND x.root = y.root",
)
def region_stability(spark, sf_dir):
    cells, own = _regions(spark, sf_dir)
    got = signals.spatial_stability(cells, own, ["vec_id"], "v")
    return got.select("vec_id", F.col("root").cast("int").alias("root"), _r(F.col("stability")).alias("stability"))


@frame(
    "region_view_consistency", "M13 M14",
    _ROOTS + " SELECT vec_id, CAST(root AS INT) AS root, @r((least(m, a) / greatest(m, a) + least(m, b) / greatest(m, b)) / 2) AS augmentation, @r(greatest(1 - sqrt((power(a - b, 2) / 4 + power(a - b, 2) / 4) / 2) / ((a + b) / 2), 0)) AS prompt "
    "FROM (SELECT vec_id, root, avg(v) AS m, avg(t) AS a, avg(sqrt(v)) AS b FROM l GROUP BY vec_id, root) q",
)
def region_view_consistency(spark, sf_dir):
    own = _regions(spark, sf_dir)[1].withColumn("u", F.sqrt("v"))
    got = signals.view_consistency(own, ["vec_id"], "v", ["t", "u"])
    return got.select("vec_id", F.col("root").cast("int").alias("root"), *[_r(F.col(c)).alias(c) for c in ("augmentation", "prompt")])


@frame(
    "region_background_risk", "M16",
    _ROOTS + ", f AS (SELECT avg(v) AS m FROM @pair WHERE ref = 1) SELECT vec_id, CAST(root AS INT) AS root, @r(least(greatest(0.3 * least(greatest(1 - gap / 8.0 * 10, 0), 1) + 0.3 * least(n / 64.0 / 0.05, 1) + 0.4 * least(greatest(1 - abs(own / m - 1), 0), 1), 0), 1)) AS risk "
    "FROM (SELECT vec_id, root, count(*) AS n, least(min(r), 7 - max(r), min(c), 7 - max(c)) AS gap, avg(v) AS own FROM l GROUP BY vec_id, root) q, f",
)
def region_background_risk(spark, sf_dir):
    own = _regions(spark, sf_dir)[1]
    reference = _pair(spark, sf_dir).where("ref = 1").agg(F.avg("v").alias("reference"))
    means = own.groupBy("vec_id", "root").agg(F.avg("v").alias("mean")).crossJoin(F.broadcast(reference))
    got = signals.background_risk(signals.shape_signals(own, ["vec_id"], SHAPE), means, ["vec_id"], SHAPE, "mean", "reference")
    return got.select("vec_id", F.col("root").cast("int").alias("root"), _r(F.col("risk")).alias("risk"))


@frame(
    "region_rejection", "M10 R11",
    _ROOTS + " SELECT reason, count(*) AS n FROM (SELECT CASE WHEN min(r) < 1 OR max(r) >= 7 OR min(c) < 1 OR max(c) >= 7 THEN 'edge' WHEN count(*) > 6.4 THEN 'large' WHEN count(*) >= 4 AND max(v) / avg(v) < 0.5 THEN 'scattered' "
    "WHEN max(t) > 0.15 AND max(v) <= 0.2 THEN 'isolated' ELSE 'kept' END AS reason FROM l GROUP BY vec_id, root) q GROUP BY reason",
)
def region_rejection(spark, sf_dir):
    own = _regions(spark, sf_dir)[1]
    peaks = own.groupBy("vec_id", "root").agg(F.max("v").alias("pv"), F.avg("v").alias("mv"), F.max("t").alias("pt"))
    got = signals.shape_signals(own, ["vec_id"], SHAPE, margin=1).join(peaks, ["vec_id", "root"])
    checks = [("edge", F.col("edge")), ("large", F.col("large")), ("scattered", signals.scattered(F.col("pv"), F.col("mv"), F.col("area"))), ("isolated", (F.col("pt") > 0.15) & (F.col("pv") <= 0.2))]
    return got.withColumn("reason", signals.first_reason(checks)).groupBy("reason").agg(F.count("*").alias("n"))


@frame("background_reject", "P21", "SELECT vec_id, p FROM (SELECT vec_id, p, v, avg(v) OVER w AS m, stddev_pop(v) OVER w AS sd FROM @pair WINDOW w AS (PARTITION BY vec_id)) q WHERE v > 0.12 AND abs(v - m) >= 0.05 AND sd >= 0.05")
def background_reject(spark, sf_dir):
    own = _pair(spark, sf_dir).groupBy("vec_id").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    return _pair(spark, sf_dir).where("v > 0.12").join(own, "vec_id").where("abs(v - mean) >= 0.05 and sd >= 0.05").select("vec_id", "p")


@frame("percentile_clip", "X24", "WITH q AS (SELECT label, @q(v; 0.99) AS hi, min(v) AS lo FROM @pair GROUP BY label) SELECT vec_id, p, @r(CASE WHEN hi - lo <= 0.000000000001 THEN 0 ELSE (least(v, hi) - lo) / (hi - lo) END) AS v FROM @pair x JOIN q ON x.label = q.label")
def percentile_clip(spark, sf_dir):
    own = _pair(spark, sf_dir)
    stats = own.groupBy("label").agg(F.percentile("v", F.lit(0.99)).alias("hi"), F.min("v").alias("lo"))
    v = F.when(F.col("hi") - F.col("lo") <= 1e-12, 0.0).otherwise((F.least("v", "hi") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return own.join(F.broadcast(stats), "label").select("vec_id", "p", _r(v).alias("v"))


@frame("sobel_magnitude", "A24", "SELECT vec_id, p, @r(sqrt(gx * gx + gy * gy)) AS g FROM (" + _around("@pair", "", 1, "mirror", "sum(b.v * dc * (2 - abs(dr))) AS gx, sum(b.v * dr * (2 - abs(dc))) AS gy") + ") q")
def sobel_magnitude(spark, sf_dir):
    own = _pair(spark, sf_dir).select("vec_id", "p", "r", "c", "v")

    def padded(df, at):
        return df.withColumn("__at", F.explode(grid._copies(at, 8, 1, "mirror"))).withColumn(f"o{at}", F.col(at)).withColumn(at, F.col("__at")).drop("__at")

    own = padded(padded(own, "r"), "c")
    along, down = Window.partitionBy("vec_id", "r").orderBy("c"), Window.partitionBy("vec_id", "c").orderBy("r")
    step = lambda w: F.lead("v").over(w) - F.lag("v").over(w)
    smooth = lambda x, w: F.lag(x).over(w) + 2 * F.col(x) + F.lead(x).over(w)
    own = own.withColumns({"dx": step(along), "dy": step(down)})
    own = own.withColumns({"gx": smooth("dx", down), "gy": smooth("dy", along)})
    return own.where((F.col("r") == F.col("or")) & (F.col("c") == F.col("oc"))).select("vec_id", "p", _r(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2)).alias("g"))


@frame("channel_int8", "C09", "WITH q AS (SELECT p, greatest(max(abs(x)) / 127, 0.000000000001) AS k FROM @dims WHERE vec_id % 5 = 0 GROUP BY p) SELECT d.vec_id, sum(CAST(least(greatest(round_even(x / k, 0), -127), 127) AS BIGINT)) AS total, @r(sqrt(sum(power(x - k * least(greatest(round_even(x / k, 0), -127), 127), 2)))) AS error FROM @dims d JOIN q ON d.p = q.p GROUP BY d.vec_id")
def channel_int8(spark, sf_dir):
    dims = spark_sql(spark, sf_dir, "SELECT vec_id, p, x FROM @dims")
    scale = dims.where("vec_id % 5 = 0").groupBy("p").agg(F.greatest(F.max(F.abs("x")) / 127, F.lit(1e-12)).alias("k"))
    own = dims.join(F.broadcast(scale), "p").withColumn("code", F.greatest(F.least(F.rint(F.col("x") / F.col("k")), F.lit(127.0)), F.lit(-127.0)))
    return own.groupBy("vec_id").agg(F.sum(F.col("code").cast("long")).alias("total"), _r(F.sqrt(F.sum((F.col("x") - F.col("k") * F.col("code")) ** 2))).alias("error"))
