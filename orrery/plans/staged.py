"""Staged and selective rescue as queries. The oracles hold a map's region as the bits of one number."""

from pyspark.sql import functions as F

from orrery.operators import rescue
from orrery.plans.kit import VIEWS, frame, spark_sql

#: Three branches of small maps: a map, the same turned by half, and the same mirrored at its diagonal.
VIEWS["three"] = (
    "SELECT x.vec_id, x.p, x.r, x.c, x.ref, x.v, x.t, b.s AS q, x.t * 0.9 + 0.01 AS a1, sqrt(x.t) AS b1, x.t * x.t * 5 AS b2, 0.05 AS center, 0.05 AS scale "
    "FROM @pair x JOIN @cells b ON x.vec_id = b.vec_id AND b.p = x.c * 8 + x.r",
    None,
)
SHAPE, KEYS = (8, 8), ["vec_id"]
#: Thresholds for maps of 64 cells; outlines, which the SQL does not follow, decide nothing here.
LIMITS = rescue.Limits(
    min_area=2, max_share=0.4, min_compactness=0.2, text_above=0.16, third_above=0.18, visual_low=0.14, visual_high=0.5, margin=0, large=0.3, outline=1e9, outline_area=1,
    lone_text=0.3, lone_third=0.2, lone_visual=0.16, signal=0.17, reliability=0.5, background=0.7, augmentation=0.9, rescue_share=0.1,
)
_COLUMNS = {"center": "center", "scale": "scale", "augmented": ["a1"], "prompts": ["b1", "b2"], "reference": "normal"}


def _r(x):
    return F.round(x, 6) + F.lit(0.0)


def _cells(spark, sf_dir):
    own = spark_sql(spark, sf_dir, "SELECT * FROM @three")
    return own.crossJoin(F.broadcast(own.where("ref = 1").agg(F.avg("t").alias("normal"))))  # one row


def _found(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return cells, rescue.candidate_regions(cells, KEYS, SHAPE, "v", "t", "q", LIMITS).persist()


_L = LIMITS
_MIDDLE = (_L.visual_low + _L.visual_high) / 2
_STRUCT = "STRUCT(m HUGEINT, b BIGINT, i BIGINT)"
_FOUND = (
    "WITH RECURSIVE s AS (SELECT vec_id, p, r, c, 0 AS br, t AS s FROM @three WHERE t > {_L.text_above} UNION ALL SELECT vec_id, p, r, c, 1, q FROM @three WHERE q > {_L.third_above} "
    "UNION ALL SELECT vec_id, p, r, c, 2, least(v, {_MIDDLE}) FROM @three WHERE v > {_L.visual_low}), "
    "w AS (SELECT vec_id, br, p, p AS root FROM s UNION SELECT b.vec_id, b.br, b.p, w.root FROM w JOIN s x ON w.vec_id = x.vec_id AND w.br = x.br AND w.p = x.p "
    "JOIN s b ON b.vec_id = x.vec_id AND b.br = x.br AND abs(b.r - x.r) <= 1 AND abs(b.c - x.c) <= 1 WHERE w.root < b.p), "
    "l0 AS (SELECT s.*, w.root FROM s JOIN (SELECT vec_id, br, p, min(root) AS root FROM w GROUP BY vec_id, br, p) w ON s.vec_id = w.vec_id AND s.br = w.br AND s.p = w.p), "
    "g0 AS (SELECT vec_id, br, root, count(*) AS n, max(s) AS peak, count(*) / CAST((max(r) - min(r) + 1) * (max(c) - min(c) + 1) AS DOUBLE) AS fill, bit_or(CAST(1 AS HUGEINT) << p) AS m FROM l0 GROUP BY vec_id, br, root), "
    "g AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY br, root) AS i FROM g0 WHERE n BETWEEN {_L.min_area} AND {_MOST} AND fill >= {_L.min_compactness}), "
    "mg AS (SELECT vec_id, 0 AS step, list({'m': m, 'b': CAST(1 << br AS BIGINT), 'i': i} ORDER BY i) AS todo, CAST(0 AS HUGEINT) AS m, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS i FROM g GROUP BY vec_id "
    "UNION ALL SELECT vec_id, step + 1, f.rest, f.m, f.b, f.i FROM (SELECT vec_id, step, list_reduce(list_transform(todo, lambda x: {'m': x.m, 'b': x.b, 'i': x.i, 'rest': CAST([] AS " + _STRUCT + "[])}), "
    "lambda a, x: CASE WHEN bit_count(a.m & x.m) / CAST(bit_count(a.m | x.m) AS DOUBLE) > {_L.overlap} THEN {'m': a.m | x.m, 'b': a.b | x.b, 'i': a.i, 'rest': a.rest} "
    "ELSE {'m': a.m, 'b': a.b, 'i': a.i, 'rest': list_append(a.rest, {'m': x.m, 'b': x.b, 'i': x.i})} END) AS f FROM mg WHERE len(todo) > 0)), "
    "k AS (SELECT mg.vec_id, mg.m, mg.b, g.fill, row_number() OVER (PARTITION BY mg.vec_id ORDER BY bit_count(mg.b) DESC, g.peak DESC, step) AS root FROM mg JOIN g ON g.vec_id = mg.vec_id AND g.i = mg.i WHERE step > 0), "
    "l AS (SELECT k.vec_id, k.root, k.fill, k.b, x.p, x.r, x.c, x.v, x.t, x.q, x.a1, x.b1, x.b2 FROM k JOIN @three x ON x.vec_id = k.vec_id AND (k.m >> x.p) & 1 = 1)"
)


def _put(text: str) -> str:
    """The thresholds in place of their names."""
    for name in _L.__dataclass_fields__:
        text = text.replace("{_L." + name + "}", repr(getattr(_L, name)))
    return text.replace("{_MIDDLE}", repr(_MIDDLE)).replace("{_MOST}", str(int(64 * _L.max_share)))


_FOUND = _put(_FOUND)


@frame(
    "candidate_regions", "M03 M04",
    _FOUND + " SELECT vec_id, CAST(root AS INT) AS root, list_aggregate(list_filter([CASE WHEN b & 1 = 1 THEN 'text' END, CASE WHEN b & 2 = 2 THEN 'third' END, CASE WHEN b & 4 = 4 THEN 'visual' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS branches, "
    "count(*) AS area, @r(any_value(fill)) AS compactness, @r(max(t)) AS text_peak, @r(max(q)) AS third_peak, @r(max(v)) AS visual_peak, @r(avg(v)) AS visual_mean FROM l GROUP BY vec_id, root, b",
)
def candidate_regions(spark, sf_dir):
    found = _found(spark, sf_dir)[1]
    told = {"text_peak": F.max("text"), "third_peak": F.max("third"), "visual_peak": F.max("visual"), "visual_mean": F.avg("visual")}
    return found.groupBy("vec_id", "root", "branches").agg(F.count("*").alias("area"), _r(F.first("compactness")).alias("compactness"), *[_r(c).alias(n) for n, c in told.items()])


_CLIP = "least(greatest({x}, 0), 1)"
_RATIO = "least({a}, {b}) / greatest({a}, {b}, 0.00000001)"
_EVIDENCE = _FOUND + (
    ", looks AS (SELECT vec_id, root, count(*) AS area, CASE WHEN count(*) > 64 * {_L.large} THEN 'large' WHEN count(*) >= 4 AND (max(t) <= 0 OR max(t) / greatest(avg(t), 0.00000001) < {_L.peak_ratio}) THEN 'scattered' "
    "WHEN max(t) > {_L.lone_text} AND max(q) <= {_L.lone_third} AND max(v) <= {_L.lone_visual} THEN 'isolated' ELSE 'kept' END AS reason FROM l GROUP BY vec_id, root), "
    "o AS (SELECT DISTINCT l.vec_id, l.root, x.p, x.t FROM l JOIN @three x ON x.vec_id = l.vec_id AND abs(x.r - l.r) + abs(x.c - l.c) <= 3 WHERE NOT EXISTS (SELECT 1 FROM l i WHERE i.vec_id = l.vec_id AND i.root = l.root AND i.p = x.p)), "
    "y AS (SELECT vec_id, root, avg(t) AS outside FROM o GROUP BY vec_id, root), f AS (SELECT avg(t) AS normal FROM @three WHERE ref = 1), "
    "m AS (SELECT vec_id, root, count(*) AS n, any_value(fill) AS fill, max(t) AS peak, avg(t) AS mean, avg(q) AS mq, avg(a1) AS ma, avg(b1) AS m1, avg(b2) AS m2, max(v) AS pv, "
    "avg(CASE WHEN (t - 0.05) / 0.05 > 1 THEN 1e0 ELSE 0e0 END) AS over, median(greatest((t - 0.05) / 0.05, 0)) AS mid, least(min(r), 7 - max(r), min(c), 7 - max(c)) AS gap FROM l GROUP BY vec_id, root), "
    "e AS (SELECT m.vec_id, m.root, pv, " + _CLIP.replace("{x}", "0.5 * over + 0.5 * " + _CLIP.replace("{x}", "asinh(mid) / 3")) + " AS excess, "
    "CASE WHEN n < 4 OR peak <= 0 THEN 0 ELSE " + _CLIP.replace("{x}", "0.35 * " + _CLIP.replace("{x}", "(peak / greatest(mean, 0.00000001) - 1) / 3") + " + 0.35 * " + _CLIP.replace("{x}", "fill / 0.5")
    + " + 0.3 * CASE WHEN outside IS NULL THEN 0.5 WHEN outside > 0 THEN least(peak / outside, 5) / 5 ELSE 1 END") + " END AS stability, "
    + _CLIP.replace("{x}", _RATIO.replace("{a}", "mean").replace("{b}", "ma")) + " AS augmentation, "
    + _CLIP.replace("{x}", "1 - abs(m1 - m2) / 2 / greatest((m1 + m2) / 2, 0.00000001)") + " AS prompt, "
    "CASE WHEN mean <= {_L.signal} THEN 0 WHEN mq > {_L.signal} THEN 0.9 ELSE 0.3 END AS agreement, "
    + _CLIP.replace("{x}", "0.3 * " + _CLIP.replace("{x}", "1 - gap / 8.0 * 10") + " + 0.3 * " + _CLIP.replace("{x}", "n / 64.0 / 0.05") + " + 0.4 * " + _CLIP.replace("{x}", "1 - abs(mean / normal - 1)"))
    + " AS risk FROM m LEFT JOIN y ON y.vec_id = m.vec_id AND y.root = m.root CROSS JOIN f), "
    "er AS (SELECT *, 0.25 * excess + 0.15 * stability + 0.2 * augmentation + 0.2 * prompt + 0.2 * agreement AS reliability FROM e)"
)
_EVIDENCE = _put(_EVIDENCE)
_SIGNALS = ("excess", "stability", "augmentation", "prompt", "agreement", "reliability", "risk")


@frame(
    "reliability_evidence", "M17 R38 M11 M12 M13 M14 M15 M16",
    _EVIDENCE + " SELECT vec_id, CAST(root AS INT) AS root, " + ", ".join(f"@r({c}) AS {c}" for c in _SIGNALS) + ", @r(pv) AS peak FROM er",
)
def reliability_evidence(spark, sf_dir):
    cells, found = _found(spark, sf_dir)
    got = rescue.evidence(cells, found, KEYS, SHAPE, "t", limits=LIMITS, **_COLUMNS)
    return got.select("vec_id", "root", *[_r(F.col(c)).alias(c) for c in (*_SIGNALS, "peak")])


_REASON = (
    f"CASE WHEN reliability < {_L.reliability} THEN 'reliability_too_low' WHEN agreement < {_L.agreement} THEN 'branches_disagree' WHEN risk > {_L.background} THEN 'background_risk' "
    f"WHEN augmentation < {_L.augmentation} THEN 'augmentation_unstable' WHEN prompt < {_L.prompt} THEN 'prompts_disagree' WHEN pv < {_L.visual_low} THEN 'visual_confident_normal' "
    f"WHEN pv > {_L.visual_high} THEN 'visual_confident_anomaly' ELSE 'passed' END"
)
_BUDGET = int(64 * _L.rescue_share)
_DECIDED = _EVIDENCE + (
    f", d0 AS (SELECT er.vec_id, er.root, area, reliability, {_REASON} AS reason, (SELECT count(*) FROM l WHERE l.vec_id = er.vec_id AND l.root = er.root AND t > v) AS cells "
    "FROM er JOIN looks ON looks.vec_id = er.vec_id AND looks.root = er.root WHERE looks.reason = 'kept'), "
    "d1 AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY reliability DESC, root) AS place FROM d0), "
    "d2 AS (SELECT vec_id, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS root, CAST(0 AS BIGINT) AS used, '' AS reason, 0e0 AS allowed FROM d1 GROUP BY vec_id "
    f"UNION ALL SELECT d1.vec_id, d1.place, d1.root, d2.used + CASE WHEN d1.reason = 'passed' AND d2.used + area <= {_BUDGET} THEN cells ELSE 0 END, "
    f"CASE WHEN d1.reason <> 'passed' THEN d1.reason WHEN d2.used + area > {_BUDGET} THEN 'budget_clipped' WHEN cells = 0 THEN 'text_not_exceeding' ELSE 'rescue_applied' END, {_L.residual} * reliability "
    "FROM d2 JOIN d1 ON d1.vec_id = d2.vec_id AND d1.place = d2.place + 1)"
)


@frame(
    "staged_rescue", "R10 R11 R12",
    _DECIDED + ", u AS (SELECT l.vec_id, l.p, max_by(least(l.t - l.v, d2.allowed), d2.place) AS residual FROM d2 JOIN l ON l.vec_id = d2.vec_id AND l.root = d2.root WHERE d2.reason = 'rescue_applied' AND l.t > l.v GROUP BY l.vec_id, l.p) "
    "SELECT x.vec_id, x.p, @r(x.v + coalesce(residual, 0)) AS fused, @r(coalesce(residual, 0)) AS residual, CAST(residual IS NOT NULL AS INT) AS rescued FROM @three x LEFT JOIN u ON u.vec_id = x.vec_id AND u.p = x.p",
)
def staged_rescue(spark, sf_dir):
    fused = rescue.rescue(_cells(spark, sf_dir), KEYS, SHAPE, "v", "t", "q", LIMITS, **_COLUMNS)[0]
    return fused.select("vec_id", "p", _r(F.col("fused")).alias("fused"), _r(F.col("residual")).alias("residual"), F.col("rescued").cast("int").alias("rescued"))


@frame(
    "rescue_decisions", "R10 M10 R11 R12",
    _DECIDED + " SELECT vec_id, CAST(root AS INT) AS root, reason FROM d2 WHERE place > 0 UNION ALL SELECT vec_id, CAST(root AS INT), reason FROM looks WHERE reason <> 'kept'",
)
def rescue_decisions(spark, sf_dir):
    return rescue.rescue(_cells(spark, sf_dir), KEYS, SHAPE, "v", "t", "q", LIMITS, **_COLUMNS)[1].select("vec_id", "root", "reason")


SELECTIVE = rescue.Selective(gap=0.03, image_ambiguity=0.35, pixel_ambiguity=0.2, min_cells=2, max_share=0.1, images=True)
_IMAGES = "SELECT vec_id, max(v) AS visual, max(t) * (0.8 + (vec_id % 5) * 0.1) AS text, 0.3 + (vec_id % 7) * 0.1 AS visual_reliability, 0.2 + (vec_id % 4) * 0.2 AS text_reliability FROM @pair GROUP BY vec_id"
_S = SELECTIVE
_CHOSEN = (
    f"WITH RECURSIVE s AS (SELECT vec_id, p, r, c, t - v AS gap FROM @pair WHERE 0.3 + (p % 5) * 0.15 >= {_S.text_reliability} AND v <= {_S.pixel_ambiguity} AND t - v >= {_S.gap}), "
    "w AS (SELECT vec_id, p, p AS root FROM s UNION SELECT b.vec_id, b.p, w.root FROM w JOIN s x ON w.vec_id = x.vec_id AND w.p = x.p JOIN s b ON b.vec_id = x.vec_id AND abs(b.r - x.r) + abs(b.c - x.c) = 1 WHERE w.root < b.p), "
    "l AS (SELECT vec_id, p, min(root) AS root FROM w GROUP BY vec_id, p), "
    f"a AS (SELECT l.vec_id, l.p FROM l JOIN (SELECT vec_id, root FROM l GROUP BY vec_id, root HAVING count(*) BETWEEN {_S.min_cells} AND {int(64 * _S.max_share)}) k ON l.vec_id = k.vec_id AND l.root = k.root)"
)


def _selective(spark, sf_dir):
    cells = spark_sql(spark, sf_dir, "SELECT vec_id, p, r, c, v AS visual, t AS text, 0.3 + (p % 5) * 0.15 AS text_reliability FROM @pair")
    return rescue.selective_rescue(spark_sql(spark, sf_dir, _IMAGES), cells, KEYS, SHAPE, SELECTIVE)


@frame("selective_rescue_maps", "R09", _CHOSEN + f" SELECT x.vec_id, x.p, @r(v + CASE WHEN a.p IS NOT NULL THEN least(t - v, {_S.pixel_residual}) ELSE 0 END) AS fused, CAST(a.p IS NOT NULL AS INT) AS allowed FROM @pair x LEFT JOIN a ON a.vec_id = x.vec_id AND a.p = x.p")
def selective_rescue_maps(spark, sf_dir):
    return _selective(spark, sf_dir)[1].select("vec_id", "p", _r(F.col("fused")).alias("fused"), F.col("allowed").cast("int").alias("allowed"))


@frame(
    "selective_rescue_images", "R09",
    _CHOSEN + f", i AS ({_IMAGES}), j AS (SELECT i.*, CASE WHEN text_reliability >= {_S.text_reliability} AND abs(visual) <= {_S.image_ambiguity} AND text - visual >= {_S.gap} THEN least(text - visual, {_S.image_residual}) ELSE 0 END AS residual, "
    "EXISTS (SELECT 1 FROM a WHERE a.vec_id = i.vec_id) AS helped FROM i) "
    f"SELECT vec_id, @r(visual + residual) AS score, @r(residual) AS residual, CASE WHEN residual > 0 OR helped THEN 'text_rescue_applied' WHEN visual_reliability >= text_reliability AND abs(visual) > {_S.image_ambiguity} THEN 'visual_confident' "
    f"WHEN text_reliability < {_S.text_reliability} THEN 'text_ineligible' ELSE 'no_rescue_opportunity' END AS decision FROM j",
)
def selective_rescue_images(spark, sf_dir):
    return _selective(spark, sf_dir)[0].select("vec_id", _r(F.col("score")).alias("score"), _r(F.col("residual")).alias("residual"), "decision")
