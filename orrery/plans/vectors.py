"""Nearest-neighbour, vector, linear-algebra and selection queries over ``embeddings``."""

import numpy as np
from pyspark.sql import functions as F

from orrery.functions import vectors as fv
from orrery.operators import knn, linalg
from orrery.plans.kit import VIEWS, both, frame, table

VIEWS["b"] = ("SELECT vec_id, label, (vec_id // 5) % 4 AS ri, CAST(embedding AS DOUBLE[]) AS v FROM {embeddings} WHERE vec_id % 5 = 0", None)
VIEWS["q"] = ("SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM {embeddings} WHERE vec_id % 5 <> 0", None)
_D = "0.5 * power(list_distance({a}, {b}), 2)"


def _d(a="q.v", b="b.v"):
    return _D.replace("{a}", a).replace("{b}", b)


VIEWS["pairs"] = (f"SELECT q.vec_id AS qid, b.vec_id AS bid, q.label AS ql, b.label AS bl, b.ri, {_d()} AS d FROM @q q CROSS JOIN @b b", None)


def _r(x):
    return F.round(x, 6) + F.lit(0.0)


def _sides(spark, sf_dir, vec=None):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.expr("(vec_id div 5) % 4").alias("ri"), (vec if vec is not None else F.col("embedding")).alias("vec"))
    return rows.where("id % 5 <> 0"), rows.where("id % 5 = 0")


def _part(k):
    return F.slice("embedding", 32 * k + 1, 32)



@frame("knn_bank_score", "V01 V06 V07 V30 V43 J11", "SELECT qid AS vec_id, @r(min(d)) AS score FROM @pairs GROUP BY qid")
def knn_bank_score(spark, sf_dir):
    q, b = _sides(spark, sf_dir)
    return knn.knn_join(q, b).select(F.col("query").alias("vec_id"), _r(F.col("dist")).alias("score"))


@frame("exact_search_ties", "V45", "WITH ed AS (SELECT qid, bid, sqrt(2 * greatest(d, 0)) AS e FROM @pairs), m AS (SELECT qid, min(e) AS least FROM ed GROUP BY qid), bst AS (SELECT qid, bid, row_number() OVER (PARTITION BY qid ORDER BY round(e, 9), bid) AS k FROM ed) SELECT m.qid AS vec_id, any_value(bst.bid) AS bank, @r(any_value(least)) AS dist, CAST(sum(CASE WHEN e <= least + 0.03 THEN 1 ELSE 0 END) AS BIGINT) AS ties FROM m JOIN ed ON ed.qid = m.qid JOIN bst ON bst.qid = m.qid AND bst.k = 1 GROUP BY m.qid")
def exact_search_ties(spark, sf_dir):
    q, b = _sides(spark, sf_dir)
    return knn.nearest_with_ties(q, b, 0.03).select(F.col("query").alias("vec_id"), "bank", _r(F.col("dist")).alias("dist"), "ties")


_TOP = "SELECT qid, bid, d, bl, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), bid) AS k FROM @pairs"


@frame("knn_topk", "K02 K03 V26", f"SELECT qid AS vec_id, bid AS bank_id, CAST(k AS INT) AS place, @r(d) AS dist FROM ({_TOP}) t WHERE k <= 5")
def knn_topk(spark, sf_dir):
    q, b = _sides(spark, sf_dir)
    return knn.knn_join(q, b, 5).select(F.col("query").alias("vec_id"), F.col("bank").alias("bank_id"), "place", _r(F.col("dist")).alias("dist"))


_HALF = "(SELECT vec_id, list_transform(v[{s}], lambda x: x / sqrt(list_dot_product(v[{s}], v[{s}]))) AS v FROM @{t})"
_FUSE = "SELECT vec_id, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS v FROM (SELECT vec_id, list_concat(list_transform(v[1:32], lambda x: 0.5 * x / sqrt(list_dot_product(v[1:32], v[1:32]))), list_transform(v[33:64], lambda x: 0.5 * x / sqrt(list_dot_product(v[33:64], v[33:64])))) AS w FROM @{t}) u"


@frame("knn_fused_concat", "V03 V04 V09 J06", f"SELECT q.vec_id, @r(min({_d()})) AS score FROM ({_FUSE.replace('{t}', 'q')}) q CROSS JOIN ({_FUSE.replace('{t}', 'b')}) b GROUP BY q.vec_id")
def knn_fused_concat(spark, sf_dir):
    q, b = _sides(spark, sf_dir, fv.fused(_part(0), _part(1)))
    return knn.knn_join(q, b).select(F.col("query").alias("vec_id"), _r(F.col("dist")).alias("score"))


@frame("knn_per_category", "V04 O04", "SELECT qid AS vec_id, @r(min(d)) AS score FROM @pairs WHERE ql = bl GROUP BY qid")
def knn_per_category(spark, sf_dir):
    q, b = _sides(spark, sf_dir)
    return knn.knn_join(q, b, same="label").select(F.col("query").alias("vec_id"), _r(F.col("dist")).alias("score"))


_PER = "SELECT qid, ri, min(d) AS d FROM @pairs GROUP BY qid, ri"


def _per_reference(spark, sf_dir):
    q, b = _sides(spark, sf_dir)
    return knn.nearest_per(q, b, "ri").withColumn("ri", F.col("ri").cast("int"))


@frame("knn_per_reference", "V12 V14 V15", f"SELECT qid AS vec_id, CAST(ri AS INT) AS ref_image, @r(d) AS dist FROM ({_PER}) t")
def knn_per_reference(spark, sf_dir):
    return _per_reference(spark, sf_dir).select(F.col("query").alias("vec_id"), F.col("ri").alias("ref_image"), _r(F.col("dist")).alias("dist"))


@frame("knn_agreement", "V12 V16 V17 V18 V19 G32", f"WITH p AS ({_PER}), m AS (SELECT qid, median(d) AS md, min(d) AS lo FROM p GROUP BY qid) SELECT p.qid AS vec_id, @r(any_value(lo)) AS pooled, @r(any_value(lo) + 0.5 * greatest(0, any_value(md) - any_value(lo))) AS score_gap, @r(median(abs(d - md))) AS mad FROM p JOIN m ON p.qid = m.qid GROUP BY p.qid")
def knn_agreement(spark, sf_dir):
    p = _per_reference(spark, sf_dir)
    m = p.groupBy("query").agg(F.sort_array(F.collect_list("dist")).alias("a"))
    med = lambda a: (F.element_at(a, 2) + F.element_at(a, 3)) / 2
    m = m.withColumn("lo", F.array_min("a")).withColumn("md", med(F.col("a"))).withColumn("dev", F.sort_array(F.transform("a", lambda x: F.abs(x - F.col("md")))))
    return m.select(F.col("query").alias("vec_id"), _r(F.col("lo")).alias("pooled"), _r(F.col("lo") + 0.5 * F.greatest(F.lit(0.0), F.col("md") - F.col("lo"))).alias("score_gap"), _r(med(F.col("dev"))).alias("mad"))


_LOO = f"SELECT x.vec_id, min({_d('x.v', 'y.v')}) AS d FROM @b x JOIN @b y ON x.ri <> y.ri GROUP BY x.vec_id"


def _loo(spark, sf_dir, k=1):
    _, b = _sides(spark, sf_dir)
    return knn.knn_join(b, b, k, other="ri")


@frame("knn_loo_theta", "V11 V44 V55 J17 J18 J25", f"SELECT @r(@q(d; 0.95)) AS theta, CAST(count(*) AS BIGINT) AS n FROM ({_LOO}) t")
def knn_loo_theta(spark, sf_dir):
    return _loo(spark, sf_dir).agg(_r(F.percentile("dist", 0.95)).alias("theta"), F.count("*").alias("n"))


@frame("knn_conditional", "V10", f"WITH t AS (SELECT q.vec_id AS qid, {_d('q.v[33:64]', 'b.v[33:64]')} AS dc, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_d('q.v[1:32]', 'b.v[1:32]')}, 9), b.vec_id) AS k FROM @q q CROSS JOIN @b b) SELECT qid AS vec_id, @r(min(dc)) AS score FROM t WHERE k <= 5 GROUP BY qid")
def knn_conditional(spark, sf_dir):
    q, b = _sides(spark, sf_dir, _part(0))
    near = knn.knn_join(q, b, 5)
    q2, b2 = _sides(spark, sf_dir, _part(1))
    met = near.join(q2.select(F.col("id").alias("query"), F.col("vec").alias("qv")), "query").join(b2.select(F.col("id").alias("bank"), F.col("vec").alias("bv")), "bank")
    return met.groupBy(F.col("query").alias("vec_id")).agg(_r(F.min(0.5 * fv.sq_l2(F.col("qv"), F.col("bv")))).alias("score"))


@frame("knn_mutual_pairs", "J15 J16 V41", "WITH f AS (SELECT qid, bid, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), bid) AS k, row_number() OVER (PARTITION BY bid ORDER BY round(d, 9), qid) AS j FROM @pairs) SELECT qid AS vec_id, bid AS bank_id FROM f WHERE k = 1 AND j = 1")
def knn_mutual_pairs(spark, sf_dir):
    q, b = _sides(spark, sf_dir)
    return knn.mutual(knn.knn_join(q, b), knn.knn_join(b, q)).select(F.col("query").alias("vec_id"), F.col("bank").alias("bank_id"))


@frame("knn_band_window", "J12 J13 J14", "WITH w AS (SELECT qid, min(CASE WHEN abs(qid % 8 - bid % 8) <= 1 AND abs((qid // 8) % 8 - (bid // 8) % 8) <= 1 THEN d END) AS dw, min(d) AS dg FROM @pairs GROUP BY qid) SELECT qid AS vec_id, @r(coalesce(dw, dg)) AS score, CASE WHEN dw IS NULL THEN 1 ELSE 0 END AS fell_back FROM w")
def knn_band_window(spark, sf_dir):
    place = lambda df: df.withColumn("row", F.expr("(id div 8) % 8")).withColumn("col", F.expr("id % 8"))
    q, b = _sides(spark, sf_dir)
    got = knn.banded(place(q), place(b))
    return got.select(F.col("id").alias("vec_id"), _r(F.coalesce("dw", "dg")).alias("score"), F.col("dw").isNull().cast("int").alias("fell_back"))


@frame("knn_position_locked", "V40b J09", "SELECT qid AS vec_id, @r(min(d)) AS score FROM @pairs WHERE qid % 8 = bid % 8 AND (qid // 8) % 8 = (bid // 8) % 8 GROUP BY qid")
def knn_position_locked(spark, sf_dir):
    place = lambda df: df.withColumn("row", F.expr("(id div 8) % 8")).withColumn("col", F.expr("id % 8"))
    q, b = _sides(spark, sf_dir)
    return knn.position_locked(place(q), place(b)).select(F.col("id").alias("vec_id"), _r(F.col("dist")).alias("score"))


@frame("knn_l1", "V40", "SELECT q.vec_id, @r(min(list_sum(list_transform(list_zip(q.v, b.v), lambda z: abs(z[1] - z[2]))))) AS score FROM @q q CROSS JOIN @b b GROUP BY q.vec_id")
def knn_l1(spark, sf_dir):
    q, b = _sides(spark, sf_dir)
    return knn.knn_join(q, b, metric="l1").select(F.col("query").alias("vec_id"), _r(F.col("dist")).alias("score"))


@frame("knn_chebyshev", "V40", "SELECT q.vec_id, @r(min(list_max(list_transform(list_zip(q.v, b.v), lambda z: abs(z[1] - z[2]))))) AS score FROM @q q CROSS JOIN @b b GROUP BY q.vec_id")
def knn_chebyshev(spark, sf_dir):
    q, b = _sides(spark, sf_dir)
    return knn.knn_join(q, b, metric="chebyshev").select(F.col("query").alias("vec_id"), _r(F.col("dist")).alias("score"))


@frame("knn_weighted_bank", "V35", "SELECT qid AS vec_id, @r(min(d + 0.1 * ri)) AS score FROM @pairs GROUP BY qid")
def knn_weighted_bank(spark, sf_dir):
    q, b = _sides(spark, sf_dir)
    return knn.knn_join(q, b.withColumn("w", F.col("ri")), weight=0.1).select(F.col("query").alias("vec_id"), _r(F.col("dist")).alias("score"))


@frame("knn_gap_ratio", "K04 V36 V39", f"SELECT qid AS vec_id, @r(max(CASE WHEN k = 2 THEN d END) - max(CASE WHEN k = 1 THEN d END)) AS gap, @r(max(CASE WHEN k = 1 THEN d END) / max(CASE WHEN k = 2 THEN d END)) AS ratio FROM ({_TOP}) t WHERE k <= 2 GROUP BY qid")
def knn_gap_ratio(spark, sf_dir):
    q, b = _sides(spark, sf_dir)
    two = knn.knn_join(q, b, 2).groupBy(F.col("query").alias("vec_id")).agg(F.min("dist").alias("a"), F.max("dist").alias("b"))
    return two.select("vec_id", _r(F.col("b") - F.col("a")).alias("gap"), _r(F.col("a") / F.col("b")).alias("ratio"))


_RHO = f"SELECT vec_id, median(d) AS rho FROM (SELECT x.vec_id, {_d('x.v', 'y.v')} AS d, row_number() OVER (PARTITION BY x.vec_id ORDER BY round({_d('x.v', 'y.v')}, 9), y.vec_id) AS k FROM @b x JOIN @b y ON x.ri <> y.ri) u WHERE k <= 5 GROUP BY vec_id"


@frame("local_density_ratio", "V20 V21 W08", f"WITH r AS ({_RHO}) SELECT qid AS vec_id, @r(median(d / (rho + 0.000001))) AS score FROM ({_TOP}) t JOIN r ON t.bid = r.vec_id WHERE k <= 5 GROUP BY qid")
def local_density_ratio(spark, sf_dir):
    q, b = _sides(spark, sf_dir)
    rho = _loo(spark, sf_dir, 5).groupBy(F.col("query").alias("bank")).agg(F.median("dist").alias("rho"))
    return knn.knn_join(q, b, 5).join(rho, "bank").groupBy(F.col("query").alias("vec_id")).agg(_r(F.median(F.col("dist") / (F.col("rho") + 1e-6))).alias("score"))


@frame("band_mean_k5", "V34", f"SELECT qid AS vec_id, @r(avg(d)) AS score FROM ({_TOP}) t WHERE k <= 5 GROUP BY qid")
def band_mean_k5(spark, sf_dir):
    q, b = _sides(spark, sf_dir)
    return knn.knn_join(q, b, 5).groupBy(F.col("query").alias("vec_id")).agg(_r(F.avg("dist")).alias("score"))


@frame("bank_union_growth", "U09 V38 A13", f"SELECT q.vec_id, @r(min({_d('q.v', 'x.v')})) AS score FROM @q q JOIN (SELECT vec_id, v FROM @b UNION ALL SELECT vec_id, v FROM @q WHERE vec_id % 5 = 1) x ON x.vec_id <> q.vec_id GROUP BY q.vec_id")
def bank_union_growth(spark, sf_dir):
    q, b = _sides(spark, sf_dir)
    own = lambda df: df.withColumn("own", F.col("id"))
    return knn.knn_join(own(q), own(b.union(q.where("id % 5 = 1"))), other="own").select(F.col("query").alias("vec_id"), _r(F.col("dist")).alias("score"))


@frame("bank_compactness", "V48 V49", f"WITH t AS (SELECT x.vec_id, {_d('x.v', 'y.v')} AS d, row_number() OVER (PARTITION BY x.vec_id ORDER BY round({_d('x.v', 'y.v')}, 9), y.vec_id) AS k FROM @b x JOIN @b y ON x.vec_id <> y.vec_id) SELECT @r(avg(2 * d)) AS compactness, CASE WHEN avg(2 * d) < 0.5 THEN 'tight' ELSE 'loose' END AS kind FROM t WHERE k = 1")
def bank_compactness(spark, sf_dir):
    _, b = _sides(spark, sf_dir)
    own = b.withColumn("own", F.col("id"))
    mean = F.avg(2 * F.col("dist"))
    return knn.knn_join(own, own, other="own").agg(_r(mean).alias("compactness"), F.when(mean < 0.5, "tight").otherwise("loose").alias("kind"))


_CELL = "(vec_id // 64) * 16 + (vec_id // 16 % 4) * 4 + vec_id % 8 // 2"
_MID = (
    "WITH pr AS (SELECT a.vec_id AS i1, b.vec_id AS i2, unnest(range(64)) AS p, unnest(a.v) AS x, unnest(b.v) AS y FROM @b a JOIN @b b ON a.label = b.label AND a.vec_id < b.vec_id AND (a.vec_id * 7919 + b.vec_id) % 13 = 0), "
    "nm AS (SELECT i1, i2, sqrt(sum(power((x + y) / 2, 2))) AS n FROM pr GROUP BY i1, i2), "
    "md AS (SELECT list((x + y) / 2 / n ORDER BY p) AS v FROM pr JOIN nm ON pr.i1 = nm.i1 AND pr.i2 = nm.i2 GROUP BY pr.i1, pr.i2), "
    f"fine AS (SELECT q.vec_id, min({_d('q.v', 'x.v')}) AS d FROM @q q CROSS JOIN (SELECT v FROM @b UNION ALL SELECT v FROM md) x GROUP BY q.vec_id), "
    f"pool AS (SELECT vec_id % 5 = 0 AS ref, {_CELL} AS cell, p, avg(x) AS x FROM @dims GROUP BY vec_id % 5 = 0, {_CELL}, p), "
    "pn AS (SELECT ref, cell, list(x ORDER BY p) AS v0, sqrt(sum(x * x)) AS n FROM pool GROUP BY ref, cell), "
    "pv AS (SELECT pool.ref, pool.cell, list(x / n ORDER BY p) AS v FROM pool JOIN pn ON pool.ref = pn.ref AND pool.cell = pn.cell GROUP BY pool.ref, pool.cell), "
    f"coarse AS (SELECT q.cell, min({_d('q.v', 'x.v')}) AS d FROM pv q JOIN pv x ON NOT q.ref AND x.ref GROUP BY q.cell) "
    f"SELECT f.vec_id, @r(least(f.d, c.d)) AS score FROM (SELECT vec_id, d, {_CELL} AS cell FROM fine) f JOIN coarse c ON f.cell = c.cell"
).replace("list(x ORDER BY p) AS v0, ", "")


@frame("midpoint_bank_score", "", _MID)
def midpoint_bank_score(spark, sf_dir):
    """Smaller of the distances to a bank densified by midpoints, and on the grid of 2 x 2 pooled positions (images of
    8 x 8 consecutive ids)."""
    q, b = _sides(spark, sf_dir, F.col("embedding").cast("array<double>"))
    unit = lambda v: F.expr(f"transform({v}, x -> x / sqrt(aggregate({v}, 0D, (s, y) -> s + y * y)))")
    # (i1 * 7919 + i2) % 13 = 0 says that i1 and 6 * i2 leave the same remainder by 13, as 7919 leaves 2, and 2 * 6 is -1.
    left = lambda x: F.when(F.col("label").isNotNull(), F.struct("label", F.pmod(x, F.lit(13)).alias("k")))
    keyed = b.select("id", "vec", left(F.col("id")).alias("first"), left(6 * F.pmod("id", F.lit(13))).alias("second"))
    fine = knn.nearest_midpoint(q, keyed, "first", "second").select(F.col("query").alias("vec_id"), F.col("dist").alias("fine"))
    cell = lambda name: F.expr(_CELL.replace("vec_id", name).replace("//", "div"))

    def pooled(side):
        whole = side.groupBy(cell("id").alias("id")).agg(F.collect_list("vec").alias("of"))
        mean = F.expr("transform(sequence(0, size(of[0]) - 1), p -> aggregate(of, 0D, (s, v) -> s + v[p]) / size(of))")
        return whole.select("id", mean.alias("m")).select("id", unit("m").alias("vec"))

    coarse = knn.nearest(pooled(q), pooled(b)).select(F.col("query").alias("cell"), F.col("dist").alias("coarse"))
    return fine.join(coarse, cell("vec_id") == F.col("cell")).select("vec_id", _r(F.least("fine", "coarse")).alias("score"))


both("centroid_distance", "V37 V57", "WITH c AS (SELECT label, p, avg(x) AS m FROM @dims WHERE vec_id % 5 = 0 GROUP BY label, p) SELECT d.vec_id, @r(sum((d.x - c.m) * (d.x - c.m))) AS dist FROM @dims d JOIN c ON d.label = c.label AND d.p = c.p WHERE d.vec_id % 5 <> 0 GROUP BY d.vec_id")
both("prototype_mean", "V57 V02", "WITH m AS (SELECT label, p, avg(x) AS m FROM @dims GROUP BY label, p) SELECT label, p, @r(m / sqrt(sum(m * m) OVER (PARTITION BY label))) AS v FROM m".replace("SELECT label, p, @r", "SELECT label, CAST(p AS INT) AS p, @r"))
both("channel_standardised", "B15 V33", "WITH q AS (SELECT p, median(x) AS med FROM @dims WHERE vec_id % 5 = 0 GROUP BY p), d AS (SELECT q.p, any_value(med) AS med, median(abs(x - med)) AS mad FROM @dims x JOIN q ON x.p = q.p WHERE vec_id % 5 = 0 GROUP BY q.p) SELECT vec_id, @r(sqrt(sum(power((x - med) / greatest(mad, 0.000001), 2)))) AS energy FROM @dims x JOIN d ON x.p = d.p WHERE vec_id % 5 <> 0 GROUP BY vec_id")
both("channel_topk_select", "K13 C15", "SELECT CAST(p AS INT) AS channel, @r(sd) AS sd FROM (SELECT p, stddev_pop(x) AS sd, row_number() OVER (ORDER BY round(stddev_pop(x), 9) DESC, p) AS k FROM @dims GROUP BY p) t WHERE k <= 8")
both("int8_quantise_error", "C10", "WITH s AS (SELECT vec_id, max(abs(x)) / 127.0 AS sc FROM @dims GROUP BY vec_id) SELECT d.vec_id, @r(sqrt(sum(power(x - @even(x / sc) * sc, 2)))) AS err FROM @dims d JOIN s ON d.vec_id = s.vec_id GROUP BY d.vec_id".replace("@even(x / sc)", "bround(x / sc, 0)"), "WITH s AS (SELECT vec_id, max(abs(x)) / 127.0 AS sc FROM @dims GROUP BY vec_id) SELECT d.vec_id, @r(sqrt(sum(power(x - round_even(x / sc, 0) * sc, 2)))) AS err FROM @dims d JOIN s ON d.vec_id = s.vec_id GROUP BY d.vec_id")
both("checkerboard_coreset", "C04 C05", "SELECT vec_id FROM {embeddings} WHERE vec_id % 5 = 0 AND ((vec_id // 8) % 8 + vec_id % 8) % 2 = 0")


@frame("citation_coreset", "C05", f"WITH t AS (SELECT x.vec_id, y.vec_id AS cited, row_number() OVER (PARTITION BY x.vec_id ORDER BY round({_d('x.v', 'y.v')}, 9), y.vec_id) AS k FROM @b x JOIN @b y ON x.vec_id <> y.vec_id) SELECT cited AS vec_id, CAST(count(*) AS BIGINT) AS citations FROM t WHERE k = 1 GROUP BY cited")
def citation_coreset(spark, sf_dir):
    _, b = _sides(spark, sf_dir)
    own = b.withColumn("own", F.col("id"))
    return knn.knn_join(own, own, other="own").groupBy(F.col("bank").alias("vec_id")).agg(F.count("*").alias("citations"))


def _cov(n, total, gram):
    return gram / n - np.outer(total / n, total / n)


def _corr(n, total, gram):
    c = _cov(n, total, gram)
    sd = np.sqrt(np.diag(c))
    return c / np.outer(sd, sd)


_ALL = "SELECT CAST(a.p AS INT) AS {i}, CAST(b.p AS INT) AS {j}, @r({f}) AS {v} FROM @dims a JOIN @dims b ON a.vec_id = b.vec_id AND a.p {op} b.p GROUP BY a.p, b.p"


def _over_all(name, operators, i, j, v, f, diagonal, value):
    """The query over every pair of dimensions, by one Gram matrix a partition."""
    text = _ALL.replace("{i}", i).replace("{j}", j).replace("{v}", v).replace("{f}", f).replace("{op}", "<=" if diagonal else "<")

    @frame(name, operators, text)
    def run(spark, sf_dir):
        n, total, gram = linalg.moments(table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("vec")))
        m = value(n, total, gram)
        rows = [(a, b, float(m[a, b])) for a in range(len(m)) for b in range(a if diagonal else a + 1, len(m))]
        return spark.createDataFrame(rows, f"{i} int, {j} int, {v} double").withColumn(v, _r(F.col(v)))


_over_all("gram_matrix_all", "L01 L12", "i", "j", "g", "sum(a.x * b.x)", True, lambda n, total, gram: gram)
_over_all("covariance_all", "L03 L05", "i", "j", "cov", "covar_pop(a.x, b.x)", True, _cov)
_over_all("channel_corr_all", "C16 C19", "c1", "c2", "rho", "corr(a.x, b.x)", False, _corr)
both("joint_histogram_surprise", "L20 L21", "WITH u AS (SELECT vec_id, CAST(least(floor(8 * cume_dist() OVER (ORDER BY peak)), 7) AS INT) AS i, CAST(least(floor(8 * cume_dist() OVER (ORDER BY mean)), 7) AS INT) AS j FROM @img), h AS (SELECT i, j, (count(*) + 1 / 64.0) AS n FROM u GROUP BY i, j), t AS (SELECT sum(n) AS n FROM h), a AS (SELECT i, sum(n) AS n FROM h GROUP BY i), b AS (SELECT j, sum(n) AS n FROM h GROUP BY j) SELECT u.vec_id, @r(greatest(0, ln(CAST(a.n AS DOUBLE) * b.n / (CAST(t.n AS DOUBLE) * h.n)))) AS surprise FROM u JOIN h ON u.i = h.i AND u.j = h.j JOIN a ON u.i = a.i JOIN b ON u.j = b.j CROSS JOIN t")
both("attention_context", "L07", "WITH w AS (SELECT a.vec_id, a.p, exp(a.s * b.s / 0.1) AS w, b.s FROM @cells a JOIN @cells b ON a.vec_id = b.vec_id AND a.r = b.r) SELECT vec_id, p, @r(sum(w * s) / sum(w)) AS v FROM w GROUP BY vec_id, p")
both("sinkhorn_cost", "L14", "WITH a AS (SELECT label AS i, avg(peak) AS x FROM @img GROUP BY label), b AS (SELECT label AS j, avg(mean) AS y FROM @img GROUP BY label), c AS (SELECT i, j, abs(x - y) AS c, exp(-abs(x - y) / 0.05) AS k FROM a CROSS JOIN b), u1 AS (SELECT i, 0.1 / sum(k) AS u FROM c GROUP BY i), v1 AS (SELECT j, 0.1 / sum(k * u) AS v FROM c JOIN u1 ON c.i = u1.i GROUP BY j), u2 AS (SELECT i, 0.1 / sum(k * v) AS u FROM c JOIN v1 ON c.j = v1.j GROUP BY i), v2 AS (SELECT j, 0.1 / sum(k * u) AS v FROM c JOIN u2 ON c.i = u2.i GROUP BY j) SELECT @r(sum(u * k * v * c)) AS cost FROM c JOIN u2 ON c.i = u2.i JOIN v2 ON c.j = v2.j".replace("SELECT i, 0.1", "SELECT c.i AS i, 0.1").replace("SELECT j, 0.1", "SELECT c.j AS j, 0.1").replace("GROUP BY i)", "GROUP BY c.i)").replace("GROUP BY j)", "GROUP BY c.j)").replace("(SELECT label AS i, avg(peak) AS x FROM @img GROUP BY label)", "(SELECT label AS i, avg(peak) AS x FROM @img GROUP BY label)"))


@frame("pivot_pruned_knn", "V46 V47 C01 C02", "SELECT qid AS vec_id, @r(min(d)) AS score FROM @pairs GROUP BY qid")
def pivot_pruned_knn(spark, sf_dir):
    q, b = _sides(spark, sf_dir)
    return linalg.pivot_knn(q, b, 8).select(F.col("query").alias("vec_id"), _r(F.col("dist")).alias("score"))


@frame("pca_residual", "L01 L02 L03 L10 L11")
def pca_residual(spark, sf_dir):
    q, b = _sides(spark, sf_dir)
    return linalg.pca_residual(b, q, 0.9).select(F.col("id").alias("vec_id"), _r(F.col("residual")).alias("residual"))


@frame("ridge_residual", "L12 L13")
def ridge_residual(spark, sf_dir):
    q, b = _sides(spark, sf_dir)
    return linalg.ridge_residual(b, q, 32, 1.0).select(F.col("id").alias("vec_id"), _r(F.col("residual")).alias("residual"))


@frame("cca_fuse", "L04 L05 L08")
def cca_fuse(spark, sf_dir):
    q, b = _sides(spark, sf_dir)
    return linalg.shared_subspace(b, q, 32, 8).select(F.col("id").alias("vec_id"), _r(F.col("alignment")).alias("alignment"))


@frame("kmeans_parts", "L22 L24")
def kmeans_parts(spark, sf_dir):
    q, b = _sides(spark, sf_dir)
    return linalg.kmeans(b, q, 8).select(F.col("id").alias("vec_id"), "part", _r(F.col("dist")).alias("dist"))


@frame("farthest_first", "C01 C02 V47")
def farthest_first(spark, sf_dir):
    _, b = _sides(spark, sf_dir)
    return linalg.farthest_first(b, 16)


@frame("local_linear_residual", "V50 V51")
def local_linear_residual(spark, sf_dir):
    q, b = _sides(spark, sf_dir)
    return linalg.local_linear(q, b, 8, 0.01).select(F.col("id").alias("vec_id"), _r(F.col("residual")).alias("residual"))


@frame("logistic_probe", "L25 L33")
def logistic_probe(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("id"), F.array(F.log1p("n_chars"), F.length("text") / 1000.0).alias("vec"), F.col("quality").alias("y"))
    return linalg.logistic(rows).select(F.col("id").alias("doc_id"), _r(F.col("p")).alias("p"))
