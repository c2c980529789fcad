"""Aggregations, windows, sets and gates over scores and labels."""

from pyspark.sql import functions as F

from orrery.operators import metrics
from orrery.plans.kit import both, frame, spark_sql


def _r6(c):
    return F.round(c, 6) + F.lit(0.0)


both("macro_mean", "G01 G02", "SELECT seed, shot, @r(avg(m)) AS macro_score, CAST(count(*) AS BIGINT) AS n_categories FROM (SELECT cat, seed, shot, avg(vis) AS m FROM @ev GROUP BY cat, seed, shot) t GROUP BY seed, shot")
both("group_mean_std", "G03 G04 G05", "SELECT cat, shot, @r(avg(vis)) AS mean_score, @r(stddev_pop(vis)) AS sd_pop, @r(stddev_samp(vis)) AS sd_samp, @r(min(vis)) AS lo, @r(max(vis)) AS hi FROM @ev GROUP BY cat, shot")
both("pivot_shot_metric", "G06 G07", "SELECT cat, @r(avg(CASE WHEN shot = 1 THEN vis END)) AS shot1, @r(avg(CASE WHEN shot = 2 THEN vis END)) AS shot2, @r(avg(CASE WHEN shot = 4 THEN vis END)) AS shot4 FROM @ev GROUP BY cat")
both("grouping_sets_report", "G08 G10", "SELECT coalesce(cat, 'all') AS cat, coalesce(CAST(shot AS INT), -1) AS shot, @r(avg(vis)) AS mean_score, CAST(count(*) AS BIGINT) AS n FROM @ev GROUP BY GROUPING SETS ((cat, shot), (cat), (shot), ())")
both("value_counts_routes", "G19", "SELECT cat, CASE WHEN zv > 3 THEN 'visual' WHEN zt > 3 THEN 'text' ELSE 'none' END AS route, CAST(count(*) AS BIGINT) AS n FROM @z GROUP BY 1, 2")
both("describe_stats", "G24 G25", "SELECT cat, CAST(count(*) AS BIGINT) AS n, @r(avg(vis)) AS mean_v, @r(stddev_samp(vis)) AS sd, @r(min(vis)) AS lo, @r(@q(vis; 0.25)) AS q1, @r(median(vis)) AS med, @r(@q(vis; 0.75)) AS q3, @r(max(vis)) AS hi FROM @ev GROUP BY cat")
both("score_separation", "G27", "SELECT lang, @r(avg(CASE WHEN y = 1 THEN s END) - avg(CASE WHEN y = 0 THEN s END)) AS gap, @r((avg(CASE WHEN y = 1 THEN s END) - avg(CASE WHEN y = 0 THEN s END)) / nullif(sqrt((var_pop(CASE WHEN y = 1 THEN s END) + var_pop(CASE WHEN y = 0 THEN s END)) / 2), 0)) AS effect FROM @doc GROUP BY lang")
both("augmentation_consistency", "G12", "SELECT cat, @r(avg(sd)) AS mean_sd, @r(max(sd)) AS worst_sd FROM (SELECT cat, user_id, stddev_pop(vis) AS sd FROM @ev GROUP BY cat, user_id HAVING count(*) >= 2) t GROUP BY cat")
both("shot_sensitivity", "G13", "SELECT cat, @r(max(m) - min(m)) AS spread FROM (SELECT cat, shot, avg(vis) AS m FROM @ev GROUP BY cat, shot) t GROUP BY cat")
both("macro_null_policy", "G38", "SELECT seed, @r(avg(m)) AS mean_without_null, @r(avg(coalesce(m, 0))) AS mean_null_as_zero, CAST(count(*) - count(m) AS BIGINT) AS undefined FROM (SELECT cat, seed, CASE WHEN count(*) % 7 = 0 THEN NULL ELSE avg(vis) END AS m FROM @ev GROUP BY cat, seed) t GROUP BY seed")
both("weight_scan_summary", "G39", "SELECT w, @r(avg(m)) AS mean_score, CAST(row_number() OVER (ORDER BY round(avg(m), 6) DESC, w) AS BIGINT) AS place FROM (SELECT cat, w, avg(w * zv + (1 - w) * zt) AS m FROM @z CROSS JOIN (SELECT 0.0 AS w UNION ALL SELECT 0.25 UNION ALL SELECT 0.5 UNION ALL SELECT 0.75 UNION ALL SELECT 1.0) g GROUP BY cat, w) t GROUP BY w".replace("SELECT w, @r", "SELECT CAST(w AS DOUBLE) AS w, @r"))
both("registry_audit", "Q11", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(DISTINCT url) AS BIGINT) AS duplicate_urls, CAST(sum(CASE WHEN length(html) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty_pages FROM {pages}")

both("average_rank", "W01", "SELECT cat, @r(avg(rk)) AS mean_rank, @r(max(rk)) AS worst_rank FROM (SELECT cat, rank() OVER (PARTITION BY shot ORDER BY vis) + (count(*) OVER (PARTITION BY shot, vis) - 1) / 2.0 AS rk FROM @ev) t GROUP BY cat")
both("spearman", "W02 W03", "SELECT cat, @r(corr(ra, rb)) AS rho FROM (SELECT cat, CAST(rank() OVER (PARTITION BY cat ORDER BY vis) + (count(*) OVER (PARTITION BY cat, vis) - 1) / 2.0 AS DOUBLE) AS ra, CAST(rank() OVER (PARTITION BY cat ORDER BY user_id) + (count(*) OVER (PARTITION BY cat, user_id) - 1) / 2.0 AS DOUBLE) AS rb FROM @ev) t GROUP BY cat")
both("rank_copula", "W06", "SELECT event_id, @r((u + w) / 2) AS score FROM (SELECT event_id, (rank() OVER (PARTITION BY cat ORDER BY vis) - 0.5) / count(*) OVER (PARTITION BY cat) AS u, (rank() OVER (PARTITION BY cat ORDER BY user_id) - 0.5) / count(*) OVER (PARTITION BY cat) AS w FROM @ev) t")
both("percentile_rank_risk", "W04", "SELECT event_id, @r(cume_dist() OVER (PARTITION BY cat ORDER BY vis)) AS pct, @r(percent_rank() OVER (PARTITION BY cat ORDER BY vis)) AS rel FROM @ev")
both("kendall_tau", "H04", "SELECT label, @r(CAST(sum(sign(a1 - a2) * sign(b1 - b2)) AS DOUBLE) / count(*)) AS tau FROM (SELECT x.label, x.peak AS a1, y.peak AS a2, x.mean AS b1, y.mean AS b2 FROM @img x JOIN @img y ON x.label = y.label AND x.vec_id < y.vec_id) t GROUP BY label")
both("tail_neglog_p", "W10 W11", "SELECT event_id, @r(-ln((1 + at_least) / CAST(n + 1 AS DOUBLE))) AS neglog_p FROM (SELECT event_id, ref, sum(ref) OVER (PARTITION BY cat ORDER BY vis DESC) AS at_least, sum(ref) OVER (PARTITION BY cat) AS n FROM @ev) t WHERE ref = 0")
both("depth_slope", "W15", "SELECT cat, user_id, @r(regr_slope(vis, CAST(k AS DOUBLE))) AS slope FROM (SELECT cat, user_id, vis, row_number() OVER (PARTITION BY cat, user_id ORDER BY event_id) AS k FROM @ev) t GROUP BY cat, user_id HAVING count(*) >= 3")
both("second_difference", "W16", "SELECT event_id, @r(lead(vis) OVER w - 2 * vis + lag(vis) OVER w) AS d2 FROM @ev WINDOW w AS (PARTITION BY cat, user_id ORDER BY event_id)")
@frame("risk_coverage", "W20 E18", "SELECT k, @r(k / CAST(n AS DOUBLE)) AS coverage, @r(wrong / CAST(k AS DOUBLE)) AS risk FROM (SELECT CAST(row_number() OVER (ORDER BY s DESC, doc_id) AS BIGINT) AS k, CAST(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) OVER (ORDER BY s DESC, doc_id) AS BIGINT) AS wrong, count(*) OVER () AS n FROM @doc) t")
def risk_coverage(spark, sf_dir):
    own = spark_sql(spark, sf_dir, "SELECT doc_id, CAST(s AS DOUBLE) AS s, CAST(1 AS BIGINT) AS one, CAST(CASE WHEN y = 0 THEN 1 ELSE 0 END AS BIGINT) AS bad FROM @doc")
    got = metrics.running(own, [], [F.col("s").desc(), F.col("doc_id")], "s", {"k": "one", "wrong": "bad"})
    return got.select("k", F.round(F.col("k") / F.col("all_k"), 6).alias("coverage"), F.round(F.col("wrong") / F.col("k"), 6).alias("risk"))
both("ecdf_interpolate", "W13 W14", "WITH k AS (SELECT cat, vis, event_id, ref, sum(ref) OVER (PARTITION BY cat ORDER BY vis) / CAST(sum(ref) OVER (PARTITION BY cat) AS DOUBLE) AS f FROM @ev), n AS (SELECT event_id, ref, vis, max(CASE WHEN ref = 1 THEN vis END) OVER a AS x1, max(CASE WHEN ref = 1 THEN f END) OVER a AS f1, min(CASE WHEN ref = 1 THEN vis END) OVER b AS x2, min(CASE WHEN ref = 1 THEN f END) OVER b AS f2 FROM k WINDOW a AS (PARTITION BY cat ORDER BY vis RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY cat ORDER BY vis DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT event_id, @r(CASE WHEN f1 IS NULL THEN 0 WHEN x2 IS NULL OR x2 = x1 THEN f1 ELSE f1 + (f2 - f1) * (vis - x1) / (x2 - x1) END) AS ecdf FROM n WHERE ref = 0")

both("loo_variant_select", "K05", "WITH g AS (SELECT cat, shot, avg(vis) AS m FROM @ev GROUP BY cat, shot), o AS (SELECT a.cat AS held, b.shot, avg(b.m) AS m FROM (SELECT DISTINCT cat FROM g) a JOIN g b ON a.cat <> b.cat GROUP BY a.cat, b.shot), p AS (SELECT held, shot, row_number() OVER (PARTITION BY held ORDER BY round(m, 9) DESC, shot) AS k FROM o) SELECT p.held AS cat, CAST(p.shot AS INT) AS chosen_shot, @r(g.m) AS held_out_score FROM p JOIN g ON p.held = g.cat AND p.shot = g.shot WHERE p.k = 1")
both("constrained_pick", "K06", "SELECT seed, cat FROM (SELECT seed, cat, row_number() OVER (PARTITION BY seed ORDER BY round(avg(vis), 9) DESC, cat) AS k FROM @ev GROUP BY seed, cat HAVING stddev_pop(vis) < 1000000) t WHERE k = 1")
both("best_flag", "K07 K08", "SELECT cat, shot, CASE WHEN round(m, 9) = max(round(m, 9)) OVER (PARTITION BY cat) THEN 1 ELSE 0 END AS is_best FROM (SELECT cat, shot, avg(vis) AS m FROM @ev GROUP BY cat, shot) t")
both("top_bottom_union", "K14", "SELECT cat, event_id, 'top' AS side FROM (SELECT cat, event_id, row_number() OVER (PARTITION BY cat ORDER BY vis DESC, event_id) AS k FROM @ev) a WHERE k <= 3 UNION ALL SELECT cat, event_id, 'bottom' AS side FROM (SELECT cat, event_id, row_number() OVER (PARTITION BY cat ORDER BY vis, event_id) AS k FROM @ev) b WHERE k <= 3")
both("image_topq_score", "G14 G15 G16", "SELECT vec_id, @r(avg(s)) AS score FROM (SELECT vec_id, s, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, p) AS k FROM @cells) t WHERE k <= 7 GROUP BY vec_id")

both("matrix_completeness", "U01 U02", "SELECT c.cat, s.seed, h.shot FROM (SELECT DISTINCT cat FROM @ev) c CROSS JOIN (SELECT DISTINCT seed FROM @ev) s CROSS JOIN (SELECT 1 AS shot UNION ALL SELECT 2 UNION ALL SELECT 4 UNION ALL SELECT 8) h EXCEPT SELECT cat, seed, shot FROM @ev")
both("nested_subset_check", "U03 P24", "SELECT a.cat, CAST(count(*) AS BIGINT) AS small, CAST(count(b.user_id) AS BIGINT) AS also_in_large FROM (SELECT DISTINCT cat, user_id FROM @ev WHERE shot = 1) a LEFT JOIN (SELECT DISTINCT cat, user_id FROM @ev WHERE shot IN (1, 2)) b ON a.cat = b.cat AND a.user_id = b.user_id GROUP BY a.cat")
both("jaccard_selection", "U05 U06", "WITH a AS (SELECT DISTINCT cat, user_id FROM @ev WHERE vis > 50), n AS (SELECT cat, count(*) AS n FROM a GROUP BY cat), i AS (SELECT x.cat AS c1, y.cat AS c2, count(*) AS k FROM a x JOIN a y ON x.user_id = y.user_id AND x.cat < y.cat GROUP BY x.cat, y.cat) SELECT c1, c2, @r(k / CAST(n1.n + n2.n - k AS DOUBLE)) AS jaccard FROM i JOIN n n1 ON i.c1 = n1.cat JOIN n n2 ON i.c2 = n2.cat")
both("set_difference", "U08", "SELECT user_id FROM @ev WHERE cat = 'click' EXCEPT SELECT user_id FROM @ev WHERE cat = 'purchase' AND vis > 20")

both("gate_small", "D01", "SELECT cat, CASE WHEN count(*) = 3 AND avg(d) >= 0 AND sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) >= 2 AND min(d) >= -10 THEN 1 ELSE 0 END AS pass FROM (SELECT cat, seed, avg(zv) - avg(zt) AS d FROM @z GROUP BY cat, seed) t GROUP BY cat")
both("gate_full", "D02 D05", "SELECT CASE WHEN count(*) = 9 THEN 1 ELSE 0 END AS complete, CASE WHEN avg(d) >= 0.005 THEN 1 ELSE 0 END AS mean_ok, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive, @r(min(d)) AS worst FROM (SELECT seed, shot, avg(zv) - avg(zt) AS d FROM @z GROUP BY seed, shot) t")
both("gate_final", "D03", "SELECT CASE WHEN min(ok) = 1 THEN 1 ELSE 0 END AS pass, CAST(sum(ok) AS BIGINT) AS passed FROM (SELECT cat, CASE WHEN avg(zv) >= avg(zt) - 5 THEN 1 ELSE 0 END AS ok FROM @z GROUP BY cat) t")
both("gset_votes", "G31 D06", "SELECT cat, CAST(sum(CASE WHEN d > 0.02 THEN 1 ELSE 0 END) AS BIGINT) AS votes, @r(avg(d)) AS headroom, CASE WHEN avg(d) > 0 AND sum(CASE WHEN d > 0.02 THEN 1 ELSE 0 END) >= 2 THEN 1 ELSE 0 END AS chosen FROM (SELECT cat, seed, avg(greatest(zv, zt)) - avg(zv) AS d FROM @z GROUP BY cat, seed) t GROUP BY cat")
both("acceptance_matrix", "D09", "SELECT cat, CASE WHEN count(*) > 10 THEN 1 ELSE 0 END AS enough, CASE WHEN max(abs(zv)) < 100000 THEN 1 ELSE 0 END AS bounded, CASE WHEN count(*) > 10 AND max(abs(zv)) < 100000 THEN 1 ELSE 0 END AS pass FROM @z GROUP BY cat")

both("auroc_by_group", "E02", "SELECT lang, CASE WHEN sum(y) = 0 OR sum(y) = count(*) THEN NULL ELSE @r((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * CAST(count(*) - sum(y) AS DOUBLE))) END AS auroc FROM (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0 AS rk FROM @doc) t GROUP BY lang")
@frame("rank_auc", "E14", "SELECT @r((sum(CASE WHEN t = 1 THEN rk END) - sum(t) * (sum(t) + 1) / 2.0) / (sum(t) * CAST(count(*) - sum(t) AS DOUBLE))) AS auc FROM (SELECT t, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM @doc) x")
def rank_auc(spark, sf_dir):
    own = spark_sql(spark, sf_dir, "SELECT CAST(s AS DOUBLE) AS s, t FROM @doc")
    return metrics.auroc(own, [], "s", "t").select(_r6("auroc").alias("auc"))
_PR = "g AS (SELECT lang, s, sum(y) AS tp, count(*) AS n FROM @doc GROUP BY lang, s), c AS (SELECT lang, s, tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY lang) AS pos FROM g WINDOW w AS (PARTITION BY lang ORDER BY s DESC))"
both("average_precision", "E03", f"WITH {_PR} SELECT lang, @r(sum(tp / CAST(pos AS DOUBLE) * ctp / CAST(cn AS DOUBLE))) AS ap FROM c WHERE pos > 0 GROUP BY lang")
both("f1_max", "E04", f"WITH {_PR} SELECT lang, @r(max(2.0 * ctp / CAST(cn + pos AS DOUBLE))) AS f1_max FROM c WHERE pos > 0 GROUP BY lang")
@frame("ap_binary_rows", "E15", "WITH r AS (SELECT y, row_number() OVER (ORDER BY s DESC, doc_id) AS k, sum(y) OVER (ORDER BY s DESC, doc_id) AS tp, sum(y) OVER () AS pos FROM @doc) SELECT @r(sum(CASE WHEN y = 1 THEN tp / CAST(k AS DOUBLE) END) / max(pos)) AS ap FROM r")
def ap_binary_rows(spark, sf_dir):
    own = spark_sql(spark, sf_dir, "SELECT doc_id, CAST(s AS DOUBLE) AS s, CAST(1 AS BIGINT) AS one, y FROM @doc")
    got = metrics.running(own, [], [F.col("s").desc(), F.col("doc_id")], "s", {"k": "one", "tp": "y"})
    return got.agg(_r6(F.sum(F.when(F.col("y") == 1, F.col("tp") / F.col("k"))) / F.max("all_tp")).alias("ap"))
both("threshold_metrics", "E16", "SELECT lang, @r(2.0 * sum(CASE WHEN y = 1 AND s > 500 THEN 1 ELSE 0 END) / nullif(2.0 * sum(CASE WHEN y = 1 AND s > 500 THEN 1 ELSE 0 END) + sum(CASE WHEN y = 0 AND s > 500 THEN 1 ELSE 0 END) + sum(CASE WHEN y = 1 AND s <= 500 THEN 1 ELSE 0 END), 0)) AS f1 FROM @doc GROUP BY lang")
both("rescue_harm", "E17", "SELECT lang, CAST(sum(CASE WHEN (s > 500) <> (y = 1) AND (s > 300) = (y = 1) THEN 1 ELSE 0 END) AS BIGINT) AS rescued, CAST(sum(CASE WHEN (s > 500) = (y = 1) AND (s > 300) <> (y = 1) THEN 1 ELSE 0 END) AS BIGINT) AS harmed FROM @doc GROUP BY lang")
both("dice", "E22", "SELECT vec_id, @r(2.0 * sum(CASE WHEN s > 0.1 AND m = 1 THEN 1 ELSE 0 END) / (sum(CASE WHEN s > 0.1 THEN 1 ELSE 0 END) + sum(m) + 0.000000001)) AS dice FROM @cells GROUP BY vec_id")
both("fp_rate", "E19", "SELECT label, @r(sum(CASE WHEN s > 0.2 AND m = 0 THEN 1 ELSE 0 END) / CAST(sum(1 - m) AS DOUBLE)) AS fpr FROM @cells GROUP BY label")
both("patch_auroc", "E20 E13", "SELECT vec_id, @r((sum(CASE WHEN m = 1 THEN rk END) - sum(m) * (sum(m) + 1) / 2.0) / nullif(sum(m) * CAST(count(*) - sum(m) AS DOUBLE), 0)) AS auroc FROM (SELECT vec_id, m, rank() OVER (PARTITION BY vec_id ORDER BY s) + (count(*) OVER (PARTITION BY vec_id, s) - 1) / 2.0 AS rk FROM @cells) t GROUP BY vec_id HAVING sum(m) > 0")
@frame("pooled_stride_metrics", "P22 E01", "SELECT @r((sum(CASE WHEN m = 1 THEN rk END) - sum(m) * (sum(m) + 1) / 2.0) / (sum(m) * CAST(count(*) - sum(m) AS DOUBLE))) AS auroc, CAST(count(*) AS BIGINT) AS n FROM (SELECT m, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM @cells WHERE r % 2 = 0 AND c % 2 = 0) t")
def pooled_stride_metrics(spark, sf_dir):
    own = spark_sql(spark, sf_dir, "SELECT s, m FROM @cells WHERE r % 2 = 0 AND c % 2 = 0")
    return metrics.auroc(own, [], "s", "m").select(_r6("auroc").alias("auroc")).join(own.agg(F.count("*").alias("n")))
@frame("image_metrics", "E09 E11 E12", "SELECT @r((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * CAST(count(*) - sum(y) AS DOUBLE))) AS auroc, CAST(sum(y) AS BIGINT) AS positives FROM (SELECT y, rank() OVER (ORDER BY peak) + (count(*) OVER (PARTITION BY peak) - 1) / 2.0 AS rk FROM @img) t")
def image_metrics(spark, sf_dir):
    own = spark_sql(spark, sf_dir, "SELECT peak, y FROM @img")
    return metrics.auroc(own, [], "peak", "y").select(_r6("auroc").alias("auroc")).join(own.agg(F.sum("y").cast("long").alias("positives")))
both("tier_metrics", "P30 G33", "SELECT CASE WHEN f = 0 THEN 'none' WHEN f <= 0.08 THEN 'small' WHEN f <= 0.1 THEN 'mid' ELSE 'large' END AS tier, CAST(count(*) AS BIGINT) AS n, @r(avg(mx)) AS mean_peak FROM (SELECT vec_id, avg(CAST(m AS DOUBLE)) AS f, max(s) AS mx FROM @cells GROUP BY vec_id) t GROUP BY 1")
both("bucket_metrics", "P31 G36", "SELECT CAST(least(floor(s / 500), 9) AS INT) AS bucket, CAST(count(*) AS BIGINT) AS n, @r(avg(CAST(y AS DOUBLE))) AS share FROM @doc GROUP BY 1")
both("aupro_fast", "E05 E07 E08", "WITH t AS (SELECT k / 20.0 * (SELECT max(s) FROM @cells) AS th, k FROM (SELECT DISTINCT p AS k FROM @cells WHERE p <= 20) x), a AS (SELECT vec_id, s, m FROM @cells), o AS (SELECT k, vec_id, avg(CASE WHEN s > th THEN 1e0 ELSE 0e0 END) AS ov FROM a JOIN t ON 1 = 1 WHERE m = 1 GROUP BY k, vec_id), f AS (SELECT k, avg(CASE WHEN s > th THEN 1e0 ELSE 0e0 END) AS fpr FROM a JOIN t ON 1 = 1 WHERE m = 0 GROUP BY k), j AS (SELECT f.k, f.fpr, avg(o.ov) AS pro FROM f JOIN o ON f.k = o.k GROUP BY f.k, f.fpr), l AS (SELECT fpr, pro, lag(fpr) OVER (ORDER BY fpr, k DESC) AS pf, lag(pro) OVER (ORDER BY fpr, k DESC) AS pp FROM j WHERE fpr < 0.3) SELECT @r(sum((fpr - pf) * (pro + pp) / 2) / nullif(max(fpr) - min(fpr), 0)) AS aupro FROM l")

both("sign_test", "H03", "WITH d AS (SELECT seed, shot, avg(zv) - avg(zt) AS d FROM @z GROUP BY seed, shot), n AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS k FROM d), b AS (SELECT i, factorial(CAST(n AS INT)) / CAST(factorial(CAST(i AS INT)) * factorial(CAST(n - i AS INT)) AS DOUBLE) * power(0.5, n) AS p, k FROM n JOIN (SELECT DISTINCT p AS i FROM @cells WHERE p <= 20) x ON i <= n) SELECT CAST(max(k) AS BIGINT) AS positives, @r(sum(CASE WHEN i >= k THEN p ELSE 0 END)) AS p_value FROM b")
_LCG = "((b.r * 1103515245 + g.d * 12345 + b.r * g.d * 7) % g.k)"
both("cluster_bootstrap", "H07", f"WITH c AS (SELECT cat, row_number() OVER (ORDER BY cat) - 1 AS i, avg(zv) - avg(zt) AS d FROM @z GROUP BY cat), b AS (SELECT DISTINCT CAST(p AS BIGINT) AS r FROM @cells), g AS (SELECT i AS d, count(*) OVER () AS k FROM c), s AS (SELECT b.r, avg(c.d) AS m FROM b JOIN g ON 1 = 1 JOIN c ON c.i = {_LCG} GROUP BY b.r) SELECT @r(avg(m)) AS mean_delta, @r(@q(m; 0.025)) AS lo, @r(@q(m; 0.975)) AS hi, @r(avg(CASE WHEN m > 0 THEN 1e0 ELSE 0e0 END)) AS p_positive FROM s")
both("bootstrap_ci", "H01 G28", f"WITH c AS (SELECT seed, shot, row_number() OVER (ORDER BY seed, shot) - 1 AS i, avg(zv) - avg(zt) AS d FROM @z GROUP BY seed, shot), b AS (SELECT DISTINCT CAST(p AS BIGINT) AS r FROM @cells), g AS (SELECT i AS d, count(*) OVER () AS k FROM c), s AS (SELECT b.r, avg(c.d) AS m FROM b JOIN g ON 1 = 1 JOIN c ON c.i = {_LCG} GROUP BY b.r) SELECT @r(avg(m)) AS mean_delta, @r(@q(m; 0.025)) AS lo, @r(@q(m; 0.975)) AS hi FROM s")
both("conformal_p", "H05", "SELECT event_id, @r((1 + at_least) / CAST(n + 1 AS DOUBLE)) AS p FROM (SELECT event_id, ref, sum(ref) OVER (PARTITION BY cat ORDER BY vis DESC) AS at_least, sum(ref) OVER (PARTITION BY cat) AS n FROM @ev) t WHERE ref = 0")
