"""Diagnostics, audits, per-image normalisation and further selection queries."""

from pyspark.sql import functions as F

from orrery.operators import metrics
from orrery.plans.kit import both, frame, spark_sql

both("decision_threshold", "G17 G18", "SELECT label, @r(max(peak)) AS threshold, CAST(count(*) AS BIGINT) AS n FROM @img WHERE vec_id % 5 = 0 GROUP BY label")
both("calibration_diagnostics", "G21", "WITH t AS (SELECT cat, vis, count(*) AS n FROM @ev GROUP BY cat, vis) SELECT cat, CAST(sum(n) AS BIGINT) AS n, @r(count(*) / CAST(sum(n) AS DOUBLE)) AS distinct_ratio, CAST(max(n) AS BIGINT) AS largest_tie, @r(min(vis)) AS lo, @r(max(vis)) AS hi FROM t GROUP BY cat")
both("method_long_table", "G09", "SELECT method, cat, shot, @r(avg(v)) AS mean_v, @r(stddev_samp(v)) AS sd FROM (SELECT 'visual' AS method, cat, shot, zv AS v FROM @z UNION ALL SELECT 'text' AS method, cat, shot, zt AS v FROM @z) t GROUP BY method, cat, shot")
both("bank_stats", "G29", "SELECT ri AS ref_image, CAST(count(*) AS BIGINT) AS patches, CAST(count(DISTINCT label) AS BIGINT) AS labels FROM (SELECT vec_id, label, CAST((vec_id // 5) % 4 AS INT) AS ri FROM {embeddings} WHERE vec_id % 5 = 0) t GROUP BY ri")
both("latency_summary", "G30", "SELECT cat, @r(avg(vis)) AS mean_v, @r(max(CASE WHEN k = CAST(ceil(0.5 * n) AS BIGINT) THEN vis END)) AS p50, @r(max(CASE WHEN k = CAST(ceil(0.95 * n) AS BIGINT) THEN vis END)) AS p95, @r(1 / avg(vis)) AS rate FROM (SELECT cat, vis, row_number() OVER (PARTITION BY cat ORDER BY vis, event_id) AS k, count(*) OVER (PARTITION BY cat) AS n FROM @ev) t GROUP BY cat")
both("risk_composite", "G34", "SELECT event_id, @r((cume_dist() OVER (ORDER BY vis) + cume_dist() OVER (ORDER BY zv) + cume_dist() OVER (ORDER BY zt)) / 3) AS risk FROM @z")
@frame("defect_type_metrics", "G35", "WITH p AS (SELECT label, peak FROM @img WHERE y = 1), g AS (SELECT peak FROM @img WHERE y = 0) SELECT p.label, @r(avg(CASE WHEN p.peak > g.peak THEN 1e0 WHEN p.peak = g.peak THEN 5e-1 ELSE 0e0 END)) AS auroc FROM p CROSS JOIN g GROUP BY p.label")
def defect_type_metrics(spark, sf_dir):
    own = spark_sql(spark, sf_dir, "SELECT label, peak, y FROM @img")
    return metrics.auroc_against(own, "label", "peak", "y").select("label", (F.round("auroc", 6) + F.lit(0.0)).alias("auroc"))
both("null_skipping_mean", "G37 X27 X28", "SELECT seed, @r(avg(CASE WHEN vis > 90 THEN NULL ELSE vis END)) AS mean_v, CAST(count(CASE WHEN vis > 90 THEN NULL ELSE vis END) AS BIGINT) AS used FROM @ev GROUP BY seed")
both("worst_five", "K09", "SELECT seed, cat, user_id, @r(d) AS delta FROM (SELECT seed, cat, user_id, d, row_number() OVER (PARTITION BY seed ORDER BY round(d, 9), cat, user_id) AS k FROM (SELECT seed, cat, user_id, avg(zv) - avg(zt) AS d FROM @z GROUP BY seed, cat, user_id) t) u WHERE k <= 5")
both("multi_key_order", "K10", "SELECT vec_id, CAST(row_number() OVER (ORDER BY y DESC, round(peak, 9) DESC, vec_id) AS BIGINT) AS place FROM @img")
both("argmin_subset", "K11 C08", "WITH s AS (SELECT label, avg(peak) AS a FROM @img GROUP BY label), p AS (SELECT x.label AS l1, y.label AS l2, x.a + y.a AS v FROM s x JOIN s y ON x.label < y.label) SELECT l1, l2, @r(v) AS v FROM (SELECT l1, l2, v, row_number() OVER (ORDER BY round(v, 9), l1, l2) AS k FROM p) t WHERE k = 1")
both("shift_estimate", "K12", "WITH d AS (SELECT a.label, b.r - a.r AS dy, b.c - a.c AS dx, avg(abs(a.s - b.s)) AS gap FROM @cells a JOIN @cells b ON a.label = b.label AND a.vec_id + 10 = b.vec_id AND abs(b.r - a.r) <= 1 AND abs(b.c - a.c) <= 1 GROUP BY a.label, b.r - a.r, b.c - a.c) SELECT label, CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx FROM (SELECT label, dy, dx, row_number() OVER (PARTITION BY label ORDER BY round(gap, 9), abs(dy) + abs(dx), abs(dy), abs(dx), dy, dx) AS k FROM d) t WHERE k = 1")
both("union_frames", "U10", "SELECT vec_id AS id, 'bank' AS part FROM {embeddings} WHERE vec_id % 5 = 0 UNION ALL SELECT vec_id AS id, 'query' AS part FROM {embeddings} WHERE vec_id % 5 <> 0")
both("pair_field_audit", "U11 Q07", "SELECT cat, CAST(count(*) AS BIGINT) AS cells, CAST(sum(CASE WHEN n1 = n2 THEN 1 ELSE 0 END) AS BIGINT) AS equal_counts FROM (SELECT cat, seed, sum(CASE WHEN shot = 1 THEN 1 ELSE 0 END) AS n1, sum(CASE WHEN shot = 2 THEN 1 ELSE 0 END) AS n2 FROM @ev GROUP BY cat, seed) t GROUP BY cat")
both("double_rank_filter", "W07 V23", "SELECT vec_id, p FROM (SELECT vec_id, p, row_number() OVER (PARTITION BY vec_id ORDER BY s, p) AS a, row_number() OVER (PARTITION BY vec_id ORDER BY s * (1 + r), p) AS b FROM @cells) t WHERE a <= 24 AND b <= 24")
both("precision_at_positives", "W09", "SELECT lang, @r(avg(tp / CAST(k AS DOUBLE))) AS ap FROM (SELECT lang, y, row_number() OVER w AS k, sum(y) OVER (PARTITION BY lang ORDER BY s DESC, doc_id ROWS UNBOUNDED PRECEDING) AS tp FROM @doc WINDOW w AS (PARTITION BY lang ORDER BY s DESC, doc_id)) t WHERE y = 1 GROUP BY lang")
both("late_layer_share", "W17", "SELECT vec_id, @r(avg(CASE WHEN z > 1 THEN 1e0 ELSE 0e0 END)) AS share FROM (SELECT vec_id, p, (s - avg(s) OVER (PARTITION BY p)) / stddev_pop(s) OVER (PARTITION BY p) AS z FROM @cells) t WHERE p >= 32 GROUP BY vec_id")
both("image_robust_z", "W18 X20", "WITH q AS (SELECT vec_id, median(s) AS med, @q(s; 0.75) - @q(s; 0.25) AS iqr FROM @cells GROUP BY vec_id) SELECT c.vec_id, c.p, @r((s - med) / greatest(iqr, 0.000001)) AS z FROM @cells c JOIN q ON c.vec_id = q.vec_id")
both("image_max_normalise", "W19", "SELECT vec_id, p, @r(s / max(s) OVER (PARTITION BY vec_id)) AS v FROM @cells")
both("clipped_robust_z", "X19 X21", "SELECT event_id, @r(greatest(least(zv, 10), -5)) AS z, @r(zv / (1 + greatest(zv, 0))) AS squashed FROM @z")
both("branch_is_reliable", "P19 A02", "SELECT cat, CASE WHEN @q(vis; 0.75) - @q(vis; 0.25) <= 0.000001 OR avg(CASE WHEN vis IS NULL THEN 1e0 ELSE 0e0 END) > 0 THEN 0 ELSE 1 END AS reliable FROM @ev WHERE ref = 1 GROUP BY cat")
both("accepted_calibrations", "P27 P28 P29 B17", "SELECT c.cat, @r(cv) AS center FROM @cal c JOIN (SELECT cat, CASE WHEN count(*) >= 10 THEN 'passed' ELSE 'failed' END AS status FROM @ev WHERE ref = 1 GROUP BY cat) s ON c.cat = s.cat WHERE s.status = 'passed'")
both("cache_audit", "Q08", "SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS sources, CAST(count(*) AS BIGINT) AS views, @r(min(value)) AS lo, @r(max(value)) AS hi FROM {events} GROUP BY event_type")
both("row_equivariance", "A12", "SELECT a.vec_id, a.r, @r(sum(a.s * b.s) / sqrt(sum(a.s * a.s) * sum(b.s * b.s))) AS cosine FROM @cells a JOIN @cells b ON a.vec_id = b.vec_id AND a.r = 7 - b.r AND a.c = b.c GROUP BY a.vec_id, a.r")
both("destroyed_alignment", "E26 H06", "SELECT a.label, @r(corr(a.s, b.s)) AS rotated, @r(corr(a.s, h.s)) AS rolled FROM @cells a JOIN @cells b ON a.vec_id = b.vec_id AND a.p = 63 - b.p JOIN @cells h ON a.vec_id = h.vec_id AND h.p = (a.p + 32) % 64 GROUP BY a.label")
both("trimmed_region_mean", "M20", "SELECT vec_id, @r(avg(s)) AS v FROM (SELECT vec_id, s, row_number() OVER (PARTITION BY vec_id ORDER BY s, p) AS k, count(*) OVER (PARTITION BY vec_id) AS n FROM @cells) t WHERE k > floor(0.1 * n) AND k <= n - floor(0.1 * n) GROUP BY vec_id")
both("region_support", "M09 M15", "SELECT vec_id, CASE WHEN max(s) > 0.25 AND avg(s) > 0.1 THEN 0.9 WHEN max(s) > 0.25 THEN 0.6 WHEN avg(s) > 0.1 THEN 0.3 ELSE 0.0 END AS level, CAST(sum(m) AS BIGINT) AS truth FROM @cells GROUP BY vec_id".replace("ELSE 0.0 END AS level", "ELSE 0.0 END * 1.0 AS level").replace("CASE WHEN max(s) > 0.25 AND", "CAST(CASE WHEN max(s) > 0.25 AND").replace("END * 1.0 AS level", "END AS DOUBLE) AS level"))
both("normal_range_excess", "M11", "SELECT vec_id, @r(0.5 * avg(CASE WHEN z > 1 THEN 1e0 ELSE 0e0 END) + 0.5 * least(greatest(asinh(median(greatest(z, 0))) / 3, 0), 1)) AS score FROM (SELECT vec_id, (s - avg(s) OVER (PARTITION BY label)) / stddev_pop(s) OVER (PARTITION BY label) AS z FROM @cells) t GROUP BY vec_id")
both("scattered_response", "M07", "SELECT vec_id, CASE WHEN max(s) / avg(s) < 0.5 THEN 1 ELSE 0 END AS scattered, @r(max(s) / avg(s)) AS ratio FROM @cells GROUP BY vec_id")
both("prototype_similarity", "", "WITH c AS (SELECT label, p, avg(x) AS m FROM @dims WHERE vec_id % 5 = 0 GROUP BY label, p) SELECT d.vec_id, @r(1 - sum(d.x * c.m) / sqrt(sum(d.x * d.x) * sum(c.m * c.m))) AS dist FROM @dims d JOIN c ON d.label = c.label AND d.p = c.p WHERE d.vec_id % 5 <> 0 GROUP BY d.vec_id")
both("cell_texture", "A26", "SELECT vec_id, r // 4 AS tr, c // 4 AS tc, @r(avg(s)) AS mean_s, @r(stddev_pop(s)) AS sd, @r(max(s) - min(s)) AS span FROM @cells GROUP BY vec_id, r // 4, c // 4")
both("channel_response", "C17", "SELECT CAST(p AS INT) AS channel, @r(median(CASE WHEN y = 1 THEN x END) - median(x)) AS response FROM (SELECT p, x, CASE WHEN label IN (3, 7, 9) THEN 1 ELSE 0 END AS y FROM @dims) t GROUP BY p")
both("seconds_between", "X13", "SELECT event_id, CAST(unix_timestamp(CAST(ts AS TIMESTAMP)) - unix_timestamp(TIMESTAMP '2024-01-01 00:00:00') AS BIGINT) AS seconds FROM {events}", "SELECT event_id, CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01 00:00:00')) AS BIGINT) AS seconds FROM {events}")
