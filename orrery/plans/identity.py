"""Ids, paths, seeds, samples and rank queries."""

from pyspark.sql import functions as F

from orrery.operators import metrics
from orrery.plans.kit import VIEWS, both, frame, spark_sql

#: Sample ids as paths; labels 3, 7 and 9 stand for a defect, every fifth sample is a reference.
VIEWS["paths"] = (
    "SELECT vec_id, label, concat('c', label, CASE WHEN vec_id % 5 = 0 THEN '/train/good/' WHEN label IN (3, 7, 9) THEN '/test/crack/' ELSE '/test/good/' END, vec_id, '.png') AS path, CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END AS ref FROM {embeddings}",
    None,
)

both(
    "path_labels", "X03 X04 X05",
    "SELECT vec_id, CASE WHEN path LIKE '%/good/%' THEN 1 ELSE 0 END AS is_normal, CASE WHEN path LIKE '%/good/%' THEN 0 ELSE 1 END AS label, element_at(split(path, '/'), CAST(array_position(split(path, '/'), 'test') + 1 AS INT)) AS defect FROM @paths WHERE ref = 0",
    "SELECT vec_id, CAST(contains(path, '/good/') AS INT) AS is_normal, CAST(NOT contains(path, '/good/') AS INT) AS label, list_extract(string_split(path, '/'), list_position(string_split(path, '/'), 'test') + 1) AS defect FROM @paths WHERE ref = 0",
)
_WORDS = "[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*"
both(
    "word_counts", "X10",
    "SELECT doc_id, CAST(regexp_count(text, \"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*\") AS BIGINT) AS words FROM {documents}",
    f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_WORDS}')) AS BIGINT) AS words FROM {{documents}}",
)
_JSON = "to_json(named_struct('mean', named_struct('image', named_struct('image_ap', vec_id * 0.5), 'pixel', named_struct('pixel_ap', label * 0.25))))"
both(
    "flatten_json", "X26",
    f"SELECT vec_id, CAST(get_json_object(j, '$.mean.image.image_ap') AS DOUBLE) AS image_ap, CAST(get_json_object(j, '$.mean.pixel.pixel_ap') AS DOUBLE) AS pixel_ap FROM (SELECT vec_id, {_JSON} AS j FROM {{embeddings}}) t",
    "SELECT vec_id, CAST(vec_id * 0.5 AS DOUBLE) AS image_ap, CAST(label * 0.25 AS DOUBLE) AS pixel_ap FROM {embeddings}",
)
both(
    "stable_seeds", "X31 X33",
    "SELECT vec_id, CAST(conv(substr(sha2(path, 256), 1, 8), 16, 10) AS BIGINT) + 17 AS cat_seed, CAST(conv(concat(substr(sha2(path, 256), 7, 2), substr(sha2(path, 256), 5, 2), substr(sha2(path, 256), 3, 2), substr(sha2(path, 256), 1, 2)), 16, 10) AS BIGINT) AS ref_seed FROM @paths",
    "SELECT vec_id, CAST('0x' || substr(h, 1, 8) AS BIGINT) + 17 AS cat_seed, CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) AS ref_seed FROM (SELECT vec_id, sha256(path) AS h FROM @paths) t",
)
both("fit_ids_are_support", "Q10", "SELECT CAST(count(*) AS BIGINT) AS fitted, CAST(sum(CASE WHEN f.path LIKE '%/test/%' OR s.path IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM (SELECT path FROM @paths WHERE ref = 1 OR vec_id % 17 = 0) f LEFT JOIN (SELECT path FROM @paths WHERE ref = 1) s ON f.path = s.path")
both(
    "manifest_audit", "Q12 Q04",
    "SELECT label, CAST(count(*) AS BIGINT) AS entries, CAST(count(*) - count(DISTINCT path) AS BIGINT) AS duplicates, CAST(sum(CASE WHEN path LIKE '%/train/good/%' THEN 0 ELSE 1 END) AS BIGINT) AS not_normal, "
    "CASE WHEN count(*) < 4 THEN 'too few' WHEN count(*) > count(DISTINCT path) THEN 'duplicates' WHEN sum(CASE WHEN path LIKE '%/train/good/%' THEN 0 ELSE 1 END) > 0 THEN 'outside training' ELSE 'ok' END AS status FROM @paths WHERE ref = 1 OR vec_id % 37 = 0 GROUP BY label",
)
both("selection_union", "U07", "SELECT vec_id FROM @paths WHERE ref = 1 UNION SELECT vec_id FROM @paths WHERE label IN (3, 7)")
both("percentile_risk", "W05", "SELECT event_id, @r((rank() OVER (PARTITION BY cat ORDER BY vis) + (count(*) OVER (PARTITION BY cat, vis) - 1) / 2.0) / count(*) OVER (PARTITION BY cat)) AS risk FROM @ev")
both("linspace_sample", "C21", "SELECT DISTINCT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM {embeddings}) t JOIN (SELECT DISTINCT p AS j FROM @cells WHERE p < 32) g ON k = (j * (n - 1)) // 31")
both("label_seeds_across_shots", "Q05", "SELECT cat, CASE WHEN count(DISTINCT d) = 1 THEN 'same' ELSE 'differ' END AS status FROM (SELECT cat, shot, concat(min(user_id), ':', count(DISTINCT user_id)) AS d FROM @ev GROUP BY cat, shot) t GROUP BY cat")

_FLAT = "(SELECT label, s, m FROM @cells WHERE (vec_id * 64 + p) % 8 = 0)"


@frame(
    "flat_stride_metrics", "P23 E10",
    f"WITH c AS (SELECT label, s, sum(m) AS tp, count(*) AS n FROM {_FLAT} f GROUP BY label, s), k AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY label) AS pos, sum(n) OVER (PARTITION BY label) AS al FROM c WINDOW w AS (PARTITION BY label ORDER BY s DESC)) "
    "SELECT label, @r(CASE WHEN max(pos) > 0 THEN sum(tp / pos * ctp / cn) END) AS ap, @r(CASE WHEN max(pos) > 0 AND max(pos) < max(al) THEN sum((n - tp) * (ctp - tp / 2)) / max(pos * (al - pos)) END) AS auroc FROM k GROUP BY label",
)
def flat_stride_metrics(spark, sf_dir):
    own = spark_sql(spark, sf_dir, f"SELECT * FROM {_FLAT} f")
    ap, auc = metrics.average_precision(own, ["label"], "s", "m"), metrics.auroc(own, ["label"], "s", "m")
    r = lambda c: F.round(c, 6) + F.lit(0.0)
    return ap.join(auc, "label").select("label", r("ap").alias("ap"), r("auroc").alias("auroc"))
