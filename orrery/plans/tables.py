"""Alignment joins, guards, strings, hashes, and sampling queries over the relational tables."""

from pyspark.sql import functions as F

from orrery.operators import align, guards
from orrery.plans.kit import both, frame, table

_CANON = "lower(trim(regexp_replace(replace(c_name, '\\\\', '/'), '#0*', '-{g}')))"
both("string_canonical_id", "X01 X02", "SELECT c_custkey, lower(replace(trim(c_name), '#', '-')) AS cid, regexp_extract(c_name, '([0-9]+)$', 1) AS digits, length(c_name) AS len FROM {customer}")
both("path_segments", "X06 X07", "SELECT page_id, regexp_extract(url, '^[a-z]+:[/][/]([^/]+)', 1) AS host, regexp_extract(url, '([^/]*)$', 1) AS stem, CAST(length(url) - length(replace(url, '/', '')) AS INT) AS slashes FROM {pages}")
both("regex_run_keys", "X08 X09", "SELECT doc_id, regexp_extract(source, '^([a-z]+)([0-9]+)$', 1) AS prefix, CAST(regexp_extract(source, '^([a-z]+)([0-9]+)$', 2) AS INT) AS num FROM {documents}")
both("json_props", "X25", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM {events}")
both("ts_cutoff", "X11", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 1 ELSE 0 END) AS BIGINT) AS before_cut, CAST(max(hour(ts)) AS INT) AS last_hour FROM {events} GROUP BY event_type")
both("hash_digest", "X29 X30 Q02 Q01", "SELECT page_id, @sha(html) AS digest, length(html) AS n FROM {pages}")
both("rolling_hash", "X32", "SELECT event_id, CAST((event_id * 7919 + user_id * 104729) % 1000003 AS BIGINT) AS h, CAST(row_number() OVER (PARTITION BY event_type ORDER BY (event_id * 7919 + user_id * 104729) % 1000003, event_id) AS BIGINT) AS place FROM {events}")
both("manifest_diff", "Q02 Q03", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'extra' WHEN b.k IS NULL THEN 'missing' WHEN a.v <> b.v THEN 'changed' ELSE 'same' END AS state FROM (SELECT p_partkey AS k, p_size AS v FROM {part} WHERE p_partkey % 7 <> 0) a FULL OUTER JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN p_size + 1 ELSE p_size END AS v FROM {part} WHERE p_partkey % 5 <> 0) b ON a.k = b.k")
both("nested_kshot_sample", "C20 J23", "SELECT event_type, shot, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY (event_id * 7919) % 104729, event_id) AS k FROM {events}) t JOIN (SELECT 1 AS shot UNION ALL SELECT 2 UNION ALL SELECT 4) s ON t.k <= s.shot")
both("pairs_and_triples", "C08", "SELECT a.n_name AS n1, b.n_name AS n2, c.n_name AS n3 FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey JOIN {nation} c ON b.n_regionkey = c.n_regionkey AND b.n_nationkey < c.n_nationkey")
both("superset_alignment", "J04 J20", "SELECT c.c_custkey, CAST(count(o.o_orderkey) AS BIGINT) AS n_orders FROM {orders} o RIGHT JOIN {customer} c ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
both("paired_arms", "J19 J21 J22 G26", "SELECT l_orderkey, @r(max(CASE WHEN l_linenumber = 1 THEN l_extendedprice END)) AS low_arm, @r(max(CASE WHEN l_linenumber = 2 THEN l_extendedprice END)) AS high_arm, @r(max(CASE WHEN l_linenumber = 2 THEN l_extendedprice END) - max(CASE WHEN l_linenumber = 1 THEN l_extendedprice END)) AS delta FROM {lineitem} GROUP BY l_orderkey")
both("shuffled_control_join", "J10 H06", "WITH a AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_custkey) AS k FROM {customer}), b AS (SELECT c_acctbal, row_number() OVER (ORDER BY (c_custkey * 7919) % 104729, c_custkey) AS k FROM {customer}) SELECT a.c_custkey, @r(a.c_acctbal - b.c_acctbal) AS gap FROM a JOIN b ON a.k = b.k")
both("late_label_join", "J24 P10 P11", "WITH s AS (SELECT doc_id, ln(1 + n_chars) AS score FROM {documents}) SELECT s.doc_id, @r(s.score) AS score, l.quality FROM s LEFT JOIN {labels} l ON s.doc_id = l.doc_id")
both("missing_masks", "P26 P25 J23", "SELECT c.c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)")
both("binary_class_guard", "P15 P33", "SELECT lang, CASE WHEN min(quality) = 0 AND max(quality) = 1 THEN 1 ELSE 0 END AS both_classes, CAST(sum(CASE WHEN quality NOT IN (0, 1) THEN 1 ELSE 0 END) AS BIGINT) AS invalid FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY lang")
both("evaluation_target_join", "P06 E23", "SELECT CAST(count(*) AS BIGINT) AS labelled, CAST(count(d.doc_id) AS BIGINT) AS scored, CAST(count(*) - count(d.doc_id) AS BIGINT) AS unscored FROM {labels} l LEFT JOIN {documents} d ON d.doc_id = l.doc_id")
both("revenue_report", "S06 G01", "SELECT l_returnflag, l_linestatus, @r(sum(l_quantity)) AS sum_qty, @r(sum(l_extendedprice * (1 - l_discount))) AS revenue, CAST(count(*) AS BIGINT) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
both("top_customers", "K01", "SELECT c_custkey, n_name, @r(spent) AS spent FROM (SELECT c_custkey, n_name, sum(o_totalprice) AS spent, row_number() OVER (ORDER BY round(sum(o_totalprice), 2) DESC, c_custkey) AS k FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY c_custkey, n_name) t WHERE k <= 20")


@frame("strict_alignment", "X01 J01 J02 J03 J05 J08 U04", "SELECT a.c_custkey AS k, lower(replace(a.c_name, '#', '-')) AS cid, CAST(row_number() OVER (ORDER BY lower(replace(a.c_name, '#', '-'))) AS INT) AS place FROM {customer} a")
def strict_alignment(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("id"))
    right = left.select(F.upper("id").alias("id"))
    from pyspark.sql.window import Window

    met = align.strict_join(left, right, "id")
    return met.select(F.col("c_custkey").alias("k"), "cid", F.row_number().over(Window.orderBy("cid")).alias("place"))


@frame("alignment_audit", "J01 G20 U04 P02 P04", "WITH a AS (SELECT lower(o_orderpriority) AS id, count(*) AS n FROM {orders} GROUP BY 1), b AS (SELECT DISTINCT lower(o_orderpriority) AS id FROM {orders} WHERE o_orderkey % 2 = 0) SELECT CAST(sum(CASE WHEN a.n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicated_left, CAST(sum(CASE WHEN b.id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_right, CAST(sum(CASE WHEN a.id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS extra_right FROM a FULL OUTER JOIN b ON a.id = b.id")
def alignment_audit(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    left = orders.select(F.col("o_orderpriority").alias("id"))
    right = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderpriority").alias("id")).distinct()
    return align.audit(left, right, "id").select("duplicated_left", "missing_right", "extra_right")


@frame("contract_report", "P01 P02 P03 P05 P07 P08 P09 P32 P33", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(DISTINCT event_id) AS BIGINT) AS repeated_ids, CAST(sum(CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 1 ELSE 0 END) AS BIGINT) AS not_finite, CAST(sum(CASE WHEN value >= 1 AND value <= 50 THEN 0 ELSE 1 END) AS BIGINT) AS out_of_range FROM {events}")
def contract_report(spark, sf_dir):
    return guards.report(table(spark, sf_dir, "events"), ids=["event_id"], finite=["value"], between={"value": (1.0, 50.0)})
