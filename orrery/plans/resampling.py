"""Bootstrap and rank tests of paired arms, with SQL that draws the same weights."""

from pyspark.sql import functions as F

from orrery.operators import bootstrap
from orrery.plans.kit import frame, spark_sql

B = 64
_OWN = "SELECT event_id, cat, seed, shot, CASE WHEN (event_id * 31 + user_id) % 5 < 2 THEN 1 ELSE 0 END AS y, round(zv, 1) AS a, round(zt + CASE WHEN (event_id * 31 + user_id) % 5 < 2 THEN 0.4 ELSE 0 END, 1) AS b FROM @z"


def _r(c):
    return F.round(c, 6) + F.lit(0.0)


def _replicates(spark, sf_dir):
    return bootstrap.metric_replicates(spark_sql(spark, sf_dir, _OWN), ["cat", "seed", "shot"], "event_id", "y", ("b", "a"), B)


# Written from the definition: rows times replicates, thresholds by windows.
_DRAWN = (
    f"WITH o AS ({_OWN}), k AS (SELECT unnest(range({B + 1})) AS replicate), "
    f"w AS (SELECT cat, seed, shot, y, a, b, replicate, {bootstrap.weight_sql('event_id', 'replicate')} AS w FROM o, k), "
    + ", ".join(
        f"g{x} AS (SELECT cat, seed, shot, replicate, {x} AS s, sum(w * y) AS p, sum(w) AS n FROM w GROUP BY ALL), "
        f"c{x} AS (SELECT *, sum(p) OVER v AS cp, sum(n) OVER v AS cn, sum(p) OVER u AS ap, sum(n) OVER u AS an FROM g{x} WINDOW v AS (PARTITION BY cat, seed, shot, replicate ORDER BY s DESC), u AS (PARTITION BY cat, seed, shot, replicate)), "
        f"m{x} AS (SELECT cat, seed, shot, replicate, CASE WHEN max(ap) > 0 THEN sum(p * cp / CASE WHEN cn > 0 THEN cn ELSE 1 END) / max(ap) END AS prec, "
        f"CASE WHEN max(ap) > 0 AND max(an - ap) > 0 THEN sum(p * ((an - ap) - (cn - cp) + (n - p) / 2)) / max(ap * (an - ap)) END AS area FROM c{x} GROUP BY cat, seed, shot, replicate)"
        for x in "ab"
    )
    + ", d AS (SELECT cat, seed, shot, replicate, mb.prec - ma.prec AS ap, mb.area - ma.area AS auroc FROM ma JOIN mb USING (cat, seed, shot, replicate))"
)


def _told(value: str, by: str = "") -> str:
    drawn = f"CASE WHEN replicate > 0 THEN {value} END"
    return (
        f"{by} @r(max(CASE WHEN replicate = 0 THEN {value} END)) AS observed, @r(avg({drawn})) AS mean, @r(@q({drawn}; 0.5)) AS median, @r(@q({drawn}; 0.025)) AS lo, @r(@q({drawn}; 0.975)) AS hi, "
        f"@r(avg(CASE WHEN replicate > 0 AND {value} > 0 THEN 1e0 WHEN replicate > 0 AND {value} IS NOT NULL THEN 0e0 END)) AS p_positive"
    )


_FIELDS = ("observed", "mean", "median", "lo", "hi", "p_positive")


@frame(
    "paired_bootstrap", "H02 H01",
    _DRAWN + ", f AS (SELECT seed, shot, replicate, avg(ap) AS ap, avg(auroc) AS auroc FROM d GROUP BY ALL), t AS (SELECT replicate, avg(ap) AS dap, avg(auroc) AS dauroc FROM f GROUP BY replicate) "
    f"SELECT 'ap' AS metric, {_told('dap')} FROM t UNION ALL SELECT 'auroc', {_told('dauroc')} FROM t",
)
def paired_bootstrap(spark, sf_dir):
    deltas = bootstrap.macro_deltas(_replicates(spark, sf_dir), ["seed", "shot"])
    both = deltas.select("replicate", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("delta")) for m, c in (("ap", "dap"), ("auroc", "dauroc"))])))
    return bootstrap.interval(both, ["metric"], "delta").select("metric", *[_r(F.col(c)).alias(c) for c in _FIELDS])


@frame(
    "paired_bootstrap_by_config", "H02",
    _DRAWN + f", f AS (SELECT seed, shot, replicate, avg(ap) AS ap FROM d GROUP BY ALL) SELECT seed, shot, {_told('ap')} FROM f GROUP BY seed, shot",
)
def paired_bootstrap_by_config(spark, sf_dir):
    got = _replicates(spark, sf_dir).groupBy("seed", "shot", "replicate").agg(F.avg(F.col("ap_a") - F.col("ap_b")).alias("dap"))
    return bootstrap.interval(got, ["seed", "shot"], "dap").select("seed", "shot", *[_r(F.col(c)).alias(c) for c in _FIELDS])


_NUMBER = "length(cat) * 100 + ascii(cat)"


@frame(
    "category_cluster_bootstrap", "H02 H07",
    _DRAWN + f", e AS (SELECT seed, shot, replicate, ap, CASE WHEN replicate = 0 THEN 1 ELSE {bootstrap.weight_sql(_NUMBER, 'replicate + 1000003')} END AS w FROM d), "
    "f AS (SELECT seed, shot, replicate, CASE WHEN sum(CASE WHEN ap IS NOT NULL THEN w END) > 0 THEN sum(w * ap) / sum(CASE WHEN ap IS NOT NULL THEN w END) END AS ap FROM e GROUP BY ALL), "
    f"t AS (SELECT replicate, avg(ap) AS dap FROM f GROUP BY replicate) SELECT {_told('dap')} FROM t",
)
def category_cluster_bootstrap(spark, sf_dir):
    got = _replicates(spark, sf_dir).withColumn("number", F.length("cat") * 100 + F.ascii("cat"))
    deltas = bootstrap.macro_deltas(got, ["seed", "shot"], cluster="number")
    return bootstrap.interval(deltas, [], "dap").select(*[_r(F.col(c)).alias(c) for c in _FIELDS])


@frame(
    "mean_bootstrap", "H01 G28",
    f"WITH w AS (SELECT cat, replicate, zv - zt AS d, {bootstrap.weight_sql('event_id', 'replicate')} AS w FROM @z, (SELECT unnest(range({B + 1})) AS replicate)), "
    f"m AS (SELECT cat, replicate, CASE WHEN sum(w) > 0 THEN sum(w * d) / sum(w) END AS m FROM w GROUP BY cat, replicate) SELECT cat, {_told('m')} FROM m GROUP BY cat",
)
def mean_bootstrap(spark, sf_dir):
    got = bootstrap.mean_replicates(spark_sql(spark, sf_dir, "SELECT event_id, cat, zv - zt AS d FROM @z"), ["cat"], "event_id", "d", B)
    return bootstrap.interval(got, ["cat"], "mean").select("cat", *[_r(F.col(c)).alias(c) for c in _FIELDS])


# Written from the definition: all choices of signs.
@frame(
    "signed_rank_test", "H03",
    "WITH d AS (SELECT cat, shot * 10 + seed AS i, round(avg(zv) - avg(zt), 1) AS d FROM @z GROUP BY cat, shot, seed), "
    "r AS (SELECT cat, i, d, rank() OVER (PARTITION BY cat ORDER BY abs(d)) + (count(*) OVER (PARTITION BY cat, abs(d)) - 1) / 2.0 AS rk FROM d WHERE d <> 0), "
    "l AS (SELECT cat, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w, list(rk) AS ranks FROM r GROUP BY cat), "
    "s AS (SELECT cat, n, w, list_sum(list_transform(ranks, lambda x, j: CASE WHEN (m >> CAST(j - 1 AS INT)) & 1 = 1 THEN x ELSE 0 END))  AS got FROM (SELECT *, unnest(range(1 << CAST(n AS INT))) AS m FROM l)) "
    "SELECT cat, n, @r(w) AS w, @r(avg(CASE WHEN got >= w THEN 1e0 ELSE 0e0 END)) AS p_value FROM s GROUP BY cat, n, w",
)
def signed_rank_test(spark, sf_dir):
    own = spark_sql(spark, sf_dir, "SELECT cat, round(avg(zv) - avg(zt), 1) AS d FROM @z GROUP BY cat, shot, seed")
    return bootstrap.signed_rank(own, ["cat"], "d").select("cat", "n", _r(F.col("w")).alias("w"), _r(F.col("p_value")).alias("p_value"))
