"""Mixtures of spatial bins: each map of embeddings gives sixteen patches of two by two cells."""

from pyspark.sql import functions as F

from orrery.operators import mixtures
from orrery.plans.kit import VIEWS, frame, spark_sql

STEPS, K, REG = 3, 3, 1e-4
_PATCH = "SELECT vec_id, label, p, (p {div} 16) * 4 + (p % 8) {div} 2 AS bin, (p {div} 8) % 2 * 2 + p % 2 AS q, s FROM @cells"
VIEWS["patch"] = (_PATCH.replace("{div}", "div"), _PATCH.replace("{div}", "//"))


def _r(x):
    return F.round(x, 6) + F.lit(0.0)


def _steps() -> str:
    """CTEs of the models m0 .. mSTEPS, written from the formulas: responsibilities, then moments under them."""
    moments = "SELECT bin, k, q, sum(w) AS n, sum(w * s) / sum(w) AS mean, sum(w * s * s) / sum(w) - power(sum(w * s) / sum(w), 2) + {reg} AS var FROM {of} GROUP BY bin, k, q"
    model = "SELECT bin, k, q, mean, var, n / sum(n) OVER (PARTITION BY bin, q) AS share FROM (" + moments + ") t"
    out = [
        f"b AS (SELECT vec_id, bin, CAST(floor(5 * sum(s)) AS BIGINT) % {K} AS k FROM @patch WHERE vec_id % 5 = 0 GROUP BY vec_id, bin)",
        "f AS (SELECT p.bin, p.vec_id, p.q, p.s, b.k, 1e0 AS w FROM @patch p JOIN b ON b.vec_id = p.vec_id AND b.bin = p.bin)",
        "m0 AS MATERIALIZED (" + model.format(reg=REG, of="f") + ")",
    ]
    for i in range(STEPS):
        out.append(f"j{i} AS ({_joint(f'm{i}', 'p.vec_id % 5 = 0')})")
        out.append(f"r{i} AS (SELECT vec_id, bin, k, exp(l - max(l) OVER v) / sum(exp(l - mx)) OVER v AS w FROM (SELECT *, max(l) OVER (PARTITION BY vec_id, bin) AS mx FROM j{i}) t WINDOW v AS (PARTITION BY vec_id, bin))")
        out.append(f"f{i} AS (SELECT p.bin, p.vec_id, p.q, p.s, r.k, r.w FROM @patch p JOIN r{i} r ON r.vec_id = p.vec_id AND r.bin = p.bin)")
        out.append(f"m{i + 1} AS MATERIALIZED (" + model.format(reg=REG, of=f"f{i}") + ")")
    return ", ".join(out)


def _joint(model: str, which: str) -> str:
    return f"SELECT p.vec_id, p.bin, m.k, any_value(ln(m.share)) - 0.5 * sum(power(p.s - m.mean, 2) / m.var + ln(2 * pi() * m.var)) AS l FROM @patch p JOIN {model} m ON m.bin = p.bin AND m.q = p.q WHERE {which} GROUP BY p.vec_id, p.bin, m.k"


@frame(
    "spatial_mixture", "L32",
    f"WITH {_steps()}, j AS ({_joint(f'm{STEPS}', 'p.vec_id % 5 <> 0')}), t AS (SELECT vec_id, bin, l, max(l) OVER (PARTITION BY vec_id, bin) AS mx FROM j), "
    "u AS (SELECT vec_id, bin, l, mx, sum(exp(l - mx)) OVER (PARTITION BY vec_id, bin) AS z FROM t) "
    "SELECT vec_id, bin, @r(-any_value(mx + ln(z))) AS nll, @r(-sum(exp(l - mx) / z * ln(greatest(exp(l - mx) / z, 1e-12)))) AS entropy FROM u GROUP BY vec_id, bin",
)
def spatial_mixture(spark, sf_dir):
    patch = spark_sql(spark, sf_dir, "SELECT * FROM @patch").groupBy("vec_id", "bin").agg(F.transform(F.sort_array(F.collect_list(F.struct("q", "s"))), lambda x: x["s"]).alias("vec"))
    patch = patch.withColumn("id", F.col("vec_id") * 16 + F.col("bin"))
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    model = mixtures.fit(patch.where("vec_id % 5 = 0"), "bin", F.floor(5 * total), K, REG, STEPS, tol=-1)
    got = mixtures.score(patch.where("vec_id % 5 <> 0"), "bin", model)
    return got.select(F.expr("id div 16").alias("vec_id"), (F.col("id") % 16).alias("bin"), _r(F.col("nll")).alias("nll"), _r(F.col("entropy")).alias("entropy"))
