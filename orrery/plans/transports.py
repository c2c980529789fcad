"""Transport between the cells of each label's mean map and those of the mean map of all; the SQL writes out the steps."""

from pyspark.sql import functions as F

from orrery.operators import transport
from orrery.plans.kit import frame, spark_sql

EPS, TAU, STEPS = 0.05, 0.5, 4
_COST = "SELECT x.label, x.p AS i, y.p AS j, abs(x.{a} - y.{a}) * {k} AS c FROM (SELECT label, p, avg(s) AS u, avg(s * s) AS w FROM @cells GROUP BY label, p) x CROSS JOIN (SELECT p, avg(s) AS u, avg(s * s) AS w FROM @cells GROUP BY p) y"
_U, _W = _COST.format(a="u", k=4), _COST.format(a="w", k=20)


def _r(x):
    return F.round(x, 6) + F.lit(0.0)


def _steps(name: str, cost: str, steps: int, alpha: float = 1.0, damp: float = 1.0) -> str:
    """CTEs <name>_b<k> (potentials after k steps) and <name>_s (shares with their costs)."""
    out = [f"{name}_b0 AS (SELECT DISTINCT label, j, 0e0 AS b FROM {cost})"]
    shared = f"SELECT c.label, i, c.j, c.c, exp(-c.c / {EPS} + b) / sum(exp(-c.c / {EPS} + b)) OVER (PARTITION BY c.label, i) AS share, b FROM {cost} c JOIN {name}_b{{k}} p ON p.label = c.label AND p.j = c.j"
    for k in range(steps):
        out.append(f"{name}_b{k + 1} AS MATERIALIZED (SELECT label, j, any_value(b) + {damp} * (-{alpha} * (ln(sum(share) / 64) - any_value(b) - ln(1 / 64e0)) - any_value(b)) AS b FROM ({shared.format(k=k)}) q GROUP BY label, j)")
    out.append(f"{name}_s AS MATERIALIZED ({shared.format(k=steps)})")
    return ", ".join(out)


@frame("sinkhorn_log", "L15 L14", f"WITH c AS MATERIALIZED ({_U}), {_steps('u', 'c', STEPS)} SELECT label, i AS row, @r(sum(share * c)) AS cost, @r(max(share)) AS most FROM u_s GROUP BY label, i")
def sinkhorn_log(spark, sf_dir):
    got = transport.plan(spark_sql(spark, sf_dir, _U), ["label"], "i", "j", "c", EPS, STEPS, tol=-1)
    return got.groupBy("label", "row").agg(_r(F.sum(F.col("share") * F.col("c"))).alias("cost"), _r(F.max("share")).alias("most"))


_OFF = "SELECT c.label, c.i, c.j, least(greatest(c.c + 0.1 * 0.5 * (ln(greatest({a}.share / 64, 1e-12)) - ln(greatest((greatest(u_s.share / 64, 1e-12) + greatest(w_s.share / 64, 1e-12)) / 2, 1e-12))), 0), 50) AS c FROM {x} c JOIN u_s ON u_s.label = c.label AND u_s.i = c.i AND u_s.j = c.j JOIN w_s ON w_s.label = c.label AND w_s.i = c.i AND w_s.j = c.j"


@frame(
    "coupled_transport", "L16",
    f"WITH cu AS MATERIALIZED ({_U}), cw AS MATERIALIZED ({_W}), {_steps('u', 'cu', 2)}, {_steps('w', 'cw', 2)}, du AS MATERIALIZED ({_OFF.format(a='u_s', x='cu')}), dw AS MATERIALIZED ({_OFF.format(a='w_s', x='cw')}), "
    f"{_steps('v', 'du', 2)}, {_steps('z', 'dw', 2)}, "
    + ", ".join(f"r{k} AS (SELECT c.label, c.i, sum({s}.share * c.c) AS m, min(c.c) AS least FROM {x} c JOIN {s} ON {s}.label = c.label AND {s}.i = c.i AND {s}.j = c.j GROUP BY c.label, c.i)" for k, (s, x) in enumerate((("u_s", "cu"), ("w_s", "cw"), ("v_s", "cu"), ("z_s", "cw"))))
    + " SELECT r0.label, r0.i AS row, @r(r0.least) AS free, @r((r0.m + r1.m) / 2) AS apart, @r((r2.m + r3.m) / 2) AS together FROM r0 JOIN r1 ON r1.label = r0.label AND r1.i = r0.i JOIN r2 ON r2.label = r0.label AND r2.i = r0.i JOIN r3 ON r3.label = r0.label AND r3.i = r0.i",
)
def coupled_transport(spark, sf_dir):
    a, b = spark_sql(spark, sf_dir, _U), spark_sql(spark, sf_dir, _W)
    how = {"iterations": 2, "tol": -1}
    apart = [transport.row_costs(transport.plan(x, ["label"], "i", "j", "c", EPS, **how), ["label"], n) for x, n in ((a, "ma"), (b, "mb"))]
    together = [transport.row_costs(x, ["label"], n) for x, n in zip(transport.coupled(a, b, ["label"], "i", "j", "c", EPS, 0.1, 1, **how), ("ta", "tb"), strict=True)]
    got = a.groupBy("label", F.col("i").cast("long").alias("row")).agg(F.min("c").alias("free"))
    for x in (*apart, *together):
        got = got.join(x, ["label", "row"])
    return got.select("label", "row", _r(F.col("free")).alias("free"), _r((F.col("ma") + F.col("mb")) / 2).alias("apart"), _r((F.col("ta") + F.col("tb")) / 2).alias("together"))


@frame(
    "capacity_premium", "L18 L17",
    f"WITH c AS MATERIALIZED ({_U}), {_steps('p', 'c', STEPS, TAU / (EPS + TAU), 0.5)}, {_steps('f', 'c', 0)}, "
    "a AS (SELECT label, i, sum(share * c) AS cost FROM p_s GROUP BY label, i), b AS (SELECT label, i, sum(share * c) AS free_cost FROM f_s GROUP BY label, i) "
    "SELECT a.label, a.i AS row, @r(cost) AS cost, @r(free_cost) AS free_cost, @r(cost - free_cost) AS premium FROM a JOIN b ON a.label = b.label AND a.i = b.i",
)
def capacity_premium(spark, sf_dir):
    got = transport.capacity_premium(spark_sql(spark, sf_dir, _U), ["label"], "i", "j", "c", EPS, TAU, iterations=STEPS, tol=-1)
    return got.select("label", "row", *[_r(F.col(c)).alias(c) for c in ("cost", "free_cost", "premium")])
