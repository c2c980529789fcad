"""Affine resampling of maps."""

from pyspark.sql import functions as F

from orrery.operators import warp
from orrery.plans.kit import frame, spark_sql

SHAPE, MATRIX = (8, 8), [[0.9, -0.2, 1.4], [0.1, 1.05, -0.6]]
_AT = "SELECT vec_id, p, s, 0.9 * c - 0.2 * r + 1.4 / 2 AS x, 0.1 * c + 1.05 * r - 0.6 / 2 AS y FROM @cells"


def _r(x):
    return F.round(x, 6) + F.lit(0.0)


def _sampled(at: str) -> str:
    """Written from the formula: the weight of every cell is the product of its nearness in both directions."""
    near = lambda a, b: f"greatest(0, 1 - abs({a} - {b}))"
    return f"SELECT t.vec_id, t.p, sum(b.s * {near('b.c', 't.x')} * {near('b.r', 't.y')}) AS v FROM ({at}) t JOIN @cells b ON b.vec_id = t.vec_id AND abs(b.c - t.x) < 1 AND abs(b.r - t.y) < 1 GROUP BY t.vec_id, t.p"


_MOVED = f"SELECT vec_id, p, s, least(greatest(x, 0), 7) AS x, least(greatest(y, 0), 7) AS y FROM ({_AT}) q"
_INSIDE = f"SELECT * FROM ({_AT}) q WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7"


def _cells(spark, sf_dir):
    return spark_sql(spark, sf_dir, "SELECT vec_id, p, s FROM @cells")


@frame("inverse_warp_edge", "A27 A28", f"SELECT vec_id, p, @r(v) AS v FROM ({_sampled(_MOVED)}) z")
def inverse_warp_edge(spark, sf_dir):
    return warp.inverse_warp(_cells(spark, sf_dir), ["vec_id"], SHAPE, MATRIX, ["s"], stride=2.0, edge=True).select("vec_id", "p", _r(F.col("s")).alias("v"))


@frame("inverse_warp_valid", "A11", f"SELECT c.vec_id, c.p, @r(v) AS v, CAST(v IS NOT NULL AS INT) AS valid FROM @cells c LEFT JOIN ({_sampled(_INSIDE)}) z ON z.vec_id = c.vec_id AND z.p = c.p")
def inverse_warp_valid(spark, sf_dir):
    got = warp.inverse_warp(_cells(spark, sf_dir), ["vec_id"], SHAPE, MATRIX, ["s"], stride=2.0)
    return got.select("vec_id", "p", _r(F.col("s")).alias("v"), F.col("valid").cast("int").alias("valid"))


@frame("compensated_grid", "V29", f"SELECT c.vec_id, c.p, @r(s + 0.25 * greatest(0, coalesce(v - s, 0))) AS fused FROM @cells c LEFT JOIN ({_sampled(_INSIDE)}) z ON z.vec_id = c.vec_id AND z.p = c.p")
def compensated_grid(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    placed = warp.inverse_warp(cells.withColumnRenamed("s", "placed"), ["vec_id"], SHAPE, MATRIX, ["placed"], stride=2.0)
    got = warp.compensated(cells.join(placed, ["vec_id", "p"]), ["vec_id"], "s", "placed")
    return got.select("vec_id", "p", _r(F.col("fused")).alias("fused"))
