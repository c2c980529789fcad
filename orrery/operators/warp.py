"""Affine resampling of maps: each cell takes the four cells around the place that it comes from.

Where a cell comes from, and with which weights, follows from the shape and the matrix alone: a table of at most four
rows a cell of one map, whatever the number of maps. Cells are joined with it by their place and added up by map and
target, so a map may be larger than a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the table of weights that are sent to every executor; larger tables are joined.
BROADCAST_ROWS = 200_000


def weights(spark: SparkSession, shape: tuple[int, int], matrix: list[list[float]], stride: float = 1.0, edge: bool = False) -> DataFrame:
    """to, p, w: the cell at row r and column c takes from column ``(m00 c + m01 r) + m02 / stride`` and row
    ``(m10 c + m11 r) + m12 / stride``, between the cells there in proportion. Places outside the map are moved to its
    border with ``edge``, else their cells have no rows."""
    h, w = shape
    (a, b, x0), (c, d, y0) = matrix
    own = spark.range(h * w).select(F.col("id").alias("to"), F.expr(f"id div {w}").cast("double").alias("r"), (F.col("id") % w).cast("double").alias("c"))
    x, y = a * F.col("c") + b * F.col("r") + x0 / stride, c * F.col("c") + d * F.col("r") + y0 / stride
    if edge:
        x, y = F.least(F.greatest(x, F.lit(0.0)), F.lit(w - 1.0)), F.least(F.greatest(y, F.lit(0.0)), F.lit(h - 1.0))
    own = own.select("to", x.alias("x"), y.alias("y")).where((F.col("x") >= 0) & (F.col("x") <= w - 1) & (F.col("y") >= 0) & (F.col("y") <= h - 1))
    fx, fy = F.col("x") - F.floor("x"), F.col("y") - F.floor("y")
    place = lambda i, j: (F.floor("y") + i) * w + F.floor("x") + j
    corners = [F.struct(place(i, j).cast("long").alias("p"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("w")) for i in (0, 1) for j in (0, 1)]
    return own.select("to", F.inline(F.array(*corners))).where("w > 0")  # a corner outside the map has no weight


def inverse_warp(cells: DataFrame, keys: list[str], shape: tuple[int, int], matrix: list[list[float]], values: list[str], stride: float = 1.0, edge: bool = False) -> DataFrame:
    """keys, p, values, valid for every cell: the resampled values, null where the place they come from is outside the
    map (and ``edge`` is off), or where a cell that they take from is missing or null."""
    got = weights(cells.sparkSession, shape, matrix, stride, edge)
    got = F.broadcast(got) if 4 * shape[0] * shape[1] <= BROADCAST_ROWS else got
    own = cells.select(*keys, F.col("p").cast("long").alias("p"), *values).join(got, "p")
    full = F.abs(F.sum("w") - 1) < 1e-9
    taken = own.groupBy(*keys, "to").agg(*[F.when(full & (F.count(v) == F.count("*")), F.sum(F.col("w") * F.col(v))).alias(v) for v in values], full.alias("valid"))
    rest = cells.select(*keys, F.col("p").cast("long").alias("to")).join(taken, [*keys, "to"], "left")
    return rest.select(*keys, F.col("to").alias("p"), *values, F.coalesce("valid", F.lit(False)).alias("valid"))


def compensated(cells: DataFrame, keys: list[str], score: str, placed: str, weight: float = 0.25) -> DataFrame:
    """``cells`` with fused: the score, and ``weight`` times what the score at the place where the alignment looks
    (``placed``) lies above it; without an alignment (null) the score alone."""
    return cells.withColumn("fused", F.col(score) + weight * F.greatest(F.lit(0.0), F.coalesce(F.col(placed) - F.col(score), F.lit(0.0))))
