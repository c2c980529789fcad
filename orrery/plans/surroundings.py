"""What surrounds a cell: wavelet energies of maps, and descriptors of cells that hold vectors.

Each embedding is a map of eight by eight cells; for vectors, 32 embeddings make a map of four by eight whose cells hold
the first eight dimensions."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions import vectors as fv
from orrery.operators import grid, wavelets
from orrery.plans.kit import VIEWS, frame, table

_SCALES, _WINDOW = 2, 2


def _r(x):
    return F.round(x, 6) + F.lit(0.0)


def _turned(i: str) -> str:
    return f"(CASE WHEN {i} < 0 THEN -1 - ({i}) WHEN {i} > 7 THEN 15 - ({i}) ELSE {i} END)"


def _haar(of: str, k: int) -> str:
    """A scale's four bands from the definition: all four cells of a pair of pairs, with their signs."""
    joins = f"JOIN {of} x ON x.vec_id = w.vec_id AND x.r = w.r AND x.c = (w.c + {k}) % 8 JOIN {of} y ON y.vec_id = w.vec_id AND y.r = (w.r + {k}) % 8 AND y.c = w.c JOIN {of} z ON z.vec_id = w.vec_id AND z.r = (w.r + {k}) % 8 AND z.c = (w.c + {k}) % 8"
    return f"SELECT w.vec_id, w.r, w.c, (w.a + x.a + y.a + z.a) / 2 AS a, (w.a + x.a - y.a - z.a) / 2 AS h, (w.a - x.a + y.a - z.a) / 2 AS v, (w.a - x.a - y.a + z.a) / 2 AS d FROM {of} w {joins}"


def _box(of: str, columns: str, first: int, last: int) -> str:
    means = ", ".join(f"avg({e}) AS {n}" for e, n in (c.split(":") for c in columns.split()))
    return f"SELECT t.vec_id, t.r, t.c, {means} FROM {of} t CROSS JOIN (SELECT unnest(range({first}, {last + 1})) AS i) a CROSS JOIN (SELECT unnest(range({first}, {last + 1})) AS j) b JOIN {of} s ON s.vec_id = t.vec_id AND s.r = {_turned('t.r + i')} AND s.c = {_turned('t.c + j')} GROUP BY t.vec_id, t.r, t.c"


@frame(
    "haar_energies", "A21",
    "WITH s0 AS MATERIALIZED (SELECT vec_id, r, c, s AS a FROM @cells), b0 AS MATERIALIZED (" + _haar("s0", 1) + "), b1 AS MATERIALIZED (" + _haar("b0", 2) + "), "
    + ", ".join(
        f"e{k} AS MATERIALIZED ({_box(f'b{k}', 's.h*s.h:h s.v*s.v:v s.d*s.d:d', -1, 0)}), t{k} AS (SELECT vec_id, r, c, h + v + d AS t FROM e{k}), w{k} AS ({_box(f't{k}', 's.t:t', -3, 2)}), "
        f"l{k} AS (SELECT e.vec_id, CAST(e.r // 2 AS INT) AS r, CAST(e.c // 2 AS INT) AS c, avg(ln(1e-8 + h)) AS h{k}, avg(ln(1e-8 + v)) AS v{k}, avg(ln(1e-8 + d)) AS d{k}, avg(ln(1e-8 + h) - ln(1e-8 + v)) AS hv{k}, avg(ln(1e-8 + d) - ln(1e-8 + h + v)) AS dhv{k}, avg(ln(1e-8 + h + v + d) - ln(1e-8 + w.t)) AS drop{k} "
        f"FROM e{k} e JOIN w{k} w ON w.vec_id = e.vec_id AND w.r = e.r AND w.c = e.c GROUP BY ALL)"
        for k in (0, 1)
    )
    + " SELECT vec_id, r, c, " + ", ".join(f"@r({n}{k}) AS {n}{k}" for n in ("h", "v", "d", "hv", "dhv", "drop") for k in (0, 1)) + " FROM l0 JOIN l1 USING (vec_id, r, c)",
)
def haar_energies(spark, sf_dir):
    images = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", F.abs).cast("array<double>").alias("pixels"))
    got = wavelets.haar_energies(images, (1, 8, 8), _SCALES, _WINDOW)
    order = ["h1", "v1", "d1", "h0", "v0", "d0", "hv1", "dhv1", "hv0", "dhv0", "drop1", "drop0"]
    return got.select(F.col("id").alias("vec_id"), "r", "c", *[_r(F.col("vec")[i]).alias(n) for i, n in enumerate(order)])


_PLACED = "SELECT vec_id // 32 AS map, CAST(vec_id // 8 % 4 AS INT) AS r, CAST(vec_id % 8 AS INT) AS c, vec_id, {v} AS u, count(*) OVER (PARTITION BY vec_id // 32) AS size FROM (SELECT vec_id, CAST(embedding AS DOUBLE[])[1:8] AS embedding FROM {{embeddings}}) t"
_DUCK_UNIT = "list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: y * y))))"
#: For the oracle only: cells of whole maps with their unit vectors.
VIEWS["placed"] = ("", "SELECT * FROM (" + _PLACED.format(v=_DUCK_UNIT) + ") p WHERE size = 32")


def _placed(spark, sf_dir):
    """Whole maps only: the last one may have too few cells to be one."""
    at = {n: F.expr(e) for n, e in (("map", "vec_id div 32"), ("r", "int(vec_id div 8 % 4)"), ("c", "int(vec_id % 8)"))}
    own = table(spark, sf_dir, "embeddings").select("vec_id", fv.normalised(F.slice("embedding", 1, 8)).alias("vec")).withColumns(at)
    return own.withColumn("size", F.count("*").over(Window.partitionBy("map"))).where("size = 32").drop("size")


@frame(
    "neighbour_contrast", "A14",
    "WITH o AS (SELECT * FROM (SELECT unnest(range(-2, 3)) AS i) a CROSS JOIN (SELECT unnest(range(-2, 3)) AS j) b WHERE i <> 0 OR j <> 0) "
    "SELECT t.vec_id, @r(avg(1 - list_dot_product(t.u, s.u))) AS contrast FROM @placed t CROSS JOIN o JOIN @placed s ON s.map = t.map AND s.r = least(greatest(t.r + i, 0), 3) AND s.c = least(greatest(t.c + j, 0), 7) GROUP BY t.vec_id",
)
def neighbour_contrast(spark, sf_dir):
    return grid.neighbour_contrast(_placed(spark, sf_dir), ["map"]).select("vec_id", _r(F.col("contrast")).alias("contrast"))


_MIRROR = "SELECT t.vec_id, i, j, t.u AS own, s.u AS u FROM @placed t CROSS JOIN (SELECT unnest(range(-1, 2)) AS i) a CROSS JOIN (SELECT unnest(range(-1, 2)) AS j) b JOIN @placed s ON s.map = t.map AND s.r = 3 - abs(3 - abs(t.r + i)) AND s.c = 7 - abs(7 - abs(t.c + j))"


@frame(
    "context_descriptors", "A15",
    f"WITH n AS ({_MIRROR}), x AS (SELECT vec_id, i, j, unnest(range(8)) AS p, unnest(own) AS x, unnest(u) AS y FROM n), "
    "m AS (SELECT vec_id, p, any_value(x) AS x, avg(CASE WHEN i <> 0 OR j <> 0 THEN y END) AS y, sum(CASE WHEN i = -1 AND j = 0 THEN y END) AS up, sum(CASE WHEN i = 1 AND j = 0 THEN y END) AS down, sum(CASE WHEN i = 0 AND j = -1 THEN y END) AS l, sum(CASE WHEN i = 0 AND j = 1 THEN y END) AS rt FROM x GROUP BY vec_id, p) "
    "SELECT vec_id, CAST(p AS INT) AS p, @r(x / sqrt(sum(x * x + y * y) OVER w)) AS own, @r(y / sqrt(sum(x * x + y * y) OVER w)) AS around, "
    + ", ".join(f"@r({e} / sqrt(sum(x * x + up * up + down * down + l * l + rt * rt) OVER w)) AS {n}" for e, n in (("up", "up"), ("down", "down"), ("l", "left_of"), ("rt", "right_of")))
    + " FROM m WINDOW w AS (PARTITION BY vec_id)",
)
def context_descriptors(spark, sf_dir):
    cells = _placed(spark, sf_dir)
    mean = grid.context_descriptor(cells, ["map"], "mean").withColumnRenamed("descriptor", "m")
    both = grid.context_descriptor(mean, ["map"], "sides")
    at = lambda v, k: _r(F.col(v)[F.col("p") + 8 * k])
    return both.select("vec_id", "m", "descriptor", F.explode(F.expr("sequence(0, 7)")).alias("p")).select(
        "vec_id", "p", at("m", 0).alias("own"), at("m", 1).alias("around"), *[at("descriptor", k + 1).alias(n) for k, n in enumerate(("up", "down", "left_of", "right_of"))]
    )
