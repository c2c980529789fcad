"""Stencils on score maps held as rows (keys, r, c, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions.vectors import normalised


def stencil(cells: DataFrame, keys: list[str], reach: int, what: dict[str, tuple[str, str]]) -> DataFrame:
    """Aggregates over the (2 reach + 1) square around each cell, cells outside the map left out.

    Separable: a range window along rows, then one along columns, so each map is sorted twice and never self-joined.
    ``what`` names results: (sum, count, min or max; column).
    """
    kinds = {"sum": (F.sum, F.sum), "count": (F.count, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}
    along = Window.partitionBy(*keys, "r").orderBy("c").rangeBetween(-reach, reach)
    down = Window.partitionBy(*keys, "c").orderBy("r").rangeBetween(-reach, reach)
    rows = cells.withColumns({f"__{k}": kinds[kind][0](col).over(along) for k, (kind, col) in what.items()})
    return rows.withColumns({k: kinds[kind][1](f"__{k}").over(down) for k, (kind, _) in what.items()}).drop(*[f"__{k}" for k in what])


def dilate(cells: DataFrame, keys: list[str], mask: str, name: str) -> DataFrame:
    """``mask`` dilated by the 4-neighbour cross."""
    along = Window.partitionBy(*keys, "r").orderBy("c").rangeBetween(-1, 1)
    down = Window.partitionBy(*keys, "c").orderBy("r").rangeBetween(-1, 1)
    return cells.withColumn(name, F.greatest(F.max(mask).over(along), F.max(mask).over(down)))


def _copies(at: str, size: int, reach: int, border: str) -> Column:
    """Where a row or column stands once the map is continued by ``reach`` beyond its borders."""
    i = F.col(at)
    if border == "edge":
        low, high = F.when(i == 0, F.lit(-reach)).otherwise(i), F.when(i == size - 1, F.lit(size - 1 + reach)).otherwise(i)
        return F.sequence(low.cast("int"), high.cast("int"))
    shift, least = {"symmetric": (1, 0), "mirror": (0, 1)}[border]
    before = F.when((i >= least) & (i < reach + least), -i - shift)
    after = F.when((i <= size - 1 - least) & (i > size - 1 - least - reach), 2 * size - 2 + shift - i)
    return F.filter(F.array(i, before, after), lambda x: x.isNotNull())


def bordered_stencil(cells: DataFrame, keys: list[str], shape: tuple[int, int], reach: int, border: str, what: dict[str, tuple[str, str]]) -> DataFrame:
    """``stencil`` with maps of ``shape`` continued beyond their borders: ``edge`` repeats the border cell, ``symmetric``
    turns back with it, ``mirror`` without it. Maps must be larger than ``reach`` for the last two. Maps are dealt out once,
    before they are continued, so that neither the copies nor the two windows need a shuffle."""
    padded = cells.repartition(*keys).withColumns({"__r": F.col("r"), "__c": F.col("c")})
    for at, size in (("r", shape[0]), ("c", shape[1])):
        padded = padded.withColumn("__at", F.explode(_copies(at, size, reach, border))).withColumn(at, F.col("__at")).drop("__at")
    got = stencil(padded, keys, reach, what)
    return got.where("r = __r and c = __c").drop("__r", "__c")


def _beside(vec: Column, window, step: int, border: str) -> Column:
    """The vector ``step`` cells on (before, if negative), the map continued beyond its border."""
    if border == "mirror":
        return F.coalesce(F.lead(vec, step).over(window), F.lead(vec, -step).over(window))
    towards = 1 if step > 0 else -1
    return F.coalesce(*[F.lead(vec, k).over(window) for k in range(step, 0, -towards)], vec)


def _along(keys: list[str]):
    return Window.partitionBy(*keys, "r").orderBy("c"), Window.partitionBy(*keys, "c").orderBy("r")


def vector_stencil(cells: DataFrame, keys: list[str], reach: int, border: str, name: str) -> DataFrame:
    """``name``: the sum of ``vec`` over the (2 reach + 1) square around each cell of whole maps (every row and column has a
    cell), continued by their border cell (``edge``) or turned back without it (``mirror``, reach 1 and two cells a side at
    least; else null). Vectors stay whole: two sorts a map, no row for each dimension."""
    if border == "mirror" and reach != 1:
        raise ValueError("mirrored vector stencils reach one cell")
    got = cells
    for source, result, window in zip(("vec", "__along"), ("__along", name), _along(keys), strict=True):
        parts = [_beside(F.col(source), window, k, border) for k in range(-reach, reach + 1) if k]
        got = got.withColumns({f"__{i}": p for i, p in enumerate(parts)})
        total = F.transform(F.col(source), lambda x, i: x + sum((F.col(f"__{k}")[i] for k in range(len(parts))), F.lit(0.0)))
        got = got.withColumn(result, total).drop(*[f"__{k}" for k in range(len(parts))])
    return got.drop("__along")


def neighbour_contrast(cells: DataFrame, keys: list[str], reach: int = 2) -> DataFrame:
    """``cells`` with contrast: the mean of one minus the cosine of a cell's unit ``vec`` with each other cell of the square
    around it. As cosines are linear, it takes one product with the neighbours' sum."""
    own = cells.withColumn("vec", F.col("vec").cast("array<double>"))
    got = vector_stencil(own, keys, reach, "edge", "__sum")
    product = F.aggregate(F.zip_with("vec", "__sum", lambda x, t: x * (t - x)), F.lit(0.0), lambda a, x: a + x)
    return got.withColumn("contrast", 1 - product / ((2 * reach + 1) ** 2 - 1)).drop("__sum")


def context_descriptor(cells: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """``cells`` with descriptor: the unit vector of a cell's ``vec`` followed by the mean of its eight neighbours (``mean``)
    or by the neighbours above, below, left and right (``sides``); maps turn back at their borders."""
    own = cells.withColumn("vec", F.col("vec").cast("array<double>"))
    if kind == "mean":
        got = vector_stencil(own, keys, 1, "mirror", "__sum")
        return got.withColumn("descriptor", normalised(F.concat("vec", F.zip_with("vec", "__sum", lambda x, t: (t - x) / 8)))).drop("__sum")
    if kind != "sides":
        raise ValueError("descriptors are of kind mean or sides")
    along, down = _along(keys)
    sides = {f"__{i}": _beside(F.col("vec"), w, k, "mirror") for i, (w, k) in enumerate(((down, -1), (down, 1), (along, -1), (along, 1)))}
    return own.withColumns(sides).withColumn("descriptor", normalised(F.concat("vec", *sides))).drop(*sides)
