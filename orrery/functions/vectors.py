"""Vector arithmetic as column expressions; elements are cast to double first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def sq_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def normalised(v: Column) -> Column:
    """Unit vector; a zero vector is an error."""

    def over(d: Column) -> Column:
        n = norm(d)
        checked = F.when(n > 0, n).otherwise(F.raise_error(F.lit("zero vector")).cast("double"))
        return let(checked, lambda m: F.transform(d, lambda x: x / m))

    return let(doubles(v), over)


def fused(a: Column, b: Column, weight: float = 0.5) -> Column:
    """Unit vector of two encoders' unit vectors, weighted and joined end to end."""
    left = F.transform(normalised(a), lambda x: x * weight)
    return normalised(F.concat(left, F.transform(normalised(b), lambda x: x * (1 - weight))))


def quantised(v: Column) -> Column:
    """int8 codes and their scale: value = code * scale; halves go to even."""

    def over(d: Column) -> Column:
        scale = F.array_max(F.transform(d, F.abs)) / 127.0
        return let(scale, lambda s: F.struct(F.transform(d, lambda x: F.bround(x / s, 0).cast("tinyint")).alias("codes"), s.alias("scale")))

    return let(doubles(v), over)
