"""Alignment of two tables on canonical ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(id_: Column) -> Column:
    """Lower case, forward slashes, no outer blanks, ``#`` as ``-``."""
    return F.lower(F.replace(F.replace(F.trim(id_), F.lit("\\"), F.lit("/")), F.lit("#"), F.lit("-")))


def audit(left: DataFrame, right: DataFrame, id_: str) -> DataFrame:
    """One row: canonical ids that repeat on a side, that the other side lacks, and whether the join is one to one."""
    a, b = (df.groupBy(canonical(F.col(id_)).alias("cid")).agg(F.count("*").alias(n)) for df, n in ((left, "na"), (right, "nb")))
    met = a.join(b, "cid", "full_outer")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias
    out = met.agg(
        count(F.col("na") > 1)("duplicated_left"), count(F.col("nb") > 1)("duplicated_right"), count(F.col("nb").isNull())("missing_right"), count(F.col("na").isNull())("extra_right")
    )
    return out.withColumn("one_to_one", F.expr("duplicated_left + duplicated_right + missing_right + extra_right = 0"))


def strict_join(left: DataFrame, right: DataFrame, id_: str) -> DataFrame:
    """Inner join on the canonical id that fails when it is not one to one; the failure is raised by the query itself,
    so nothing is collected to find it."""
    a, b = left.withColumn("cid", canonical(F.col(id_))), right.withColumn("cid", canonical(F.col(id_))).drop(id_)
    count_a, count_b = a.groupBy("cid").agg(F.count("*").alias("__na")), b.groupBy("cid").agg(F.count("*").alias("__nb"))
    counts = count_a.join(count_b, "cid", "full_outer")
    ok = F.coalesce(F.col("__na") == 1, F.lit(False)) & F.coalesce(F.col("__nb") == 1, F.lit(False))
    checked = counts.withColumn("__ok", F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not one to one: "), F.col("cid"))).cast("boolean")))
    return a.join(b, "cid").join(checked.where("__ok").select("cid"), "cid")


def superset_join(left: DataFrame, right: DataFrame, id_: str) -> DataFrame:
    """Rows of ``left`` in full; rows of ``right`` that it lacks are left out silently."""
    b = right.withColumn("cid", canonical(F.col(id_))).drop(id_)
    return left.withColumn("cid", canonical(F.col(id_))).join(b, "cid", "left")


def shuffled_pairs(left: DataFrame, right: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Negative control: rows paired by rank, one side in the order of a hash. Both marginals stay as they are."""
    from pyspark.sql.window import Window

    a = left.withColumn("__k", F.row_number().over(Window.orderBy(key)))
    b = right.withColumn("__k", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), key), key))).drop(key)
    return a.join(b, "__k").drop("__k")
