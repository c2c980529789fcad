"""Contracts on tables: checks that are aggregates, and guards on schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns that scoring functions must not see.
LABEL_COLUMNS = ("gt_sp", "imgs_masks", "labels", "pixel_gt", "gt_masks")


def not_finite(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def report(df: DataFrame, ids: list[str], finite: list[str] | None = None, between: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """One row: rows, repeated ids, values that are not finite, values out of range; one pass over the table."""
    own = df.groupBy(*ids).agg(
        F.count("*").alias("n"),
        F.sum(sum((F.when(not_finite(F.col(c).cast("double")), 1).otherwise(0) for c in finite or []), F.lit(0))).alias("bad"),
        F.sum(sum((F.when(F.col(c).between(*x), 0).otherwise(1) for c, x in (between or {}).items()), F.lit(0))).alias("out"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return own.agg(total("n").alias("n"), total(F.col("n") - 1).alias("repeated_ids"), total("bad").alias("not_finite"), total("out").alias("out_of_range"))


def checked(df: DataFrame, what: Column, message: str) -> DataFrame:
    """``df``, which fails when read if a row breaks the condition."""
    return df.where(F.when(what, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def without_labels(df: DataFrame, banned: tuple[str, ...] = LABEL_COLUMNS) -> DataFrame:
    """``df`` itself, or an error if it has a column that carries ground truth."""
    found = sorted(set(df.columns) & set(banned))
    if found:
        raise ValueError(f"label columns in the input: {found}")
    return df


def min_views(reference: DataFrame, source: str, least: int) -> DataFrame:
    """Sources with fewer than ``least`` reference views."""
    return reference.groupBy(source).agg(F.count("*").alias("views")).where(F.col("views") < least)


def assert_role(dataset: str, allowed: tuple[str, ...]) -> str:
    """``dataset``, or an error where it must not be used for this (tuning, or frozen validation)."""
    if dataset not in allowed:
        raise ValueError(f"{dataset} is not one of {', '.join(allowed)}")
    return dataset


def require_manifest(spark, path: str) -> DataFrame:
    """The frozen manifest at ``path``; nothing may run without one."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        raise FileNotFoundError(f"no frozen manifest at {path}")
    return spark.read.option("multiLine", True).json(path)
