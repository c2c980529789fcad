"""Readers and writers: Parquet, CSV, JSON manifests, and NumPy archives."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON category -> seed -> shot -> [path] to one row a path with its place."""
    raw = spark.read.text(path, wholetext=True)
    kind = "map<string,map<string,map<string,array<string>>>>"
    return (
        raw.select(F.explode(F.from_json("value", kind)).alias("category", "x")).select("category", F.explode("x").alias("seed", "x"))
        .select("category", F.col("seed").cast("int").alias("seed"), F.explode("x").alias("shot", "x"))
        .select("category", "seed", F.col("shot").cast("int").alias("shot"), F.posexplode("x").alias("ord", "path"))
    )


def read_arrays(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Array ``name`` of every .npz file, one row an item along its first axis: file, item, shape, values (flattened)."""

    def load(frames):
        for pdf in frames:
            for file, raw in zip(pdf["path"], pdf["content"], strict=True):
                a = np.load(io.BytesIO(raw), allow_pickle=False)[name]
                yield pd.DataFrame({"file": file, "item": range(len(a)), "shape": [list(a.shape[1:])] * len(a), "values": [x.ravel().astype(float) for x in a]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInPandas(load, "file string, item long, shape array<long>, values array<double>")


def to_cells(maps: DataFrame, keys: list[str], values: str, width: int) -> DataFrame:
    """Flattened maps to rows (keys, p, r, c, s)."""
    own = maps.select(*keys, F.posexplode(values).alias("p", "s"))
    return own.select(*keys, "p", F.expr(f"p div {width}").alias("r"), (F.col("p") % width).alias("c"), F.col("s").cast("double").alias("s"))


def write_scores(df: DataFrame, path: str, by: list[str], provenance: dict[str, str] | None = None) -> None:
    """Partitioned Parquet with provenance columns."""
    for k, v in (provenance or {}).items():
        df = df.withColumn(k, F.lit(v))
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def read_runs(spark: SparkSession, path: str, schema: str, pattern: str = r"/([^/]+)_seed_(\d+)_shot_(\d+)/") -> DataFrame:
    """CSV reports of many runs in one scan; method, seed and shot come from the folder's name. Files elsewhere are left
    out."""
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).schema(schema).csv(path).withColumn("file", F.col("_metadata.file_path"))
    keys = [F.regexp_extract("file", pattern, k + 1).cast(kind).alias(name) for k, (name, kind) in enumerate((("method", "string"), ("seed", "int"), ("shot", "int")))]
    return rows.where(F.col("file").rlike(pattern)).select(*keys, *[c for c in rows.columns if c != "file"])


def macro_rows(runs: DataFrame) -> DataFrame:
    """The rows that hold a run's macro mean."""
    return runs.where(F.col("category") == "macro_mean")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank ones are skipped, one that does not parse fails the query and is named in the error."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    row = raw.select("value", F.from_json("value", schema).alias("row"))
    bad = F.raise_error(F.concat(F.lit("not JSON: "), F.substring("value", 1, 80)))
    return row.select(F.when(F.try_parse_json("value").isNotNull(), F.col("row")).otherwise(bad).alias("row")).select("row.*")


def write_partial(df: DataFrame, path: str, unit: str) -> None:
    """Results unit by unit as JSON lines; a unit that is written again replaces its own part only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(unit).json(path)


def index_images(spark: SparkSession, path: str, pattern: str = r"/([^/]+)/test/([^/]+)/([^/]+)\.png$") -> DataFrame:
    """category, defect, stem and path of every test image by its folders; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(path).select("path")
    return files.where(F.col("path").rlike(pattern)).select(*[F.regexp_extract("path", pattern, k + 1).alias(c) for k, c in enumerate(("category", "defect", "stem"))], "path")
