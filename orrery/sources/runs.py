"""Audit of a matrix of runs: every fault is a row, nothing stops the audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN = r"/([^/]+)/([^/]+)$"


def _texts(spark: SparkSession, root: str, name: str, whole: bool) -> DataFrame:
    """run and text of every file of this name (a line a row, unless ``whole``)."""
    own = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=whole)
    return own.select(F.regexp_extract(F.col("_metadata.file_path"), _RUN, 1).alias("run"), F.col("value").alias("text"))


def audit(
    spark: SparkSession, root: str, expected: DataFrame, required: Sequence[str], report: str, report_checks: Mapping[str, Column],
    row_counts: Mapping[str, int], summary: str, metrics: Sequence[str],
) -> DataFrame:
    """run, fault: what is wrong with the ``expected`` runs (column run), whose files are in folders of their names anywhere
    below ``root``. Folder names of runs must be unique.

    Faults: ``missing <file>`` for each of ``required`` (such a run is not looked into further); ``unreadable <report>``
    where the JSON report does not parse; ``check <name>`` where one of ``report_checks`` (a condition on the variant
    ``report``) is not true, null included; ``rows of <file>`` where a CSV file has not so many rows under its header;
    ``field <metric>`` where the one-row ``summary`` has no such column; ``finite <metric>`` where its value is no finite
    number. Fields of CSV files must not hold line breaks, nor those of the summary commas. A run without faults has no row;
    files of runs that are not expected are left out.
    """
    names = expected.select("run").distinct()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    found = found.select(F.regexp_extract("path", _RUN, 1).alias("run"), F.regexp_extract("path", _RUN, 2).alias("file")).distinct()
    needed = names.select("run", F.explode(F.array(*[F.lit(f) for f in required])).alias("file"))
    missing = needed.join(found, ["run", "file"], "left_anti").select("run", F.concat(F.lit("missing "), "file").alias("fault"))
    whole = names.join(missing.select("run").distinct(), "run", "left_anti")

    parsed = whole.join(_texts(spark, root, report, True), "run").select("run", F.try_parse_json("text").alias("report"))
    failed = F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(f"check {n}")) for n, c in report_checks.items()])
    faults = F.when(F.col("report").isNull(), F.array(F.lit(f"unreadable {report}"))).otherwise(F.array_compact(failed))
    parts = [missing, parsed.select("run", F.explode(faults).alias("fault"))]

    for file, n in row_counts.items():
        lines = _texts(spark, root, file, False).where(F.trim("text") != "").groupBy("run").agg(F.count("*").alias("n"))
        own = whole.join(lines, "run", "left").where(F.coalesce("n", F.lit(0)) != n + 1)
        parts.append(own.select("run", F.lit(f"rows of {file}").alias("fault")))

    lines = F.filter(F.split(F.col("text"), r"\r?\n"), lambda x: F.trim(x) != "")
    fields = lambda i: F.transform(F.split(F.get(lines, F.lit(i)), ","), lambda x: F.trim(x))
    told = whole.join(_texts(spark, root, summary, True), "run").select("run", fields(0).alias("heads"), fields(1).alias("values"))
    value = lambda m: F.get("values", F.array_position("heads", m).cast("int") - 1).try_cast("double")
    finite = lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    each = [F.when(~F.coalesce(F.array_contains("heads", m), F.lit(False)), F.lit(f"field {m}")).when(~finite(value(m)), F.lit(f"finite {m}")) for m in metrics]
    parts.append(told.select("run", F.explode(F.array_compact(F.array(*each))).alias("fault")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
