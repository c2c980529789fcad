"""Run catalogue queries in both engines and compare them; ``python -m tests.oracle SF_DIR [NAME...]`` prints misses."""

from __future__ import annotations

import math
import sys
import time


def rows_of(frame):
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or str(v) in ("<NA>", "NaT") or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        if hasattr(v, "item"):
            v = v.item()
        if type(v).__name__ == "Decimal":
            v = float(v)
        return round(float(v), 6) if isinstance(v, (int, float)) else str(v)

    return sorted((tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


def connect(sf_dir):
    import duckdb

    from orrery.plans.kit import TABLES

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def same(spark, con, sf_dir, run, sql):
    """Empty string, or what differs."""
    got, want = run(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    off = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    close = all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-6) for x, y in off for p, q in zip(x, y, strict=True))
    return f"{len(off)} rows differ{' (in the last digit)' if close else ''}, as {off[0]}" if off else ""


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    con, queries, sql = connect(sf_dir), e.queries(), e.oracle_sql()
    good = 0
    for name in names or [n for n in queries if not n.startswith("op") and n != "pipeline"]:
        t = time.time()
        try:
            said = same(spark, con, sf_dir, queries[name], sql[name]) if name in sql else f"(no SQL) {queries[name](spark, sf_dir).count()} rows"
        except Exception as ex:
            said = "FAIL " + str(ex).replace("\n", " ")[:330]
        good += not said or said.startswith("(no SQL)")
        if said or time.time() - t > 8:
            print(f"{name}: {said} [{time.time() - t:.1f} s]", flush=True)
    print(good, "good")
