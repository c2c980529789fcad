"""A made matrix of runs, each with one fault."""

import json

from pyspark.sql import functions as F

from orrery.sources import runs

REPORT = {"score_direction": "higher", "category_count": 2}


def made(root, run, report=None, rows=2, summary="f1, ap\n0.5,0.25\n", skip=()):
    folder = root / "deep" / run
    folder.mkdir(parents=True)
    for name, text in (("report.json", json.dumps(REPORT) if report is None else report), ("rows.csv", "c,v\n" + "x,1\n" * rows), ("summary.csv", summary)):
        if name not in skip:
            (folder / name).write_text(text)


def test_each_fault_is_a_row(spark, tmp_path):
    made(tmp_path, "good")
    made(tmp_path, "lacks", skip=("rows.csv", "summary.csv"))
    made(tmp_path, "torn", report='{"score_')
    made(tmp_path, "turned", report=json.dumps(REPORT | {"score_direction": "lower"}))
    made(tmp_path, "silent", report="{}")
    made(tmp_path, "short", rows=1)
    made(tmp_path, "infinite", summary="f1,ap\r\ninf,NaN\r\n")
    made(tmp_path, "worded", summary="f1\nmany\n")
    made(tmp_path, "bare", summary="f1,ap\n")
    made(tmp_path, "unasked", rows=9)
    expected = spark.createDataFrame([(r,) for r in ("good", "lacks", "torn", "turned", "silent", "short", "infinite", "worded", "bare", "absent")], "run string")
    checks = {"direction": F.expr("try_variant_get(report, '$.score_direction', 'string') = 'higher'"), "categories": F.expr("try_variant_get(report, '$.category_count', 'int') = 2")}
    files = ["report.json", "rows.csv", "summary.csv"]
    got = runs.audit(spark, str(tmp_path), expected, files, "report.json", checks, {"rows.csv": 2}, "summary.csv", ["f1", "ap"]).collect()
    assert sorted((r["run"], r["fault"]) for r in got) == sorted(
        [("lacks", "missing rows.csv"), ("lacks", "missing summary.csv"), *[("absent", f"missing {f}") for f in files], ("torn", "unreadable report.json"), ("turned", "check direction")]
        + [("silent", "check direction"), ("silent", "check categories"), ("short", "rows of rows.csv"), ("infinite", "finite f1"), ("infinite", "finite ap")]
        + [("worded", "finite f1"), ("worded", "field ap"), ("bare", "finite f1"), ("bare", "finite ap")]
    )
