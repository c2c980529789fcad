"""One query text for two engines: Spark SQL runs it, and the same text in DuckDB's dialect checks it.

Texts use a few marks that differ between the engines: ``//`` integer division, ``@q(x; p)`` a linear quantile,
``@r(x)`` rounding to six digits without negative zero, ``@sha(x)`` SHA-256, and ``@name`` for the shared views.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Shared views: (Spark text, DuckDB text or None where the first serves both).
VIEWS: dict[str, tuple[str, str | None]] = {
    "ev": (
        "SELECT event_id, event_type AS cat, user_id, ts, CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS ref, user_id % 3 AS seed, "
        "CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS shot, value AS vis, sqrt(greatest(value, 0)) * 20 AS txt FROM {events}",
        None,
    ),
    "med": ("SELECT cat, median(vis) AS mv, median(txt) AS mt FROM @ev WHERE ref = 1 GROUP BY cat", None),
    "cal": (
        "SELECT e.cat, any_value(mv) AS cv, any_value(mt) AS ct, greatest(1.4826 * median(abs(vis - mv)), 0.000001) AS sv, "
        "greatest(1.4826 * median(abs(txt - mt)), 0.000001) AS st FROM @ev e JOIN @med m ON e.cat = m.cat WHERE ref = 1 GROUP BY e.cat",
        None,
    ),
    "z": (
        "SELECT e.event_id, e.cat, e.seed, e.shot, e.user_id, e.vis, e.txt, (vis - cv) / sv AS zv, (txt - ct) / st AS zt "
        "FROM @ev e JOIN @cal c ON e.cat = c.cat WHERE ref = 0",
        None,
    ),
    "cells": (
        "SELECT vec_id, label, p, p div 8 AS r, p % 8 AS c, abs(CAST(x AS DOUBLE)) AS s, CASE WHEN label IN (3, 7, 9) AND (vec_id * 7 + p) % 11 = 0 THEN 1 ELSE 0 END AS m "
        "FROM (SELECT vec_id, label, posexplode(embedding) AS (p, x) FROM {embeddings})",
        "SELECT vec_id, label, p, p // 8 AS r, p % 8 AS c, abs(CAST(x AS DOUBLE)) AS s, CASE WHEN label IN (3, 7, 9) AND (vec_id * 7 + p) % 11 = 0 THEN 1 ELSE 0 END AS m "
        "FROM (SELECT vec_id, label, unnest(range(64)) AS p, unnest(embedding) AS x FROM {embeddings})",
    ),
    "img": ("SELECT vec_id, label, max(s) AS peak, avg(s) AS mean, CASE WHEN label IN (3, 7, 9) THEN 1 ELSE 0 END AS y FROM @cells GROUP BY vec_id, label", None),
    "doc": ("SELECT d.doc_id, d.lang, d.source, CAST(d.n_chars AS DOUBLE) AS s, l.quality AS y, l.toxic AS t FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id", None),
    "dims": (
        "SELECT vec_id, label, p, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, label, posexplode(embedding) AS (p, x) FROM {embeddings})",
        "SELECT vec_id, label, p, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, label, unnest(range(64)) AS p, unnest(embedding) AS x FROM {embeddings})",
    ),
}


@dataclass(frozen=True)
class Query:
    name: str
    operators: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def _expand(text: str, duck: bool) -> str:
    """Put the views a text uses in front of it."""
    need: list[str] = []

    def visit(t: str) -> None:
        for name in re.findall(r"@(\w+)\b(?!\()", t):
            if name in VIEWS and name not in need:
                visit(_view(name, duck))
                need.append(name)

    visit(text)
    views = ", ".join(f"{n} AS ({_view(n, duck)})" for n in need)
    text = text.strip()
    if views:
        if re.match(r"(?i)WITH RECURSIVE\b", text):
            text = "WITH RECURSIVE " + views + ", " + text[14:].lstrip()
        elif re.match(r"(?i)WITH\b", text):
            text = "WITH " + views + ", " + text[4:].lstrip()
        else:
            text = "WITH " + views + " " + text
    return re.sub(r"@(\w+)\b(?!\()", r"\1", text)


def _view(name: str, duck: bool) -> str:
    spark, other = VIEWS[name]
    return other if duck and other else spark


def _call(text: str, mark: str, made: Callable[[str], str]) -> str:
    """Replace ``@mark(...)`` with balanced brackets."""
    while (at := text.find(f"@{mark}(")) >= 0:
        depth, i = 1, at + len(mark) + 2
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        text = text[:at] + made(text[at + len(mark) + 2 : i - 1]) + text[i:]
    return text


def dialect(text: str, duck: bool) -> str:
    text = _expand(text, duck)
    text = _call(text, "r", lambda x: f"(round(CAST({x} AS DOUBLE), 6) + 0.0)")
    quantile = "quantile_cont" if duck else "percentile"
    text = _call(text, "q", lambda x: "{}({}, {})".format(quantile, *x.rsplit(";", 1)))
    text = _call(text, "sha", lambda x: f"sha256({x})" if duck else f"sha2({x}, 256)")
    if duck:
        text = re.sub(r"\{(\w+)\}", r"\1", text)
    else:
        text = text.replace("//", " div ")
    return text


def tables(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    own = dialect(text, False)
    return spark.sql(own, **tables(spark, sf_dir, sorted(set(re.findall(r"\{(\w+)\}", own)) & set(TABLES))))


def both(name: str, operators: str, text: str, oracle: str | None = None) -> None:
    """Register a query whose text serves both engines (or has an own text for the oracle)."""
    CATALOG[name] = Query(name, operators, lambda spark, sf_dir: spark_sql(spark, sf_dir, text), dialect(oracle or text, True))


def frame(name: str, operators: str, oracle: str | None = None) -> Callable:
    """Register a DataFrame function as a query, with the oracle's text."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        CATALOG[name] = Query(name, operators, f, dialect(oracle, True) if oracle else None)
        return f

    return add
