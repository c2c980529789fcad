"""Connected components of a link table, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm._store import discard, stored


def connected_components(links: DataFrame, spark: SparkSession, rounds: int = 60) -> DataFrame:
    """``links(a, b)`` of longs to ``(id, component)``, where component is the smallest id of the component.

    Each round hooks every vertex to its smallest neighbour (if that is smaller), follows the hooks twice, and
    contracts the links; the number of links left falls with each round. Vertices without a link get no row; loops,
    repeated and reversed links are harmless; an empty table gives an empty table.
    """
    edges = stored(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        spark,
        "edges",
    )
    roots, tables = [], [edges]
    for _ in range(rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), spark, "hook")
        once = hook.select(F.col("a").alias("p"), F.col("p").alias("q"))
        root = hook
        for _ in range(2):
            root = root.join(once, "p").select("a", F.col("q").alias("p"))
        ra, rb = root.select("a", F.col("p").alias("pa")), root.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        met = edges.join(ra, "a").join(rb, "b").where("pa <> pb").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b"))
        edges = stored(met.distinct(), spark, "edges")
        roots.append(root)
        tables += [hook, edges]
    else:
        raise RuntimeError("the components did not settle")
    if not roots:
        return spark.createDataFrame([], "id long, component long")
    label = roots[0].select(F.col("a").alias("id"), F.col("p").alias("component"))
    for root in roots[1:]:
        new = root.select(F.col("a").alias("component"), "p")
        label = label.join(new, "component", "left").select("id", F.coalesce("p", "component").alias("component"))
    label = stored(label, spark, "label")
    discard(spark, *tables)
    return label
