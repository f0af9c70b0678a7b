"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v): each neighbour of a node moves to the least node around it."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = both.join(least, "u")
    if large:
        return moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    kept = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u long, v long); component is its least node.

    Null ends and loops are ignored; repeated edges do no harm; no edges give no rows. Every round ends in a
    written table, so a lost executor repeats one round only.
    """
    now = materialize(edges.where("u <> v").select("u", "v").distinct(), "edges")
    nothing = (0, 0)
    seen = None
    for _ in range(rounds):
        now = materialize(_star(_star(now, True), False), "star")
        row = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        sign = (row[0], row[1] or 0)
        if sign in (seen, nothing):
            break
        seen = sign
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
