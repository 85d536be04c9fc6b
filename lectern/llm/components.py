"""Connected components by alternating large and small stars, each round a few shuffles.

Every step is a minimum per vertex (combined before the shuffle) and a join on the vertex, so a
vertex with very many neighbours is never gathered into one task.  Edges stay in Spark throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v; gives edges of the same form."""
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    near = edges.join(least, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) for each vertex of an edge; component: the least vertex reachable.

    Vertices are longs.  Null vertices and loops are left out, repeated and reversed edges count
    once, an empty table gives an empty one.
    """
    now = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a) != F.col(b)).alias("apart"))
        .where("apart")
        .select("u", "v")
        .distinct()
    )
    old: list[str] = []
    now = written(now, "edges", old)
    seen = None
    while True:
        kept: list[str] = []
        now = written(_stars(_stars(now, True), False), "stars", kept)
        drop_path(edges.sparkSession, old[0])
        old = kept
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    )
