"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.session import cut, discard


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _pointed_down(edges: DataFrame) -> DataFrame:
    """Distinct (u, v) with u > v."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node points at one node at most, and none that points is pointed at: then the components are found. One aggregation."""
    out, into = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    ends = out.union(into).groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return ends.filter("out > 1 or out = 1 and into = 1").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Label each node of an undirected edge table with the smallest node id of its component.

    Alternates the large-star and small-star steps (Kiveris et al. 2014): each step points the
    neighbours of a node at the smallest of them. That smallest one is a partial aggregation, so a hub never gathers its neighbours into one
    row. Each round is written to the shared folder, which cuts the lineage and survives a lost executor; the round before is removed.
    Self loops give a component of one; nulls are ignored. Returns ``(node, component)``, a table of the shared folder.
    """
    pairs = cut(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).dropna())
    e = cut(_pointed_down(pairs))
    while not _is_star_forest(e):
        both = _both_ways(e)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        done = cut(_pointed_down(small))
        discard(e)
        e = done
    labels = e.select("u", "v").union(e.select(F.col("v").alias("u"), "v")).union(pairs.filter("u = v").select("u", "v"))
    out = cut(labels.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")))
    discard(pairs, e)
    return out
