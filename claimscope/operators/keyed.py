"""Joins and row numbers by key."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_rows(rows: DataFrame, order: str, name: str = "idx") -> DataFrame:
    """Numbers from 0 in the order of a numeric key, without a global window.

    Rows are dealt into ranges of the key; the sizes of the ranges (one row each, at most 1,024) are summed and broadcast.
    """
    low, high = rows.agg(F.min(order), F.max(order)).first()
    if low is None:
        return rows.withColumn(name, F.lit(None).cast("long"))
    width = max(1, -(-(high - low + 1) // 1024))
    part = rows.withColumn("_part", F.floor((F.col(order) - low) / width))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = part.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return part.withColumn("_in", inside).join(F.broadcast(sizes), "_part").withColumn(name, F.col("_in") + F.col("_before") - 1).drop("_part", "_in", "_before")


def select_matching(rows: DataFrame, prefixes: tuple[str, ...] = (), not_matching: str | None = None) -> DataFrame:
    """Columns that begin with one of ``prefixes`` and do not match the pattern."""
    return rows.select(*[c for c in rows.columns if (not prefixes or c.startswith(prefixes)) and not (not_matching and re.search(not_matching, c))])


def join_on_cast(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Inner join of a numeric id with the same id as text; ids that are no numbers match nothing."""
    typed = right.withColumn(left_id, F.col(right_id).try_cast("long"))
    return left.join(typed.drop(right_id), left_id)


def claims_to_posts(claims: DataFrame, posts: DataFrame) -> DataFrame:
    """(claim_id, cluster_id, id): posts of each claim's clusters; a missing, empty or malformed list falls back to the trigger's cluster."""
    ids = F.from_json("cluster_ids", "array<bigint>")
    fallback = F.filter(F.array("trigger_cluster_id"), lambda x: x.isNotNull())
    listed = claims.select("claim_id", F.array_distinct(F.when(F.coalesce(F.size(ids), F.lit(0)) > 0, ids).otherwise(fallback)).alias("ids"))
    return listed.select("claim_id", F.explode("ids").alias("cluster_id")).filter("cluster_id is not null").join(posts.select("cluster_id", "id"), "cluster_id")


def update_text(rows: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` replaced where ``new`` has a non-empty value for the key."""
    better = new.filter(F.length(column) > 0).select(key, F.col(column).alias("_new"))
    return rows.join(better, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def cluster_tags(rows: DataFrame, key: str) -> DataFrame:
    """(key, cluster): a comma list, else a single cluster, else ``no_cluster``."""
    listed = F.transform(F.split("clusters", ","), lambda x: F.trim(x))
    single = F.when(F.col("cluster").isNotNull(), F.array("cluster")).otherwise(F.array(F.lit("no_cluster")))
    return rows.select(key, F.explode(F.when(F.coalesce(F.length("clusters"), F.lit(0)) > 0, listed).otherwise(single)).alias("cluster"))


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def alignment(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sizes of both sides and of their join by id, and whether they agree. There is no join by position."""
    a, b = left.select(key, F.lit(1).alias("_a")), right.select(key, F.lit(1).alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    g = a.join(b, key, "full_outer").agg(F.count("_a").alias("n_left"), F.count("_b").alias("n_right"), F.sum(both.cast("int")).alias("n_both"))
    return g.withColumn("aligned", F.col("n_left") == F.col("n_right"))
