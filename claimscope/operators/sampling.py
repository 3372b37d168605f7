"""Samples, splits and set operations that depend on ids alone, so that they are the same on every run and cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))


def uniform(id_col: str, seed: int) -> Column:
    """A number in [0, 1) from the first 32 bits of the key."""
    return F.conv(F.substring(key(id_col, seed), 1, 8), 16, 10).cast("double") / float(2**32)


def sample(rows: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """The ``n`` rows of smallest key: each partition sends its own ``n`` at most."""
    return rows.orderBy(key(id_col, seed), id_col).limit(n)


def stratified(rows: DataFrame, id_col: str, label: str, quotas: dict, seed: int) -> DataFrame:
    """The first rows by key of each label, as many as its quota. The rank filter is pushed below the shuffle by Spark."""
    w = Window.partitionBy(label).orderBy(key(id_col, seed), id_col)
    most = max(quotas.values(), default=0)
    ranked = rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most)
    quota = F.lit(0)
    for value, n in quotas.items():
        quota = F.when(F.col(label) == value, n).otherwise(quota)
    return ranked.filter(F.col("_rank") <= quota).drop("_rank")


def ranks(rows: DataFrame, id_col: str, seed: int, buckets: int = 256) -> DataFrame:
    """Adds ``_rank`` (from 1) by key and ``_n``, without a global window: rows are ranked in key ranges whose sizes are summed."""
    r = rows.withColumn("_key", key(id_col, seed)).withColumn("_bucket", F.conv(F.substring("_key", 1, 2), 16, 10).cast("int"))
    sizes = r.groupBy("_bucket").agg(F.count("*").alias("_size"))  # at most 256 rows
    w = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_bucket", F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy()).alias("_n"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", id_col))
    return r.withColumn("_in", inside).join(F.broadcast(sizes), "_bucket").withColumn("_rank", F.col("_in") + F.col("_before")).drop("_bucket", "_key", "_in", "_before")


def split(rows: DataFrame, id_col: str, test_share: float, folds: int, seed: int) -> DataFrame:
    """Adds ``split`` (ceil(share * n) test rows) and ``fold`` by rank of key."""
    r = ranks(rows, id_col, seed)
    part = F.when(F.col("_rank") <= F.ceil(test_share * F.col("_n")), "test").otherwise("train")
    return r.select(*rows.columns, part.alias("split"), ((F.col("_rank") - 1) % folds).cast("int").alias("fold"))


def compare_ids(expected: DataFrame, actual: DataFrame, id_col: str) -> DataFrame:
    """(id, status): missing where only expected, unexpected where only actual, else both."""
    a = expected.select(id_col).distinct().withColumn("_a", F.lit(1))
    b = actual.select(id_col).distinct().withColumn("_b", F.lit(1))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").otherwise("both")
    return a.join(b, id_col, "full_outer").select(id_col, status.alias("status"))


def first_by_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in the order given."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def shares(rows: DataFrame, by: list[str]) -> DataFrame:
    """Count and percentage of each group; the total is taken over the groups."""
    g = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return g.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))
