"""Gaps between successive times inside groups of any size.

Times are counted by group and value and cut into ranges (see ``ranks``). Gaps are taken inside a group's range; the last time of the range before is carried over the
border, with the group's number of rows, first and last time, in one row a group and range. The mean gap is the span over the number of gaps, so
the squared deviations from it add up in any order. No window or list holds all rows of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.operators import ranks
from claimscope.session import cut


def gap_statistics(rows: DataFrame, by: str, at: Column) -> DataFrame:
    """(by, n, m, s): rows of each group, mean and population deviation of the seconds between successive rows; both null below two rows with a time.

    Rows without a time count in ``n`` only. Null groups are groups.
    """
    named = rows.select(F.col(by).alias("_k0"), F.unix_micros(at.cast("timestamp")).alias("_v"))
    counts = cut(named.groupBy("_k0", "_v").agg(F.count("*").alias("_n")))
    counts = ranks.ranged(counts, min(ranks.RANGES, max(1, -(-counts.count() // ranks.RANGE_ROWS))))
    group = Window.partitionBy("_k")
    known = counts.groupBy(F.col("_k0").alias("_k"), F.col("_range").alias("_r")).agg(F.sum("_n").alias("_rows"), F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))).alias("_timed"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    before = group.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    known = known.select("_k", "_r", F.max("_high").over(before).alias("_last"), F.sum("_timed").over(group).alias("_all"), F.min("_low").over(group).alias("_first"), F.max("_high").over(group).alias("_end"))
    inside = F.lag("_v").over(Window.partitionBy("_k0", "_range").orderBy("_v"))
    placed = counts.withColumn("_prev", inside).join(known, F.col("_k0").eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")))
    mean = F.try_divide(F.col("_end") / 1e6 - F.col("_first") / 1e6, F.col("_all") - 1)
    gap = F.col("_v") / 1e6 - F.coalesce("_prev", "_last") / 1e6
    off = F.when(F.col("_v").isNotNull(), F.coalesce((gap - mean) ** 2, F.lit(0.0)) + (F.col("_n") - 1) * mean**2)  # rows of one time lie 0 apart
    sums = placed.groupBy(F.col("_k0").alias(by)).agg(F.sum("_n").alias("n"), F.first(mean, ignorenulls=True).alias("m"), F.sqrt(F.try_divide(F.sum(off), F.max("_all") - 1)).alias("s"))
    return sums.select(by, "n", "m", "s")
