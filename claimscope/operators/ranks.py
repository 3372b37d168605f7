"""Average ranks with ties inside groups of any size.

Rows are first counted by distinct value. The values of all groups together are cut into ranges of about ``RANGE_ROWS`` of them; a rank is the
number of rows of the group in lower ranges, which comes from one row a group and range, plus those below inside the range. So no task sees a whole
group, and a value that a large share of the rows have is one row.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimscope.session import cut

#: Distinct values a range holds, ranges at most, and the share of all rows (one in so many) from which a value is heavy.
RANGE_ROWS, RANGES, HEAVY = 1 << 17, 1_024, 1_000


def ranged(counts: DataFrame, ranges: int) -> DataFrame:
    """Adds ``_range``: which of about equal ranges of values a row lies in; nulls come first and NaN last, as in sorting."""
    v = F.col("_v").cast("double")
    cuts = counts.agg(F.percentile_approx(v, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else None  # at most RANGES numbers
    inner = sorted({c for c in cuts or [] if abs(c) < float("inf")})
    if not inner:
        return counts.withColumn("_range", F.lit(0.0))
    cut_up = Bucketizer(splits=[-float("inf"), *inner, float("inf")], inputCol="_d", outputCol="_range", handleInvalid="keep").transform(counts.withColumn("_d", F.coalesce(v, F.lit(0.0))))
    return cut_up.withColumn("_range", F.when(F.col("_v").isNull(), -1.0).otherwise(F.col("_range"))).drop("_d")


def value_ranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(_k0, _k1 ..., _v, _n, _rank, _of): for each distinct value of a group the number of its rows, their average rank from 1, and the group's rows."""
    keys = [f"_k{i}" for i in range(len(by))]
    named = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).alias("_v"))
    counts = cut(named.groupBy(*keys, "_v").agg(F.count("*").alias("_n")))
    counts = ranged(counts, min(RANGES, max(1, -(-counts.count() // RANGE_ROWS))))
    group = Window.partitionBy(*keys)
    sizes = counts.groupBy(*keys, "_range").agg(F.sum("_n").alias("_s"))
    lower = F.coalesce(F.sum("_s").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("_range").alias("_range_"), lower.alias("_lower"), F.sum("_s").over(group).alias("_of"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (*keys, "_range")]
    placed = counts.withColumn("_below", inside).join(sizes, same)
    return placed.select(*keys, "_v", "_n", (F.col("_lower") + F.col("_below") + (F.col("_n") + 1) / 2).alias("_rank"), "_of")


def with_ranks(rows: DataFrame, ranks: DataFrame, by: list[str], value: str, name: str = "rank", of: str | None = None) -> DataFrame:
    """``rows`` with the ranks of ``value_ranks``, and with ``of`` the number of the group's rows.

    Ranks of values that more than one row in HEAVY has, at most HEAVY of them, are broadcast; rows with these are spread and meet no other rank in the join.
    """
    ranks = cut(ranks)
    total = ranks.agg(F.sum("_n")).first()[0] or 0
    is_heavy = F.col("_n") > total / HEAVY
    heavy = F.broadcast(ranks.filter(is_heavy).select(*[F.col(c).alias(f"{c}_") for c in ranks.columns]))
    light = ranks.filter(~is_heavy).withColumn("_salt_", F.lit(0))
    match = lambda end: [*(F.col(c).eqNullSafe(F.col(f"_k{i}{end}")) for i, c in enumerate(by)), F.col(value).eqNullSafe(F.col(f"_v{end}"))]
    spread = 1 + F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")]), F.lit(1024)).cast("int")
    wide = rows.join(heavy, match("_"), "left").withColumn("_salt", F.when(F.col("_n_").isNull(), 0).otherwise(spread))
    wide = wide.join(light, [*match(""), F.col("_salt") == F.col("_salt_")], "left")
    return wide.select(*rows.columns, F.coalesce("_rank_", "_rank").alias(name), *([F.coalesce("_of_", "_of").alias(of)] if of else []))


def average_ranks(rows: DataFrame, by: list[str], value: str, name: str = "rank", of: str | None = None) -> DataFrame:
    """Adds the average rank of ``value`` among the rows of its group, from 1, and with ``of`` the number of these rows. Nulls rank first and NaN last."""
    return with_ranks(rows, value_ranks(rows, by, value), by, value, name, of)
