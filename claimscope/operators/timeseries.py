"""Hourly topic series, burst triggers, detection and virality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hourly_series(posts: DataFrame, duration: str = "hour") -> DataFrame:
    """One row a cluster and hour: tweet_count, engagement, unique_users, max_followers, avg_followers."""
    hour = F.date_trunc(duration, "created_at").cast("timestamp_ntz").alias("timestamp")
    return posts.groupBy("cluster_id", hour).agg(
        F.count("*").alias("tweet_count"),
        F.sum(F.col("like_count") + F.col("retweet_count")).alias("engagement"),
        F.count_distinct("user_id").alias("unique_users"),
        F.max("followers").alias("max_followers"),
        F.avg("followers").alias("avg_followers"),
    )


def history(key: str = "cluster_id", order: str = "timestamp", rows: int | None = None):
    """All earlier rows of a cluster, or the last ``rows`` of them."""
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding if rows is None else -rows, -1)


def z_scores(series: DataFrame, threshold: float = 3.0, min_history: int = 6) -> DataFrame:
    """Adds n_prev, z-scores of count and engagement against all earlier windows (0 where these do not vary) and the trigger."""
    w = history()
    z = lambda c: F.when(F.stddev_pop(c).over(w) > 0, (F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w)).otherwise(0.0)
    out = series.select("*", F.count("*").over(w).alias("n_prev"), z("tweet_count").alias("z_score_count"), z("engagement").alias("z_score_engagement"))
    out = out.withColumn("z_score", F.greatest("z_score_count", "z_score_engagement"))
    return out.withColumn("is_anomaly_trigger", (F.col("n_prev") >= min_history) & (F.col("z_score") > threshold))


def detections(series: DataFrame) -> DataFrame:
    """First trigger of each cluster: (cluster_id, detection_time)."""
    return series.filter("is_anomaly_trigger").groupBy("cluster_id").agg(F.min("timestamp").alias("detection_time"))


def psr(series: DataFrame, found: DataFrame) -> DataFrame:
    """Share of engagement still to come at detection, 1 where there is none; clusters detected after their first peak are left out.

    One pass over the series: the peak is the largest (engagement, -time) of a cluster.
    """
    joined = series.join(found, "cluster_id")
    at_peak = F.max_by("timestamp", F.struct("engagement", -F.unix_micros(F.col("timestamp").cast("timestamp"))))
    sums = joined.groupBy("cluster_id", "detection_time").agg(
        F.sum("engagement").alias("e_final"),
        F.sum(F.when(F.col("timestamp") <= F.col("detection_time"), F.col("engagement")).otherwise(0)).alias("e_detect"),
        at_peak.alias("peak_time"),
    )
    share = F.when(F.col("e_final") > 0, (F.col("e_final") - F.col("e_detect")) / F.col("e_final")).otherwise(1.0)
    return sums.filter(F.col("detection_time") <= F.col("peak_time")).withColumn("psr", share)


def until_detection(rows: DataFrame, found: DataFrame, time: str) -> DataFrame:
    """As-of join: each cluster's rows up to and including its detection."""
    return rows.join(found, "cluster_id").filter(F.col(time) <= F.col("detection_time"))


def arrival_signal(series: DataFrame, history_window: int = 6, engagement_weight: float = 0.3) -> DataFrame:
    """Adds ``signal``: the count over the mean of the previous windows, plus the weighted same rate of engagement; 0 without history."""
    w = history(rows=history_window)
    rate = lambda c: F.when(F.avg(c).over(w) > 0, F.col(c) / F.avg(c).over(w)).otherwise(0.0)
    return series.withColumn("signal", rate("tweet_count") + engagement_weight * rate("engagement"))
