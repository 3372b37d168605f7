"""Ordered arrays per cluster: fixed-length series, arrival offsets, representative texts, early-peek features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series_tensor(series: DataFrame, channels: list[str], length: int = 24, least: int = 3) -> DataFrame:
    """(cluster_id, n, one array a channel): z-normalised over the whole series (population deviation + 1e-8), then the last ``length``, zeros before.

    A cluster's array has as many entries as it has hours.
    """
    g = series.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", *channels))).alias("xs"), F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in channels for k, f in (("m", F.avg), ("s", F.stddev_pop))])

    def padded(c: str) -> Column:
        z = F.transform("xs", lambda x: (x[c] - F.col(f"m_{c}")) / (F.col(f"s_{c}") + 1e-8))
        last = F.slice(z, F.greatest(F.size(z) - length + 1, F.lit(1)), length)
        return F.concat(F.array_repeat(F.lit(0.0), F.lit(length) - F.size(last)), last).alias(c)

    return g.filter(F.col("n") >= least).select("cluster_id", "n", *[padded(c) for c in channels])


def arrival_offsets(seen: DataFrame) -> DataFrame:
    """(cluster_id, hour, offsets): seconds of posts since the cluster's first, in order, as one array for each hour with posts. No array holds all posts of a cluster."""
    at, hour = F.unix_micros(F.col("created_at").cast("timestamp")), F.date_trunc("hour", "created_at")
    hours = seen.filter("created_at is not null").groupBy("cluster_id", hour.alias("hour")).agg(F.array_sort(F.collect_list(at)).alias("ts"))
    first = hours.groupBy("cluster_id").agg(F.min(F.element_at("ts", 1)).alias("first"))
    return hours.join(first, "cluster_id").select("cluster_id", "hour", F.transform("ts", lambda t: F.round((t - F.col("first")) / 1e6, 6)).alias("offsets"))


def arrival_figures(seen: DataFrame, least: int = 5) -> DataFrame:
    """(cluster_id, last_offset, branching) for clusters with ``least`` posts: seconds from the first post to the last, and the branching ratio.

    The branching ratio is 1 - 1 / sqrt(var / mean) of hourly counts, 0 where that is not above (Hardiman and Bouchaud 2014).
    """
    at = F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6
    hours = seen.groupBy("cluster_id", F.date_trunc("hour", "created_at").alias("h")).agg(F.count("*").alias("c"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    g = hours.groupBy("cluster_id").agg(F.sum("c").alias("n"), (F.max("hi") - F.min("lo")).alias("last"), (F.var_pop("c") / F.avg("c")).alias("f")).filter(F.col("n") >= least)
    return g.select("cluster_id", F.round("last", 6).alias("last_offset"), F.when(F.col("f") > 1, 1 - 1 / F.sqrt(F.greatest("f", F.lit(1e-12)))).otherwise(0.0).alias("branching"))


def representative_text(posts: DataFrame, n: int = 5, found: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(cluster_id, text): the first ``n`` non-empty posts by time, joined by a space; up to detection if ``found`` is given, else unbounded."""
    rows = posts.filter(F.length(F.trim("text")) > 0)
    if found is not None:
        rows = rows.join(found, "cluster_id").filter(F.col("created_at") <= F.col("detection_time"))
    w = Window.partitionBy("cluster_id").orderBy("created_at", "id")
    top = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), " ")
    return top.groupBy("cluster_id").agg((F.substring(text, 1, limit) if limit else text).alias("text"))


def top_posts(rows: DataFrame, key: str, k: int) -> DataFrame:
    """(key, text): the k most similar posts, joined by a blank line."""
    w = Window.partitionBy(key).orderBy(F.desc("similarity"), "id")
    top = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def early_peek(posts: DataFrame, found: DataFrame, peek_hours: int = 6, horizon_hours: int = 48, viral: int = 500) -> DataFrame:
    """18 features of the first hours after detection, and whether engagement within the horizon reaches ``viral``.

    Defined by their names; the posts need has_url, has_media, n_hashtags and verified.
    """
    t = F.unix_seconds(F.col("created_at").cast("timestamp"))
    after = (t - F.unix_seconds(F.col("detection_time").cast("timestamp"))) / 3600
    rows = posts.join(found, "cluster_id").withColumn("h", after).filter((F.col("h") >= 0) & (F.col("h") <= horizon_hours))
    rows = rows.withColumn("e", F.col("like_count") + F.col("retweet_count")).withColumn("in", F.col("h") <= peek_hours)
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy("created_at", "id")))
    peek = lambda c: F.when(F.col("in"), c)
    half = lambda lo, hi: F.coalesce(F.sum(F.when((F.col("h") >= lo) & (F.col("h") <= hi), F.col("e"))), F.lit(0))
    g = rows.groupBy("cluster_id", "z_score_at_detection", "detection_time").agg(
        F.sum(peek(F.lit(1))).alias("tweet_count"),
        F.sum(peek(F.col("e"))).alias("engagement_sum"),
        F.sum(peek(F.col("retweet_count"))).alias("rts"),
        F.sum(peek(F.col("like_count"))).alias("likes"),
        half(0, peek_hours / 2).alias("a"),
        half(peek_hours / 2 + 1e-9, peek_hours).alias("b"),
        F.avg(peek(F.col("has_url").cast("int"))).alias("url_density"),
        F.avg(peek(F.col("has_media").cast("int"))).alias("media_density"),
        F.avg(peek(F.col("n_hashtags"))).alias("hashtag_avg"),
        F.avg(F.when(F.col("r") <= 50, F.col("followers"))).alias("avg_followers_first_50"),
        F.max(F.when(F.col("r") <= 50, F.col("followers"))).alias("max_followers_first_50"),
        F.avg(peek(F.col("verified").cast("int"))).alias("verified_ratio"),
        (F.sum("e") >= viral).alias("is_viral"),
    )
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    n, e = F.col("tweet_count"), F.col("engagement_sum")
    return g.filter("tweet_count > 0").select(
        "cluster_id", "z_score_at_detection", "tweet_count", "engagement_sum", (n / peek_hours).alias("tweets_per_hour"), (e / peek_hours).alias("engagement_velocity"), div(F.col("b"), F.col("a")).alias("momentum"),
        div(F.col("rts"), e).alias("rt_ratio"), div(F.col("likes"), e).alias("like_ratio"), (e / n).alias("engagement_efficiency"), "url_density", "media_density", "hashtag_avg", F.hour("detection_time").alias("hour_of_day"),
        (F.weekday("detection_time") >= 5).cast("int").alias("is_weekend"), "avg_followers_first_50", "max_followers_first_50", "verified_ratio", div(F.col("rts"), F.col("likes") + 1).alias("rt_like_ratio"), "is_viral",
    )
