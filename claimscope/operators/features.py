"""Virality features of a cluster, from what was visible at its detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.operators.ordered import gap_statistics

from claimscope.operators.timeseries import until_detection


def _or(value: Column, condition: Column, default: float = 0.0) -> Column:
    return F.when(condition, value).otherwise(F.lit(default))


def gini(rows: DataFrame, key: str, value: str, name: str = "gini") -> DataFrame:
    """Gini coefficient of ``value`` by ``key``; 0 where the sum is 0.

    Equal values are counted first, by partial sums, so that only a key's distinct values are ranked.
    """
    counted = rows.groupBy(key, F.col(value).cast("double").alias("x")).agg(F.count("*").cast("double").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(key).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranks = F.col("c") * before + F.col("c") * (F.col("c") + 1) / 2  # sum of the ranks of equal values
    ranked = counted.select(key, "x", "c", ranks.alias("ranks"))
    sums = ranked.groupBy(key).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("x")).alias("s"), F.sum(F.col("ranks") * F.col("x")).alias("ix"))
    return sums.select(key, _or((2 * F.col("ix") - (F.col("n") + 1) * F.col("s")) / (F.col("n") * F.col("s")), F.col("s") != 0).alias(name))


def entropy(rows: DataFrame, key: str, value: str, name: str, unique: str | None = None) -> DataFrame:
    """-sum p ln(p + 1e-10) over the values of a key, nulls dropped; optionally their number."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(key))
    each = counts.select(key, (-p * F.log(p + 1e-10)).alias("h"))
    return each.groupBy(key).agg(F.sum("h").alias(name), *([F.count("*").alias(unique)] if unique else []))


def series_features(seen: DataFrame) -> DataFrame:
    """Features of the hourly rows up to detection."""
    order = Window.partitionBy("cluster_id").orderBy("timestamp")
    whole = Window.partitionBy("cluster_id")
    e = F.col("engagement")
    v = e - F.lag("engagement").over(order)
    rows = seen.select("*", v.alias("v"), F.row_number().over(order).alias("i"), F.count("*").over(whole).alias("n"), F.max("engagement").over(whole).alias("top"))
    rows = rows.withColumn("a", F.col("v") - F.lag("v").over(order))
    n, i = F.col("n"), F.col("i")
    at = lambda c, k: F.max(F.when(i == k, F.col(c)))
    g = rows.groupBy("cluster_id", "detection_time", "n").agg(
        F.sum("tweet_count").alias("cumulative_tweets"),
        F.sum("engagement").alias("cumulative_engagement"),
        F.avg("tweet_count").alias("mean_tweets_per_window"),
        F.avg("engagement").alias("mean_engagement_per_window"),
        at("engagement", 1).alias("first_e"),
        at("engagement", n).alias("last_e"),
        at("v", 2).alias("first_v"),
        at("v", n).alias("last_v"),
        F.avg(F.abs("v")).alias("mean_v"),
        F.avg(F.abs("a")).alias("mean_a"),
        F.sum(F.when(i <= F.greatest(F.lit(1), F.floor(n / 4)), e)).alias("early"),
        F.min(F.when(e == F.col("top"), i)).alias("peak"),
        F.max("max_followers").alias("max_followers_seen"),
        F.avg("avg_followers").alias("avg_followers_seen"),
        F.sum("unique_users").alias("total_unique_users"),
        F.max_by("z_score", "timestamp").alias("z_score_at_detect"),
        F.max("z_score").alias("max_z_score_seen"),
        F.max_by("z_score_count", "timestamp").alias("z_score_count_at_detect"),
        F.max_by("z_score_engagement", "timestamp").alias("z_score_engagement_at_detect"),
        F.max_by("kleinberg_state", "timestamp").alias("kleinberg_state_at_detect"),
    )
    total, followers = F.col("cumulative_engagement"), F.col("avg_followers_seen") * F.col("total_unique_users")
    hour, day = F.hour("detection_time"), F.weekday("detection_time")
    flag = lambda c: c.cast("double")
    return g.select(
        "cluster_id",
        "cumulative_tweets",
        "cumulative_engagement",
        n.alias("windows_since_start"),
        "mean_tweets_per_window",
        "mean_engagement_per_window",
        _or(F.col("last_e") / F.col("first_e"), (n >= 2) & (F.col("first_e") > 0), 1.0).alias("growth_rate"),
        _or((F.col("last_v") - F.col("first_v")).cast("double"), n >= 3).alias("acceleration"),
        _or(F.col("mean_v"), n >= 3).alias("engagement_velocity"),
        _or(F.col("mean_a"), n >= 3).alias("engagement_jerk"),
        F.when(n < 2, 1.0).otherwise(_or(F.col("early") / total, total > 0)).alias("early_velocity_ratio"),
        F.when(n < 2, 1.0).otherwise(_or(F.col("last_e") / total, total > 0)).alias("final_window_ratio"),
        _or(flag(F.col("peak") < n), n >= 2).alias("is_post_peak"),
        _or((F.col("peak") - 1) / (n - 1), n >= 2, 1.0).alias("peak_position_ratio"),
        "max_followers_seen",
        "avg_followers_seen",
        "total_unique_users",
        _or(total / followers, followers > 0).alias("engagement_per_follower"),
        "z_score_at_detect",
        "max_z_score_seen",
        "z_score_count_at_detect",
        "z_score_engagement_at_detect",
        "kleinberg_state_at_detect",
        hour.alias("hour_of_day"),
        flag(day >= 5).alias("is_weekend"),
        flag(hour.between(6, 11)).alias("is_morning"),
        flag(hour >= 18).alias("is_evening"),
    )


def arrival_features(seen: DataFrame) -> DataFrame:
    """Burstiness and inter-arrival times of posts; 0 below three posts."""
    g = gap_statistics(seen, "cluster_id", F.col("created_at"))
    ok, m, s = F.col("n") >= 3, F.col("m"), F.col("s")
    return g.select(
        "cluster_id",
        _or((s - m) / (s + m), ok & (s + m > 0)).alias("burstiness"),
        _or(m, ok).alias("inter_arrival_mean"),
        _or(s, ok).alias("inter_arrival_std"),
        _or(s / m, ok & (m > 0)).alias("inter_arrival_cv"),
    )


def post_features(seen: DataFrame) -> DataFrame:
    """Engagement, account age, country, hour and user features of posts up to detection."""
    likes, rts = F.col("like_count"), F.col("retweet_count")
    age = F.floor((F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(F.col("user_created_at").cast("timestamp"))) / 86_400_000_000)
    rows = seen.withColumn("e", likes + rts).withColumn("hour", F.hour("created_at"))
    g = rows.groupBy("cluster_id").agg(
        F.max("retweet_count").alias("max_retweets_per_tweet"),
        F.avg("like_count").alias("avg_likes_per_tweet"),
        F.sum("retweet_count").alias("total_retweets"),
        F.sum("like_count").alias("total_likes"),
        F.when(F.stddev_pop("e") > 0, F.skewness("e")).otherwise(0.0).alias("engagement_skewness"),
        F.avg(age).alias("account_age_avg_days"),
    )
    g = g.withColumn("rt_like_ratio", _or(F.col("total_retweets") / (F.col("total_likes") + 1), F.col("total_likes") > 0)).drop("total_likes")
    users = rows.groupBy("cluster_id", "user_id").agg(F.count("*").alias("c"))
    top = users.groupBy("cluster_id").agg((F.max("c") / F.sum("c")).alias("top_user_ratio"))
    parts = [
        gini(rows, "cluster_id", "e", "engagement_gini"),
        gini(users, "cluster_id", "c", "user_gini"),
        top,
        entropy(rows, "cluster_id", "user_location_country", "geographic_entropy_predetect", "unique_countries_predetect"),
        entropy(rows, "cluster_id", "hour", "posting_hour_entropy"),
    ]
    for p in parts:
        g = g.join(p, "cluster_id", "left")
    return g.fillna(0.0, ["geographic_entropy_predetect"]).fillna(0, ["unique_countries_predetect"])


def virality_features(series: DataFrame, posts: DataFrame, found: DataFrame) -> DataFrame:
    """The 42 features of each detected cluster."""
    s = series_features(until_detection(series, found, "timestamp"))
    seen = until_detection(posts, found, "created_at")
    out = s.join(arrival_features(seen), "cluster_id", "left").join(post_features(seen), "cluster_id", "left")
    out = out.fillna(0.0, ["burstiness", "inter_arrival_mean", "inter_arrival_std", "inter_arrival_cv"])
    users = F.col("total_unique_users")
    return out.withColumn("amplification_factor", _or(F.col("total_retweets") / users, users > 0)).drop("total_retweets")
