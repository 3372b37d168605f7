"""Views of the given tables in the shape the operators read: posts of users in topics. One Spark form and one SQL text of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TWEETS = """
tweets AS (SELECT event_id AS id, user_id, ts AS created_at, user_id % 25 AS cluster_id, CAST(floor(value) AS BIGINT) AS like_count,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS retweet_count, CASE WHEN user_id % 7 = 0 THEN NULL ELSE n_name END AS user_location_country,
    (user_id * 37) % 5000 AS followers, ts - to_seconds(86400 * (user_id % 1000) + (event_id * 7919) % 86400) AS user_created_at
  FROM events LEFT JOIN nation ON n_nationkey = (user_id // 25) % 25)"""
SERIES = TWEETS + """,
ts AS (SELECT cluster_id, date_trunc('hour', created_at) AS timestamp, count(*) AS tweet_count, CAST(sum(like_count + retweet_count) AS BIGINT) AS engagement,
    count(DISTINCT user_id) AS unique_users, max(followers) AS max_followers, avg(followers) AS avg_followers FROM tweets GROUP BY 1, 2)"""
SCORED = SERIES + """,
hist AS (SELECT *, count(*) OVER p AS n_prev, avg(tweet_count) OVER p AS mean_count, stddev_pop(tweet_count) OVER p AS std_count,
    avg(engagement) OVER p AS mean_engagement, stddev_pop(engagement) OVER p AS std_engagement
  FROM ts WINDOW p AS (PARTITION BY cluster_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
zs AS (SELECT *, CASE WHEN std_count > 0 THEN (tweet_count - mean_count) / std_count ELSE 0.0 END AS z_score_count,
    CASE WHEN std_engagement > 0 THEN (engagement - mean_engagement) / std_engagement ELSE 0.0 END AS z_score_engagement FROM hist),
scored AS (SELECT *, greatest(z_score_count, z_score_engagement) AS z_score, n_prev >= 6 AND greatest(z_score_count, z_score_engagement) > 3 AS is_anomaly_trigger FROM zs)"""
DETECTED = SCORED + """,
detected AS (SELECT cluster_id, min(timestamp) AS detection_time FROM scored WHERE is_anomaly_trigger GROUP BY cluster_id)"""
LABELLED = """
labelled AS (SELECT doc_id, quality, toxic, least(1.0, greatest(0.0, 0.25 + 0.5 * quality + 0.4 * (((doc_id * 7919) % 1000) / 1000.0 - 0.5))) AS prob_a,
    least(1.0, greatest(0.0, 0.3 + 0.4 * quality + 0.5 * (((doc_id * 104729) % 1000) / 1000.0 - 0.5))) AS prob_b,
    least(1.0, greatest(0.0, 0.5 + 0.9 * (((doc_id * 1299709) % 1000) / 1000.0 - 0.5))) AS prob_c FROM labels),
long AS (SELECT 'a' AS model, doc_id AS sample_id, quality AS label, round(prob_a, 6) AS prob FROM labelled UNION ALL SELECT 'b', doc_id, quality, round(prob_b, 6) FROM labelled
    UNION ALL SELECT 'c', doc_id, quality, round(prob_c, 6) FROM labelled)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as posts: a user's posts belong to one of 25 topics."""
    e, n = table(spark, sf_dir, "events"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.floor(F.col("user_id") / 25) % 25
    joined = e.join(n, F.col("n_nationkey") == key, "left")
    age = F.make_dt_interval(secs=(86400 * (F.col("user_id") % 1000) + (F.col("event_id") * 7919) % 86400).cast("decimal(18,6)"))
    return joined.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.col("ts").alias("created_at"),
        (F.col("user_id") % 25).alias("cluster_id"),
        F.floor("value").alias("like_count"),
        F.get_json_object("props", "$.k").cast("long").alias("retweet_count"),
        F.when(F.col("user_id") % 7 != 0, F.col("n_name")).alias("user_location_country"),
        ((F.col("user_id") * 37) % 5000).alias("followers"),
        (F.col("ts") - age).alias("user_created_at"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scores in [0, 1] for each labelled document, in the long form (model, sample_id, label, prob)."""
    noise = lambda k: (F.col("doc_id") * k) % 1000 / 1000.0 - 0.5
    clip = lambda c: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), 6)
    probs = {"a": 0.25 + 0.5 * F.col("quality") + 0.4 * noise(7919), "b": 0.3 + 0.4 * F.col("quality") + 0.5 * noise(104729), "c": 0.5 + 0.9 * noise(1299709)}
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), clip(p).alias("prob")) for m, p in probs.items()])).alias("x")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"), F.col("quality").alias("label"), each).select("x.model", "sample_id", "label", "x.prob")
