"""Queries over topic series: aggregation, detection, virality, features and detectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimscope.operators import anomaly, features, timeseries
from claimscope.plans.fixtures import DETECTED, SCORED, SERIES, TWEETS, tweets
from claimscope.plans.registry import epoch, query, r6, rounded


def _series(spark, sf_dir):
    return timeseries.hourly_series(tweets(spark, sf_dir))


def _scored(spark, sf_dir):
    return timeseries.z_scores(_series(spark, sf_dir))


def _detected(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s, timeseries.detections(s)


@query("WITH" + SERIES + " SELECT cluster_id, CAST(epoch(timestamp) AS BIGINT) AS hour, tweet_count, engagement, unique_users, max_followers, round(avg_followers, 6) AS avg_followers FROM ts")
def a06_hourly_series(spark, sf_dir):
    return rounded(_series(spark, sf_dir).withColumn("hour", epoch("timestamp")).drop("timestamp"))


@query("WITH" + SCORED + " SELECT cluster_id, CAST(epoch(timestamp) AS BIGINT) AS hour, n_prev, round(z_score_count, 6) AS z_score_count, round(z_score_engagement, 6) AS z_score_engagement, is_anomaly_trigger FROM scored")
def n02_z_score(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return rounded(s.select("cluster_id", epoch("timestamp").alias("hour"), "n_prev", "z_score_count", "z_score_engagement", "is_anomaly_trigger"))


@query("WITH" + DETECTED + " SELECT cluster_id, CAST(epoch(detection_time) AS BIGINT) AS detected_at FROM detected")
def a04_detection(spark, sf_dir):
    return _detected(spark, sf_dir)[1].select("cluster_id", epoch("detection_time").alias("detected_at"))


PSR = DETECTED + """,
top AS (SELECT cluster_id, max(engagement) AS top, sum(engagement) AS e_final FROM scored GROUP BY 1),
peak AS (SELECT cluster_id, min(timestamp) AS peak_time FROM scored JOIN top USING (cluster_id) WHERE engagement = top GROUP BY 1),
early AS (SELECT cluster_id, sum(CASE WHEN timestamp <= detection_time THEN engagement ELSE 0 END) AS e_detect FROM scored JOIN detected USING (cluster_id) GROUP BY 1),
psr AS (SELECT cluster_id, CASE WHEN e_final > 0 THEN (e_final - e_detect) / e_final ELSE 1.0 END AS psr
  FROM detected JOIN top USING (cluster_id) JOIN peak USING (cluster_id) JOIN early USING (cluster_id) WHERE detection_time <= peak_time)"""


@query("WITH" + PSR + " SELECT cluster_id, round(CAST(psr AS DOUBLE), 6) AS psr FROM psr")
def a05_psr(spark, sf_dir):
    return timeseries.psr(*_detected(spark, sf_dir)).select("cluster_id", r6("psr", "psr"))


SEEN = DETECTED + """,
seen_ts AS (SELECT s.*, detection_time FROM scored s JOIN detected USING (cluster_id) WHERE timestamp <= detection_time),
seen AS (SELECT t.*, detection_time FROM tweets t JOIN detected USING (cluster_id) WHERE created_at <= detection_time)"""


@query("WITH" + SEEN + " SELECT a.cluster_id, n_windows, n_posts FROM (SELECT cluster_id, count(*) AS n_windows FROM seen_ts GROUP BY 1) a JOIN (SELECT cluster_id, count(*) AS n_posts FROM seen GROUP BY 1) b USING (cluster_id)")
def j03_as_of_detection(spark, sf_dir):
    s, found = _detected(spark, sf_dir)
    a = timeseries.until_detection(s, found, "timestamp").groupBy("cluster_id").agg(F.count("*").alias("n_windows"))
    b = timeseries.until_detection(tweets(spark, sf_dir), found, "created_at").groupBy("cluster_id").agg(F.count("*").alias("n_posts"))
    return a.join(b, "cluster_id")


KLEINBERG = """,
kb AS (SELECT cluster_id, timestamp, tweet_count AS x, row_number() OVER (PARTITION BY cluster_id ORDER BY timestamp) AS i, avg(tweet_count) OVER (PARTITION BY cluster_id) AS m, ln(count(*) OVER (PARTITION BY cluster_id)) AS g FROM ts),
walk AS (SELECT cluster_id, i, m, g, least(0.0, g, 2 * g) + m - x * ln(m) AS c0, least(0.0 + g, g, 2 * g) + 2 * m - x * ln(2 * m) AS c1, least(0.0 + 2 * g, g + g, 2 * g) + 4 * m - x * ln(4 * m) AS c2 FROM kb WHERE i = 1
  UNION ALL SELECT k.cluster_id, k.i, k.m, k.g, least(c0, c1, c2) + k.m - k.x * ln(k.m), least(c0 + k.g, c1, c2) + 2 * k.m - k.x * ln(2 * k.m), least(c0 + 2 * k.g, c1 + k.g, c2) + 4 * k.m - k.x * ln(4 * k.m)
  FROM walk w JOIN kb k ON k.cluster_id = w.cluster_id AND k.i = w.i + 1),
kstate AS (SELECT w.cluster_id, k.timestamp, CASE WHEN c0 <= least(c0, c1, c2) THEN 0 WHEN c1 <= least(c0, c1, c2) THEN 1 ELSE 2 END AS kleinberg_state FROM walk w JOIN kb k ON k.cluster_id = w.cluster_id AND k.i = w.i)"""


@query("WITH RECURSIVE" + SERIES + KLEINBERG + " SELECT cluster_id, CAST(epoch(timestamp) AS BIGINT) AS hour, CAST(kleinberg_state AS INTEGER) AS kleinberg_state FROM kstate")
def n04_kleinberg(spark, sf_dir):
    return anomaly.kleinberg_states(_series(spark, sf_dir)).select("cluster_id", epoch("timestamp").alias("hour"), "kleinberg_state")


_ALL = SEEN.replace("tweets AS", "tweets AS", 1) + KLEINBERG + """,
s AS (SELECT st.*, kleinberg_state, row_number() OVER o AS i, count(*) OVER p AS n, max(engagement) OVER p AS top, engagement - lag(engagement) OVER o AS v
  FROM seen_ts st JOIN kstate USING (cluster_id, timestamp) WINDOW o AS (PARTITION BY cluster_id ORDER BY timestamp), p AS (PARTITION BY cluster_id)),
s2 AS (SELECT *, v - lag(v) OVER (PARTITION BY cluster_id ORDER BY timestamp) AS a FROM s),
f1 AS (SELECT cluster_id, any_value(detection_time) AS dt, any_value(n) AS n, sum(tweet_count) AS tweets, sum(engagement) AS eng, avg(tweet_count) AS mt, avg(engagement) AS me,
    max(CASE WHEN i = 1 THEN engagement END) AS fe, max(CASE WHEN i = n THEN engagement END) AS le, max(CASE WHEN i = 2 THEN v END) AS fv, max(CASE WHEN i = n THEN v END) AS lv,
    avg(abs(v)) AS mv, avg(abs(a)) AS ma, sum(CASE WHEN i <= greatest(1, n // 4) THEN engagement END) AS early, min(CASE WHEN engagement = top THEN i END) AS peak,
    max(max_followers) AS mf, avg(avg_followers) AS af, sum(unique_users) AS uu, max(z_score) AS mz, max(CASE WHEN i = n THEN z_score END) AS z, max(CASE WHEN i = n THEN z_score_count END) AS zc,
    max(CASE WHEN i = n THEN z_score_engagement END) AS ze, max(CASE WHEN i = n THEN kleinberg_state END) AS ks FROM s2 GROUP BY cluster_id),
gap AS (SELECT cluster_id, epoch_us(created_at) / 1e6 - lag(epoch_us(created_at) / 1e6) OVER (PARTITION BY cluster_id ORDER BY created_at, id) AS gap FROM seen),
f2 AS (SELECT cluster_id, count(*) AS gn, avg(gap) AS gm, stddev_pop(gap) AS gs FROM gap GROUP BY cluster_id),
f3 AS (SELECT cluster_id, max(retweet_count) AS mrt, avg(like_count) AS al, sum(retweet_count) AS rt, sum(like_count) AS lk, avg(floor((epoch_us(created_at) - epoch_us(user_created_at)) / 86400000000.0)) AS age,
    avg(like_count + retweet_count) AS em FROM seen GROUP BY cluster_id),
f3b AS (SELECT cluster_id, avg(power(like_count + retweet_count - em, 2)) AS m2, avg(power(like_count + retweet_count - em, 3)) AS m3 FROM seen JOIN f3 USING (cluster_id) GROUP BY cluster_id),
er AS (SELECT cluster_id, like_count + retweet_count AS x, row_number() OVER (PARTITION BY cluster_id ORDER BY like_count + retweet_count) AS i FROM seen),
f4 AS (SELECT cluster_id, CASE WHEN sum(x) <> 0 THEN (2.0 * sum(i * x) - (count(*) + 1.0) * sum(x)) / (count(*) * CAST(sum(x) AS DOUBLE)) ELSE 0 END AS eg FROM er GROUP BY cluster_id),
uc AS (SELECT cluster_id, user_id, count(*) AS c FROM seen GROUP BY ALL),
ur AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY c) AS i FROM uc),
f5 AS (SELECT cluster_id, CASE WHEN sum(c) <> 0 THEN (2.0 * sum(i * c) - (count(*) + 1.0) * sum(c)) / (count(*) * CAST(sum(c) AS DOUBLE)) ELSE 0 END AS ug, max(c) / sum(c) AS tu FROM ur GROUP BY cluster_id),
cc AS (SELECT cluster_id, user_location_country, count(*) AS c FROM seen WHERE user_location_country IS NOT NULL GROUP BY ALL),
f6 AS (SELECT cluster_id, sum(-(c / t) * ln(c / t + 1e-10)) AS ge, count(*) AS nc FROM (SELECT *, sum(c) OVER (PARTITION BY cluster_id) AS t FROM cc) GROUP BY cluster_id),
hc AS (SELECT cluster_id, hour(created_at) AS h, count(*) AS c FROM seen GROUP BY ALL),
f7 AS (SELECT cluster_id, sum(-(c / t) * ln(c / t + 1e-10)) AS he FROM (SELECT *, sum(c) OVER (PARTITION BY cluster_id) AS t FROM hc) GROUP BY cluster_id),
feat AS (SELECT f1.cluster_id, CAST(tweets AS BIGINT) AS cumulative_tweets, CAST(eng AS BIGINT) AS cumulative_engagement, n AS windows_since_start, mt AS mean_tweets_per_window, me AS mean_engagement_per_window,
    CASE WHEN n >= 2 AND fe > 0 THEN le / fe ELSE 1.0 END AS growth_rate, CASE WHEN n >= 3 THEN CAST(lv - fv AS DOUBLE) ELSE 0 END AS acceleration, CASE WHEN n >= 3 THEN mv ELSE 0 END AS engagement_velocity,
    CASE WHEN n >= 3 THEN ma ELSE 0 END AS engagement_jerk, CASE WHEN n < 2 THEN 1.0 WHEN eng > 0 THEN early / CAST(eng AS DOUBLE) ELSE 0 END AS early_velocity_ratio, CASE WHEN n < 2 THEN 1.0 WHEN eng > 0 THEN le / CAST(eng AS DOUBLE) ELSE 0 END AS final_window_ratio,
    CASE WHEN n >= 2 AND peak < n THEN 1.0 ELSE 0.0 END AS is_post_peak, CASE WHEN n >= 2 THEN (peak - 1) / (n - 1) ELSE 1.0 END AS peak_position_ratio, mf AS max_followers_seen, af AS avg_followers_seen, CAST(uu AS BIGINT) AS total_unique_users,
    CASE WHEN af * uu > 0 THEN eng / (af * uu) ELSE 0 END AS engagement_per_follower, CASE WHEN uu > 0 THEN rt / CAST(uu AS DOUBLE) ELSE 0 END AS amplification_factor, z AS z_score_at_detect, mz AS max_z_score_seen, zc AS z_score_count_at_detect, ze AS z_score_engagement_at_detect,
    CAST(ks AS INTEGER) AS kleinberg_state_at_detect, coalesce(ge, 0.0) AS geographic_entropy_predetect, coalesce(nc, 0) AS unique_countries_predetect, CAST(hour(dt) AS INTEGER) AS hour_of_day, CASE WHEN isodow(dt) >= 6 THEN 1.0 ELSE 0.0 END AS is_weekend,
    CASE WHEN hour(dt) BETWEEN 6 AND 11 THEN 1.0 ELSE 0.0 END AS is_morning, CASE WHEN hour(dt) >= 18 THEN 1.0 ELSE 0.0 END AS is_evening, he AS posting_hour_entropy, mrt AS max_retweets_per_tweet, al AS avg_likes_per_tweet,
    CASE WHEN lk > 0 THEN rt / (lk + 1.0) ELSE 0 END AS rt_like_ratio, CASE WHEN m2 > 0 THEN m3 / power(m2, 1.5) ELSE 0 END AS engagement_skewness, eg AS engagement_gini, age AS account_age_avg_days, ug AS user_gini, tu AS top_user_ratio,
    CASE WHEN gn >= 3 AND gs + gm > 0 THEN (gs - gm) / (gs + gm) ELSE 0 END AS burstiness, CASE WHEN gn >= 3 THEN gm ELSE 0 END AS inter_arrival_mean, CASE WHEN gn >= 3 THEN gs ELSE 0 END AS inter_arrival_std, CASE WHEN gn >= 3 AND gm > 0 THEN gs / gm ELSE 0 END AS inter_arrival_cv
  FROM f1 JOIN f2 USING (cluster_id) JOIN f3 USING (cluster_id) JOIN f3b USING (cluster_id) JOIN f4 USING (cluster_id) JOIN f5 USING (cluster_id) LEFT JOIN f6 USING (cluster_id) JOIN f7 USING (cluster_id))"""

TEMPORAL = ["cumulative_tweets", "cumulative_engagement", "windows_since_start", "mean_tweets_per_window", "mean_engagement_per_window"]
GROUPS = {
    "w01_growth": ["growth_rate", "engagement_velocity", "acceleration", "engagement_jerk"],
    "w02_early_ratio": ["early_velocity_ratio", "final_window_ratio"],
    "w03_peak_position": ["peak_position_ratio", "is_post_peak"],
    "w04_values_at_detection": ["z_score_at_detect", "max_z_score_seen", "z_score_count_at_detect", "z_score_engagement_at_detect", "kleinberg_state_at_detect"],
    "w05_cumulative": TEMPORAL + ["total_unique_users", "max_followers_seen", "avg_followers_seen"],
    "w06_calendar": ["hour_of_day", "is_weekend", "is_morning", "is_evening"],
    "a09_inter_arrival": ["burstiness", "inter_arrival_mean", "inter_arrival_std", "inter_arrival_cv"],
    "a10_gini": ["engagement_gini"],
    "a11_entropy": ["geographic_entropy_predetect", "unique_countries_predetect", "posting_hour_entropy"],
    "a12_skewness": ["engagement_skewness"],
    "a13_user_concentration": ["user_gini", "top_user_ratio"],
    "a14_account_age": ["account_age_avg_days"],
    "a15_efficiency": ["engagement_per_follower", "amplification_factor", "rt_like_ratio", "max_retweets_per_tweet", "avg_likes_per_tweet"],
}
FEATURES = [c for g in ("w05_cumulative", "w01_growth", "w02_early_ratio", "w03_peak_position", "w04_values_at_detection", "w06_calendar", "a09_inter_arrival", "a10_gini", "a11_entropy", "a12_skewness", "a13_user_concentration", "a14_account_age", "a15_efficiency") for c in GROUPS[g]]
_DOUBLE = set(FEATURES) - {"cumulative_tweets", "cumulative_engagement", "windows_since_start", "max_followers_seen", "total_unique_users", "kleinberg_state_at_detect", "unique_countries_predetect", "hour_of_day", "max_retweets_per_tweet"}


def _feature_sql(cols: list[str]) -> str:
    return "WITH RECURSIVE" + _ALL + " SELECT cluster_id, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" if c in _DOUBLE else c for c in cols) + " FROM feat"


def features_of(spark, sf_dir):
    """The 42 features of each detected cluster."""
    s, found = _detected(spark, sf_dir)
    return features.virality_features(anomaly.kleinberg_states(s), tweets(spark, sf_dir), found)


@query(_feature_sql(FEATURES))
def w11_features(spark, sf_dir):
    return rounded(features_of(spark, sf_dir).select("cluster_id", *FEATURES))


@query("WITH RECURSIVE" + _ALL + PSR[len(DETECTED) :] + " SELECT cluster_id, cumulative_tweets, round(growth_rate, 6) AS growth_rate, round(CAST(psr AS DOUBLE), 6) AS psr FROM feat JOIN psr USING (cluster_id)")
def j02_features_with_psr(spark, sf_dir):
    p = timeseries.psr(*_detected(spark, sf_dir)).select("cluster_id", "psr")
    return rounded(features_of(spark, sf_dir).select("cluster_id", "cumulative_tweets", "growth_rate").join(p, "cluster_id"))


def _group(name: str, cols: list[str]):
    def run(spark, sf_dir):
        return rounded(features_of(spark, sf_dir).select("cluster_id", *cols))

    run.__name__ = name
    query(_feature_sql(cols))(run)


for _name, _cols in GROUPS.items():
    _group(_name, _cols)


@query("WITH" + SERIES + """ SELECT cluster_id, CAST(epoch(timestamp) AS BIGINT) AS hour, round(CASE WHEN avg(tweet_count) OVER w > 0 THEN tweet_count / avg(tweet_count) OVER w ELSE 0 END
    + 0.3 * CASE WHEN avg(engagement) OVER w > 0 THEN engagement / avg(engagement) OVER w ELSE 0 END + 1e-9, 6) AS signal FROM ts WINDOW w AS (PARTITION BY cluster_id ORDER BY timestamp ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""")
def n01_signal(spark, sf_dir):
    return rounded(timeseries.arrival_signal(_series(spark, sf_dir)).select("cluster_id", epoch("timestamp").alias("hour"), (F.col("signal") + 1e-9).alias("signal")))


@query("WITH" + SCORED + """, t AS (SELECT cluster_id, timestamp, coalesce(tweet_count - mean_count, 0) AS residual, coalesce(tweet_count / mean_count, 0) AS ratio,
    coalesce(tweet_count - lag(tweet_count) OVER (PARTITION BY cluster_id ORDER BY timestamp), 0) AS velocity FROM hist)
    SELECT cluster_id, CAST(epoch(timestamp) AS BIGINT) AS hour, round(residual, 6) AS residual, round(ratio, 6) AS ratio, velocity, residual > 10 AS residual_trigger, ratio > 3 AS ratio_trigger, velocity > 10 AS velocity_trigger FROM t""")
def n03_simple_triggers(spark, sf_dir):
    s = anomaly.simple_triggers(_series(spark, sf_dir))
    return rounded(s.select("cluster_id", epoch("timestamp").alias("hour"), "residual", "ratio", "velocity", "residual_trigger", "ratio_trigger", "velocity_trigger"))


COLD = """,
hrs AS (SELECT timestamp, sum(count(*)) OVER h AS n, sum(sum(tweet_count)) OVER h AS s, sum(sum(tweet_count * tweet_count)) OVER h AS q FROM scored GROUP BY timestamp WINDOW h AS (ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cold AS (SELECT sc.*, n_prev < 6 AS is_cold, CASE WHEN sqrt(greatest(q / n - power(s / n, 2), 0)) > 1e-9 THEN (tweet_count - s / n) / sqrt(greatest(q / n - power(s / n, 2), 0)) ELSE 0.0 END AS cold_z FROM scored sc JOIN hrs USING (timestamp))"""


@query("WITH" + SCORED + COLD + " SELECT cluster_id, CAST(epoch(timestamp) AS BIGINT) AS hour, is_cold, round(cold_z, 6) AS cold_z, is_cold AND cold_z > 3 AS cold_trigger FROM cold")
def n05_cold_start(spark, sf_dir):
    c = anomaly.cold_start(_scored(spark, sf_dir))
    return rounded(c.select("cluster_id", epoch("timestamp").alias("hour"), "is_cold", "cold_z", "cold_trigger"))


_TYPED = "WITH RECURSIVE" + SCORED + COLD + KLEINBERG + """,
typed AS (SELECT c.*, kleinberg_state, CASE WHEN is_cold AND cold_z > 3 THEN 'cold' WHEN is_anomaly_trigger AND kleinberg_state >= 2 THEN 'both' WHEN is_anomaly_trigger THEN 'z_only' WHEN kleinberg_state >= 2 AND NOT is_cold THEN 'burst_only' ELSE 'none' END AS trigger_type
  FROM cold c JOIN kstate USING (cluster_id, timestamp))"""


def _typed(spark, sf_dir):
    return anomaly.ensemble_trigger(anomaly.cold_start(anomaly.kleinberg_states(_scored(spark, sf_dir))))


@query(_TYPED + " SELECT cluster_id, CAST(epoch(timestamp) AS BIGINT) AS hour, trigger_type FROM typed WHERE trigger_type <> 'none'")
def n06_ensemble(spark, sf_dir):
    return _typed(spark, sf_dir).filter("trigger_type <> 'none'").select("cluster_id", epoch("timestamp").alias("hour"), "trigger_type")


@query(_TYPED + " SELECT trigger_type, count(*) AS n, count(DISTINCT cluster_id) AS n_clusters FROM typed WHERE trigger_type <> 'none' GROUP BY 1")
def a23_trigger_types(spark, sf_dir):
    return _typed(spark, sf_dir).filter("trigger_type <> 'none'").groupBy("trigger_type").agg(F.count("*").alias("n"), F.count_distinct("cluster_id").alias("n_clusters"))


_EXPOSE = """,
num AS (SELECT cluster_id, timestamp, tweet_count AS x, row_number() OVER (PARTITION BY cluster_id ORDER BY timestamp) AS t FROM ts),
ex AS (SELECT a.cluster_id, a.timestamp, a.t, 1 - coalesce(sum(0.1 * power(0.9, a.t - b.t - 1) * exp(-0.1 * power(a.x - b.x, 2))), 0) AS expose_score FROM num a LEFT JOIN num b ON a.cluster_id = b.cluster_id AND b.t < a.t GROUP BY ALL)"""


@query()
def n07_fourier(spark, sf_dir):
    return rounded(anomaly.expose_fourier(_series(spark, sf_dir)).select("cluster_id", epoch("timestamp").alias("hour"), "expose_score"))


@query("WITH" + SERIES + _EXPOSE + " SELECT cluster_id, CAST(epoch(timestamp) AS BIGINT) AS hour, round(expose_score, 6) AS expose_score FROM ex")
def n07_expose(spark, sf_dir):
    return rounded(anomaly.expose(_series(spark, sf_dir)).select("cluster_id", epoch("timestamp").alias("hour"), "expose_score"))


@query("WITH" + SERIES + """,
b AS (SELECT *, list(CAST(tweet_count AS DOUBLE)) OVER w AS past, avg(tweet_count) OVER w AS mu, stddev_pop(tweet_count) OVER w AS sd, median(tweet_count) OVER w AS med, count(*) OVER w AS n FROM ts WINDOW w AS (PARTITION BY cluster_id ORDER BY timestamp ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, CASE WHEN n >= 6 AND tweet_count > mu + 3 * sd THEN 1 ELSE 0 END AS vote_sigma, CASE WHEN n >= 6 AND tweet_count > 2 * mu THEN 1 ELSE 0 END AS vote_mean,
  CASE WHEN n >= 6 AND tweet_count > med + 6 * list_aggregate(list_transform(past, lambda p: abs(p - med)), 'median') THEN 1 ELSE 0 END AS vote_mad,
  CASE WHEN n >= 6 AND tweet_count > list_reduce(past, lambda a, p: 0.7 * a + 0.3 * p) + 3 * sd THEN 1 ELSE 0 END AS vote_ewma FROM b)
SELECT cluster_id, CAST(epoch(timestamp) AS BIGINT) AS hour, CAST(vote_sigma AS INTEGER) AS vote_sigma, CAST(vote_mean AS INTEGER) AS vote_mean, CAST(vote_mad AS INTEGER) AS vote_mad, CAST(vote_ewma AS INTEGER) AS vote_ewma, vote_sigma + vote_mean + vote_mad + vote_ewma >= 3 AS skyline_trigger,
  CAST('0x' || substr(md5(cluster_id || '|' || CAST(epoch(timestamp) AS BIGINT)), 1, 8) AS BIGINT) / 4294967296.0 < 0.05 AS random_trigger, coalesce(n >= 6 AND round((tweet_count - mu) / nullif(sd, 0), 9) > 3, false) AS z_trigger FROM v""")
def n08_baselines(spark, sf_dir):
    b = anomaly.trailing_baselines(_series(spark, sf_dir))
    return b.select("cluster_id", epoch("timestamp").alias("hour"), "vote_sigma", "vote_mean", "vote_mad", "vote_ewma", "skyline_trigger", "random_trigger", F.coalesce("z_trigger", F.lit(False)).alias("z_trigger"))


@query("WITH" + SERIES + """,
c AS (SELECT *, count(*) OVER w AS n, CAST(sum(tweet_count) OVER w AS DOUBLE) AS s, CAST(tweet_count AS DOUBLE) AS x FROM ts WINDOW w AS (PARTITION BY cluster_id ORDER BY timestamp ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT cluster_id, CAST(epoch(timestamp) AS BIGINT) AS hour, round(CASE WHEN n >= 6 THEN (CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END) + (CASE WHEN s > 0 THEN s * ln(s / n) ELSE 0 END) - (CASE WHEN x + s > 0 THEN (x + s) * ln((x + s) / (n + 1)) ELSE 0 END) ELSE 0 END, 6) AS change_score FROM c""")
def n08_change_point(spark, sf_dir):
    return rounded(anomaly.change_point(_series(spark, sf_dir)).select("cluster_id", epoch("timestamp").alias("hour"), "change_score"))


def n09_loda(spark, sf_dir):
    rows = _series(spark, sf_dir).withColumn("row", F.concat_ws("|", "cluster_id", epoch("timestamp")))
    return rounded(anomaly.loda(rows, "row", ["tweet_count", "engagement", "unique_users", "avg_followers"]))


_LODA = "WITH" + SERIES + """,
st AS (SELECT avg(tweet_count) AS m1, stddev_pop(tweet_count) AS s1, avg(engagement) AS m2, stddev_pop(engagement) AS s2, avg(unique_users) AS m3, stddev_pop(unique_users) AS s3, avg(avg_followers) AS m4, stddev_pop(avg_followers) AS s4, count(*) AS n FROM ts),
zz AS (SELECT cluster_id || '|' || CAST(epoch(timestamp) AS BIGINT) AS row, n, CASE WHEN s1 > 0 THEN (tweet_count - m1) / s1 ELSE 0 END AS z1, CASE WHEN s2 > 0 THEN (engagement - m2) / s2 ELSE 0 END AS z2, CASE WHEN s3 > 0 THEN (unique_users - m3) / s3 ELSE 0 END AS z3, CASE WHEN s4 > 0 THEN (avg_followers - m4) / s4 ELSE 0 END AS z4 FROM ts, st),
w AS (SELECT j, """ + ", ".join(f"CAST('0x' || substr(md5(j || '|{c}'), 1, 8) AS BIGINT) % 3 - 1 AS w{i}" for i, c in enumerate(("tweet_count", "engagement", "unique_users", "avg_followers"), 1)) + """ FROM (SELECT unnest(range(16)) AS j)),
ce AS (SELECT row, n, j, floor(round((w1 * z1 + w2 * z2 + w3 * z3 + w4 * z4) * 2, 6)) AS cell FROM zz, w), cn AS (SELECT j, cell, count(*) AS c FROM ce GROUP BY ALL)
SELECT row, round(avg(-ln(c / CAST(n AS DOUBLE))), 6) AS loda_score FROM ce JOIN cn USING (j, cell) GROUP BY row"""
query(_LODA)(n09_loda)

_TOPS = """,
tops AS (SELECT cluster_id, max(engagement) AS top, sum(engagement) AS total, count(*) AS n_rows FROM ts GROUP BY 1),
pk AS (SELECT ts.cluster_id, min(timestamp) AS peak_time, any_value(n_rows) AS n_rows, any_value(total) AS total FROM ts JOIN tops USING (cluster_id) WHERE engagement = top GROUP BY 1)"""
_LEADS = """,
ld AS (SELECT {by} pk.cluster_id, max(CASE WHEN l > 0 AND l <= 24 THEN l END) AS lead_h, max(CASE WHEN l > 0 AND l <= 24 THEN 0 ELSE 1 END) AS is_fp, sum(CASE WHEN l > 0 AND l <= 24 THEN 1 ELSE 0 END) AS n_tp, count(*) AS n_det
  FROM (SELECT {by} tr.cluster_id, (epoch(peak_time) - epoch(timestamp)) / 3600 AS l FROM tr JOIN pk USING (cluster_id)) tr JOIN pk USING (cluster_id) GROUP BY ALL)"""
_NAB = """count(*) AS clusters, count(lead_h) AS detected, round(100 * (coalesce(sum(lead_h), 0) / 24 - 0.1 * sum(coalesce(is_fp, 0))) / count(*), 6) AS nab_score, round(100.0 * count(lead_h) / count(*), 6) AS detection_rate,
  round(100 - 100.0 * count(lead_h) / count(*), 6) AS missed_rate, round(CASE WHEN sum(coalesce(n_det, 0)) > 0 THEN 100.0 * sum(coalesce(n_tp, 0)) / sum(n_det) ELSE 0 END, 6) AS precision, round(quantile_cont(lead_h, 0.5), 6) AS median_lead"""


@query("WITH" + SCORED + _TOPS + ", tr AS (SELECT cluster_id, timestamp FROM scored WHERE is_anomaly_trigger)" + _LEADS.format(by="") + f" SELECT {_NAB} FROM pk LEFT JOIN ld USING (cluster_id)")
def n10_nab_score(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return rounded(anomaly.nab_figures(anomaly.lead_rows(s.filter("is_anomaly_trigger"), anomaly.peaks(s))))


@query("WITH" + SCORED + _TOPS + ", tr AS (SELECT cluster_id, timestamp FROM scored WHERE is_anomaly_trigger)" + _LEADS.format(by="") + f" SELECT min_rows, {_NAB} FROM (SELECT unnest([50, 70, 89, 150, 300]) AS min_rows) JOIN pk ON n_rows >= min_rows LEFT JOIN ld USING (cluster_id) GROUP BY min_rows")
def n11_min_rows(spark, sf_dir):
    s = _scored(spark, sf_dir)
    rows = anomaly.lead_rows(s.filter("is_anomaly_trigger"), anomaly.peaks(s))
    sweep = rows.withColumn("min_rows", F.explode(F.array(*map(F.lit, (50, 70, 89, 150, 300))))).filter("n_rows >= min_rows")
    return rounded(anomaly.nab_figures(sweep, by=["min_rows"]))


_GRID = {"decay": [0.005, 0.01, 0.02, 0.05], "gamma": [0.25, 0.5, 1.0], "threshold": [0.05, 0.1, 0.15, 0.2]}
_BY = "decay, gamma, threshold, signal"
_GRID_SQL = "WITH" + SERIES + _TOPS + f""",
sg AS (SELECT cluster_id, timestamp, CAST(tweet_count AS DOUBLE) AS tweet_count, CASE WHEN avg(tweet_count) OVER w > 0 THEN tweet_count / avg(tweet_count) OVER w ELSE 0 END + 0.3 * CASE WHEN avg(engagement) OVER w > 0 THEN engagement / avg(engagement) OVER w ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY cluster_id ORDER BY timestamp) AS t FROM ts WINDOW w AS (PARTITION BY cluster_id ORDER BY timestamp ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
num AS (SELECT 'tweet_count' AS signal, cluster_id, timestamp, t, tweet_count AS x FROM sg UNION ALL SELECT 'signal', cluster_id, timestamp, t, rate FROM sg),
pr AS (SELECT a.signal, a.cluster_id, a.timestamp, a.t - b.t - 1 AS lag, power(a.x - b.x, 2) AS d FROM num a LEFT JOIN num b ON a.signal = b.signal AND a.cluster_id = b.cluster_id AND b.t < a.t),
par AS (SELECT d AS decay, g AS gamma FROM (SELECT unnest({_GRID["decay"]}::DOUBLE[]) AS d), (SELECT unnest({_GRID["gamma"]}::DOUBLE[]) AS g)),
ex AS (SELECT decay, gamma, signal, cluster_id, timestamp, 1 - coalesce(sum(decay * power(1 - decay, lag) * exp(-gamma * d)), 0) AS e FROM par, pr GROUP BY ALL),
tr AS (SELECT {_BY}, cluster_id, timestamp FROM ex, (SELECT unnest({_GRID["threshold"]}::DOUBLE[]) AS threshold) WHERE round(e, 9) > threshold),
st AS (SELECT DISTINCT {_BY} FROM tr)""" + _LEADS.format(by=_BY + ",") + f""", gr AS (SELECT {_BY}, {_NAB} FROM (SELECT * FROM st, pk) LEFT JOIN ld USING ({_BY}, cluster_id) GROUP BY 1, 2, 3, 4)
SELECT *, row_number() OVER (ORDER BY nab_score DESC, {_BY}) = 1 AS is_best FROM gr"""


@query(_GRID_SQL)
def n12_expose_grid(spark, sf_dir):
    s = timeseries.arrival_signal(_series(spark, sf_dir))
    scores = anomaly.expose_grid(s, _GRID["decay"], _GRID["gamma"], ["tweet_count", "signal"])  # thresholds are applied after
    hits = scores.withColumn("threshold", F.explode(F.array(*map(F.lit, _GRID["threshold"])))).filter(F.round("expose_score", 9) > F.col("threshold"))
    by = ["decay", "gamma", "threshold", "signal"]
    grid = rounded(anomaly.nab_figures(anomaly.lead_rows(hits, anomaly.peaks(s), by=by), by=by))
    return grid.withColumn("is_best", F.row_number().over(Window.orderBy(F.desc("nab_score"), *by)) == 1)  # over a row a setting


@query("WITH" + DETECTED + _TOPS + """,
g AS (SELECT CAST(total AS DOUBLE) AS total, CASE WHEN detection_time IS NULL THEN 0 ELSE 1 END AS hit FROM pk LEFT JOIN detected USING (cluster_id)),
c AS (SELECT unnest(['>=100', '>=250', '>=500', '>=1000']) AS rule, unnest([100.0, 250.0, 500.0, 1000.0]) AS cut UNION ALL SELECT 'p90', quantile_cont(total, 0.9) FROM g),
m AS (SELECT rule, sum(CASE WHEN total >= cut AND hit = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN total < cut AND hit = 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN total >= cut AND hit = 0 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN total < cut AND hit = 0 THEN 1 ELSE 0 END) AS tn FROM g, c GROUP BY rule)
SELECT rule, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fn + fp) ELSE 0 END, 6) AS f1, round(CASE WHEN tp > 0 THEN 5 * tp / (5 * tp + 4 * fn + fp) ELSE 0 END, 6) AS f2 FROM m""")
def n13_ground_truth(spark, sf_dir):
    s, found = _detected(spark, sf_dir)
    tops = s.groupBy("cluster_id").agg(F.sum("engagement").alias("total"))
    return rounded(anomaly.ground_truth(tops, found, [100, 250, 500, 1000]))


@query("WITH" + DETECTED + _TOPS + """, h AS (SELECT (epoch(peak_time) - epoch(detection_time)) / 3600 AS h FROM detected JOIN pk USING (cluster_id))
SELECT count(*) AS n, round(quantile_cont(h, 0.5), 6) AS median_lead, round(avg(h), 6) AS mean_lead, round(quantile_cont(h, 0.25), 6) AS p25_lead, round(quantile_cont(h, 0.75), 6) AS p75_lead, CAST(sum(CASE WHEN h > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive FROM h""")
def n14_lead_time(spark, sf_dir):
    s, found = _detected(spark, sf_dir)
    return rounded(anomaly.lead_times(found, anomaly.peaks(s)))
