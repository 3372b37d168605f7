"""Queries of files, sequences, quality checks, models and streams."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimscope.functions.text import count_cosine
from claimscope.operators import anomaly, evaluate, ingest, models, quality, sequences, timeseries
from claimscope.plans.fixtures import DETECTED, SCORED, SERIES, TWEETS, table, tweets
from claimscope.plans.registry import epoch, query, rounded
from claimscope.plans.series_queries import _TOPS, _detected, _scored, _series
from claimscope.session import new_path as _new_path
from claimscope.sources import files
from claimscope.streaming import jobs


@query("SELECT doc_id AS idx, text AS post, lang AS gold_claim FROM documents")
def src02_csv(spark, sf_dir):
    path = _new_path(spark, "csv")
    files.write_posts_csv(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("post"), F.col("lang").alias("normalized claim")), path)
    return files.read_posts_csv(spark, path, line_sep="\n").select(F.col("idx").cast("long").alias("idx"), "post", "gold_claim")


_LOG = "lg AS (SELECT doc_id AS idx, CASE WHEN doc_id % 11 = 0 THEN 'ERROR: x' WHEN doc_id % 13 = 0 THEN 'TIMEOUT: y' ELSE lang END AS predicted_claim FROM documents)"


def _log(spark, sf_dir):
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(i.alias("idx"), F.when(i % 11 == 0, "ERROR: x").when(i % 13 == 0, "TIMEOUT: y").otherwise(F.col("lang")).alias("predicted_claim"), F.lit("m").alias("model"))
    path = _new_path(spark, "log")
    files.append_results(rows.filter("idx % 2 = 0"), path)
    files.append_results(rows.filter("idx % 2 = 1"), path)
    return path


@query(f"WITH {_LOG} SELECT idx, predicted_claim FROM lg WHERE predicted_claim NOT LIKE 'ERROR:%' AND predicted_claim NOT LIKE 'TIMEOUT:%'")
def src05_result_log(spark, sf_dir):
    return files.read_result_log(spark, _log(spark, sf_dir)).select("idx", "predicted_claim")


@query(f"WITH {_LOG} SELECT idx FROM lg WHERE predicted_claim LIKE 'ERROR:%' OR predicted_claim LIKE 'TIMEOUT:%'")
def src06_resume(spark, sf_dir):
    done = files.read_result_log(spark, _log(spark, sf_dir))
    return files.to_do(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx")), done)


@query(f"WITH {_LOG} SELECT count(*) AS n FROM lg")
def src07_append(spark, sf_dir):
    return spark.read.schema(files.RESULT_LOG).json(_log(spark, sf_dir)).agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS pred_label, 'r1' AS run_id FROM labels")
def src08_prediction_file(spark, sf_dir):
    path = _new_path(spark, "tsv")
    files.write_predictions(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("pred")), path, "r1")
    return spark.read.schema("id long, pred_label string, run_id string").csv(path, header=True, sep="\t")


@query()
def src09_file_profile(spark, sf_dir):
    return files.file_profile(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "documents").columns)


@query()
def src10_manifest(spark, sf_dir):
    listed = files.manifest(spark, sf_dir).withColumn("digest", F.when(F.col("name").contains("labels"), "00").otherwise(F.col("digest")))
    listed = listed.filter("name not like '%region%'").union(spark.createDataFrame([("not_there.parquet", "00")], "name string, digest string"))
    return files.check_manifest(spark, sf_dir, listed)


_Z = "(CAST({c} AS DOUBLE) - avg({c}) OVER p) / (stddev_pop({c}) OVER p + 1e-8)"


@query("WITH" + SERIES + f""", z AS (SELECT cluster_id, {_Z.format(c='tweet_count')} AS z, row_number() OVER (PARTITION BY cluster_id ORDER BY timestamp DESC) AS back, count(*) OVER p AS n FROM ts WINDOW p AS (PARTITION BY cluster_id))
SELECT cluster_id, any_value(n) AS n, round(sum(CASE WHEN back <= 24 THEN z ELSE 0 END), 6) AS total, round(max(CASE WHEN back = 1 THEN z END), 6) AS last FROM z WHERE n >= 3 GROUP BY cluster_id""")
def w07_series_tensor(spark, sf_dir):
    t = sequences.series_tensor(_series(spark, sf_dir), ["tweet_count", "engagement", "unique_users"])
    return rounded(t.select("cluster_id", "n", F.aggregate("tweet_count", F.lit(0.0), lambda a, x: a + x).alias("total"), F.element_at("tweet_count", -1).alias("last")))


@query("WITH" + DETECTED + """, seen AS (SELECT t.* FROM tweets t JOIN detected USING (cluster_id) WHERE created_at <= detection_time), g AS (SELECT cluster_id, count(*) AS n, round(epoch_us(max(created_at)) / 1e6 - epoch_us(min(created_at)) / 1e6, 6) AS last_offset, sum(epoch_us(created_at) / 1e6) - count(*) * min(epoch_us(created_at) / 1e6) AS total FROM seen GROUP BY cluster_id),
h AS (SELECT cluster_id, var_pop(c) / avg(c) AS f FROM (SELECT cluster_id, date_trunc('hour', created_at) AS h, count(*) AS c FROM seen GROUP BY ALL) GROUP BY cluster_id) SELECT cluster_id, last_offset, round(CASE WHEN f > 1 THEN 1 - 1 / sqrt(f) ELSE 0 END, 6) AS branching FROM g JOIN h USING (cluster_id) WHERE n >= 5""")
def w08_arrival_offsets(spark, sf_dir):
    _, found = _detected(spark, sf_dir)
    seen = timeseries.until_detection(tweets(spark, sf_dir), found, "created_at")
    return rounded(sequences.arrival_figures(seen))


_POSTS = "ps AS (SELECT doc_id AS id, doc_id % 25 AS cluster_id, TIMESTAMP '2024-01-01' + to_minutes(doc_id * 37 % 5000) AS created_at, text FROM documents)"


def _posts(spark, sf_dir):
    i = F.col("doc_id")
    at = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(mins=(i * 37 % 5000).cast("int"))
    return table(spark, sf_dir, "documents").select(i.alias("id"), (i % 25).alias("cluster_id"), at.alias("created_at"), "text")


@query(f"WITH {_POSTS}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY created_at, id) AS r FROM ps WHERE length(trim(text, ' ')) > 0) SELECT cluster_id, string_agg(text, ' ' ORDER BY r) AS text FROM r WHERE r <= 5 GROUP BY cluster_id")
def w09_representative_text(spark, sf_dir):
    return sequences.representative_text(_posts(spark, sf_dir))


_WORDS = r"regexp_extract_all(lower({0}), '\p{{L}}+')"
_COUNTS = "list_sum(list_transform(list_distinct({0}), lambda w: len(list_filter({0}, lambda x: x = w)) * len(list_filter({1}, lambda x: x = w))))"


@query(f"""WITH {_POSTS}, f AS (SELECT cluster_id, text AS title FROM ps WHERE length(trim(text)) > 0 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY created_at, id) = 1),
s AS (SELECT id, cluster_id, text, {_WORDS.format('text')} AS a, {_WORDS.format('title')} AS b FROM ps JOIN f USING (cluster_id) WHERE text IS NOT NULL),
r AS (SELECT cluster_id, text, row_number() OVER (PARTITION BY cluster_id ORDER BY round(coalesce({_COUNTS.format('a', 'b')} / nullif(sqrt({_COUNTS.format('a', 'a')}) * sqrt({_COUNTS.format('b', 'b')}), 0), 0), 9) DESC, id) AS r FROM s)
SELECT cluster_id, string_agg(text, chr(10) || chr(10) ORDER BY r) AS text FROM r WHERE r <= 4 GROUP BY cluster_id""")
def w10_top_posts(spark, sf_dir):
    posts = _posts(spark, sf_dir).filter("text is not null")
    titles = sequences.representative_text(posts, 1).select("cluster_id", ingest.words(F.col("text")).alias("title"))  # a row for each of 25 topics, so posts are scored where they are read
    similarity = F.round(count_cosine(ingest.words(F.col("text")), F.col("title")), 9)
    return sequences.top_posts(posts.join(F.broadcast(titles), "cluster_id").withColumn("similarity", similarity), "cluster_id", 4)


_PEEK = """pk6 AS (SELECT t.*, like_count + retweet_count AS e, z_score_at_detection, detection_time, (floor(epoch(created_at)) - epoch(detection_time)) / 3600 AS h, id % 3 = 0 AS has_url, id % 4 = 0 AS has_media, id % 5 AS n_hashtags, id % 10 = 0 AS verified FROM tweets t JOIN (SELECT cluster_id, detection_time, z_score AS z_score_at_detection FROM detected JOIN scored USING (cluster_id) WHERE timestamp = detection_time) d USING (cluster_id)),
w AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY created_at, id) AS r, h <= 6 AS i FROM pk6 WHERE h BETWEEN 0 AND 48),
g AS (SELECT cluster_id, any_value(z_score_at_detection) AS z, any_value(detection_time) AS dt, count(*) FILTER (i) AS n, sum(e) FILTER (i) AS e, sum(retweet_count) FILTER (i) AS rt, sum(like_count) FILTER (i) AS lk, coalesce(sum(e) FILTER (h <= 3), 0) AS a, coalesce(sum(e) FILTER (h > 3 AND h <= 6), 0) AS b,
  avg(CAST(has_url AS INT)) FILTER (i) AS ud, avg(CAST(has_media AS INT)) FILTER (i) AS md, avg(n_hashtags) FILTER (i) AS hs, avg(followers) FILTER (r <= 50) AS af, max(followers) FILTER (r <= 50) AS mf, avg(CAST(verified AS INT)) FILTER (i) AS vr, sum(e) >= 500 AS is_viral FROM w GROUP BY cluster_id)"""


@query("WITH" + DETECTED + ", " + _PEEK + " SELECT cluster_id, round(z, 6) AS z_score_at_detection, n AS tweet_count, CAST(e AS BIGINT) AS engagement_sum, round(n / 6, 6) AS tweets_per_hour, round(e / 6, 6) AS engagement_velocity, round(CASE WHEN a > 0 THEN b / a ELSE 0 END, 6) AS momentum, round(CASE WHEN e > 0 THEN rt / e ELSE 0 END, 6) AS rt_ratio, round(CASE WHEN e > 0 THEN lk / e ELSE 0 END, 6) AS like_ratio, round(e / n, 6) AS engagement_efficiency, round(ud, 6) AS url_density, round(md, 6) AS media_density, round(hs, 6) AS hashtag_avg, CAST(hour(dt) AS INTEGER) AS hour_of_day, CASE WHEN isodow(dt) >= 6 THEN 1 ELSE 0 END AS is_weekend, round(af, 6) AS avg_followers_first_50, mf AS max_followers_first_50, round(vr, 6) AS verified_ratio, round(rt / (lk + 1), 6) AS rt_like_ratio, is_viral FROM g WHERE n > 0")
def w12_early_peek(spark, sf_dir):
    s, found = _detected(spark, sf_dir)
    at = found.join(s, "cluster_id").filter("timestamp = detection_time").select("cluster_id", "detection_time", F.col("z_score").alias("z_score_at_detection"))
    i = F.col("id")
    posts = tweets(spark, sf_dir).withColumns({"has_url": i % 3 == 0, "has_media": i % 4 == 0, "n_hashtags": i % 5, "verified": i % 10 == 0})
    return rounded(sequences.early_peek(posts, at))


_CLAIM = "cl AS (SELECT doc_id AS claim_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id * 37 % 101 / 100.0 END AS p, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(doc_id * 13 % 101 AS DOUBLE) END AS c, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE CAST(doc_id * 17 % 101 AS DOUBLE) END AS v, CAST(doc_id * 19 % 101 AS DOUBLE) AS h, doc_id % 4 = 0 AS vir FROM documents)"


@query(f"""WITH {_CLAIM}, s AS (SELECT 'positive' AS category, claim_id, coalesce(p, 0) * 100 + coalesce(c, 50) + coalesce(v, 50) + coalesce(h, 30) + CASE WHEN vir THEN 20 ELSE 0 END AS s FROM cl WHERE p > 0.6 AND (c IS NULL OR c > 60) AND (v IS NULL OR v > 60)
UNION ALL SELECT 'negative', claim_id, (1 - coalesce(p, 0.5)) * 100 + 100 - coalesce(c, 50) + 100 - coalesce(v, 50) + 100 - coalesce(h, 50) FROM cl WHERE p < 0.4
UNION ALL SELECT 'borderline', claim_id, 100 - abs(p - 0.5) * 200 + (abs(coalesce(c, 50) - coalesce(h, 50)) + abs(coalesce(v, 50) - coalesce(h, 50))) * 0.5 FROM cl WHERE p > 0.35 AND p < 0.65),
r AS (SELECT category, claim_id, round(CAST(s AS DOUBLE), 6) AS selection_score, row_number() OVER (PARTITION BY category ORDER BY round(CAST(s AS DOUBLE), 6) DESC, claim_id) AS r FROM s) SELECT category, claim_id, selection_score FROM r WHERE r <= 20""")
def t08_study_selection(spark, sf_dir):
    i = F.col("doc_id")
    claims = table(spark, sf_dir, "documents").select(
        i.alias("claim_id"), F.when(i % 9 != 0, i * 37 % 101 / 100.0).alias("checkworthiness_prob"), F.when(i % 7 != 0, (i * 13 % 101).cast("double")).alias("checkability_score"),
        F.when(i % 8 != 0, (i * 17 % 101).cast("double")).alias("verifiability_score"), (i * 19 % 101).cast("double").alias("harm_score"), (i % 4 == 0).alias("is_viral"), (i % 3 == 0).alias("is_checkworthy"),
    )
    return quality.study_selection(claims, 20)


_COUNTED = "ob AS (SELECT source AS name, count(*) AS n FROM documents GROUP BY source), ex AS (SELECT source AS name, count(*) + CASE CAST(substr(source, 4) AS INT) % 3 WHEN 0 THEN 0 WHEN 1 THEN 50 ELSE 0 END AS expected FROM documents WHERE source <> 'src5' GROUP BY source UNION ALL SELECT 'src99', 5)"
_CHECKS = f"WITH {_COUNTED}, ck AS (SELECT name, n, expected, CASE WHEN expected IS NULL THEN 'INFO' WHEN n IS NULL THEN 'FAIL' WHEN n = expected THEN 'OK' WHEN abs(n - expected) <= 0.01 * expected THEN 'WARN' ELSE 'FAIL' END AS status FROM ob FULL JOIN ex USING (name))"


def _row_checks(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"))
    more = F.when(F.substring("name", 4, 9).cast("int") % 3 == 1, 50).otherwise(0)
    expected = n.filter("name <> 'src5'").select("name", (F.col("n") + more).alias("expected")).union(spark.createDataFrame([("src99", 5)], "name string, expected long"))
    return quality.row_count_checks(n, expected)


@query(_CHECKS + " SELECT * FROM ck")
def q01_row_counts(spark, sf_dir):
    return _row_checks(spark, sf_dir)


@query("WITH a AS (SELECT lang AS name, avg(n_chars) AS actual FROM documents GROUP BY lang), e AS (SELECT name, round(actual, 2) AS value, CASE WHEN name = 'fr' THEN 1.0 END AS tol, CASE WHEN name = 'en' THEN 2 WHEN name = 'de' THEN 4 WHEN name = 'es' THEN 1 END AS digits FROM a) SELECT name, CASE WHEN digits IS NOT NULL THEN CASE WHEN round(actual, CAST(digits AS INTEGER)) = round(value, CAST(digits AS INTEGER)) THEN 'OK' ELSE 'FAIL' END WHEN abs(round(actual - value, 12)) <= coalesce(tol, 0.0) THEN 'OK' ELSE 'FAIL' END AS status FROM e JOIN a USING (name)")
def q02_values(spark, sf_dir):
    a = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("name")).agg(F.avg("n_chars").alias("actual"))
    e = a.select("name", F.round("actual", 2).alias("value"), F.when(F.col("name") == "fr", 1.0).alias("tol"), F.when(F.col("name") == "en", 2).when(F.col("name") == "de", 4).when(F.col("name") == "es", 1).alias("digits"))
    return quality.value_checks(a, e)


@query(_CHECKS + ", s AS (SELECT " + ", ".join(f"CAST(sum(CASE WHEN status = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{s.lower()}" for s in ("OK", "WARN", "INFO", "FAIL")) + ", NOT bool_or(status = 'FAIL') AS passed FROM ck) SELECT * FROM s")
def q03_severity(spark, sf_dir):
    return quality.severity(_row_checks(spark, sf_dir))


@query("""WITH c AS (SELECT doc_id AS claim, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE n_chars / 7.0 END AS value, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN n_chars / 7.0 WHEN 2 THEN round(n_chars / 7.0, 2) WHEN 3 THEN n_chars / 7.0 + 0.5 ELSE n_chars * 1.0 END AS evidence, 1.0 AS tolerance, CASE doc_id % 4 WHEN 0 THEN 'external' WHEN 1 THEN 'none' ELSE 'log' END AS source, doc_id % 400 AS age_days FROM documents)
SELECT claim, CASE WHEN value IS NULL THEN 'missing' WHEN age_days > 365 THEN 'stale' WHEN evidence IS NULL AND source = 'external' THEN 'external' WHEN evidence IS NULL AND source = 'none' THEN 'unverifiable' WHEN evidence IS NULL THEN 'open' WHEN abs(round(value - evidence, 9)) = 0 THEN 'reproduced' WHEN round(value, 2) = round(evidence, 2) THEN 'rounded' WHEN abs(round(value - evidence, 9)) <= tolerance THEN 'approximate' ELSE 'contradicted' END AS audit FROM c""")
def q04_audit(spark, sf_dir):
    i, v = F.col("doc_id"), F.col("n_chars") / 7.0
    e = F.when(i % 6 == 1, v).when(i % 6 == 2, F.round(v, 2)).when(i % 6 == 3, v + 0.5).when(i % 6 > 3, F.col("n_chars") * 1.0)
    claims = table(spark, sf_dir, "documents").select(i.alias("claim"), F.when(i % 10 != 0, v).alias("value"), e.alias("evidence"), F.lit(1.0).alias("tolerance"), F.when(i % 4 == 0, "external").when(i % 4 == 1, "none").otherwise("log").alias("source"), (i % 400).alias("age_days"))
    return quality.audit(claims)


@query("""WITH r AS (SELECT unnest(['doc_id', 'text', 'n_chars', 'nothing', 'feat_*']) AS "column", unnest(['ok', 'ok', 'wrong type', 'missing', 'ok']) AS status), n AS (SELECT count(*) AS a, count(*) - count(doc_id) AS b, count(*) - count(text) AS c, count(*) - count(n_chars) AS d FROM documents)
SELECT "column", status, CASE WHEN "column" IN ('doc_id', 'text', 'n_chars') THEN a END AS n_rows, CASE "column" WHEN 'doc_id' THEN b WHEN 'text' THEN c WHEN 'n_chars' THEN d END AS n_null FROM r, n""")
def q05_conformance(spark, sf_dir):
    return quality.conformance(table(spark, sf_dir, "documents"), {"doc_id": "bigint", "text": "string", "n_chars": "string", "nothing": "int"}, 0)


@query("WITH" + DETECTED + _TOPS + """, f AS (SELECT cluster_id, first(id ORDER BY created_at, id) AS post, first(user_id ORDER BY created_at, id) AS author, count(*) AS n_posts, CAST(sum(like_count + retweet_count) AS BIGINT) AS engagement FROM tweets GROUP BY cluster_id)
SELECT item_id AS claim_id, '{"origin":{"post":' || post || ',"author":' || author || '},"cluster":{"n_posts":' || n_posts || ',"engagement":' || engagement || '},"modules":{"checkworthiness":' || item_id * 37 % 101 || ',"harm":' || item_id * 19 % 101 || '},"verdict":"' || CASE WHEN item_id % 2 = 0 THEN 'check' ELSE 'skip' END || '"' || coalesce(',"lead_hours":' || CAST((epoch(peak_time) - epoch(detection_time)) / 3600 AS BIGINT), '') || '}' AS report
FROM benchmark JOIN f ON f.cluster_id = item_id % 25 LEFT JOIN detected USING (cluster_id) LEFT JOIN pk USING (cluster_id)""")
def q07_claim_report(spark, sf_dir):
    s, found = _detected(spark, sf_dir)
    claims = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), (F.col("item_id") % 25).alias("cluster_id"), F.when(F.col("item_id") % 2 == 0, 0.9).otherwise(0.1).alias("prob"), (F.col("item_id") * 37 % 101).alias("checkworthiness"), (F.col("item_id") * 19 % 101).alias("harm"))
    return quality.claim_report(claims, tweets(spark, sf_dir), found, anomaly.peaks(s), ["checkworthiness", "harm"])


_DETECTORS = """dt AS (SELECT 'z' AS detector, cluster_id, timestamp, n_prev FROM scored WHERE is_anomaly_trigger UNION ALL SELECT 'ratio', cluster_id, timestamp, n_prev FROM hist WHERE tweet_count / mean_count > 3),
fs AS (SELECT detector, cluster_id, min(timestamp) AS t, arg_min(n_prev, timestamp) AS n_prev FROM dt GROUP BY ALL)"""


@query("WITH" + DETECTED + _TOPS + ", " + _DETECTORS + """, ps AS (SELECT count(*) FILTER (total >= 500) AS positives FROM pk)
SELECT detector, count(*) AS unique_clusters, count(*) FILTER (total >= 500) AS tp, round(count(*) FILTER (total >= 500) / any_value(positives), 6) AS recall, round(count(*) FILTER (total >= 500) / count(*), 6) AS precision, count(*) FILTER (n_prev < 6) AS sparse, count(*) FILTER (n_prev >= 6) AS mature FROM fs JOIN pk USING (cluster_id), ps GROUP BY detector""")
def n15_detector_comparison(spark, sf_dir):
    s = _scored(spark, sf_dir)
    r = anomaly.simple_triggers(s)
    rows = s.filter("is_anomaly_trigger").select(F.lit("z").alias("detector"), "cluster_id", "timestamp", "n_prev").unionByName(r.filter("ratio_trigger").select(F.lit("ratio").alias("detector"), "cluster_id", "timestamp", "n_prev"))
    return rounded(anomaly.compare_detectors(rows, s.groupBy("cluster_id").agg(F.sum("engagement").alias("total")), 500))


_M1 = "st AS (SELECT avg(p_size) AS m, stddev_pop(p_size) AS s, avg(CAST(p_retailprice AS DOUBLE)) AS mp, stddev_pop(CAST(p_retailprice AS DOUBLE)) AS sp FROM part WHERE p_partkey % 5 <> 0)"


def _parts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), F.col("p_retailprice").cast("double").alias("price"))
    return p.withColumn("y", 0.05 * F.col("price") + 2 * F.col("p_size") + F.col("p_partkey") % 7).withColumn("label", (F.col("y") > 130).cast("int")).withColumn("fold", F.col("p_partkey") % 3)


@query(f"WITH {_M1} SELECT p_partkey, round((p_size - m) / s, 6) AS p_size, round((CAST(p_retailprice AS DOUBLE) - mp) / sp, 6) AS price FROM part, st")
def m01_scale(spark, sf_dir):
    p = _parts(spark, sf_dir).select("p_partkey", "p_size", "price")
    return rounded(models.scale(p.filter("p_partkey % 5 <> 0"), p, ["p_size", "price"]))


def _regression(spark, sf_dir, kinds):
    p = _parts(spark, sf_dir)
    train, test = p.filter("p_partkey % 5 <> 0"), p.filter("p_partkey % 5 = 0")
    out = None
    for kind in kinds:
        r = models.regress(train, test, ["p_size", "price"], "y", "p_partkey", kind).withColumn("model", F.lit(kind))
        out = r if out is None else out.unionByName(r)
    return evaluate.regression_scores(out, ["model"], "y", "prediction")


@query()
def m02_linear(spark, sf_dir):
    return _regression(spark, sf_dir, ["ridge", "lasso", "elastic_net", "huber"])


@query()
def m03_trees(spark, sf_dir):
    return _regression(spark, sf_dir, ["forest", "boosted"])


def _classified(spark, sf_dir, **params):
    p = _parts(spark, sf_dir)
    r = models.classify(p.filter("p_partkey % 5 <> 0"), p.filter("p_partkey % 5 = 0"), ["p_size", "price"], "label", "p_partkey", **params)
    return evaluate.sweep(r.withColumn("model", F.lit("m")), ["model"], [0.3, 0.5, 0.7])


@query()
def m04_boosted_classifier(spark, sf_dir):
    return _classified(spark, sf_dir, kind="boosted", positive=3.0)


@query()
def m05_logistic(spark, sf_dir):
    return _classified(spark, sf_dir)


@query()
def m06_pca(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    p = models.principal_components(e, "embedding", 64)
    return rounded(p.select("vec_id", F.size("pca").alias("k"), *[F.abs(F.element_at("pca", i)).alias(f"abs_pc{i}") for i in (1, 2, 3)], F.aggregate("pca", F.lit(0.0), lambda a, x: a + x * x).alias("energy")))


@query()
def m07_grid_search(spark, sf_dir):
    return rounded(models.grid_search(_parts(spark, sf_dir), ["p_size", "price"], "y", "fold", [0.01, 1.0, 10.0], [0.0, 0.5, 1.0], folds=3))


@query()
def m08_stacking(spark, sf_dir):
    p = _parts(spark, sf_dir)
    train, test = p.filter("p_partkey % 5 <> 0"), p.filter("p_partkey % 5 = 0")
    stacked = models.stack(train, test, ["p_size", "price"], "y", "p_partkey", "fold", ["ridge", "forest"])
    voted = models.vote([models.regress(train, test, ["p_size", "price"], "y", "p_partkey", k) for k in ("ridge", "forest")], "p_partkey", "y")
    rows = stacked.withColumn("model", F.lit("stacked")).unionByName(voted.withColumn("model", F.lit("voted")))
    return evaluate.regression_scores(rows, ["model"], "y", "prediction")


def _streamed(spark, sf_dir, build, mode="append"):
    """Runs a stream over the events' posts and a closing heartbeat to its end and returns what its file sink holds."""
    source, sink = _new_path(spark, "posts"), _new_path(spark, "sink")
    p = tweets(spark, sf_dir).withColumn("created_at", F.col("created_at").cast("timestamp")).drop("user_created_at")
    p.write.parquet(source)
    jobs.heartbeat(spark.read.schema(p.schema).parquet(source)).write.mode("append").parquet(source)
    built = build(jobs.replay(spark, source, p.schema, 10_000))
    built.writeStream.outputMode(mode).option("checkpointLocation", _new_path(spark, "progress")).trigger(availableNow=True).format("parquet").start(sink).awaitTermination()
    return spark.read.schema(built.schema).parquet(sink)


@query()
def st01_hourly_stream(spark, sf_dir):
    return _streamed(spark, sf_dir, jobs.hourly).withColumn("timestamp", epoch("timestamp"))


@query("WITH" + SERIES + " SELECT cluster_id, CAST(epoch(timestamp) AS BIGINT) AS hour, tweet_count, engagement FROM ts")
def st01_closed_hours(spark, sf_dir):
    return _streamed(spark, sf_dir, jobs.hourly).select("cluster_id", epoch("timestamp").alias("hour"), "tweet_count", "engagement")


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def _rocksdb(spark):
    """The state store that arbitrary state needs, for the time of a stream."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


@query("WITH" + SERIES + """,
h AS (SELECT cluster_id, CAST(epoch(timestamp) AS BIGINT) AS hour, CAST(tweet_count AS BIGINT) AS n, CAST(engagement AS BIGINT) AS e FROM ts),
g AS (SELECT *, CASE WHEN hour - lag(hour, 1, 0) OVER (PARTITION BY cluster_id ORDER BY hour) > 24 * 3600 THEN 1 ELSE 0 END AS new FROM h),
s AS (SELECT *, sum(new) OVER (PARTITION BY cluster_id ORDER BY hour) AS session FROM g),
b AS (SELECT cluster_id, session, min(hour) AS lo, least(max(hour) + 24 * 3600, (SELECT max(hour) FROM h)) AS hi FROM s GROUP BY ALL),
d AS (SELECT cluster_id, session, unnest(generate_series(lo, hi, 3600)) AS hour FROM b),
f AS (SELECT cluster_id, hour, coalesce(n, 0) AS n, coalesce(e, 0) AS e, count(*) OVER w AS n_prev, avg(coalesce(n, 0)) OVER w AS m, var_pop(coalesce(n, 0)) OVER w AS v FROM d LEFT JOIN h USING (cluster_id, hour) WINDOW w AS (PARTITION BY cluster_id, session ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT cluster_id, hour, n AS tweet_count, e AS engagement, n_prev, round(CASE WHEN v > 1e-9 THEN (n - m) / sqrt(v) ELSE 0 END, 6) AS z_score_count FROM f""")
def st03_hours_by_timer(spark, sf_dir):
    with _rocksdb(spark):
        return rounded(_streamed(spark, sf_dir, jobs.detect_hours))


@query("WITH RECURSIVE" + SCORED + """,
kb AS (SELECT cluster_id, timestamp, tweet_count AS x, n_prev + 1 AS i, coalesce(mean_count, tweet_count) AS m, ln(n_prev + 1) AS g FROM scored),
walk AS (SELECT cluster_id, i, m - x * ln(m) AS c0, 2 * m - x * ln(2 * m) AS c1, 4 * m - x * ln(4 * m) AS c2 FROM kb WHERE i = 1
  UNION ALL SELECT k.cluster_id, k.i, least(c0, c1, c2) + k.m - k.x * ln(k.m), least(c0 + k.g, c1, c2) + 2 * k.m - k.x * ln(2 * k.m), least(c0 + 2 * k.g, c1 + k.g, c2) + 4 * k.m - k.x * ln(4 * k.m)
  FROM walk w JOIN kb k ON k.cluster_id = w.cluster_id AND k.i = w.i + 1),
z AS (SELECT *, CASE WHEN std_count > 1e-6 THEN (tweet_count - mean_count) / std_count ELSE 0.0 END AS zc, CASE WHEN std_engagement > 1e-6 THEN (engagement - mean_engagement) / std_engagement ELSE 0.0 END AS ze FROM scored)
SELECT z.cluster_id, CAST(epoch(timestamp) AS BIGINT) AS hour, tweet_count, n_prev, round(zc, 6) AS z_score_count, round(ze, 6) AS z_score_engagement, CAST(CASE WHEN c0 <= least(c0, c1, c2) THEN 0 WHEN c1 <= least(c0, c1, c2) THEN 1 ELSE 2 END AS INTEGER) AS burst_state,
  n_prev >= 6 AND round(greatest(zc, ze), 9) > 3 AS is_trigger FROM z JOIN walk w ON w.cluster_id = z.cluster_id AND w.i = n_prev + 1""")
def st03_stateful_detector(spark, sf_dir):
    with _rocksdb(spark):
        source, sink = _new_path(spark, "windows"), _new_path(spark, "sink")
        s = _series(spark, sf_dir).select("cluster_id", F.col("timestamp").cast("timestamp").alias("timestamp"), "tweet_count", "engagement")
        s.write.parquet(source)
        stream = jobs.detect(jobs.replay(spark, source, s.schema, 10_000))
        stream.writeStream.outputMode("append").option("checkpointLocation", _new_path(spark, "progress")).trigger(availableNow=True).format("parquet").start(sink).awaitTermination()
    out = spark.read.schema(jobs.DETECTED).parquet(sink)
    return rounded(out.select("cluster_id", epoch("timestamp").alias("hour"), "tweet_count", "n_prev", "z_score_count", "z_score_engagement", "burst_state", "is_trigger"))


def _last_version(spark, path: str):
    versions = spark.read.parquet(path)  # a version a batch
    last = versions.agg(F.max("version").alias("version"))
    return versions.join(F.broadcast(last), "version").drop("version")


@query()
def v05_streaming_clusters(spark, sf_dir):
    source, state = _new_path(spark, "vectors"), _new_path(spark, "state")
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    v.repartition(2, "vec_id").write.parquet(source)
    jobs.cluster_batches(jobs.replay(spark, source, v.schema, 1), state, _new_path(spark, "progress"), 0.3, most=100).awaitTermination()
    return _last_version(spark, state).select("cluster_id", "size", F.array_join("representatives", ",").alias("representatives"))


@query()
def st04_claim_registry(spark, sf_dir):
    source, state = _new_path(spark, "claims"), _new_path(spark, "registry")
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("claim_id"), F.col("label").cast("long").alias("cluster_id"), F.col("embedding").alias("vec"))
    v.repartition(2, "claim_id").write.parquet(source)
    jobs.register_claims(jobs.replay(spark, source, v.schema, 1), state, _new_path(spark, "progress"), 0.3).awaitTermination()
    return _last_version(spark, state).select("registry_id", "n_claims", F.array_join(F.transform("clusters", lambda c: c.cast("string")), ",").alias("clusters"))


@query("WITH c AS (SELECT text FROM documents WHERE doc_id % 3 = 0) SELECT count(DISTINCT text) AS misses FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM c WHERE text IS NOT NULL)")
def st05_response_cache(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text").filter("text is not null")
    cache = d.filter("doc_id % 3 = 0").select(F.sha2("text", 256).alias("text_hash")).distinct()
    return jobs.cache_misses(d, cache).agg(F.count("*").alias("misses"))


@query("WITH" + TWEETS + " SELECT count(*) AS processed, CAST(sum(CASE WHEN like_count >= 100 THEN 1 ELSE 0 END) AS BIGINT) AS passed FROM tweets")
def st06_stage_counters(spark, sf_dir):
    from pyspark.sql import Observation

    seen = Observation("stages")
    posts = tweets(spark, sf_dir)
    posts.observe(seen, F.count(F.lit(1)).alias("processed"), F.sum((F.col("like_count") >= 100).cast("int")).alias("passed")).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["processed"], seen.get["passed"])], "processed long, passed long")


@query("""WITH f AS (SELECT text, min(doc_id % 3) AS b FROM documents WHERE text IS NOT NULL GROUP BY text), m AS (SELECT b, count(*) AS misses FROM f GROUP BY b), n AS (SELECT doc_id % 3 AS b, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT n.b AS batch_id, n - coalesce(misses, 0) AS hits, coalesce(misses, 0) AS misses, CAST(sum(coalesce(misses, 0)) OVER (ORDER BY n.b) AS BIGINT) AS size FROM n LEFT JOIN m USING (b)""")
def st05_cache_counts(spark, sf_dir):
    """Documents in three parts, a part a micro-batch, through the response cache: what each batch hit and missed, and what the cache then holds."""
    source, out = _new_path(spark, "texts"), _new_path(spark, "cache")
    posts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.timestamp_seconds(1_700_000_000 + F.col("doc_id") % 3).alias("created_at"))
    for part in range(3):
        posts.filter(F.col("id") % 3 == part).repartition(4).write.mode("append").parquet(source)

    def keep(batch, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("append").parquet(out)

    with _rocksdb(spark):
        jobs.cached(jobs.replay(spark, source, posts.schema, 4)).writeStream.foreachBatch(keep).option("checkpointLocation", _new_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{jobs.CACHE}, batch_id long").parquet(out)
    sizes = rows.select("part", "batch_id", (F.col("size") - F.lag("size", 1, 0).over(Window.partitionBy("part").orderBy("batch_id"))).alias("more"), "hits", "misses")
    batches = sizes.groupBy("batch_id").agg(*[F.sum(c).alias(c) for c in ("hits", "misses", "more")])
    return batches.select("batch_id", "hits", "misses", F.sum("more").over(Window.orderBy("batch_id")).alias("size"))  # a row a batch


@query("WITH" + TWEETS + ", n AS (SELECT count(*) AS processed, CAST(sum(CASE WHEN like_count >= 100 THEN 1 ELSE 0 END) AS BIGINT) AS passed FROM tweets) SELECT 'posts' AS stage, 'processed' AS counter, processed AS value FROM n UNION ALL SELECT 'posts', 'passed', passed FROM n")
def st06_stream_counters(spark, sf_dir):
    """Counters of a stream's micro-batches, as a listener appended them to a table, summed."""
    source, path = _new_path(spark, "posts"), _new_path(spark, "counters")
    posts = tweets(spark, sf_dir).select("cluster_id", "like_count")
    posts.repartition(4).write.parquet(source)
    listener = jobs.CounterTable(path)
    spark.streams.addListener(listener)
    try:
        q = jobs.with_counters(jobs.replay(spark, source, posts.schema, 2), "posts", "like_count >= 100").writeStream.option("checkpointLocation", _new_path(spark, "progress")).trigger(availableNow=True).format("noop").start()
        q.awaitTermination()
        listener.wait(q)
    finally:
        spark.streams.removeListener(listener)
    return spark.read.schema(jobs.COUNTERS).parquet(path).groupBy("stage", "counter").agg(F.sum("value").alias("value"))
