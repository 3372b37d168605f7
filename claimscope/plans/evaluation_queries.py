"""Queries on classifier scores: sweeps, thresholds, ensembles, correlations, samples and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimscope.operators import evaluate, sampling
from claimscope.plans.fixtures import LABELLED, labelled, table
from claimscope.plans.registry import query, rounded

CUTS = evaluate.thresholds()
_COUNTS = "CAST(sum(CASE WHEN prob >= {t} AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN prob >= {t} AND label <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN prob < {t} AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN prob < {t} AND label <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn"
_RATES = "tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"
_SWEEP = "WITH" + LABELLED + f", cuts AS (SELECT unnest({CUTS}) AS threshold), c AS (SELECT model, CAST(threshold AS DOUBLE) AS threshold, {_COUNTS.format(t='threshold')} FROM long, cuts GROUP BY ALL), m AS (SELECT model, threshold, {_RATES} FROM c)"


@query("WITH" + LABELLED + f", c AS (SELECT model, {_COUNTS.format(t='0.5')} FROM long GROUP BY model) SELECT model, {_RATES} FROM c")
def e01_confusion(spark, sf_dir):
    return rounded(evaluate.add_rates(evaluate.confusion(labelled(spark, sf_dir), ["model"], F.lit(0.5))))


@query(_SWEEP + " SELECT * FROM m")
def e02_threshold_sweep(spark, sf_dir):
    return rounded(evaluate.sweep(labelled(spark, sf_dir), ["model"], CUTS))


@query(_SWEEP + " SELECT ties, model, threshold, f1 FROM (SELECT 'lowest' AS ties, *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) AS r FROM m UNION ALL SELECT 'highest', *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold DESC) FROM m) WHERE r = 1")
def e03_best_threshold(spark, sf_dir):
    m = rounded(evaluate.sweep(labelled(spark, sf_dir), ["model"], CUTS))
    low, high = (evaluate.best_threshold(m, ["model"], t).select(F.lit(t).alias("ties"), "model", "threshold", "f1") for t in ("lowest", "highest"))
    return low.unionByName(high)


@query("WITH" + LABELLED + f""", sp AS (SELECT *, CASE WHEN sample_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split FROM long), cuts AS (SELECT unnest({CUTS}) AS threshold),
dc AS (SELECT model, CAST(threshold AS DOUBLE) AS threshold, {_COUNTS.format(t='threshold')} FROM sp, cuts WHERE split = 'dev' GROUP BY ALL), dm AS (SELECT model, threshold, {_RATES} FROM dc),
ch AS (SELECT model, threshold FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(f1, 6) DESC, threshold) AS r FROM dm) WHERE r = 1),
tc AS (SELECT model, split, threshold, {_COUNTS.format(t='threshold')} FROM sp JOIN ch USING (model) WHERE split = 'test' GROUP BY ALL) SELECT model, split, threshold, {_RATES} FROM tc""")
def e04_calibrated_threshold(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("split", F.when(F.col("sample_id") % 2 == 0, "dev").otherwise("test"))
    return rounded(evaluate.calibrated(rows, ["model"], "dev", CUTS))


@query("WITH" + LABELLED + f", cuts AS (SELECT unnest([0.65, 0.75, 0.85]) AS threshold), c AS (SELECT model, CAST(threshold AS DOUBLE) AS threshold, {_COUNTS.format(t='threshold')} FROM long, cuts GROUP BY ALL) SELECT model, threshold, round(CASE WHEN tp + fn = 0 OR fp + tn = 0 OR tp = 0 THEN 0 ELSE 5 * tp / (5 * tp + 4 * fn + fp) END, 6) AS f_beta FROM c")
def e05_f_beta(spark, sf_dir):
    return rounded(evaluate.sweep(labelled(spark, sf_dir), ["model"], [0.65, 0.75, 0.85], beta=2.0).select("model", "threshold", "f_beta"))


@query(_SWEEP + ", p AS (SELECT * FROM (VALUES ('a', 0.95::DOUBLE), ('b', 0.7), ('c', NULL)) AS p(model, published)) SELECT model, threshold, published, CASE WHEN published IS NULL OR abs(round(f1 - published, 9)) <= 0.002 THEN 'reproduced' WHEN abs(round(f1 - published, 9)) <= 0.01 THEN 'close' ELSE 'different' END AS status FROM m JOIN p USING (model)")
def e06_reproduction_status(spark, sf_dir):
    m = rounded(evaluate.sweep(labelled(spark, sf_dir), ["model"], CUTS))
    published = F.when(F.col("model") == "a", 0.95).when(F.col("model") == "b", 0.7)
    return evaluate.reproduction_status(m.withColumn("published", published), "f1", "published").select("model", "threshold", "published", "status")


TEMPS = [0.3, 0.5, 1.5]
_ENS = "WITH" + LABELLED + """, wt AS (SELECT * FROM (VALUES ('a', 0.5), ('b', 0.3), ('c', 0.2)) AS w(model, w)),
rk AS (SELECT l.*, w, (rank() OVER (PARTITION BY model ORDER BY prob) + (count(*) OVER (PARTITION BY model, prob) - 1) / 2) / count(*) OVER (PARTITION BY model) AS r FROM long l JOIN wt USING (model)),
g AS (SELECT sample_id, label, avg(prob) AS soft, sum(prob * w) / sum(w) AS weighted, avg(CASE WHEN prob >= 0.5 THEN 1.0 ELSE 0.0 END) AS hard, arg_max(prob, abs(prob - 0.5) * 1e9 - ascii(model) * 1e-3) AS max_confidence,
  median(prob) AS median, exp(avg(ln(greatest(prob, 1e-8)))) AS geometric, avg(r) AS rank, """ + ", ".join(f"avg(1 / (1 + exp(-ln(greatest(prob, 1e-8) / greatest(1 - prob, 1e-8)) / {t}))) AS temperature_{round(t * 100)}" for t in TEMPS) + """ FROM rk GROUP BY sample_id, label),
e AS (UNPIVOT g ON COLUMNS(* EXCLUDE (sample_id, label)) INTO NAME method VALUE prob)"""


def _ensembles(spark, sf_dir):
    weights = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "model string, w double")
    return evaluate.ensembles(labelled(spark, sf_dir), weights, TEMPS)


@query(_ENS + " SELECT sample_id, label, method, round(prob, 6) AS prob FROM e")
def e07_ensembles(spark, sf_dir):
    return rounded(_ensembles(spark, sf_dir))


@query("WITH" + LABELLED + " SELECT a.sample_id, a.label, round(0.5 * a.prob + 0.5 * b.prob + 1e-9, 6) AS prob FROM long a JOIN long b USING (sample_id) WHERE a.model = 'a' AND b.model = 'b'")
def e08_late_fusion(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return rounded(evaluate.late_fusion(rows.filter("model = 'a'"), rows.filter("model = 'b'")).withColumn("prob", F.col("prob") + 1e-9))


_BASE = "p AS (SELECT * FROM (VALUES ('a', 0.8), ('b', 0.0)) AS p(model, baseline))"


@query("WITH" + LABELLED + f", {_BASE}, c AS (SELECT model, {_COUNTS.format(t='0.5')} FROM long GROUP BY model), m AS (SELECT model, {_RATES} FROM c) SELECT model, f1, round(CASE WHEN coalesce(baseline, 0) = 0 THEN 0 ELSE f1 - baseline END, 6) AS delta, row_number() OVER (ORDER BY f1 DESC, model) AS place FROM m LEFT JOIN p USING (model)")
def e09_model_comparison(spark, sf_dir):
    m = rounded(evaluate.add_rates(evaluate.confusion(labelled(spark, sf_dir), ["model"], F.lit(0.5))))
    base = spark.createDataFrame([("a", 0.8), ("b", 0.0)], "model string, baseline double")
    delta = F.when(F.coalesce("baseline", F.lit(0.0)) == 0, 0.0).otherwise(F.col("f1") - F.col("baseline"))
    place = F.row_number().over(Window.orderBy(F.desc("f1"), "model")).cast("long")  # over a row a model
    return rounded(m.join(F.broadcast(base), "model", "left").select("model", "f1", delta.alias("delta"), place.alias("place")))


@query("WITH" + LABELLED + f", {_BASE} SELECT model, round(avg(prob), 6) AS mean_prob, round(CASE WHEN coalesce(any_value(baseline), 0) = 0 THEN 0 ELSE avg(prob) - any_value(baseline) END, 6) AS delta FROM long LEFT JOIN p USING (model) GROUP BY model")
def j06_baseline_delta(spark, sf_dir):
    base = spark.createDataFrame([("a", 0.8), ("b", 0.0)], "model string, baseline double")
    m = labelled(spark, sf_dir).groupBy("model").agg(F.avg("prob").alias("mean_prob")).join(F.broadcast(base), "model", "left")
    return rounded(m.select("model", "mean_prob", F.when(F.coalesce("baseline", F.lit(0.0)) == 0, 0.0).otherwise(F.col("mean_prob") - F.col("baseline")).alias("delta")))


@query(_ENS.replace("UNPIVOT g", "UNPIVOT g") + f""", sw AS (SELECT method, CAST(threshold AS DOUBLE) AS threshold, {_COUNTS.format(t='threshold').replace('prob', 'round(prob, 9)')} FROM e, (SELECT unnest({CUTS}) AS threshold) GROUP BY ALL),
best AS (SELECT method, max(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END) AS f1 FROM sw GROUP BY method),
ss AS (SELECT model, CAST(threshold AS DOUBLE) AS threshold, {_COUNTS.format(t='threshold')} FROM long, (SELECT unnest({CUTS}) AS threshold) GROUP BY ALL),
single AS (SELECT max(f) AS top, avg(f) AS mean FROM (SELECT model, max(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END) AS f FROM ss GROUP BY model))
SELECT method, round(f1, 6) AS f1, round(f1 - mean, 6) AS gain_over_mean, round(f1 - top, 6) AS gain_over_best, row_number() OVER (ORDER BY round(f1, 6) DESC, method) AS place FROM best, single""")
def e10_ensemble_gain(spark, sf_dir):
    e = _ensembles(spark, sf_dir).withColumn("prob", F.round("prob", 9))
    best = evaluate.sweep(e, ["method"], CUTS).groupBy("method").agg(F.max("f1").alias("f1"))
    single = evaluate.sweep(labelled(spark, sf_dir), ["model"], CUTS).groupBy("model").agg(F.max("f1").alias("f")).agg(F.max("f").alias("top"), F.avg("f").alias("mean"))
    place = F.row_number().over(Window.orderBy(F.round("f1", 6).desc(), "method")).cast("long")  # over a row a method
    out = best.crossJoin(F.broadcast(single)).select("method", "f1", (F.col("f1") - F.col("mean")).alias("gain_over_mean"), (F.col("f1") - F.col("top")).alias("gain_over_best"), place.alias("place"))
    return rounded(out)


@query("WITH" + LABELLED + """, r AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY prob) + (count(*) OVER (PARTITION BY model, prob) - 1) / 2 AS rx, rank() OVER (PARTITION BY model ORDER BY label) + (count(*) OVER (PARTITION BY model, label) - 1) / 2 AS ry FROM long)
SELECT model, round(CASE WHEN max(rx) = min(rx) OR max(ry) = min(ry) THEN 0 ELSE corr(rx, ry) END, 6) AS rho, count(*) AS n FROM r GROUP BY model""")
def a19_spearman(spark, sf_dir):
    return rounded(evaluate.spearman(labelled(spark, sf_dir), ["model"], "prob", "label"))


@query("WITH" + LABELLED + ", m AS (SELECT model, avg(label) AS mu FROM long GROUP BY model) SELECT model, round(CASE WHEN sum(power(label - mu, 2)) > 0 THEN 1 - sum(power(label - prob, 2)) / sum(power(label - mu, 2)) ELSE 0 END, 6) AS r2, round(avg(abs(label - prob)), 6) AS mae FROM long JOIN m USING (model) GROUP BY model")
def a20_regression_scores(spark, sf_dir):
    return rounded(evaluate.regression_scores(labelled(spark, sf_dir), ["model"], "label", "prob"))


@query("WITH" + LABELLED + """, c AS (SELECT model, CAST(label AS DOUBLE) AS y, least(greatest(prob, 1e-7), 1 - 1e-7) AS p FROM long),
w AS (SELECT *, 1 - least(greatest(-(p * ln(p) + (1 - p) * ln(1 - p)) / ln(2), 0), 1) AS w FROM c)
SELECT model, round((count(*) - sum(y)) / sum(y), 6) AS pos_weight, round(sum(w * power(y - p, 2)) / sum(w), 6) AS weighted_mse, round(((count(*) - sum(y)) / sum(y) * sum(-y * ln(p)) + sum(-(1 - y) * ln(1 - p))) / count(*), 6) AS weighted_ce FROM w GROUP BY model""")
def a21_weighted_losses(spark, sf_dir):
    return rounded(evaluate.weighted_losses(labelled(spark, sf_dir)))


_RUN = "run AS (SELECT role AS model, length(text) % 101 / 100.0 AS score, length(text) AS tokens_in, turn + 1 AS tokens_out, 100 + length(text) % 37 AS latency_ms FROM conversations WHERE text IS NOT NULL)"


@query("WITH " + _RUN + " SELECT model, count(*) AS n, round(avg(score), 6) AS mean_score, round(stddev_samp(score), 6) AS std_score, round(median(score), 6) AS median_score, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round(avg(latency_ms), 6) AS mean_latency_ms, round(avg(score) - 0.4569, 6) AS delta FROM run GROUP BY model")
def a16_run_statistics(spark, sf_dir):
    return rounded(evaluate.run_statistics(_run(spark, sf_dir), ["model"]))


def _run(spark, sf_dir):
    n = F.length("text").cast("long")
    return table(spark, sf_dir, "conversations").filter("text is not null").select(F.col("role").alias("model"), (n % 101 / 100.0).alias("score"), n.alias("tokens_in"), (F.col("turn") + 1).alias("tokens_out"), (100 + n % 37).alias("latency_ms"))


@query("WITH l AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL) SELECT quality, toxic, n, round(100.0 * n / sum(n) OVER (), 6) AS pct FROM l")
def a18_class_distribution(spark, sf_dir):
    return rounded(sampling.shares(table(spark, sf_dir, "labels"), ["quality", "toxic"]))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def t01_top_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(25)


@query("SELECT 'benchmark' AS part, item_id AS id, text FROM benchmark UNION ALL SELECT 'documents', doc_id, text FROM documents")
def t02_union(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("part"), F.col("item_id").alias("id"), "text").unionByName(table(spark, sf_dir, "documents").select(F.lit("documents").alias("part"), F.col("doc_id").alias("id"), "text"))


@query("SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 200")
def t03_sample(spark, sf_dir):
    return sampling.sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 200, seed=42)


@query("WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('7|' || doc_id), doc_id) AS i FROM labels) SELECT doc_id, quality FROM r WHERE i <= CASE WHEN quality = 1 THEN 30 ELSE 70 END")
def t04_stratified_sample(spark, sf_dir):
    return sampling.stratified(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality", {1: 30, 0: 70}, seed=7)


_SPLIT = "r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('3|' || doc_id), doc_id) AS i, count(*) OVER () AS n FROM labels)"


@query(f"WITH {_SPLIT} SELECT doc_id, CASE WHEN i <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split, CAST((i - 1) % 5 AS INTEGER) AS fold FROM r")
def t05_split_and_folds(spark, sf_dir):
    return sampling.split(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", 0.2, 5, seed=3)


@query(f"WITH {_SPLIT}, s AS (SELECT doc_id, CASE WHEN i <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM r) SELECT split, count(*) AS n, list_aggregate(list_sort(list(doc_id)), 'string_agg', ',') AS ids FROM s GROUP BY split")
def q06_split_manifest(spark, sf_dir):
    s = sampling.split(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", 0.2, 5, seed=3)
    return s.groupBy("split").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda i: i.cast("string")), ",").alias("ids"))


@query("SELECT doc_id, 'missing' AS status FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'both' FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)")
def t06_set_difference(spark, sf_dir):
    return sampling.compare_ids(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def t07_distinct_by_key(spark, sf_dir):
    return sampling.first_by_key(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.asc("doc_id")])


@query("SELECT doc_id, CAST(('0x' || substr(md5('5|' || doc_id), 1, 8)) AS BIGINT) / 4294967296.0 AS guess FROM labels")
def m09_random_baseline(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", sampling.uniform("doc_id", 5).alias("guess"))
