"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.llm import decontaminate, html, langid, licenses, mixing, neardup, negatives, pii, runs, spans, substrings, tokens, topk


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_html(spark, sf_dir):
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


def op2_pii(spark, sf_dir):
    return pii.find(_documents(spark, sf_dir))


def op3_mixing(spark, sf_dir):
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "source", "text", "copy", "mix_key")


def op4_topk(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op5_licenses(spark, sf_dir):
    return licenses.scan(_documents(spark, sf_dir)).withColumns({c: F.array_join(c, " ") for c in ("missing", "extra")})


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op6_langid(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    out = langid.predict(docs, langid.fit(docs.filter(~held_out())))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["lang"])), ",")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", spans.alias("spans"))


def op7_tokens(spark, sf_dir):
    return tokens.token_counts(_documents(spark, sf_dir))


def op8_neardup(spark, sf_dir):
    return neardup.near_duplicates(_documents(spark, sf_dir))


def op9_decontaminate(spark, sf_dir):
    found = decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("item_ids", F.array_join(F.transform("item_ids", lambda i: i.cast("string")), ","))


def op10_substrings(spark, sf_dir):
    return substrings.report(_documents(spark, sf_dir))


def _planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where one document in ten has a periodic tail: from its word a on, the next p words repeat to the end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size("words"), F.floor(h / 10)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    words_then = F.concat(F.slice("words", F.lit(1), a), F.slice(tail, F.lit(1), n - a))
    planted = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"))
    return planted.select("doc_id", F.when(n > 0, F.array_join(words_then, " ")).otherwise(F.col("text")).alias("text"))


def op11_runs(spark, sf_dir):
    found = runs.find_runs(_planted(_documents(spark, sf_dir)))
    best = lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))
    longest = F.array_min(F.transform("runs", best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = F.col("best.start"), -F.col("best.less"), F.col("best.period")
    named = start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli")
    return found.select("doc_id", "n_runs", *named, "runs_sha256", "collapsed_sha256")


def op12_spans(spark, sf_dir):
    out = spans.remove_repeats(_documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    n_bytes = (F.octet_length("kept") + removed).cast("long")
    return out.select("doc_id", n_bytes.alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_negatives(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", noisy), F.col("vec_id") % 100 == 0)


def queries() -> dict:
    """Callables by name."""
    return {f.__name__: f for f in (op1_html, op2_pii, op3_mixing, op4_topk, op5_licenses, op6_langid, op7_tokens, op8_neardup, op9_decontaminate, op10_substrings, op11_runs, op12_spans, op13_negatives)}


ORACLE = {
    "op4_topk": """
        WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
              FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op12_spans": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        b AS (SELECT r, unnest(range(0, CAST(length(x) / 2 AS BIGINT) - 199, 256)) AS lo, x FROM d WHERE length(x) >= 400),
        y AS MATERIALIZED (SELECT r, lo, x[2 * lo + 1 : 2 * lo + 910] AS y FROM b),
        p AS (SELECT r, lo, unnest(range(0, CAST(length(y) / 2 AS BIGINT) - 199)) AS j, y FROM y),
        g AS MATERIALIZED (SELECT r, lo + j AS i, md5_number(y[2 * j + 1 : 2 * j + 400]) AS s FROM p),
        f AS (SELECT s FROM g GROUP BY s HAVING count(*) > 1),
        w AS (SELECT r, i, i - lag(i, 1, -1000) OVER (PARTITION BY r ORDER BY i) > 200 AS new FROM g JOIN f USING (s)),
        q AS (SELECT r, i, sum(CAST(new AS INT)) OVER (PARTITION BY r ORDER BY i) AS n FROM w),
        s AS (SELECT r, n, min(i) AS lo, max(i) + 200 AS hi FROM q GROUP BY r, n),
        k AS (SELECT r, list([lo, hi] ORDER BY lo) AS spans, sum(hi - lo) AS gone, count(*) AS n FROM s GROUP BY r)
        SELECT doc_id, CAST(length(x) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
        sha256(unhex(CASE WHEN spans IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(spans) + 1), lambda j: x[(CASE WHEN j = 0 THEN 0 ELSE 2 * spans[j][2] END) + 1 : CASE WHEN j = len(spans) THEN length(x) ELSE 2 * spans[j + 1][1] END]), '') END)) AS kept_sha256
        FROM d LEFT JOIN k USING (r)""",
    "op13_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
              FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
        m AS (SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
              FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM m WHERE rank <= 5""",
    "op10_substrings": r"""
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
        g AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM p),
        f AS (SELECT s, min(doc_id) AS first_doc FROM g GROUP BY s),
        r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM g JOIN f USING (s) WHERE first_doc < doc_id),
        x AS (SELECT doc_id, list(k) AS gone FROM r GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(coalesce(gone, []), z[2])), lambda z: z[1]), ' ')) AS kept_sha256
        FROM d LEFT JOIN x USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
