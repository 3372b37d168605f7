"""Queries on raw rows: scans, coercion, cleaning, text functions, prompts, joins by key, group counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimscope.functions import text as T
from claimscope.operators import evaluate, ingest, keyed, sampling
from claimscope.plans.fixtures import TWEETS, table, tweets
from claimscope.plans.registry import epoch, query, rounded


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("SELECT o_orderkey, o_orderdate IS NOT NULL AS dated FROM orders")
def src01_pruned_scan(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").isNotNull().alias("dated"))


@query("SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang")
def src04_partitioned_scan(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS idx FROM events")
def src11_row_numbers(spark, sf_dir):
    return keyed.number_rows(table(spark, sf_dir, "events").select("event_id"), "event_id")


_RAW = "raw AS (SELECT event_id AS raw_id, CASE WHEN event_id % 40 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS raw_likes, CASE WHEN event_id % 50 = 0 THEN 'not a date' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS raw_date, user_location_country AS raw_country FROM events JOIN tweets ON id = event_id), al AS (SELECT * FROM (VALUES ('united states', 'US'), ('france', 'FR'), ('germany', 'DE')) AS a(alias, country)), cl AS (SELECT CAST(raw_id AS VARCHAR) AS id, coalesce(TRY_CAST(raw_likes AS DOUBLE), 0) AS likes, try_strptime(raw_date, '%Y-%m-%d %H:%M:%S') AS created_at, coalesce(country, raw_country) AS country, TRY_CAST(raw_likes AS DOUBLE) IS NULL AS likes_filled, try_strptime(raw_date, '%Y-%m-%d %H:%M:%S') IS NULL AS date_invalid, country IS NOT NULL AS country_mapped FROM raw LEFT JOIN al ON lower(raw_country) = alias)"


def _coerced(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "value", "ts")
    raw = e.join(tweets(spark, sf_dir).select("id", "user_location_country"), "id").select(
        F.col("id").alias("raw_id"),
        F.when(F.col("id") % 40 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("raw_likes"),
        F.when(F.col("id") % 50 == 0, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("raw_date"),
        F.col("user_location_country").alias("raw_country"),
    )
    aliases = spark.createDataFrame([("united states", "US"), ("france", "FR"), ("germany", "DE")], "alias string, country string")
    return ingest.coerce(raw, aliases)


@query("WITH" + TWEETS + ", " + _RAW + " SELECT id, round(likes, 6) AS likes, CAST(epoch(created_at) AS BIGINT) AS created_at, country FROM cl")
def s01_coerce(spark, sf_dir):
    return rounded(_coerced(spark, sf_dir).select("id", "likes", epoch("created_at").alias("created_at"), "country"))


@query("WITH" + TWEETS + ", " + _RAW + " SELECT count(*) AS n, CAST(sum(CAST(likes_filled AS INT)) AS BIGINT) AS likes_filled, CAST(sum(CAST(date_invalid AS INT)) AS BIGINT) AS date_invalid, CAST(sum(CAST(country_mapped AS INT)) AS BIGINT) AS country_mapped FROM cl")
def s01_coercion_counters(spark, sf_dir):
    return ingest.coercion_counters(_coerced(spark, sf_dir))


@query("SELECT event_id, value FROM events WHERE value >= 100")
def s02_gate(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("value >= 100").select("event_id", "value")


@query("SELECT event_id, CASE WHEN value >= 100 THEN row_number() OVER (PARTITION BY value >= 100 ORDER BY event_id) - 1 ELSE -1 END AS embedding_idx FROM events")
def s03_dense_index(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") >= 100).alias("gate"))
    numbered = keyed.number_rows(e.filter("gate").select("event_id"), "event_id")
    return e.join(numbered, "event_id", "left").select("event_id", F.coalesce("idx", F.lit(-1)).alias("embedding_idx"))


@query(r"SELECT doc_id, CASE WHEN coalesce(length(regexp_replace(text, '^\s+|\s+$', '', 'g')), 0) < 10 THEN 'unknown' WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 20 THEN 'short' ELSE 'text' END AS tag FROM documents")
def s04_short_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.coalesce(T.short_text_tag(F.col("text")), T.short_text_tag(F.col("text"), 20, "short"), F.lit("text")).alias("tag"))


_STOPS = "(VALUES " + ", ".join(f"('{g}', '{w}')" for g, ws in ingest.STOP_WORDS.items() for w in ws) + ") AS p(lang_tag, word)"


@query(r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents), c AS (SELECT doc_id, lang_tag, count(*) AS hits FROM w JOIN (SELECT * FROM " + _STOPS + ") p USING (word) GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, lang_tag) AS r FROM c) SELECT d.doc_id, coalesce(lang_tag, 'unknown') AS tag, coalesce(hits, 0) AS hits FROM documents d LEFT JOIN (SELECT * FROM b WHERE r = 1) b USING (doc_id)")
def s05_language_tag(spark, sf_dir):
    return ingest.language_tag(_docs(spark, sf_dir))


_LEXICON = "(VALUES " + ", ".join(f"('{w}', {s})" for w, s in ingest.SENTIMENT.items()) + ") AS p(word, score)"


@query(r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents), c AS (SELECT doc_id, avg(score) AS s, count(*) AS n FROM w JOIN (SELECT * FROM " + _LEXICON + ") p USING (word) GROUP BY ALL) SELECT d.doc_id, round(CAST(coalesce(s, 0) AS DOUBLE), 6) AS sentiment, coalesce(n, 0) AS n_hits FROM documents d LEFT JOIN c USING (doc_id)")
def s06_sentiment(spark, sf_dir):
    return rounded(ingest.sentiment(_docs(spark, sf_dir)))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'Yes' ELSE 'No' END AS verdict, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS label FROM labels")
def s07_label_mapping(spark, sf_dir):
    named = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "Yes").otherwise("No").alias("verdict"), "quality")
    return named.select("doc_id", "verdict", F.when(F.col("quality") == 1, 1).otherwise(0).alias("label"))


@query("SELECT doc_id, CASE WHEN length(text) > 512 THEN substr(text, 1, 512) || '...' ELSE text END AS short FROM documents")
def s08_truncate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.truncate(F.col("text"), 512).alias("short"))


@query("WITH" + TWEETS + " SELECT id, coalesce(user_location_country, 'none') AS country, CASE WHEN user_location_country > 'J' THEN 'late' ELSE 'early' END AS half FROM tweets")
def s09_nulls(spark, sf_dir):
    return tweets(spark, sf_dir).select("id", F.coalesce("user_location_country", F.lit("none")).alias("country"), F.when(F.col("user_location_country") > "J", "late").otherwise("early").alias("half"))


@query("SELECT p_partkey, p_retailprice FROM part")
def s10_drop_columns(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.drop(*[c for c in p.columns if c not in ("p_partkey", "p_retailprice")], "not_there")


_ODD = "odd AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST('nan' AS DOUBLE) WHEN 1 THEN CAST('inf' AS DOUBLE) WHEN 2 THEN CAST('-inf' AS DOUBLE) WHEN 3 THEN NULL ELSE value END AS x FROM events)"
_POLICY = [("zero", 0.0, 0.0, 0.0), ("large", 0.0, 1e6, -1e6), ("half", 0.5, 1.0, 0.0)]


@query(f"WITH {_ODD} SELECT event_id, " + ", ".join(f"round(CASE WHEN x IS NULL OR isnan(x) THEN {n} WHEN x = CAST('inf' AS DOUBLE) THEN {p} WHEN x = CAST('-inf' AS DOUBLE) THEN {m} ELSE x END, 6) AS \"{k}\"" for k, n, p, m in _POLICY) + " FROM odd")
def s11_non_finite(spark, sf_dir):
    r = F.col("event_id") % 5
    x = F.when(r == 0, float("nan")).when(r == 1, float("inf")).when(r == 2, float("-inf")).when(r == 4, F.col("value"))
    return rounded(table(spark, sf_dir, "events").select("event_id", *[T.replace_non_finite(x, n, p, m).alias(k) for k, n, p, m in _POLICY]))


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def s12_select_by_name(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return keyed.select_matching(c, prefixes=("c_",), not_matching=r"(acctbal|mktsegment|phone|address|comment)").select("c_custkey", "c_name", "c_nationkey")


@query("SELECT event_id, round(least(1.0, greatest(0.0, value / 300 - 0.2)), 6) AS p FROM events")
def s13_clip(spark, sf_dir):
    return rounded(table(spark, sf_dir, "events").select("event_id", T.clip(F.col("value") / 300 - 0.2).alias("p")))


_MADE = r"""CASE doc_id % 8 WHEN 0 THEN '  "' || text || '" ' WHEN 1 THEN 'Claim: ' || text WHEN 2 THEN 'The claim is that ' || text WHEN 3 THEN 'Normalized Claim:' || text || '...' WHEN 4 THEN '**' || text || '**' WHEN 5 THEN 'Answer : ''' || text || '''' WHEN 6 THEN '   ' ELSE text END"""
_UNQ = r"CASE WHEN length({x}) > 1 AND (regexp_matches({x}, '(?s)^\".*\"$') OR regexp_matches({x}, '(?s)^''.*''$')) THEN regexp_replace(substr({x}, 2, length({x}) - 2), '^\s+|\s+$', '', 'g') ELSE {x} END"


def _claim_sql() -> str:
    steps = [("c0", f"SELECT doc_id, {_MADE} AS x FROM documents WHERE text IS NOT NULL"), ("c1", r"SELECT doc_id, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x FROM c0"), ("c2", f"SELECT doc_id, {_UNQ.format(x='x')} AS x FROM c1".replace('\\"', '"'))]
    starts = [r"normalized\s*claim\s*:\s*", r"the\s*claim\s*is\s*:\s*", r"the\s*claim\s*is\s+that\s+", r"the\s*normalized\s*claim\s*:\s*", r"claim\s*:\s*", r"output\s*:\s*", r"answer\s*:\s*", r"here\s*is\s*the\s*normalized\s*claim\s*:\s*"]
    for i, p in enumerate(starts):
        steps.append((f"p{i}", f"SELECT doc_id, regexp_replace(x, '(?i)^{p}', '') AS x FROM {steps[-1][0]}"))
    steps.append(("l", rf"SELECT doc_id, regexp_replace(string_split(x, chr(10))[1], '^\s+|\s+$', '', 'g') AS x FROM {steps[-1][0]}"))
    steps.append(("e", r"SELECT doc_id, CASE WHEN x LIKE '%...' THEN regexp_replace(substr(x, 1, length(x) - 3), '^\s+|\s+$', '', 'g') ELSE x END AS x FROM l"))
    steps.append(("q", f"SELECT doc_id, {_UNQ.format(x='x')} AS x FROM e".replace('\\"', '"')))
    steps.append(("m", r"SELECT doc_id, regexp_replace(x, '^[*_`]+|[*_`]+$', '', 'g') AS x FROM q"))
    return "WITH " + ", ".join(f"{n} AS ({b})" for n, b in steps) + " SELECT doc_id, CASE WHEN length(x) > 0 AND NOT regexp_matches(x, '[.!?]$') THEN x || '.' ELSE x END AS claim FROM m"


@query(_claim_sql())
def s14_normalize_claim(spark, sf_dir):
    x, r = F.col("text"), F.col("doc_id") % 8
    made = F.when(r == 0, F.concat(F.lit('  "'), x, F.lit('" '))).when(r == 1, F.concat(F.lit("Claim: "), x)).when(r == 2, F.concat(F.lit("The claim is that "), x)).when(r == 3, F.concat(F.lit("Normalized Claim:"), x, F.lit("...")))
    made = made.when(r == 4, F.concat(F.lit("**"), x, F.lit("**"))).when(r == 5, F.concat(F.lit("Answer : '"), x, F.lit("'"))).when(r == 6, "   ").otherwise(x)
    return _docs(spark, sf_dir).filter("text is not null").select("doc_id", T.normalize_claim(made).alias("claim"))


# Letters beyond ASCII become underscores, which are word characters too, so that \b means what it does for all of Unicode.
_ASCII = r"regexp_replace(text, '[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2C1}\x{370}-\x{1FFF}\x{2C00}-\x{2FEF}\x{3040}-\x{D7FF}\x{F900}-\x{FFDC}]', '_', 'g')"
_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
_ENT = rf"""list_sort(list_distinct(list_transform(flatten([regexp_extract_all(text, '\$?[0-9]+(?:,[0-9][0-9][0-9])*(?:[.][0-9]+)?%?'),
  regexp_extract_all({_ASCII}, '\b(?:[0-9][0-9]?[/-][0-9][0-9]?[/-][0-9][0-9][0-9]?[0-9]?|[0-9][0-9][0-9][0-9][/-][0-9][0-9]?[/-][0-9][0-9]?)\b'),
  regexp_extract_all({_ASCII}, '(?i)\b(?:{_MONTHS})\s+[0-9][0-9]?(?:,?\s+[0-9][0-9][0-9][0-9])?\b'), regexp_extract_all({_ASCII}, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b'),
  list_filter(list_transform(list_filter(flatten(list_transform(string_split_regex(text, '[.!?]\s+'), lambda s: list_filter(string_split_regex(s, '\s+'), lambda w: length(w) > 0)[2:])), lambda w: regexp_matches(w, '^\p{{Lu}}') AND w <> upper(w) AND length(w) > 1), lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}_]', '', 'g')), lambda w: length(w) > 1)]), lambda x: lower(x))))"""


@query(f"SELECT doc_id, list_aggregate({_ENT}, 'string_agg', '|') AS entities, len({_ENT}) AS n FROM documents WHERE text IS NOT NULL")
def s15_entities(spark, sf_dir):
    e = _docs(spark, sf_dir).filter("text is not null").select("doc_id", T.extract_entities(F.col("text")).alias("e"))
    return e.select("doc_id", F.when(F.size("e") > 0, F.array_join("e", "|")).alias("entities"), F.size("e").cast("long").alias("n"))


@query(f"WITH b AS (SELECT item_id, text, {_ENT} AS e FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(CASE WHEN len(a.e) = 0 AND len(b.e) = 0 THEN 0.5 WHEN len(a.e) = 0 OR len(b.e) = 0 THEN 0 ELSE len(list_intersect(a.e, b.e)) / len(list_distinct(list_concat(a.e, b.e))) END, 6) AS overlap FROM b a JOIN b ON b.item_id = a.item_id + 1")
def v11_entity_jaccard(spark, sf_dir):
    e = table(spark, sf_dir, "benchmark").select("item_id", T.extract_entities(F.col("text")).alias("e"))
    a, b = e.select(F.col("item_id").alias("a"), F.col("e").alias("ea")), e.select(F.col("item_id").alias("b"), F.col("e").alias("eb"))
    return rounded(a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", T.jaccard(F.col("ea"), F.col("eb")).alias("overlap")))


@query("""WITH q AS (SELECT conv_id, conv_id * 1000 + turn AS idx, text, 'Post: ' || CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '...' ELSE text END AS post FROM conversations WHERE role = 'user' AND text IS NOT NULL),
g AS (SELECT item_id // 2 % 20 AS k, item_id // 40 + 1 AS rank, item_id % 2 AS bad, 'Post: ' || CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS post, substr(text, 1, 40) AS claim, substr(text, 41, 20) AS wrong FROM benchmark WHERE item_id // 40 < 3),
x AS (SELECT k, string_agg('Example ' || rank || chr(10) || post || chr(10) || 'Claim: ' || claim, chr(10) || chr(10) ORDER BY rank) AS t FROM g WHERE bad = 0 GROUP BY k),
y AS (SELECT k, string_agg('Mistake ' || rank || chr(10) || post || chr(10) || 'Wrong: ' || wrong || chr(10) || 'Right: ' || claim, chr(10) || chr(10) ORDER BY rank) AS t FROM g WHERE bad = 1 GROUP BY k)
SELECT idx, CASE conv_id % 3 WHEN 0 THEN 'Write one claim.' WHEN 1 THEN '<task>Write one claim.</task>' || chr(10) || '<hint>' || h || '</hint>' ELSE 'Write one claim. ' || h END AS system,
  CASE conv_id % 3 WHEN 0 THEN '' WHEN 1 THEN coalesce(x.t || chr(10) || chr(10), '') ELSE coalesce(x.t || chr(10) || chr(10), '') || coalesce(y.t || chr(10) || chr(10), '') END || post AS user
FROM (SELECT *, CASE WHEN length(text) > 400 THEN 'The post makes more than one claim; take the one that is easiest to verify.' WHEN contains(text, 'en') THEN 'The post may be ironic; state what it implies as fact.' WHEN regexp_matches(text, '[0-9]') THEN 'Keep every number and share as it stands.' ELSE 'State one clear claim that can be checked.' END AS h FROM q) q
LEFT JOIN x ON x.k = conv_id % 20 LEFT JOIN y ON y.k = conv_id % 20""")
def s16_prompts(spark, sf_dir):
    x, c, i = F.col("text"), F.col("conv_id"), F.col("item_id")
    groups = F.array_compact(F.array(F.when(x.rlike("[0-9]"), "figures"), F.when(x.contains("en"), "irony"), F.when(F.length(x) > 400, "several")))
    q = table(spark, sf_dir, "conversations").filter("role = 'user' and text is not null").select((c.cast("long") * 1000 + F.col("turn")).alias("idx"), c.alias("c"), x.alias("post"), groups.alias("groups"))
    shown = table(spark, sf_dir, "benchmark").filter("floor(item_id / 40) < 3").select((F.floor(i / 2) % 20).alias("k"), (F.floor(i / 40) + 1).alias("rank"), (i % 2).alias("bad"), x.alias("p"), F.substring(x, 1, 40).alias("claim"), F.substring(x, 41, 20).alias("wrong"))
    examples = q.select("idx", (F.col("c") % 20).alias("k")).join(F.broadcast(shown), "k").withColumnRenamed("p", "post")  # 120 rows
    good, bad = examples.filter("bad = 0").select("idx", "rank", "post", "claim"), examples.filter("bad = 1").select("idx", "rank", "post", "wrong", "claim")
    form = lambda n: q.filter(F.col("c") % 3 == n)
    plain = ingest.prompts(form(0), None, None, "Write one claim.")
    few = ingest.prompts(form(1), good, None, "Write one claim.", style="tagged")
    return plain.unionByName(few).unionByName(ingest.prompts(form(2), good, bad, "Write one claim.", style="short"))


@query("""SELECT conv_id * 1000 + turn AS idx, '[{"role":"system","content":"s"},{"role":"user","content":' || to_json(substr(text, 1, 2000)) || '},{"role":"assistant","content":' || to_json(role) || '}]' AS messages FROM conversations WHERE text IS NOT NULL AND role <> 'system'""")
def s17_chat_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("text is not null").select((F.col("conv_id").cast("long") * 1000 + F.col("turn")).alias("idx"), F.col("text").alias("post"), F.when(F.col("role") != "system", F.col("role")).alias("gold_claim"))
    return ingest.chat_rows(rows, "s")


@query("WITH u AS (SELECT role AS model, length(text) AS ti, turn + 1 AS tout, turn AS tr FROM conversations WHERE text IS NOT NULL), p AS (SELECT * FROM (VALUES ('user', 2.5, 10.0), ('assistant', 0.15, 0.6)) AS p(model, price_in, price_out)) SELECT model, round(CAST(sum(ti / 1e6 * price_in + (tout + tr) / 1e6 * price_out) AS DOUBLE), 6) AS cost FROM u JOIN p USING (model) GROUP BY model")
def s18_token_cost(spark, sf_dir):
    usage = table(spark, sf_dir, "conversations").filter("text is not null").select(F.col("role").alias("model"), F.length("text").alias("tokens_in"), (F.col("turn") + 1).alias("tokens_out"), F.col("turn").alias("tokens_reasoning"))
    prices = spark.createDataFrame([("user", 2.5, 10.0), ("assistant", 0.15, 0.6)], "model string, price_in double, price_out double")
    return rounded(ingest.token_cost(usage, prices))


_LP = "lp AS (SELECT doc_id, -0.01 * (1 + doc_id % 97) AS y, -0.02 * (1 + doc_id % 89) AS n FROM labels), pr AS (SELECT doc_id, exp(y) / (exp(y) + exp(n)) AS p FROM lp)"


@query(f"WITH {_LP} SELECT doc_id, round(p, 6) AS p_yes, round(-p * ln(p) - (1 - p) * ln(1 - p), 6) AS entropy, round((-p * ln(p) - (1 - p) * ln(1 - p)) / ln(2), 6) AS entropy_norm, round(2 * p - 1, 6) AS margin_p FROM pr")
def s19_log_prob_features(spark, sf_dir):
    y, n = (-0.01 * (1 + F.col("doc_id") % 97)), (-0.02 * (1 + F.col("doc_id") % 89))
    token = lambda t, v: F.struct(F.lit(t).alias("token"), v.alias("logprob"))
    rows = table(spark, sf_dir, "labels").select("doc_id", F.to_json(F.array(token(" Yes", y), token("No", n), token("maybe", y))).alias("raw"))
    return rounded(ingest.yes_no_features(rows, "raw").select("doc_id", "p_yes", "entropy", "entropy_norm", "margin_p"))


_MOD = "md AS (SELECT doc_id, (doc_id * 7 % 11) / 10.0 AS a, (doc_id * 5 % 11) / 10.0 AS b, (doc_id * 3 % 11) / 10.0 AS c FROM labels)"


def _modules(spark, sf_dir):
    return ingest.cross_module(table(spark, sf_dir, "labels").select("doc_id", *[((F.col("doc_id") * k) % 11 / 10.0).alias(c) for c, k in (("a", 7), ("b", 5), ("c", 3))]), ["a", "b", "c"])


@query(f"WITH {_MOD} SELECT doc_id, round((power(a - (a + b + c) / 3, 2) + power(b - (a + b + c) / 3, 2) + power(c - (a + b + c) / 3, 2)) / 3, 6) AS score_variance, round(CAST(greatest(a, b, c) - least(a, b, c) AS DOUBLE), 6) AS score_max_diff, CAST((a >= 0.5) AS INT) + CAST((b >= 0.5) AS INT) + CAST((c >= 0.5) AS INT) AS yes_vote_count, a >= 0.5 AND b >= 0.5 AND c >= 0.5 AS unanimous_yes, a < 0.5 AND b < 0.5 AND c < 0.5 AS unanimous_no FROM md")
def s20_cross_module(spark, sf_dir):
    return rounded(_modules(spark, sf_dir).select("doc_id", "score_variance", "score_max_diff", "yes_vote_count", "unanimous_yes", "unanimous_no"))


@query("WITH md AS (SELECT doc_id, (doc_id * 7 % 11) + (doc_id * 5 % 11) + (doc_id * 3 % 11) AS s FROM labels) SELECT doc_id, CASE WHEN s >= 15 THEN 'Yes' ELSE 'No' END AS verdict FROM md")
def s21_verdict(spark, sf_dir):
    return _modules(spark, sf_dir).select("doc_id", "verdict")


@query("SELECT l.doc_id, quality, n_chars FROM labels l JOIN documents d ON l.doc_id = CAST(CAST(d.doc_id AS VARCHAR) AS BIGINT)")
def j01_typed_join(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("sentence_id"), "n_chars")
    return keyed.join_on_cast(table(spark, sf_dir, "labels").select("doc_id", "quality"), d, "doc_id", "sentence_id")


_CLAIMS = "cm AS (SELECT item_id, CASE item_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '[]' WHEN 2 THEN '[' || item_id % 25 || ',' || (item_id + 3) % 25 || ',' || item_id % 25 || ']' WHEN 3 THEN 'oops' ELSE '[' || item_id % 25 || ']' END AS raw, CASE WHEN item_id % 10 < 9 THEN item_id % 25 END AS trigger_cluster_id, text FROM benchmark)"


def _claims(spark, sf_dir):
    i = F.col("item_id")
    raw = F.when(i % 5 == 1, "[]").when(i % 5 == 2, F.format_string("[%d,%d,%d]", i % 25, (i + 3) % 25, i % 25)).when(i % 5 == 3, "oops").when(i % 5 == 4, F.format_string("[%d]", i % 25))
    return table(spark, sf_dir, "benchmark").select(i.alias("claim_id"), raw.alias("cluster_ids"), F.when(i % 10 < 9, i % 25).alias("trigger_cluster_id"), "text")


@query("WITH" + TWEETS + ", " + _CLAIMS + """, x AS (SELECT item_id AS claim_id, list_distinct(CASE WHEN raw LIKE '[_%]' THEN CAST(string_split(trim(raw, '[]'), ',') AS BIGINT[]) WHEN trigger_cluster_id IS NOT NULL THEN [trigger_cluster_id] ELSE [] END) AS cs FROM cm),
e AS (SELECT claim_id, unnest(cs) AS cluster_id FROM x) SELECT claim_id, count(*) AS n_tweets, count(DISTINCT cluster_id) AS n_clusters FROM e JOIN tweets USING (cluster_id) GROUP BY claim_id""")
def j04_claims_to_posts(spark, sf_dir):
    return keyed.claims_to_posts(_claims(spark, sf_dir), tweets(spark, sf_dir)).groupBy("claim_id").agg(F.count("*").alias("n_tweets"), F.count_distinct("cluster_id").alias("n_clusters"))


@query("SELECT b.item_id, CASE WHEN d.text IS NOT NULL AND d.text <> '' THEN d.text ELSE b.text END AS text FROM benchmark b LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS text FROM documents) d ON d.doc_id = b.item_id * 2")
def j05_update_by_key(spark, sf_dir):
    new = _docs(spark, sf_dir).filter("doc_id % 2 = 0").select((F.col("doc_id") / 2).cast("long").alias("item_id"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text")).alias("text"))
    return keyed.update_text(table(spark, sf_dir, "benchmark").select("item_id", "text"), new, "item_id", "text")


@query("WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || ', ' || source WHEN 1 THEN NULL ELSE '' END AS cs, CASE WHEN doc_id % 6 = 1 THEN source END AS c FROM documents) SELECT doc_id, unnest(CASE WHEN cs <> '' THEN list_transform(string_split(cs, ','), lambda x: trim(x)) WHEN c IS NOT NULL THEN [c] ELSE ['no_cluster'] END) AS cluster FROM t")
def j07_cluster_tags(spark, sf_dir):
    r = F.col("doc_id")
    t = _docs(spark, sf_dir).select("doc_id", F.when(r % 3 == 0, F.concat_ws(", ", "lang", "source")).when(r % 3 == 2, "").alias("clusters"), F.when(r % 6 == 1, F.col("source")).alias("cluster"))
    return keyed.cluster_tags(t, "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j08_resume(spark, sf_dir):
    return keyed.not_done(_docs(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT (SELECT count(*) FROM labels) AS n_left, (SELECT count(*) FROM documents) AS n_right, (SELECT count(*) FROM labels JOIN documents USING (doc_id)) AS n_both, (SELECT count(*) FROM labels) = (SELECT count(*) FROM documents) AS aligned")
def j09_alignment(spark, sf_dir):
    return keyed.alignment(table(spark, sf_dir, "labels"), _docs(spark, sf_dir), "doc_id")


@query("WITH g AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT lang, n, round(n / sum(n) OVER (), 6) AS share, CASE WHEN lang = 'en' THEN 'english' ELSE 'other' END AS grp FROM g ORDER BY n DESC, lang LIMIT 20")
def a01_language_share(spark, sf_dir):
    g = sampling.shares(_docs(spark, sf_dir), ["lang"]).select("lang", "n", (F.col("pct") / 100).alias("share"), F.when(F.col("lang") == "en", "english").otherwise("other").alias("grp"))
    return rounded(g.orderBy(F.desc("n"), "lang").limit(20))


@query("WITH s AS (SELECT * FROM documents ORDER BY md5('11|' || doc_id), doc_id LIMIT 2000) SELECT CASE WHEN lang = 'en' THEN 'english' ELSE 'other' END AS grp, count(*) AS n, round(count(*) / (SELECT count(*) FROM s), 6) AS share FROM s GROUP BY 1")
def a02_sample_share(spark, sf_dir):
    s = sampling.sample(_docs(spark, sf_dir).select("doc_id", "lang"), "doc_id", 2000, 11).withColumn("grp", F.when(F.col("lang") == "en", "english").otherwise("other"))
    return rounded(sampling.shares(s, ["grp"]).select("grp", "n", (F.col("pct") / 100).alias("share")))


@query("SELECT count(*) AS n, CAST(floor(epoch(min(ts))) AS BIGINT) AS first, CAST(floor(epoch(max(ts))) AS BIGINT) AS last FROM events")
def a03_corpus_span(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n"), epoch(F.min("ts")).alias("first"), epoch(F.max("ts")).alias("last"))


@query("SELECT role AS model, count(*) AS n, CAST(sum(CASE WHEN length(text) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_valid, CAST(sum(CASE WHEN text LIKE 'Th%' THEN 1 ELSE 0 END) AS BIGINT) AS n_retrieved FROM conversations GROUP BY role")
def a17_run_quality(spark, sf_dir):
    n = lambda c, name: F.sum(F.coalesce(c, F.lit(False)).cast("int")).alias(name)
    return table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("model")).agg(F.count("*").alias("n"), n(F.length("text") > 0, "n_valid"), n(F.col("text").startswith("Th"), "n_retrieved"))


_PART = "pt AS (SELECT p_partkey, p_size, CAST(p_retailprice AS DOUBLE) AS price, (p_partkey * 37) % 101 / 10.0 AS mix FROM part)"


@query(f"""WITH {_PART}, l AS (UNPIVOT (SELECT price AS target, CAST(p_size AS DOUBLE) AS p_size, CAST(mix AS DOUBLE) AS mix, price * 0 + 1 AS flat FROM pt) ON p_size, mix, flat INTO NAME feature VALUE x),
r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY feature ORDER BY target) + (count(*) OVER (PARTITION BY feature, target) - 1) / 2 AS ry FROM l),
s AS (SELECT feature, CASE WHEN max(rx) = min(rx) OR max(ry) = min(ry) THEN 0 ELSE corr(rx, ry) END AS rho, count(*) AS n FROM r GROUP BY feature),
t AS (SELECT *, abs(rho) * sqrt((n - 2) / greatest(1 - rho * rho, 1e-12)) AS t FROM s) SELECT feature, round(rho, 6) AS rho, n, CASE WHEN t > 3.291 THEN '***' WHEN t > 2.576 THEN '**' WHEN t > 1.96 THEN '*' ELSE '' END AS mark, abs(rho) < 0.05 AS weak FROM t WHERE n > 10""")
def a26_feature_screening(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_retailprice").cast("double").alias("target"), "p_size", ((F.col("p_partkey") * 37) % 101 / 10.0).alias("mix"), F.lit(1.0).alias("flat"))
    return rounded(evaluate.screen_features(p, ["p_size", "mix", "flat"], "target"))
