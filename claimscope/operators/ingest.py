"""Coercion with counters, language and sentiment by lexicon, prompt and training rows, costs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.functions.text import truncate

# Frequent words by language.
STOP_WORDS = {
    "de": "der die das und ist nicht mit ein den von zu im für sich auf".split(),
    "en": "the of and to in is that it was for with as be on are".split(),
    "es": "el los las de que y en un por con para una su al del".split(),
    "fr": "le les de et la des est un une que dans pour pas du sur".split(),
}
# Our own word scores.
SENTIMENT = {"worthless": -2.0, "pathetic": -2.0, "disgusting": -2.0, "moron": -2.0, "idiot": -2.0, "scum": -2.0, "loser": -1.5, "clown": -1.0, "not": -0.5, "good": 1.0, "great": 1.5, "best": 1.5, "safe": 0.5, "true": 0.5}


def words(c: Column) -> Column:
    """Lower-case runs of letters."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0))


def coerce(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Ids as strings, numbers as numbers, dates or null, countries by alias (a bounded table, broadcast); flags tell what each rule touched.

    Expects raw_id, raw_likes, raw_date and raw_country.
    """
    likes, date = F.col("raw_likes").try_cast("double"), F.try_to_timestamp("raw_date", F.lit("yyyy-MM-dd HH:mm:ss"))
    joined = rows.join(F.broadcast(aliases), F.lower("raw_country") == F.col("alias"), "left")
    return joined.select(
        F.col("raw_id").cast("string").alias("id"),
        F.coalesce(likes, F.lit(0.0)).alias("likes"),
        date.alias("created_at"),
        F.coalesce("country", "raw_country").alias("country"),
        (likes.isNull()).alias("likes_filled"),
        (date.isNull()).alias("date_invalid"),
        (F.col("country").isNotNull()).alias("country_mapped"),
    )


def coercion_counters(rows: DataFrame) -> DataFrame:
    """How many rows each rule touched, in one pass."""
    n = lambda c: F.sum(F.col(c).cast("int")).alias(c)
    return rows.agg(F.count("*").alias("n"), n("likes_filled"), n("date_invalid"), n("country_mapped"))


def _occurrences(text: Column, listed: list[str]) -> Column:
    """How often words of a list occur as whole runs of letters in lower-case ``text``; 0 for null."""
    either = "|".join(re.escape(w) for w in sorted(listed))
    return F.coalesce(F.regexp_count(text, F.lit(rf"(?<!\p{{L}})(?:{either})(?!\p{{L}})")), F.lit(0)).cast("long")


def language_tag(docs: DataFrame, profiles: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, tag, hits) for each row: the language with most stop words, ties to the first by name; ``unknown`` without any.

    Profiles are lists of lower-case words of letters. Nothing is joined or shuffled: a text's words that are in any list are kept, and counted for each.
    """
    lists = sorted((profiles or STOP_WORDS).items())
    every = sorted({w for _, ws in lists for w in ws})
    words_of = F.split(F.regexp_replace(F.lower("text"), r"\P{L}+", " "), " ", -1)
    known = docs.select("doc_id", F.filter(words_of, lambda w: w.isin(every)).alias("_known"))

    def hits(listed: list[str]) -> Column:
        return F.coalesce(F.size(F.filter("_known", lambda w: w.isin(listed))), F.lit(0)).cast("long")

    best = known.select("doc_id", F.array_min(F.array(*[F.struct((-hits(ws)).alias("n"), F.lit(lang).alias("lang")) for lang, ws in lists])).alias("_best"))
    return best.select("doc_id", F.when(F.col("_best.n") < 0, F.col("_best.lang")).otherwise("unknown").alias("tag"), (-F.col("_best.n")).alias("hits"))


def sentiment(docs: DataFrame, lexicon: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, sentiment, n_hits) for each row: mean word score over the words in the lexicon, 0 without any. One pattern a score."""
    by_score: dict[float, list[str]] = {}
    for word, score in (lexicon or SENTIMENT).items():
        by_score.setdefault(score, []).append(word)
    low = F.lower("text")
    n = {score: _occurrences(low, ws) for score, ws in sorted(by_score.items())}
    rows = docs.select("doc_id", F.array(*[F.struct(F.lit(float(s)).alias("s"), c.alias("n")) for s, c in n.items()]).alias("_c"))
    hits = F.aggregate("_c", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    total = F.aggregate("_c", F.lit(0.0), lambda a, x: a + x["s"] * x["n"])
    return rows.select("doc_id", F.coalesce(F.try_divide(total, hits), F.lit(0.0)).alias("sentiment"), hits.alias("n_hits"))


#: Our own wordings: how a post of a group is to be read, a task line by the style of the model, and the frame of the prompt.
GROUP_HINTS = {
    "several": "The post makes more than one claim; take the one that is easiest to verify.",
    "irony": "The post may be ironic; state what it implies as fact.",
    "figures": "Keep every number and share as it stands.",
    "politics": "Keep who said or did what.",
    "picture": "Say what the picture or video is said to show.",
    "other": "State one clear claim that can be checked.",
}
STYLES = {"plain": "{task}\n{hint}", "tagged": "<task>{task}</task>\n<hint>{hint}</hint>", "short": "{task} {hint}"}


def primary_group(groups: Column, order: list[str] | None = None) -> Column:
    """The first of ``order`` that is in an array of group names, else ``other``."""
    return F.coalesce(*[F.when(F.array_contains(groups, g), g) for g in (order or list(GROUP_HINTS)) if g != "other"], F.lit("other"))


def prompts(queries: DataFrame, good: DataFrame | None, bad: DataFrame | None, instruction: str, limit: int = 500, style: str | None = None) -> DataFrame:
    """(idx, system, user): three forms of a prompt. Without examples the post alone; with good ones these, numbered, before the post; with bad ones
    also the wrong and the right claim of each.

    ``queries`` is (idx, post) and, if ``style`` is given, ``groups``, whose primary one adds its hint to the instruction in that style.
    ``good`` is (idx, rank, post, claim), ``bad`` is (idx, rank, post, wrong, claim), a few rows an idx. Posts are cut at twice ``limit``, examples at ``limit``.
    """
    out = queries
    n = lambda x: x["rank"].cast("string")
    parts = []
    if good is not None:
        out = out.join(good.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("rank", "post", "claim"))).alias("_good")), "idx", "left")
        shown = F.transform("_good", lambda x: F.concat(F.lit("Example "), n(x), F.lit("\nPost: "), truncate(x["post"], limit), F.lit("\nClaim: "), x["claim"]))
        parts.append(F.nullif(F.array_join(shown, "\n\n"), F.lit("")))
    if bad is not None:
        out = out.join(bad.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("rank", "post", "wrong", "claim"))).alias("_bad")), "idx", "left")
        shown = F.transform("_bad", lambda x: F.concat(F.lit("Mistake "), n(x), F.lit("\nPost: "), truncate(x["post"], limit), F.lit("\nWrong: "), x["wrong"], F.lit("\nRight: "), x["claim"]))
        parts.append(F.nullif(F.array_join(shown, "\n\n"), F.lit("")))
    user = F.concat_ws("\n\n", *parts, F.concat(F.lit("Post: "), truncate(F.col("post"), 2 * limit)))
    system = F.lit(instruction)
    if style is not None:
        frame = {g: STYLES[style].format(task=instruction, hint=hint) for g, hint in GROUP_HINTS.items()}
        system = F.element_at(F.create_map(*[F.lit(x) for kv in frame.items() for x in kv]), primary_group(F.col("groups")))
    return out.select("idx", system.alias("system"), user.alias("user"))


def chat_rows(rows: DataFrame, system: str, limit: int = 2000) -> DataFrame:
    """(idx, messages): supervised training rows as JSON; rows without a gold claim are left out."""
    m = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    messages = F.to_json(F.array(m("system", F.lit(system)), m("user", F.substring("post", 1, limit)), m("assistant", F.col("gold_claim"))))
    return rows.filter("gold_claim is not null").select("idx", messages.alias("messages"))


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, cost): tokens in and out at prices per million; ``prices`` has a row a model and is broadcast."""
    cost = F.col("tokens_in") / 1e6 * F.col("price_in") + (F.col("tokens_out") + F.col("tokens_reasoning")) / 1e6 * F.col("price_out")
    return usage.join(F.broadcast(prices), "model").groupBy("model").agg(F.sum(cost).alias("cost"))


def yes_no_features(rows: DataFrame, column: str) -> DataFrame:
    """p_yes, entropy (and normalised by ln 2) and margin from a JSON list of token log-probabilities: softmax over Yes and No."""
    parsed = F.from_json(column, "array<struct<token:string,logprob:double>>")
    mass = lambda name: F.aggregate(parsed, F.lit(0.0), lambda a, x: a + F.when(F.lower(F.trim(x["token"])) == name, F.exp(x["logprob"])).otherwise(0.0))
    out = rows.withColumn("_y", mass("yes")).withColumn("_n", mass("no"))
    p = F.when(F.col("_y") + F.col("_n") > 0, F.col("_y") / (F.col("_y") + F.col("_n"))).otherwise(0.5)
    out = out.withColumn("p_yes", p)
    h = lambda q: F.when(q > 0, -q * F.log(q)).otherwise(0.0)
    out = out.withColumn("entropy", h(F.col("p_yes")) + h(1 - F.col("p_yes")))
    return out.withColumn("entropy_norm", F.col("entropy") / F.log(F.lit(2.0))).withColumn("margin_p", 2 * F.col("p_yes") - 1).drop("_y", "_n")


def cross_module(rows: DataFrame, scores: list[str], cut: float = 0.5) -> DataFrame:
    """Population variance, spread and yes votes over module scores; the average as a verdict at 50."""
    cols = [F.col(c) for c in scores]
    n = len(cols)
    mean = sum(cols[1:], cols[0]) / n
    votes = sum(((c >= cut).cast("int") for c in cols[1:]), (cols[0] >= cut).cast("int"))
    out = rows.withColumn("score_variance", sum(((c - mean) ** 2 for c in cols[1:]), (cols[0] - mean) ** 2) / n)
    out = out.withColumn("score_max_diff", F.greatest(*cols) - F.least(*cols)).withColumn("yes_vote_count", votes)
    out = out.withColumn("unanimous_yes", F.col("yes_vote_count") == n).withColumn("unanimous_no", F.col("yes_vote_count") == 0)
    return out.withColumn("verdict", F.when(F.round(100 * mean, 6) >= 50, "Yes").otherwise("No"))
