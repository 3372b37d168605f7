"""Personal data: base patterns plus information-theoretic sanitisation, in SQL functions only.

Base spans are found with ``regexp_extract_all``; their offsets come from the pieces that ``split``
leaves between the matches, so each pattern costs two linear passes and no Python.

The method follows C-sanitisation (Sanchez and Batet 2016). A protected entity is a base span's
kind and value. For a term t in a document that holds an entity e the corpus gives

    p(e|t) = documents with t and e / documents with t
    t discloses e at level a  when  PMI(t; e) >= a * IC(e),  that is  p(e|t) >= p(e) ** (1 - a)

with p(e) = documents with e / documents. A pair needs ``MIN_SUPPORT`` distinct texts, so copies of one
text prove nothing. Terms are runs of three letters or more outside e-mail addresses: shorter ones are too common to be told from
chance and stay. Terms at or above ``GENERALISE`` become a tag, at or above ``REMOVE`` they go; all
their occurrences are touched in each document that holds the entity they disclose.

Defined cases: null text is empty (no spans, hash of the empty string); a text without spans keeps
its text; documents are told apart by ``doc_id`` and text, a repeated row gets its document's spans again; extra columns pass
through ``sanitise`` unchanged. Working columns start with ``_pii_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.session import cut, discard, rows_up_to

MIN_SUPPORT, GENERALISE, REMOVE, PART, BROADCAST_TERMS = 3, 0.8, 0.95, 256, 200_000
KINDS = ("email", "ip", "card", "phone")

# Each pattern is the contract's, made linear: a match starts at the first character of a run or where the
# last match ended, and repeats are possessive where nothing after them could take characters back.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_WORD = r"\p{L}{3,}"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(acc, i):
        d = F.substring(F.lpad(digits, 20, "0"), i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"),
        "card": n.between(12, 19) & _luhn(_digits(value)),
        "phone": n.between(9, 15),
    }[kind]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _folded(items: Column, start: Column, step, none: Column) -> Column:
    """``out`` of a fold over an array whose step gives (state, value): the values in order, without null ones.

    Appending to an array copies it, so values are gathered in parts of ``PART`` and these joined at the end.
    """

    def whole(held: Column) -> Column:
        def part(acc, i):
            inner = F.aggregate(F.slice(held, i * PART + 1, PART), F.struct(acc["at"].alias("at"), none.alias("out")), step)
            return _let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

        begin = F.struct(start.alias("at"), F.array(none).alias("out"))  # an array of parts; the first is empty
        parts = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / PART).cast("int"))
        return F.when(F.size(held) > 0, F.flatten(F.aggregate(parts, begin, part)["out"])).otherwise(none)

    return _let(items, whole)


def _located(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches, in order; code points from 0, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    parts = F.arrays_zip(gaps.alias("gap"), found.alias("value"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        here = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.when(x["value"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], here).alias("out")))

    return _folded(parts, F.lit(0), step, F.array().cast("array<struct<start:int,end:int,value:string>>"))


def base_spans(text: Column) -> Column:
    """Array of (start, end, kind_no, kind, value) of valid base matches, by start and then kind as listed."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,kind_no:int,kind:string,value:string>>")

    def of(no: int, kind: str) -> Column:
        spans = F.filter(_located(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
        named = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(no).alias("kind_no"), F.lit(kind).alias("kind"), s["value"].alias("value")))
        return F.when(text.rlike(PATTERNS[kind]), named).otherwise(none)

    return F.array_sort(F.concat(*(of(no, kind) for no, kind in enumerate(KINDS))))


def _masked(text: Column) -> Column:
    """``text`` with its e-mail addresses blanked, at the same length: no other base span has a letter, so no other can hold or touch a term."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0))
    parts = F.transform(F.arrays_zip(F.split(text, PATTERNS["email"], -1).alias("gap"), found.alias("value")), lambda x: F.concat(x["gap"], F.coalesce(F.lpad(F.lit(""), F.length(x["value"]), " "), F.lit(""))))
    return F.when(text.contains("@"), F.array_join(parts, "")).otherwise(text)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), lambda w: F.lower(w)))


def term_spans(docs: DataFrame, min_support: int = MIN_SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Spans of disclosing terms: (doc_id, content, start, end, term, level), content the text's hash, level ``generalise`` or ``remove``.

    Entities in fewer than ``min_support`` distinct texts have no pair with that support and are left out first. Copies of a text
    are counted as one row with their number. Aggregations are by key, each with map-side partial sums: entity, (entity, term),
    and term over the whole corpus. The result is a table of the shared folder; those on the way to it are removed.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    with_spans = docs.select("doc_id", text.alias("text")).filter(F.col("text").rlike(r"[0-9]|@")).withColumn("spans", base_spans(F.col("text"))).filter(F.size("spans") > 0)
    with_spans = with_spans.select("doc_id", F.xxhash64("text").alias("content"), "text", "spans")
    with_spans = cut(with_spans)  # only documents with personal data
    names = F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["value"])))
    held = with_spans.select("doc_id", "content", F.explode(names).alias("entity")).distinct()
    copies = cut(held.groupBy("entity", "content").agg(F.count("*").alias("n")))
    entities = copies.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("n_texts")).filter(F.col("n_texts") >= min_support).drop("n_texts")
    counted = cut(copies.join(entities, "entity"))
    discard(copies)

    texts = with_spans.join(counted.select("content").distinct(), "content", "left_semi").groupBy("content").agg(F.first("text").alias("text"))
    texts = cut(texts.select("content", _masked(F.col("text")).alias("masked")))
    pairs = texts.select("content", _terms(F.col("masked")).alias("terms")).join(counted, "content").select("content", "entity", "n", "n_entity", F.explode("terms").alias("term"))
    joint = cut(pairs.groupBy("entity", "n_entity", "term").agg(F.count("*").alias("support"), F.sum("n").alias("n_joint")).filter(F.col("support") >= min_support))
    wanted = joint.select("term").distinct()
    few = rows_up_to(wanted, BROADCAST_TERMS) is not None  # then other terms need not be shuffled to be counted
    df = docs.select(F.explode(_terms(_masked(F.col("text")))).alias("term")).join(F.broadcast(wanted) if few else wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    total = docs.agg(F.count("*").alias("n_docs"))  # one row

    strength = F.col("n_joint") / F.col("n_term")
    prior = F.col("n_entity") / F.col("n_docs")
    scored = joint.join(df, "term").crossJoin(F.broadcast(total))
    scored = cut(scored.filter(strength >= F.pow(prior, F.lit(1 - generalise))).select("entity", "term", F.when(strength >= F.pow(prior, F.lit(1 - remove)), 1).otherwise(0).alias("level")))
    found = cut(pairs.join(scored, ["entity", "term"]).groupBy("content", "term").agg(F.max("level").alias("level")))
    discard(joint, scored)

    # Every place of the found terms: a word ends where the lengths up to it add up to.
    pieces = F.arrays_zip(F.transform(F.split("masked", _WORD, -1), lambda x: F.length(x)).alias("gap"), F.regexp_extract_all("masked", F.lit(_WORD), F.lit(0)).alias("word"))
    words = texts.join(found.select("content").distinct(), "content", "left_semi").select("content", F.posexplode(pieces).alias("no", "w")).filter("w.word is not null")
    end = F.sum(F.col("w.gap") + F.length("w.word")).over(Window.partitionBy("content").orderBy("no"))
    words = words.withColumn("end", end.cast("int")).select("content", F.lower("w.word").alias("term"), (F.col("end") - F.length("w.word")).alias("start"), "end")
    hits = words.join(found, ["content", "term"]).select("content", "start", "end", "term", F.when(F.col("level") == 1, "remove").otherwise("generalise").alias("level"))
    out = cut(with_spans.select("doc_id", "content").distinct().join(hits, "content").select("doc_id", "content", "start", "end", "term", "level"))
    discard(with_spans, counted, texts, found)
    return out


def _terms_per_doc(docs: DataFrame, **params) -> DataFrame:
    span = F.struct("start", "end", F.lit(len(KINDS)).alias("kind_no"), F.lit("term").alias("kind"), F.col("level").alias("value"))
    return cut(term_spans(docs, **params).groupBy(F.col("doc_id").alias("_pii_id"), F.col("content").alias("_pii_found")).agg(F.array_sort(F.collect_list(span)).alias("_pii_terms")))


def _same_row() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_pii_id")) & (F.col("_pii_content") == F.col("_pii_found"))


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _content() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _add_terms(spans: Column, terms: Column) -> Column:
    return F.when(terms.isNull(), spans).otherwise(F.array_sort(F.concat(spans, terms)))


def find(docs: DataFrame, **params) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans.

    Texts are never shuffled: only spans meet in the join.
    """
    base = docs.select("doc_id", _content().alias("_pii_content"), base_spans(F.col("text")).alias("_pii_base"))
    out = base.join(_terms_per_doc(docs, **params), _same_row(), "left")
    count = lambda kind: F.size(F.filter("_pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.coalesce(F.size("_pii_terms"), F.lit(0)).cast("long").alias("n_term"),
        F.sha2(_digest(F.col("_pii_base")), 256).alias("base_sha256"),
        _digest(_add_terms(F.col("_pii_base"), F.col("_pii_terms"))).alias("spans"),
    )


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its tag, for example ``<EMAIL>``; terms to remove leave nothing.

    Overlapping spans are merged under the first one's tag. The text is cut by its characters, so that the work is linear in its length.
    """
    none = F.array().cast("array<struct<start:int,size:int,tag:string>>")

    def step(acc, s):
        tag = F.when(s["kind"] != "term", F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).when(s["value"] == "remove", "").otherwise("<TERM>")
        piece = F.array(F.struct((acc["at"] + 1).alias("start"), (s["start"] - acc["at"]).alias("size"), tag.alias("tag")))
        add = F.when(s["start"] >= acc["at"], F.concat(acc["out"], piece)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), add.alias("out"))

    def cut_up(held: Column) -> Column:
        chars, spans = held["chars"], held["spans"]
        pieces = F.transform(_folded(spans, F.lit(0), step, none), lambda p: F.concat(F.array_join(F.slice(chars, p["start"], p["size"]), ""), p["tag"]))
        rest = lambda last: F.array_join(F.slice(chars, last + 1, F.greatest(F.size(chars) - last, F.lit(0))), "")
        return F.concat(F.array_join(pieces, ""), _let(F.array_max(F.transform(spans, lambda s: s["end"])), rest))

    held = lambda spans: F.struct(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)).alias("chars"), spans.alias("spans"))
    return _let(spans, lambda known: F.when(F.size(known) == 0, text).otherwise(_let(held(known), cut_up)))


def sanitise(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with ``text`` redacted and the other columns as they were. Null texts stay null."""
    held = docs.withColumn("_pii_base", base_spans(F.col("text"))).withColumn("_pii_content", _content())
    held = held.join(_terms_per_doc(docs, **params), _same_row(), "left")
    held = held.withColumn("text", redact(F.col("text"), _add_terms(F.col("_pii_base"), F.col("_pii_terms"))))
    return held.select(*docs.columns)
