"""Language spans by Viterbi over per-word scores.

Fit: hashed letter trigrams (the letters beside a word's edge count as 0) are counted by language over a bounded sample of
labelled documents, about ``FIT_ROWS`` a language, chosen by hash of the id. The counts are summed by Spark; a model knows every language it was
shown and has ``CELLS`` numbers at most: ``BUCKETS`` a language up to 64 languages, fewer a language beyond. More than ``MAX_LANGUAGES`` labels are no languages and an error.

Predict: a word is a run of letters. Its script, from its first letter, narrows the candidates to the languages that use the
script; its score for each is the sum of trigram log probabilities, at most ``FLOOR`` below the best. The label sequence
maximises the sum of scores less ``SWITCH`` for each change of language. One label for the whole text is optimal, and taken without the
dynamic programme, if no other language gains more than one switch on any run of words.

The document's language is the label with most letters, ties to the smaller name; its score is that share of the letters times the
softmax probability of the language from the summed scores.

Defined cases: null text, or text without a letter, is ``und`` with score 0 and no spans; no labelled rows: all ``und``; null ids are
predicted, but not learned from; repeated rows are predicted each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.hashing import chunks, few_rows
from claimscope.session import rows_up_to

FIT_ROWS, BUCKETS, CELLS, MAX_LANGUAGES, SWITCH, FLOOR = 2_000, 1 << 16, 1 << 22, 1 << 14, 16.0, 8.0
_TOP = 0x30000  # letters above it are not told apart

# First code points of Unicode script ranges and their scripts.
SCRIPT_STARTS = np.array([0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0980, 0x0B80, 0x0C00, 0x0E00, 0x0E80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2C60, 0x3040, 0x3100, 0x4E00, 0xA720, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x20000])
SCRIPTS = ["latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "other", "devanagari", "indic", "tamil", "indic", "thai", "other", "georgian", "hangul", "ethiopic", "latin", "greek", "latin", "kana", "other", "han", "latin", "hangul", "other", "han", "other", "han"]
_NAMES = sorted(set(SCRIPTS))
_SCRIPT_NO = np.array([_NAMES.index(s) for s in SCRIPTS])

_tables: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and their lower case where that is one code point."""
    if not _tables:
        chars = [chr(c) for c in range(_TOP)]
        low = (c.lower() for c in chars)
        _tables[:] = [np.array([c.isalpha() for c in chars]), np.array([ord(x) if len(x) == 1 else i for i, x in enumerate(low)], dtype=np.uint32)]
    return _tables[0], _tables[1]


class Words:
    """Letters and words of several texts: trigram bucket and text of each letter, first letter, end and script of each word."""

    def __init__(self, texts: list[str | None]):
        alpha, lower = _letters()
        texts = [t or "" for t in texts]
        code = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        code = np.minimum(code, _TOP - 1)
        is_letter = alpha[code]
        self.at = np.flatnonzero(is_letter)  # place of each letter, from 1
        low = np.where(is_letter, lower[code], 0).astype(np.uint64)
        mid = low[self.at]
        h = low[self.at - 1] * np.uint64(0x9E3779B1) + mid * np.uint64(0x85EBCA77) * np.uint64(31) + low[self.at + 1] * np.uint64(0xC2B2AE3D) * np.uint64(977)
        self.bucket = ((h ^ (h >> np.uint64(17))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64) % BUCKETS
        self.first = np.flatnonzero(~is_letter[self.at - 1])  # first letter of each word
        self.size = np.diff(np.append(self.first, len(self.at)))
        edges = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=edges[1:])
        self.edges = edges + 1  # where each text begins
        self.word_at = self.at[self.first] if len(self.first) else np.zeros(0, dtype=np.int64)
        self.doc_words = np.searchsorted(self.word_at, self.edges)
        self.script = _SCRIPT_NO[np.searchsorted(SCRIPT_STARTS, code[self.word_at], side="right") - 1]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, rows in batch.groupby("lang"):
            texts = rows["text"].tolist()
            for lo, hi in chunks(texts):
                w = Words(texts[lo:hi])
                seen, n = np.unique(w.bucket, return_counts=True)
                yield pd.DataFrame({"lang": lang, "bucket": seen, "script": -1, "n": n})
                seen, n = np.unique(np.repeat(w.script, w.size), return_counts=True)
                yield pd.DataFrame({"lang": lang, "bucket": -1, "script": seen, "n": n})


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, allowed: np.ndarray):
        self.langs, self.table, self.allowed = langs, table, allowed


def _buckets(n_langs: int) -> int:
    """A power of two, so that a bucket among fewer is a remainder."""
    n = BUCKETS
    while n * n_langs > CELLS:
        n //= 2
    return n


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model of the column ``lang``; give the rows that may be learned from."""
    labelled = docs.filter("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", "text")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    if rows_up_to(sizes, MAX_LANGUAGES) is None:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    langs = sorted(r.lang for r in sizes.collect())  # at most MAX_LANGUAGES rows
    share = F.lit(fit_rows) / F.greatest(F.col("n"), F.lit(fit_rows))
    sample = labelled.join(F.broadcast(sizes), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")
    n_buckets = _buckets(max(len(langs), 1))
    counts = sample.mapInPandas(_count, "lang string, bucket long, script long, n long")
    counts = counts.withColumn("bucket", F.when(F.col("bucket") >= 0, F.col("bucket") % n_buckets).otherwise(F.col("bucket")))
    counts = counts.groupBy("lang", "bucket", "script").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS rows and a row a language and script
    table, scripts = np.full((n_buckets, len(langs)), 0.5), np.zeros((len(_NAMES), len(langs)))
    lang = counts.column("lang").combine_chunks().dictionary_encode()
    place = np.searchsorted(langs, lang.dictionary.to_pylist()) if len(lang) else np.zeros(0, dtype=np.int64)
    col = place[lang.indices.to_numpy()] if len(lang) else np.zeros(0, dtype=np.int64)
    bucket, script, n = (counts.column(c).to_numpy() for c in ("bucket", "script", "n"))
    gram = bucket >= 0
    table[bucket[gram], col[gram]] += n[gram]
    scripts[script[~gram], col[~gram]] += n[~gram]
    allowed = scripts >= 0.01 * np.maximum(scripts.sum(axis=0), 1)
    return Model(langs, np.log(table / table.sum(axis=0)).astype(np.float32), allowed)


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """Best labels for (words, languages) scores, a change costing ``switch``; ties stay, then take the first language."""
    n, k = scores.shape
    best = scores.sum(axis=0)
    one = int(best.argmax())
    gain = np.cumsum(scores - scores[:, [one]], axis=0)
    low = np.minimum.accumulate(np.vstack([np.zeros((1, k)), gain[:-1]]), axis=0)
    if n == 0 or (gain - low).max() <= switch:
        return np.full(n, one)
    value, back = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(value)
        arg = value.index(top)
        back.append([arg if top - switch > v else j for j, v in enumerate(value)])
        value = [max(v, top - switch) + s for v, s in zip(value, row, strict=True)]
    label = [value.index(max(value))]
    for step in reversed(back):
        label.append(step[label[-1]])
    return np.array(label[::-1])


def word_scores(model: Model, w: Words) -> np.ndarray:
    s = np.add.reduceat(model.table[w.bucket % len(model.table)], w.first, axis=0).astype(np.float64) if len(w.first) else np.zeros((0, len(model.langs)))
    allowed = model.allowed[w.script]
    narrowed = allowed.any(axis=1)
    s = np.where(allowed, s, -np.inf)
    s[~narrowed] = 0.0
    return np.maximum(s - s.max(axis=1, keepdims=True, initial=-1e300), -FLOOR)


def _predict(shared, switch: float, sure: bool = False):
    """With ``sure`` also ``confidence``: over the spans, by letters, the softmax probability of the span's own label from its summed scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in few_rows(batches):
            texts = batch.column("text").to_pylist()
            out: list[tuple] = []
            for lo, hi in chunks(texts):
                w = Words(texts[lo:hi])
                s = word_scores(model, w) if model.langs else None
                for d in range(hi - lo):
                    a, b = w.doc_words[d], w.doc_words[d + 1]
                    if a == b or s is None:
                        out.append(("und", 0.0, [], 0.0))
                        continue
                    label = viterbi(s[a:b], switch)
                    letters = np.bincount(label, weights=w.size[a:b], minlength=len(model.langs))
                    top = int(letters.argmax())
                    total = s[a:b].sum(axis=0)
                    p = 1.0 / np.exp(np.minimum(total - total[top], 700.0)).sum()
                    turn = np.concatenate([[0], np.flatnonzero(np.diff(label)) + 1, [b - a]])
                    begin, last = w.word_at[a:b] - w.edges[d], w.word_at[a:b] - w.edges[d] + w.size[a:b]
                    spans = [{"start": int(begin[i]), "end": int(last[j - 1]), "lang": model.langs[label[i]]} for i, j in zip(turn, turn[1:], strict=False)]
                    sums, own = np.add.reduceat(s[a:b], turn[:-1], axis=0), label[turn[:-1]]
                    each = 1.0 / np.exp(np.minimum(sums - sums[np.arange(len(own)), own][:, None], 700.0)).sum(axis=1)
                    held = np.add.reduceat(w.size[a:b], turn[:-1])
                    out.append((model.langs[top], float(letters[top] / letters.sum() * p), spans, float((held * each).sum() / held.sum())))
            lang, score, spans, confidence = zip(*out, strict=True) if out else ((), (), (), ())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
            keep = [c for c in batch.schema.names if c != "text"]
            more = [pa.array(confidence, pa.float64())] if sure else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kind), *more], [*keep, "lang_pred", "score", "spans", *["confidence"][: len(more)]])

    return run


def predict(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score, spans) for each row; spans are (start, end, lang) in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_predict(shared, switch), "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.3, switch: float = SWITCH) -> DataFrame:
    """``docs`` whose spans' languages are found with a confidence of at least ``min_score``, with ``lang`` set to the document's; other columns as they were.

    Texts of several languages stay if their spans are clear each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    schema = f"_row {packed.schema['_row'].dataType.simpleString()}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>, confidence double"
    judged = packed.mapInArrow(_predict(shared, switch, sure=True), schema).filter((F.col("lang_pred") != "und") & (F.col("confidence") >= min_score))
    return judged.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
