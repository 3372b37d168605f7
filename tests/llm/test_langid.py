import itertools
import random

import numpy as np
import pytest

from claimscope.llm import langid
from claimscope.llm.queries import held_out
from tests.llm.helpers import documents, edge_texts

WORDS = {"en": "the of and house running ship thing", "de": "der die und nicht haus schiff über", "ru": "это дом река тоже когда", "el": "και το σπίτι δεν"}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def rows(seed, n=60):
    rng = random.Random(seed)
    return [(i, text(rng, lang, 30), lang) for i, lang in enumerate(itertools.islice(itertools.cycle(WORDS), n))]


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.createDataFrame(rows(1), "doc_id long, text string, lang string"))


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    s = rng.normal(0, 3, (7, 3))
    for switch in (0.5, 3.0, 12.0):
        value = lambda p: sum(s[i, x] for i, x in enumerate(p)) - switch * sum(a != b for a, b in itertools.pairwise(p))  # noqa: E731, B023
        best = max(map(value, itertools.product(range(3), repeat=7)))
        assert value(langid.viterbi(s, switch).tolist()) == pytest.approx(best)


def test_mixed_text_has_spans(spark, model):
    rng = random.Random(2)
    a, b = text(rng, "en", 30), text(rng, "de", 20)
    r = langid.predict(documents(spark, [(1, f"{a} {b}")]), model).first()
    assert r.lang_pred == "en" and [s.lang for s in r.spans] == ["en", "de"] and r.spans[0].start == 0 and abs(r.spans[1].start - len(a)) < 12 and r.spans[1].end == len(a) + 1 + len(b)


def test_scripts_narrow(spark, model):
    got = {r.doc_id: r.lang_pred for r in langid.predict(documents(spark, [(1, "щцж ъыь"), (2, "ξψ ζθ"), (3, "漢字")]), model).collect()}
    assert got[1] == "ru" and got[2] == "el" and got[3] in WORDS


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(rows(3, 400), "doc_id long, text string, lang string")
    m = langid.fit(docs.filter(~held_out()))
    got = langid.predict(docs.filter(held_out()), m).join(docs, "doc_id").selectExpr("avg(int(lang = lang_pred)) a", "min(score) lo", "max(score) hi").first()
    assert got.a > 0.98 and 0 <= got.lo <= got.hi <= 1


def test_edges(spark, model):
    got = {(r.doc_id, r.lang_pred == "und", r.score == 0) for r in langid.predict(documents(spark, edge_texts()), model).collect()}
    assert {(1, True, True), (2, True, True), (3, True, True), (10, True, True)} <= got and (5, False, False) in got
    assert langid.predict(documents(spark, []), model).count() == 0
    none = langid.fit(documents(spark, edge_texts()))
    assert {r.lang_pred for r in langid.predict(documents(spark, edge_texts()), none).collect()} == {"und"}


def test_keep_identified_keeps_columns(spark, model):
    docs = documents(spark, [(1, text(random.Random(5), "de", 40)), (2, "123"), (None, text(random.Random(6), "en", 40))])
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.lang, r.h) for r in kept.collect()) == [(0, "en", "h"), (1, "de", "h")]


def test_clear_documents_of_several_languages_stay(spark, model):
    rng = random.Random(7)
    four = " ".join(text(rng, lang, 200)[:300] for lang in WORDS)
    two = f"{text(rng, 'en', 60)} {text(rng, 'de', 50)}"
    docs = documents(spark, [(1, four), (2, two), (3, "... 5")])
    assert {r.doc_id for r in langid.keep_identified(docs, model).collect()} == {1, 2}
    assert langid.predict(docs.filter("doc_id = 1"), model).first().score < 0.3
