"""Whole operators against plain definitions on small random tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from claimscope.llm import langid, licenses, pii
from tests.llm.helpers import documents
from tests.llm.test_pii import base


# --- op5: every stretch of a text against every template

SMALL = {name: licenses.TEMPLATES[name] for name in ("MIT", "MIT-grant", "GPL-2.0", "GPL-3.0", "MPL-2.0", "BSD-3-Clause", "CC0-1.0")}


def differences(template, stretch):
    """Fewest words missing plus words too many: by longest common subsequence."""
    row = [0] * (len(stretch) + 1)
    for w in template:
        new = [0]
        for j, x in enumerate(stretch):
            new.append(row[j] + 1 if w == x else max(row[j + 1], new[j]))
        row = new
    return len(template) + len(stretch) - 2 * row[-1]


@pytest.mark.parametrize("seed", range(8))
def test_license_places_equal_all_stretches(seed):
    rng = random.Random(seed)
    for _ in range(20):
        t = [rng.choice("abcd") for _ in range(rng.randrange(6, 13))]
        block = [rng.choice("abcde") for _ in range(rng.randrange(1, 12))] + t[: rng.randrange(len(t))] + t[rng.randrange(2) :]
        most = rng.randrange(0, 3)
        got = licenses.places(t, block, most)
        cost = {(a, b): differences(t, block[a:b]) for a in range(len(block)) for b in range(a + 1, len(block) + 1)}
        assert all(cost[a, b] == len(missing) + len(extra) <= most for a, b, missing, extra in got)
        ends = {b for (a, b), c in cost.items() if c <= most and block[b - 1] in t}
        best_end = {b: min(cost[a, b] for a in range(b)) for b in ends}
        assert all(any(a2 <= a < b2 or a <= a2 < b for a2, b2, _, _ in got) for (a, b), c in cost.items() if c <= most and block[b - 1] in t and c == best_end[b] and c < len(t))


@pytest.mark.parametrize("seed", range(6))
def test_no_license_stretch_escapes_the_cues(seed):
    """Wherever a stretch is close enough to a template, the scan confirms that template or one that overlaps and is worth more."""
    rng = random.Random(seed)
    scanner = licenses.Scanner(SMALL)
    for _ in range(3):
        ws = []
        for _ in range(5):
            t = licenses.words(rng.choice(list(SMALL.values())))
            if rng.random() < 0.6 and len(t) >= 10:
                k = rng.randrange(len(t))
                t = t[:k] + rng.choice([[], [t[k], "odd"]]) + t[k + 1 :]
            ws += [f"f{rng.randrange(9)}" for _ in range(rng.randrange(30))] + t
        got = scanner.scan(" ".join(ws))
        starts = [m.start() for m in re.finditer(r"\S+", " ".join(ws))]
        taken = [(starts.index(g[1]), g[2]) for g in got]
        for name, text in SMALL.items():
            t = licenses.words(text)
            most = licenses.most_differences(t)
            for a in range(len(ws)):
                for b in range(a + len(t) - most, min(a + len(t) + most, len(ws)) + 1):
                    if b > a and differences(t, ws[a:b]) <= most and ws[b - 1] in t:
                        assert any(p <= b and p + len(licenses.words(SMALL[n])) + 1 >= a for p, n in taken), (name, ws[a:b])


def test_every_template_has_more_cues_than_words_that_may_be_missing():
    known = {name: licenses.words(t) for name, t in licenses.TEMPLATES.items()}
    cues = licenses.cue_words(known)
    for name, ws in known.items():
        assert len({w for w, names in cues.items() if name in names}) == min(licenses.most_differences(ws) + 1, len(set(ws)))


def test_a_hundred_thousand_lines_in_one_text(spark):
    import time

    lines = [f"line {i} of a long text" if i % 1000 else licenses.TEMPLATES["MIT-text"] for i in range(100_000)]
    begin = time.monotonic()
    assert len(licenses.Scanner(licenses.TEMPLATES).scan("\n".join(lines))) == 100
    assert time.monotonic() - begin < 10


# --- op6: label and score word by word

def plain_prediction(model, text, switch=langid.SWITCH):
    words = [m[0] for m in re.finditer(r"[^\W\d_]+", text)]
    if not words:
        return "und", 0.0
    scores = []
    for w in words:
        chars = [0, *[ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in w], 0]
        total = np.zeros(len(model.langs))
        for x, y, z in zip(chars, chars[1:], chars[2:], strict=False):
            h = (x * 0x9E3779B1 + y * 0x85EBCA77 * 31 + z * 0xC2B2AE3D * 977) % 2**64
            total += model.table[(((h ^ (h >> 17)) * 0x9E3779B97F4A7C15 % 2**64) >> 48) % langid.BUCKETS % len(model.table)]
        script = langid.SCRIPTS[int(np.searchsorted(langid.SCRIPT_STARTS, ord(w[0]), side="right")) - 1]
        ok = model.allowed[sorted(set(langid.SCRIPTS)).index(script)]
        total = np.where(ok, total, -np.inf) if ok.any() else np.zeros(len(model.langs))
        scores.append(np.maximum(total - total.max(), -langid.FLOOR))
    value, back = scores[0], []
    for s in scores[1:]:
        stay = value[:, None] - switch * (1 - np.eye(len(value)))
        back.append(stay.argmax(axis=0))
        value = stay.max(axis=0) + s
    label = [int(value.argmax())]
    for step in reversed(back):
        label.append(int(step[label[-1]]))
    letters = defaultdict(int)
    for w, i in zip(words, reversed(label), strict=True):
        letters[i] += len(w)
    top = min(letters, key=lambda i: (-letters[i], i))
    total = sum(scores)
    return model.langs[top], letters[top] / sum(letters.values()) / np.exp(np.minimum(total - total[top], 700)).sum()


def test_language_labels_and_scores_equal_the_definition(spark):
    from tests.llm.test_langid import WORDS, rows, text

    model = langid.fit(spark.createDataFrame(rows(1), "doc_id long, text string, lang string"))
    rng = random.Random(8)
    langs = list(WORDS)
    texts = [(i, " ".join(text(rng, rng.choice(langs), rng.randrange(1, 25)) + rng.choice([". ", " 12-", "! "]) for _ in range(rng.randrange(1, 5)))) for i in range(80)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(documents(spark, texts), model).collect()}
    for i, t in texts:
        lang, score = plain_prediction(model, t)
        assert got[i] == (lang, pytest.approx(score, abs=1e-5)), t


def test_more_languages_share_fewer_buckets(spark, monkeypatch):
    monkeypatch.setattr(langid, "CELLS", 1 << 10)
    from tests.llm.test_langid import rows

    model = langid.fit(spark.createDataFrame(rows(1, 200), "doc_id long, text string, lang string"))
    assert model.table.shape == (256, 4)
    docs = documents(spark, [(i, t) for i, t, _ in rows(2)])
    want = {i: lang for i, _, lang in rows(2)}
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert sum(got[i] == want[i] for i in want) > 0.9 * len(want)


# --- op2: terms by counting documents

def plain_terms(texts, support=pii.MIN_SUPPORT, generalise=pii.GENERALISE, remove=pii.REMOVE):
    """{doc: {(start, end): level}} of disclosing terms."""
    texts = [(i, t or "") for i, t in texts]
    entities, n_term, words = {}, Counter(), {}
    for i, t in texts:
        entities[i] = {(k, t[s:e]) for k, s, e in base(t)}
        masked = list(t)
        for k, s, e in base(t):
            if k == "email":
                masked[s:e] = " " * (e - s)
        words[i] = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{3,}", "".join(masked))]
        n_term.update({m[0].lower() for m in re.finditer(r"[^\W\d_]{3,}", t)})
    n_entity, joint, seen = Counter(), Counter(), defaultdict(set)
    for i, t in texts:
        for e in entities[i]:
            n_entity[e] += 1
            for w in {w for _, _, w in words[i]}:
                joint[e, w] += 1
                seen[e, w].add(t)
    out = {}
    for i, _ in texts:
        level = {}
        for e in entities[i]:
            for w in {w for _, _, w in words[i]}:
                strength, prior = joint[e, w] / n_term[w], n_entity[e] / len(texts)
                if len(seen[e, w]) >= support and strength >= prior ** (1 - generalise):
                    level[w] = max(level.get(w, 0), int(strength >= prior ** (1 - remove)))
        out[i] = {(s, e): level[w] for s, e, w in words[i] if w in level}
    return out


@pytest.mark.parametrize("seed", range(2))
def test_term_spans_equal_the_definition(spark, seed):
    rng = random.Random(seed)
    people = [(f"name{c * 3}", f"{c}@mail{c}.example.org" if k % 2 else f"+49 30 12345{k}7 8") for k, c in enumerate("abcde")]
    filler = "the of list record call please number read and with Über naïve".split()
    texts = []
    for i in range(90):
        ws = [rng.choice(filler) for _ in range(rng.randrange(3, 25))]
        if rng.random() < 0.6:
            name, entity = rng.choice(people)
            name = re.sub(r"\d", "", name)
            ws.insert(rng.randrange(len(ws)), entity)
            if rng.random() < 0.9:
                ws.insert(rng.randrange(len(ws)), name.upper() if rng.random() < 0.3 else name)
        texts.append((i, " ".join(ws)))
    texts += [(200, texts[3][1]), (201, texts[3][1]), (202, None), (203, "")]
    got = defaultdict(dict)
    for r in pii.term_spans(documents(spark, texts)).collect():
        got[r.doc_id][r.start, r.end] = int(r.level == "remove")
    want = {i: v for i, v in plain_terms(texts).items() if v}
    assert dict(got) == want and want


def test_many_spans_in_one_text_are_linear(spark):
    import time

    from pyspark.sql import functions as F

    text = " ".join(f"user{i}@host{i % 7}.example.com é" for i in range(20_000))
    docs = documents(spark, [(1, text)])
    begin = time.monotonic()
    r = docs.select(F.size(pii.base_spans(F.col("text"))).alias("n"), pii.redact(F.col("text"), pii.base_spans(F.col("text"))).alias("t")).first()
    took = time.monotonic() - begin
    assert r.n == 20_000 and r.t == " ".join(["<EMAIL> é"] * 20_000) and took < 30, took
    assert math.isfinite(took)
