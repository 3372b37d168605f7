import hashlib
import random
import re

import pytest

from claimscope.llm import substrings
from tests.llm.helpers import documents, edge_texts, words


def brute_force(texts, size=13):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts]
    first = {}
    for i, ws in split:
        for k in range(len(ws) - size + 1):
            w = tuple(ws[k : k + size])
            if i is not None and (w not in first or i < first[w]):
                first[w] = i
    out = []
    for i, ws in split:
        gone = set()
        for k in range(len(ws) - size + 1):
            if i is not None and first[tuple(ws[k : k + size])] < i:
                gone.update(range(k, k + size))
        kept = [w for k, w in enumerate(ws) if k not in gone]
        out.append((i, len(ws), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, texts):
    return sorted((tuple(r) for r in substrings.report(documents(spark, texts)).collect()), key=str)


def passages(seed):
    rng = random.Random(seed)
    shared = [" ".join(words(rng, n, 3000)) for n in (13, 14, 20, 40, 12)]
    texts = []
    for i in range(40):
        parts = [" ".join(words(rng, rng.randrange(0, 60), 3000))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), " ".join(words(rng, rng.randrange(0, 20), 3000))]
        texts.append((i, "\t".join(parts)))
    return texts + [(90, texts[3][1]), (91, texts[3][1])]


def test_equals_brute_force(spark):
    assert found(spark, passages(2)) == brute_force(passages(2))


def test_few_distinct_words(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(words(rng, 60, 2))) for i in range(12)] + [(50, "a " * 100), (51, "a " * 30)]
    assert found(spark, texts) == brute_force(texts)


def test_hot_minimizers_are_split_by_window(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 3)
    rng = random.Random(4)
    core = " ".join(words(rng, 10, 3000))
    texts = [(i, f"{' '.join(words(rng, 8, 3))} {core} {' '.join(words(rng, 8, 3))}") for i in range(60)]
    assert found(spark, texts) == brute_force(texts)


def test_edge_cases(spark):
    assert found(spark, edge_texts()) == brute_force(edge_texts())
    assert found(spark, []) == []


def test_kept_texts(spark):
    texts = passages(6)
    kept = {r.doc_id: r.text for r in substrings.remove_repeats(documents(spark, texts)).collect()}
    assert kept[0] == texts[0][1] and kept[90] == ""


@pytest.mark.parametrize("seed", range(3))
def test_automaton_finds_the_smallest_document(seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(100), [rng.randrange(3) for _ in range(rng.randrange(1, 40))]) for _ in range(30)]
    a = substrings.SuffixAutomaton()
    for doc, ws in rows:
        a.add(ws, doc)
    a.close()
    asked = [rng.randrange(3) for _ in range(60)]
    for size in (1, 3, 5):
        want = []
        for k in range(len(asked) - size + 1):
            have = [d for d, ws in rows if any(ws[i : i + size] == asked[k : k + size] for i in range(len(ws) - size + 1))]
            want.append(min(have, default=None))
        assert a.match(asked, size) == want
