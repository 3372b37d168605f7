import random
from collections import Counter

import numpy as np

from claimscope.llm import neardup
from tests.llm.helpers import documents, edge_texts, words


def shingles(text):
    ws = text.split()
    return Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else Counter([tuple(ws)] if ws else [])


def brute_force(texts, threshold=0.8):
    """Class of each id: the smallest id of its component under exact weighted Jaccard similarity."""
    sets = [(i, shingles(t)) for i, t in texts if i is not None and t is not None]
    parent = {i: i for i, _ in texts if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and sum((a & b).values()) >= threshold * sum((a | b).values()):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return {i: root(i) for i in parent}


def found(spark, texts):
    return {r.doc_id: r.class_id for r in neardup.near_duplicates(documents(spark, texts)).collect()}


def near(rng, text, edits):
    ws = text.split()
    for _ in range(edits):
        ws[rng.randrange(len(ws))] = f"e{rng.randrange(10**9)}"
    return " ".join(ws)


def test_equals_brute_force_with_copies_chains_and_a_large_group(spark):
    rng = random.Random(1)
    texts = [(i, " ".join(words(rng, 120, 5000))) for i in range(1, 30)]
    base = texts[4][1]
    texts += [(100 + i, base) for i in range(12)]  # exact copies
    texts += [(200 + i, near(rng, base, 1)) for i in range(25)]  # near copies of one text, some of them apart from each other
    texts += [(300 + i, near(rng, base, 9)) for i in range(10)]  # too far
    step = texts[7][1]
    for i in range(6):  # a chain
        step = near(rng, step, 1)
        texts.append((400 + i, step))
    assert found(spark, texts) == brute_force(texts)


def test_edge_cases(spark):
    got = found(spark, edge_texts())
    want = brute_force(edge_texts())
    assert got == want
    assert got[1] == 1 and got[2] == 2 and got[3] == 3 and got[6] == 5


def test_empty_table(spark):
    assert neardup.near_duplicates(documents(spark, [])).count() == 0


def test_keep_one_keeps_columns_and_null_ids(spark):
    docs = documents(spark, edge_texts())
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is not None, x or 0))
    assert ids[0] is None and 5 in ids and 6 not in ids


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 100, 100))
    doc = np.repeat([0, 1], 700)
    sig = neardup.signatures(doc, np.concatenate([common, a, common, b]), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - 600 / 800) < 0.05


def test_recall_of_planted_near_copies(spark):
    """Each copy keeps 80 to 95 percent of its text's shingles; a third stand in one group, so that it takes several blocks."""
    rng = random.Random(11)
    texts, planted = [], []
    for i in range(40):
        base = " ".join(words(rng, 150, 9000))
        texts.append((i, base))
        for k in range(120 if i == 0 else 6):
            t = near(rng, base, rng.randrange(1, 5) if k % 2 else 2)
            a, b = shingles(base), shingles(t)
            if 0.8 <= sum((a & b).values()) / sum((a | b).values()) <= 0.95:
                planted.append((i, 1000 + 200 * i + k))
            texts.append((1000 + 200 * i + k, t))
    got = found(spark, texts)
    caught = sum(got[a] == got[b] for a, b in planted)
    assert len(planted) > 150 and caught >= 0.9 * len(planted)
    assert len({got[i] for i in range(40)}) == 40


def test_several_blocks_of_one_bucket_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(12)
    base = " ".join(words(rng, 90, 9000))
    texts = [(1, base), *((10 + i, near(rng, base, rng.choice([1, 2, 3, 6]))) for i in range(40)), *((100 + i, " ".join(words(rng, 60))) for i in range(5))]
    assert found(spark, texts) == brute_force(texts)


def test_common_units_count_repeats_as_often_as_both_have_them():
    a, b = np.array([5, 5, 7, -1], dtype=np.int32), np.array([5, 7, 7, -1, 9], dtype=np.int32)
    assert neardup.common_units([a, b], [b]).tolist() == [[3], [5]] and neardup.common_units([a, b])[0, 1] == 3


def test_keep_one_judges_each_text_of_an_id(spark):
    rng = random.Random(8)
    one, two, three = (" ".join(words(rng, 60, 3000)) for _ in range(3))
    near = one.replace(" ", "  ", 1) + " end"
    texts = [(1, one), (2, near), (2, two), (2, two), (2, None), (3, two), (3, three), (4, three), (None, one), (0, "x")]
    kept = sorted(((r.doc_id, r.text) for r in neardup.keep_one(documents(spark, texts)).collect()), key=str)
    assert kept == sorted([(1, one), (2, two), (2, two), (2, None), (3, three), (None, one), (0, "x")], key=str)
