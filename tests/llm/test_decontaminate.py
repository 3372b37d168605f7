import random

import pytest

from claimscope.llm import decontaminate as d
from tests.llm.helpers import documents, edge_texts, words

ITEMS = "item_id long, text string"


def distance(p, t):
    """Smallest edit distance of p to any part of t."""
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        new = [0]
        for i, x in enumerate(p):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def edit(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(len(s))
        s[k : k + 1] = rng.choice([[], ["q"], [s[k], "q"]])
    return "".join(s)


@pytest.mark.parametrize("seed", range(4))
def test_myers_equals_dynamic_programming(seed):
    rng = random.Random(seed)
    p = "".join(rng.choice("abc ") for _ in range(rng.randrange(5, 120)))
    t = "".join(rng.choice("abc ") for _ in range(60)) + edit(rng, p, 4) + "".join(rng.choice("abc ") for _ in range(60))
    hit = d.myers(p, t, len(p))
    assert hit[0] == distance(p, t)
    assert d.myers(p, t, hit[0] - 1) is None


def test_finds_all_within_the_budget(spark):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, 30))) for i in range(8)] + [(8, "Short item"), (9, None), (10, "!!")]
    texts = []
    for i in range(60):
        s = d.normalise(items[i % 8][1])
        texts.append((i, f"{' '.join(words(rng, 20))} {edit(rng, s, rng.randrange(0, 12)).upper()}! {' '.join(words(rng, 20))}"))
    texts += [(100, "a SHORT, item here"), (101, "shortitem"), (102, items[0][1] + " " + items[1][1])]
    got = {(r.doc_id, r.item_id): r.distance for r in d.hits(documents(spark, texts), spark.createDataFrame(items, ITEMS)).collect()}
    want = {}
    for i, t in texts:
        for k, raw in items:
            s, t2 = d.normalise(raw), d.normalise(t)
            if len(s) >= d.SHORT and (e := distance(s, t2)) <= int(d.ERROR_RATE * len(s)):
                want[i, k] = e
            elif s and len(s) < d.SHORT and f" {s} " in f" {t2} ":
                want[i, k] = 0
    assert got == want and (100, 8) in got and (101, 8) not in got and len(want) > 30


def test_blocks_of_items_give_the_same_hits(spark):
    rng = random.Random(3)
    items = spark.createDataFrame([(i, " ".join(words(rng, 20))) for i in range(9)], ITEMS)
    docs = documents(spark, [(r.item_id, f"x {r.text} y") for r in items.collect()])
    one = sorted(map(tuple, d.hits(docs, items).collect()))
    assert sorted(map(tuple, d.hits(docs, items, block_chars=200).collect())) == one and len(one) == 9


def test_edges(spark):
    items = spark.createDataFrame([(1, edge_texts()[4][1])], ITEMS)
    docs = documents(spark, edge_texts())
    kept = d.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 10, 2, 3, 4, 7, None]
    assert d.hits(docs, items.limit(0)).count() == 0 and d.hits(docs.limit(0), items).count() == 0
    assert d.contaminated(docs, items).filter("doc_id = 6").first().item_ids == [1]


def test_other_texts_of_an_id_stay(spark):
    rng = random.Random(9)
    item = " ".join(words(rng, 30))
    texts = [(1, f"a {item} b"), (1, "clean"), (1, "clean"), (2, item), (2, None), (3, "own words"), (None, item)]
    items = spark.createDataFrame([(5, item)], "item_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in d.decontaminate(documents(spark, texts), items).collect()), key=str)
    assert kept == sorted([(1, "clean"), (1, "clean"), (2, None), (3, "own words"), (None, item)], key=str)
