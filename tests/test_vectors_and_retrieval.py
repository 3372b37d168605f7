"""Similarity operators against brute force, in several blocks."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimscope.functions.vectors import normalize
from claimscope.operators import clustering, postings, retrieval


def rows_of(spark, x, key="id", name="vec", **more):
    cols = "".join(f", {k} long" for k in more)
    return spark.createDataFrame([(i, v.tolist(), *(int(m[i]) for m in more.values())) for i, v in enumerate(x)], f"{key} long, {name} array<double>{cols}")


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("threshold", [0.5, 0.65])
def test_all_links_of_more_than_two_thousand_rows(spark, threshold):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(60, 24))
    x = np.vstack([rng.normal(size=(1900, 24)), centres[rng.integers(0, 60, 400)] + rng.normal(0, 0.8, size=(400, 24))])
    s = np.triu(np.round(unit(x) @ unit(x).T, 9), 1)
    want = set(zip(*(a.tolist() for a in np.nonzero(s >= threshold)), strict=True))
    got = clustering.similar_pairs(rows_of(spark, x), "id", threshold).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 300


@pytest.mark.parametrize("threshold", [-0.2, 0.0, 0.5, 0.9])
def test_pruned_pairs_equal_all_pairs(spark, monkeypatch, threshold):
    """Clusters, zero vectors, copies, two lengths and several groups of blocks."""
    monkeypatch.setattr(clustering, "BRUTE_FORCE", 25)
    monkeypatch.setattr(clustering, "ZONES", 3)
    rng = np.random.default_rng(8)
    x = [list(map(float, c + rng.normal(0, 0.4, 6))) for c in rng.normal(size=(5, 6)) for _ in range(40)]
    x += [[0.0] * 6] * 3 + [x[0]] * 60 + [[1.0, 2.0], [1.0, 2.1], [-1.0, 0.5]]
    rows = spark.createDataFrame([(i, v, "c") for i, v in enumerate(x)] + [(None, x[0], "c"), (999, None, "c"), (998, [1.0, None] * 3, "c")], "id long, vec array<double>, block string")
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    expected = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if len(x[i]) == len(x[j]) and round(float(unit(x[i]) @ unit(x[j])), 9) >= threshold}
    got = [(r.a, r.b) for r in clustering.similar_pairs(rows, "id", threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_blocks_out_of_reach_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BRUTE_FORCE", 50)
    rng = np.random.default_rng(9)
    x = [c + rng.normal(0, 0.05, 32) for c in rng.normal(size=(12, 32)) for _ in range(100)]
    unit = spark.createDataFrame([(i, list(map(float, v / np.linalg.norm(v)))) for i, v in enumerate(x)], "id long, v array<double>")
    blocks, pairs = clustering.blocks_within_reach(unit, 0.9)
    n = blocks.select("block").distinct().count()
    assert n >= 24 and pairs.count() <= 3 * n < n * (n + 1) / 2 / 3
    sent = clustering._reaching(blocks, pairs, "p", "q", clustering._reach(0.9)).groupBy("id").count()
    assert sent.agg(F.max("count")).first()[0] <= 6 < n
    links = clustering.similar_pairs(unit.withColumnRenamed("v", "vec"), "id", 0.9)
    assert links.count() == 12 * 100 * 99 / 2


@pytest.mark.parametrize("block", [8_192, 40])
def test_nearest_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(clustering, "BRUTE_FORCE", 25)
    x = np.random.default_rng(1).normal(size=(120, 8))
    x[50] = x[7]  # a tie
    s = np.round(unit(x) @ unit(x).T, 9)
    np.fill_diagonal(s, -np.inf)
    corpus = rows_of(spark, x, name="v").union(spark.createDataFrame([(900, None), (901, [1.0])], "id long, v array<double>"))
    got = clustering.nearest(rows_of(spark, x, key="q", name="v"), corpus, 4, block=block).collect()
    want = {(q, i, r) for q in range(120) for r, i in enumerate(sorted(range(120), key=lambda i: (-s[q, i], i))[:4], 1)}
    assert {(r.q, r.id, r.rank) for r in got} == want and len(got) == len(want)
    assert clustering.nearest(corpus.limit(0).withColumnRenamed("id", "q"), corpus, 3).count() == 0


def test_topic_search_equals_the_definition(spark):
    rng = np.random.default_rng(2)
    x, topic, post = rng.normal(size=(80, 6)), rng.integers(0, 3, 80), rng.integers(0, 30, 80)
    s = np.round(unit(x) @ unit(x).T, 9)
    corpus = rows_of(spark, x, name="v", topic=topic, post=post)
    got = {(r.q, r.rank): r.id for r in retrieval.topic_search(corpus.withColumnRenamed("id", "q"), corpus, 5).collect()}
    for q in range(80):
        taken, order = [], sorted((i for i in range(80) if i != q), key=lambda i: (topic[i] != topic[q], -s[q, i], i))
        for i in order:
            if post[i] not in {post[j] for j in taken}:
                taken.append(i)
        assert [got[q, r] for r in range(1, 6)] == taken[:5]


def test_rows_over_the_cap_go_to_the_nearest_kept_cluster(spark):
    x = np.array([[1, 0], [1, 0.01], [1, 0.02], [0, 1], [0.01, 1], [0.7, 0.6], [-1, -1]])
    rows = rows_of(spark, x)
    capped = clustering.cap_clusters(clustering.form_clusters(rows, "id", 0.99), "id", 2)
    got = {r.id: (r.cluster_id, r.over_cap, r.similarity) for r in clustering.assign_over_cap(capped, rows, "id").collect()}
    assert [got[i][0] for i in range(7)] == [0, 0, 0, 3, 3, 0, 3] and [got[i][1] for i in range(7)] == [False] * 5 + [True] * 2 and got[6][2] < 0


def test_best_bm25_rows_equal_the_join(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: [f"w{int(rng.paretovariate(1))}" for _ in range(n)]
    docs = spark.createDataFrame([(i, text(rng.randrange(1, 30))) for i in range(700)] + [(900, []), (901, None)], "id long, words array<string>")
    q = spark.createDataFrame([(i, text(6)) for i in range(9)] + [(20, ["never"]), (21, [])], "q long, words array<string>")
    top = retrieval.bm25_top(q, docs, 5).collect()
    rows = {}
    for r in retrieval.bm25(q, docs.filter("words is not null")).collect():
        rows.setdefault(r.q, []).append((-round(r.score, 9), r.id, r.norm))
    want = {(q, i, round(n, 9)) for q, found in rows.items() for _, i, n in sorted(found)[:5]}
    assert {(r.q, r.id, round(r.norm, 9)) for r in top} == want and len(top) == len(want)
    for name, value in (("BLOCK_DOCS", 7), ("SHARD_BLOCKS", 3), ("QUERIES", 2)):  # many shards and groups
        monkeypatch.setattr(postings, name, value)
    few = retrieval.bm25_top(q, docs, 5).collect()
    assert {(r.q, r.id, round(r.norm, 9)) for r in few} == want


def test_words_are_not_shuffled_into_posting_lists(spark):
    """An index is made where the words are read, in shards of a bounded number of documents, and weights stand on a table and not on the lists."""
    docs = spark.createDataFrame([(i, [f"w{i % 50}", "all"]) for i in range(2_500)], "id long, words array<string>").repartition(2)
    index = postings.build(docs)
    parts = index.lists.filter("w = 'all'").select("shard", "df").collect()
    assert sum(r.df for r in parts) == 2_500 and max(r.df for r in parts) <= postings.BLOCK_DOCS * postings.SHARD_BLOCKS and len({r.shard for r in parts}) == len(parts) >= 3
    weights = postings.term_weights(index, docs.limit(3).withColumnRenamed("id", "q"))
    assert weights.inputFiles() and not set(weights.inputFiles()) & set(index.lists.inputFiles())


def test_consistency_without_pairs_equals_all_pairs(spark):
    x = np.random.default_rng(4).normal(size=(60, 5))
    grp = np.arange(60) % 7
    grp[59] = 100  # alone
    rows = rows_of(spark, x, grp=grp)
    s = unit(x) @ unit(x).T
    a, b = np.nonzero((grp[:, None] == grp[None, :]) & ~np.eye(60, dtype=bool))
    pairs = spark.createDataFrame([(int(grp[i]), int(i), int(j), float(s[i, j])) for i, j in zip(a, b, strict=True)], "grp long, a long, b long, similarity double")
    want = {r.grp: (r.id, pytest.approx(r.mean_sim)) for r in retrieval.self_consistency(pairs, rows.select("grp", "id")).collect()}
    assert {r.grp: (r.id, r.mean_sim) for r in retrieval.consistent_vectors(rows, "grp", "id").collect()} == want and want[100][0] == 59


def test_text_vectors_are_unit_and_near_for_like_texts(spark):
    rows = spark.createDataFrame([(1, "a b c d".split()), (2, "a b c e".split()), (3, "x y z".split())], "id long, words array<string>")
    v = {r.id: np.array(r.vec) for r in retrieval.hashed_text_vectors(rows).collect()}
    assert all(np.linalg.norm(x) == pytest.approx(1) for x in v.values()) and v[1] @ v[2] > v[1] @ v[3]


def test_topic_model_finds_separate_groups(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.1, size=(30, 3)) for c in (0, 5, -5)])
    rows = rows_of(spark, x)
    got = {r.id: r.topic for r in clustering.assign_topics(rows, "id", clustering.topic_model(rows, 3)).collect()}
    assert [len({got[i] for i in range(k, k + 30)}) for k in (0, 30, 60)] == [1, 1, 1] and len(set(got.values())) == 3


def test_profile_of_clusterings(spark):
    sizes = spark.createDataFrame([(0.5, n) for n in (1, 1, 3, 10, 50, 200)], "t double, size long")
    r = clustering.threshold_profile(sizes, "t").first()
    assert (r.size_1, r.size_2_5, r.size_6_20, r.size_21_100, r.size_over_100) == (2, 1, 1, 1, 1) and r.yield_pct == pytest.approx(100 * 263 / 265)
    x = np.array([[1.0, 0], [1, 0], [0, 1], [0, 1], [5, 5]])
    s = clustering.similarity_statistics(rows_of(spark, x, by=np.array([1, 1, 2, 2, 3])), "by").first()
    assert s.n == 2 and s.mean_similarity == pytest.approx(1) and s.std_similarity == pytest.approx(0, abs=1e-9)


def test_hybrid_candidates_equal_all_rows(spark, monkeypatch):
    for name, value in (("BLOCK_DOCS", 7), ("SHARD_BLOCKS", 3), ("QUERIES", 4)):
        monkeypatch.setattr(postings, name, value)
    rng = random.Random(5)
    text = lambda n: [f"w{int(rng.paretovariate(1))}" for _ in range(n)]
    texts = {i: text(rng.randrange(1, 25)) for i in range(300)}
    docs = spark.createDataFrame([*texts.items(), (900, []), (901, None)], "id long, words array<string>")
    asked = {i: text(6) for i in range(9)} | {20: ["never"], 21: []}
    q = spark.createDataFrame(list(asked.items()), "q long, words array<string>")
    lexical = {(r.q, r.id): r.norm for r in retrieval.bm25(q, docs.filter("words is not null")).collect()}
    count = lambda a, b: sum(a.count(w) * b.count(w) for w in set(a))
    want = {}
    for (i, j), b in lexical.items():
        cos = count(asked[i], texts[j]) / (count(asked[i], asked[i]) * count(texts[j], texts[j])) ** 0.5
        want.setdefault(i, []).append((-round(0.5 * cos + 0.3 * b, 9), j, cos, b))
    got = retrieval.hybrid_candidates(q, docs, first=6).collect()
    assert {(r.q, r.id): (pytest.approx(r.cos), pytest.approx(r.bm25)) for r in got} == {(i, j): (0.5 * c / 0.5, b) for i, rows in want.items() for _, j, c, b in sorted(rows)[:6]}


def test_blocks_below_the_threshold_are_not_scored(monkeypatch):
    """One block holds all of a rare word: the others' bounds fall below the second best score."""
    n = 2_000
    rows = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([i // 100 for i in range(n)], pa.int32()), pa.array([["common", "rare"] if i < 5 else ["common"] * 3 for i in range(n)])], ["id", "block", "words"])
    lists = pa.Table.from_batches([postings._shard_lists(0, [rows], 3.0, 1.5, 0.75)])
    scored = []
    true_ranges = postings._ranges
    monkeypatch.setattr(postings, "_ranges", lambda starts, sizes: scored.append(int(sizes.sum())) or true_ranges(starts, sizes))
    asked = pa.table({"q": [1, 1], "w": ["common", "rare"], "on_part": [0.01, 5.0], "on_share": [0.0, 0.0]})
    out = postings._traverse(2, 1.0, 0.0)(None, lists, asked).to_pydict()
    assert out["id"] == [0, 1] and sum(scored[1:]) <= 2 * 100 + 5


@pytest.mark.parametrize("size", [0, 1, 4, 30])
def test_bad_examples_fill_up_without_repeats(spark, size):
    x = np.random.default_rng(6).normal(size=(40, 4))
    queries = rows_of(spark, x, key="q", name="v")
    found: dict = {}
    for r in retrieval.bad_examples(queries, rows_of(spark, x[:size], name="v"), 3, 2).collect():
        found.setdefault(r.q, []).append((r.kind, r["rank"], r.id))
    for q in range(40):
        others = [i for i in range(size) if i != q]
        mine = sorted(found.get(q, []), reverse=True)
        assert q not in [i for *_, i in mine] and len({i for *_, i in mine}) == len(mine) == min(5, len(others))
        near = sorted(others, key=lambda i: (-round(float(unit(x)[q] @ unit(x)[i]), 9), i))[:3]
        assert [i for kind, _, i in sorted(mine, key=lambda m: m[1]) if kind == "similar"] == near
    if size == 30:
        assert len({tuple(i for kind, _, i in sorted(v) if kind == "random") for v in found.values()}) > 10  # not the same for all


def test_nested_unit_vectors_are_taken_once(spark):
    """A norm inside the lambda over components would make a unit vector of a unit vector cost the fourth power of its length."""
    assert str(normalize(normalize(F.col("vec")))).count("vec") == 1
    x = np.random.default_rng(3).normal(size=(20, 64))
    rows = rows_of(spark, x).union(spark.createDataFrame([(90, None), (91, [0.0, 0.0])], "id long, vec array<double>"))
    got = {r.id: r.v for r in rows.select("id", normalize(normalize(F.col("vec"))).alias("v")).collect()}
    assert np.allclose([got[i] for i in range(20)], unit(x)) and got[90] is None and got[91] == [0.0, 0.0]


def test_joining_links_are_fewer_than_pairs_and_rows_go_to_few_blocks(spark, monkeypatch):
    """Links grow with the rows, and so does what is sent, where pairs grow with their square."""
    monkeypatch.setattr(clustering, "BRUTE_FORCE", 20)
    x = np.random.default_rng(5).normal(size=(900, 6))
    rows = rows_of(spark, x)
    sent = clustering._block_pairs(rows, "id", 0.4)
    assert sent.groupBy("id").count().agg(F.max("count")).first()[0] <= 2 * (clustering.LAYOUT + clustering.PIVOTS)
    s = np.round(unit(x) @ unit(x).T, 9)
    levels = [0.4, 0.9, 0.97]
    links = clustering.joining_links(rows, "id", levels).collect()
    assert len(links) < 3 * sent.count() and np.triu(s >= 0.4, 1).sum() > 100 * 900 / 2
    for formed, t in zip(clustering.form_clusters_at(rows, "id", levels), levels, strict=True):
        least = np.arange(900)
        while (new := np.where(s >= t, least[None, :], 900).min(axis=1).clip(max=least)).tolist() != least.tolist():
            least = new
        got = {r.id: r.cluster_id for r in formed.collect()}
        assert [got[i] for i in range(900)] == least.tolist()


@pytest.mark.parametrize("sample", [60, 2_048])
def test_rows_of_large_components_are_not_compared(spark, monkeypatch, sample):
    """Two large components, a row that joins them at the lower level only, strays, copies, a zero vector and shorter vectors."""
    monkeypatch.setattr(clustering, "BRUTE_FORCE", 20)
    monkeypatch.setattr(clustering, "SAMPLE", sample)
    rng = np.random.default_rng(6)
    a, b = np.eye(16)[0], np.eye(16)[1]
    x = [c + rng.normal(0, 0.2, 16) for c in (a, b) for _ in range(400)] + [(a + b) + rng.normal(0, 0.05, 16)] + list(rng.normal(size=(40, 16)))
    x += [x[3]] * 30 + [np.zeros(16)] + [np.array(v) for v in ((1.0, 0.0), (1.0, 0.1), (-1.0, 0.5))]
    ids = [f"k{7 * i % 1009:04d}" for i in range(len(x))]  # in another order than the rows
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + [("n", None)], "id string, vec array<double>")
    v = np.array([np.pad(c / (np.linalg.norm(c) or 1.0), (0, 16 - len(c))) for c in x])
    same = np.equal.outer([len(c) for c in x], [len(c) for c in x])
    order = np.argsort(np.argsort(ids))
    for levels in ([0.6], [0.72, 0.6]):
        for formed, t in zip(clustering.form_clusters_at(rows, "id", levels), levels, strict=True):
            near, least = (np.round(v @ v.T, 9) >= t) & same | np.eye(len(x), dtype=bool), order
            while (new := np.where(near, least[None, :], len(x)).min(axis=1)).tolist() != least.tolist():
                least = new
            got = {r.id: r.cluster_id for r in formed.collect()}
            assert [got[i] for i in ids] == [sorted(ids)[k] for k in least] and got["n"] == "n"
    blocks, pairs = clustering.blocks_within_reach(rows.filter("vec is not null").select("id", normalize(F.col("vec")).alias("v")), 0.6, 0.6)
    size, part = ({r[0]: r[1] for r in blocks.groupBy("block").agg(f).collect()} for f in (F.count("*"), F.min("part")))
    compared = [(p, q) for p, q in pairs.select("p", "q").collect()]
    assert sum(n for k, n in size.items() if part[k] >= 0) > 700 and not any(part[p] == part[q] >= 0 for p, q in compared)


def test_blocks_of_a_search_do_not_multiply_with_its_rows():
    """Each query goes to every block of the corpus, so what is sent grows with the rows only if the blocks do not."""
    few, many = clustering.grid(20_000, 20_000, 64), clustering.grid(130_000, 130_000, 64)
    assert sum(many) <= 2 * clustering.LAYOUT + clustering.LAYOUT // 4 and sum(few) <= sum(many)
    assert clustering.grid(10**6, 10**6, 64)[1] * clustering.BLOCK_BYTES >= 10**6 * 64 * 8  # bounded blocks


@pytest.mark.parametrize("n", [1, 5, 6, 300, 2_000])
def test_best_rows_of_a_block_equal_a_full_sort(n):
    rng = np.random.default_rng(n)
    c, q = unit(rng.normal(size=(n, 4)).round(1) + 0.01), unit(rng.normal(size=(600, 4)).round(1) + 0.01)  # many ties
    ids, own = np.arange(n) * 3, rng.integers(0, 3 * n, 600)
    s = np.where(ids[None, :] == own[:, None], -np.inf, np.round(q @ c.T, 9))
    order = np.argsort(-s, axis=1, kind="stable")[:, :5]
    want = [(i, int(j)) for i in range(600) for j in order[i] if s[i, j] > -np.inf]
    i, j, _ = clustering._best(q, c, ids, own, 5)
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_topic_search_fills_up_from_other_topics(spark):
    """Topics with fewer posts than asked for, rows without a topic, and many rows of one post."""
    rng = np.random.default_rng(6)
    x, k = rng.normal(size=(400, 8)), 6
    topic = [None if i % 50 == 7 else 0 if i % 80 == 0 else 1 for i in range(400)]
    post = [1 if i % 4 else i for i in range(400)]
    corpus = spark.createDataFrame([(i, v.tolist(), t, p) for i, (v, t, p) in enumerate(zip(x, topic, post, strict=True))], "id long, v array<double>, topic int, post long")
    s = np.round(unit(x) @ unit(x).T, 9)
    got = {(r.q, r.rank): r.id for r in retrieval.topic_search(corpus.withColumnRenamed("id", "q"), corpus, k).collect()}
    want = {}
    for q in range(400):
        seen: list = []
        for i in sorted((i for i in range(400) if i != q), key=lambda i: (topic[q] is None or topic[i] != topic[q], -s[q, i], i)):
            if len(seen) < k and post[i] not in [post[o] for o in seen]:
                seen.append(i)
        want |= {(q, r): i for r, i in enumerate(seen, 1)}
    assert got == want


def test_hybrid_candidates_search_twice(spark, monkeypatch):
    """The weights of the second search are a table, so the first search is not run again for each reader of them."""
    seen = []
    search = postings.search
    monkeypatch.setattr(postings, "search", lambda index, weights, *more: seen.append(weights) or search(index, weights, *more))
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"])], "id long, words array<string>")
    retrieval.hybrid_candidates(spark.createDataFrame([(7, ["b", "a"])], "q long, words array<string>"), docs).collect()
    assert len(seen) == 2 and "FlatMapCoGroupsInArrow" not in seen[1]._jdf.queryExecution().toString()
