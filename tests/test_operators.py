"""Hand tables for edge branches that the given tables do not reach."""

import math

import pytest
from pyspark.sql import functions as F

from claimscope.functions import text as T
from claimscope.operators import anomaly, clustering, evaluate, features, ingest, keyed, quality, retrieval, sampling, timeseries
from claimscope.operators.graph import connected_components
from claimscope.sources import files


def series(spark, rows):
    return spark.createDataFrame(rows, "cluster_id long, t string, engagement long, is_anomaly_trigger boolean").withColumn("timestamp", F.to_timestamp_ntz("t"))


def test_psr_edges(spark):
    s = series(
        spark,
        [
            (1, "2024-01-01 00:00:00", 0, True),  # one row without engagement
            (2, "2024-01-01 00:00:00", 5, False),
            (2, "2024-01-01 01:00:00", 5, True),  # after the first of two equal peaks
            (3, "2024-01-01 00:00:00", 2, True),
            (3, "2024-01-01 01:00:00", 6, False),
        ],
    )
    got = {r.cluster_id: r.psr for r in timeseries.psr(s, timeseries.detections(s)).collect()}
    assert got == {1: 1.0, 3: 0.75}


def test_gini_and_entropy_bounds(spark):
    rows = spark.createDataFrame([(1, 0), (1, 0), (2, 5), (3, 1), (3, 1), (3, 100)], "k long, v long")
    g = {r.k: r.g for r in features.gini(rows, "k", "v", "g").collect()}
    assert g[1] == 0 and g[2] == 0 and 0 < g[3] < 1
    e = {r.k: r.e for r in features.entropy(rows, "k", "v", "e").collect()}
    assert abs(e[2]) < 1e-9 and e[3] == pytest.approx(-(2 / 3) * math.log(2 / 3) - (1 / 3) * math.log(1 / 3), abs=1e-6)


def test_connected_components_of_chain_star_and_loop(spark):
    chain = [(i, i + 1) for i in range(10, 30)]
    star = [(100, i) for i in range(101, 130)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert all(got[i] == 10 for i in range(10, 31)) and all(got[i] == 100 for i in range(100, 130)) and got[7] == 7 and 3 not in got


def test_sweep_identity_ties_and_single_class(spark):
    rows = spark.createDataFrame([("m", i, 1, 0.5) for i in range(4)] + [("n", i, i % 2, 0.1 + 0.2 * i) for i in range(4)], "model string, sample_id long, label int, prob double")
    m = evaluate.sweep(rows, ["model"], evaluate.thresholds(), beta=2.0).collect()
    assert all(r.tp + r.fp + r.fn + r.tn == 4 for r in m) and all(r.f_beta == 0 for r in m if r.model == "m")
    frame = evaluate.sweep(rows, ["model"], evaluate.thresholds())
    low, high = ({r.model: r.threshold for r in evaluate.best_threshold(frame, ["model"], t).collect()} for t in ("lowest", "highest"))
    assert low["m"] == 0.3 and high["m"] == 0.5
    assert 0.6 in evaluate.thresholds()


def test_spearman_of_constant_is_zero(spark):
    rows = spark.createDataFrame([("g", float(i), 1.0) for i in range(5)], "g string, x double, y double")
    assert evaluate.spearman(rows, ["g"], "x", "y").first().rho == 0.0


@pytest.mark.parametrize(
    ("raw", "claim"),
    [
        ('  "Claim: The sky is blue"  ', "The sky is blue."),
        ("Here is the normalized claim: 'x'", "x."),
        ("The claim is that it rains\nmore", "it rains."),
        ("**bold**", "bold."),
        ("half of it...", "half of it."),
        ("Really?", "Really?"),
        ("   ", ""),
        ('"', '".'),
    ],
)
def test_normalize_claim(spark, raw, claim):
    assert spark.createDataFrame([(raw,)], "t string").select(T.normalize_claim(F.col("t")).alias("c")).first().c == claim


def test_entities_and_jaccard(spark):
    df = spark.createDataFrame([("On January 5, 2021 the White House spent $1,000.50 or 7% more. Later Bob met NASA",), ("",)], "t string")
    e = [r.e for r in df.select(T.extract_entities(F.col("t")).alias("e")).collect()]
    assert {"january 5, 2021", "white house", "$1,000.50", "7%", "bob", "house"} <= set(e[0]) and "nasa" not in e[0] and e[1] == []
    pair = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r.j for r in pair.select(T.jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [0.5, 0.0, pytest.approx(1 / 3)]


def test_claims_to_posts_with_malformed_lists(spark):
    claims = spark.createDataFrame([(1, None, 5), (2, "[]", None), (3, "[5, 6, 5]", None), (4, "oops", 6)], "claim_id long, cluster_ids string, trigger_cluster_id long")
    posts = spark.createDataFrame([(5, 50), (6, 60)], "cluster_id long, id long")
    got = sorted((r.claim_id, r.id) for r in keyed.claims_to_posts(claims, posts).collect())
    assert got == [(1, 50), (3, 50), (3, 60), (4, 60)]


def test_number_rows_and_split_cover_all(spark):
    rows = spark.range(1000).select((F.col("id") * 3 - 500).alias("k"))
    got = sorted((r.k, r.idx) for r in keyed.number_rows(rows, "k").collect())
    assert [i for _, i in got] == list(range(1000))
    s = sampling.split(rows, "k", 0.2, 5, 1).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in s} == {"test": 200, "train": 800}
    assert keyed.number_rows(rows.limit(0), "k").count() == 0


def test_language_and_sentiment_without_words(spark):
    docs = spark.createDataFrame([(1, "123"), (2, None), (3, "the cat and the dog")], "doc_id long, text string")
    assert {r.doc_id: r.tag for r in ingest.language_tag(docs).collect()} == {1: "unknown", 2: "unknown", 3: "en"}
    assert all(r.sentiment == 0 for r in ingest.sentiment(docs).collect())


def test_study_selection_falls_back(spark):
    claims = spark.createDataFrame([(1, 0.9, None, None, None, True, True), (2, 0.5, 10.0, 90.0, None, None, False)], "claim_id long, checkworthiness_prob double, checkability_score double, verifiability_score double, harm_score double, is_viral boolean, is_checkworthy boolean")
    got = {(r.category, r.claim_id) for r in quality.study_selection(claims).collect()}
    assert got == {("positive", 1), ("negative", 2), ("borderline", 2)}


def test_nab_score_formula(spark):
    """Score of published figures: 820 clusters, 803 found with 22 h 55 min on average would give the same relation."""
    rows = spark.createDataFrame([(24.0, True, 1, 3), (12.0, False, 2, 2), (None, True, 0, 1), (None, False, 0, 0)], "lead_h double, is_fp boolean, n_tp long, n_detections long")
    r = anomaly.nab_figures(rows).first()
    assert r.nab_score == pytest.approx(100 * (36 / 24 - 0.1 * 2) / 4) and r.detection_rate == 50 and r.missed_rate == 50 and r.precision == 50 and r.median_lead == 18


def test_expose_equals_direct_sum(spark):
    xs = [1, 4, 2, 9]
    s = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "cluster_id long, timestamp long, tweet_count long")
    got = [r.expose_score for r in anomaly.expose(s, gamma=0.1, decay=0.2).orderBy("timestamp").collect()]
    want = [1 - sum(0.2 * 0.8 ** (t - i - 1) * math.exp(-0.1 * (xs[t] - xs[i]) ** 2) for i in range(t)) for t in range(4)]
    assert got == pytest.approx(want)


def test_blocked_pairs_equal_all_pairs_for_close_vectors(spark, monkeypatch):
    import random

    rng = random.Random(1)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    rows = spark.createDataFrame([(i, [x + rng.gauss(0, 0.02) for x in base[i % 20]]) for i in range(60)], "id long, vec array<double>")
    all_pairs = sorted((r.a, r.b) for r in clustering.similar_pairs(rows, "id", 0.95).collect())
    monkeypatch.setattr(clustering, "BRUTE_FORCE", 10)
    assert sorted((r.a, r.b) for r in clustering.similar_pairs(rows, "id", 0.95).collect()) == all_pairs and len(all_pairs) == 60


def test_assignment_without_vectors_or_centroids(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id long, vec array<double>")
    cents = spark.createDataFrame([(7, [1.0, 0.1])], "cluster_id long, centroid array<double>")
    assert {r.id: r.cluster_id for r in clustering.assign(rows, "id", cents, 0.9).collect()} == {1: 7, 2: -1}
    assert {r.cluster_id for r in clustering.assign(rows, "id", cents.limit(0), 0.9).collect()} == {-1}


def test_pair_scores(spark):
    rows = spark.createDataFrame([("a b c d".split(), "a b c d".split()), ("a b x".split(), "y".split()), ("c d a b".split(), "a b c d".split())], "hyp array<string>, ref array<string>")
    got = retrieval.score_pairs(rows).collect()
    assert [r.chunks for r in got] == [1, 0, 2] and got[0].score == pytest.approx(1 - 0.5 / 64) and got[1].score == 0 and got[2].score == pytest.approx(1 - 0.5 / 8)


def test_csv_tsv_log_and_manifest(spark, tmp_path):
    (tmp_path / "a.csv").write_text('post,normalized claim\n"x, ""q""\ny",c1\nz,\n')
    got = sorted((tuple(r) for r in files.read_posts_csv(spark, str(tmp_path / "a.csv")).collect()), key=str)
    assert got == [('x, "q"\ny', "c1"), ("z", None)]
    (tmp_path / "b.tsv").write_text("post\tid\nz\t1\n")
    assert files.read_posts_csv(spark, str(tmp_path / "b.tsv"), "\t").first().gold_claim is None
    import hashlib

    have = [("a.csv", hashlib.sha256((tmp_path / "a.csv").read_bytes()).hexdigest()), ("b.tsv", "00"), ("c", "11")]
    m = files.check_manifest(spark, str(tmp_path), spark.createDataFrame(have, "name string, digest string"))
    assert {r.name: r.status for r in m.collect()} == {"a.csv": "ok", "b.tsv": "mismatch", "c": "missing"}


def test_entry_and_queries_import():
    import __spark_entry__ as e

    assert "a05_psr" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_similar_pairs_near_the_threshold_in_many_blocks(spark, monkeypatch):
    """Links at 0.5 to 0.7 are all found when the rows take several blocks, also by text ids and with unusable rows."""
    import numpy as np

    x = np.random.default_rng(3).normal(size=(300, 6))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    want = {(f"k{i:03}", f"k{j:03}") for i in range(300) for j in range(i + 1, 300) if round(s[i, j], 9) >= 0.5}
    rows = spark.createDataFrame([(f"k{i:03}", v.tolist()) for i, v in enumerate(x)] + [("z1", None), ("z2", [1.0, None, 0.0, 0.0, 0.0, 0.0]), ("z3", [1.0])], "id string, vec array<double>")
    monkeypatch.setattr(clustering, "BRUTE_FORCE", 40)
    got = clustering.similar_pairs(rows, "id", 0.5).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    assert all(abs(r.similarity - s[int(r.a[1:]), int(r.b[1:])]) < 1e-9 for r in got)


def test_span_of_the_corpus_equals_its_sql(spark, tmp_path):
    """Whole seconds are cut, not rounded."""
    import duckdb

    from claimscope.plans.all import QUERIES, SQL

    duckdb.sql(f"COPY (SELECT TIMESTAMP '2024-01-01 00:00:00.7' AS ts UNION ALL SELECT TIMESTAMP '2024-01-02 00:00:00.9') TO '{tmp_path}/events.parquet'")
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
        want = db.sql(SQL["a03_corpus_span"]).fetchall()
    assert [tuple(r) for r in QUERIES["a03_corpus_span"](spark, str(tmp_path)).collect()] == want == [(2, 1704067200, 1704153600)]


def test_count_cosine_makes_its_words_once(spark):
    from claimscope.functions.text import count_cosine

    words = F.split(F.col("text"), " ")
    assert str(count_cosine(words, F.split(F.col("title"), " "))).count("text") == 1
    rows = spark.createDataFrame([("a b a", "a c"), ("x", "y"), (None, "a"), ("a b", "b a")], "text string, title string")
    got = [r[0] for r in rows.select(F.round(count_cosine(words, F.split(F.col("title"), " ")), 6)).collect()]
    assert got == [round(2 / (5**0.5 * 2**0.5), 6), 0.0, 0.0, 1.0]


def test_top_posts_are_judged_by_whole_texts(spark, tmp_path):
    """Posts and title begin with the same 350 characters and differ after them."""
    import duckdb

    from claimscope.plans.all import QUERIES, SQL

    tails = {0: "flood closes old bridge", 25: "", 50: "match ends in draw", 75: "bridge", 100: "flood closes old bridge", 125: "flood closes road", 150: None}
    rows = [(i, None if t is None else "word " * 70 + (t + " ") * 20) for i, t in tails.items()] + [(1, " "), (26, "Alone")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = sorted(db.sql(SQL["w10_top_posts"]).fetchall())
    text = dict(rows)
    assert sorted(tuple(r) for r in QUERIES["w10_top_posts"](spark, str(tmp_path)).collect()) == want == [(0, "\n\n".join(text[i] for i in (0, 100, 125, 75))), (1, "Alone\n\n ")]


def test_count_cosine_of_long_texts(spark):
    """30,000 different words a side; a pass over the words for each of them would take hours."""
    from claimscope.functions.text import count_cosine

    n = 30_000
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(2 * n - 1)), lambda i: F.concat(F.lit("w"), i % n)).alias("a"), F.transform(F.sequence(F.lit(n // 2), F.lit(n // 2 + n - 1)), lambda i: F.concat(F.lit("w"), i)).alias("b"))
    assert rows.select(F.round(count_cosine(F.col("a"), F.col("b")), 9)).first()[0] == 0.5
    few = spark.createDataFrame([(["x", None, "ab", "a", "x"], [None, "x", "b"]), ([None], [None]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in few.select(F.round(count_cosine(F.col("a"), F.col("b")), 6)).collect()] == [round(2 / (6**0.5 * 2**0.5), 6), 0.0, 0.0]
