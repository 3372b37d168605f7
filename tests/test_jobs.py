"""Models, detectors, files, prompts and stateful sinks by values and invariants."""

import gzip
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimscope.functions import digest
from claimscope.functions import text as T
from claimscope.operators import anomaly, features, ingest, models, quality
from claimscope.operators.evaluate import ensembles
from claimscope.session import cut
from claimscope.sources import files
from claimscope.streaming import jobs


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("May 2020", ["2020"]),
        ("In March 2021", ["2021", "in march", "march"]),
        ("10-12-20201", ["10", "12", "20201"]),
        ("Visit New YorkCity", ["new", "visit new", "yorkcity"]),
        ("on March 5, 2021x and the White Houses", ["2021", "5", "houses", "march", "march 5", "white", "white houses"]),
    ],
)
def test_entities_end_at_word_boundaries(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(T.extract_entities(F.col("t")).alias("e")).first().e
    assert got == sorted(want)


def test_ties_by_name(spark):
    rows = spark.createDataFrame([("ab", 1, 1, 0.9), ("aa", 1, 1, 0.1), ("b", 1, 1, 0.5)], "model string, sample_id long, label int, prob double")
    w = spark.createDataFrame([("ab", 1.0), ("aa", 1.0), ("b", 1.0)], "model string, w double")
    assert ensembles(rows, w, [2.0]).filter("method = 'max_confidence'").first().prob == 0.1
    docs = spark.createDataFrame([(1, "uno dos")], "doc_id long, text string")
    assert ingest.language_tag(docs, {"ita": ["uno"], "itb": ["dos"], "esp": ["dos"]}).first().tag == "esp"


def test_gini_equals_the_formula(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(5)) for k in range(4) for _ in range(rng.randrange(1, 50))]
    got = {r.k: r.g for r in features.gini(spark.createDataFrame(rows, "k long, v long"), "k", "v", "g").collect()}
    for k in range(4):
        x = sorted(v for j, v in rows if j == k)
        n, s = len(x), sum(x)
        assert got[k] == pytest.approx((2 * sum(i * v for i, v in enumerate(x, 1)) - (n + 1) * s) / (n * s) if s else 0)


@pytest.mark.parametrize("decay", [0.005, 0.05, 0.5, 1.0])
def test_kernel_scores_of_a_long_history(decay):
    rng = np.random.default_rng(2)
    for x in (rng.poisson(3, 2000).astype(float), rng.normal(size=700)):
        got = anomaly._kernel_scores(x, decay, [0.25, 1.0])
        lag = np.arange(len(x))[:, None] - np.arange(len(x))[None, :]
        weight = np.where(lag > 0, decay * (1 - decay) ** (np.maximum(lag, 1) - 1.0), 0)
        for j, g in enumerate((0.25, 1.0)):
            assert np.allclose(got[j], 1 - (weight * np.exp(-g * (x[:, None] - x[None, :]) ** 2)).sum(axis=1), rtol=0, atol=1e-12)


def test_fourier_scores_lie_near_the_kernel(spark):
    rng = np.random.default_rng(7)
    x = rng.poisson(3, 1500).astype(float)
    x[900:905] = 60
    exact = anomaly._kernel_scores(x, 0.05, [0.1])[0]
    for components in (2_000, 20_000):
        off = np.abs(anomaly._fourier_scores(x, 0.05, 0.1, components, 42) - exact)
        assert off.max() <= 4 / math.sqrt(components) and off.mean() <= 1 / math.sqrt(components)
    rows = spark.createDataFrame([(c, i, int(v), "other") for c in (1, 2) for i, v in enumerate(x[: 300 * c])], "cluster_id long, timestamp long, tweet_count long, note string").repartition(3)
    both = anomaly.expose(rows, decay=0.05).join(anomaly.expose_fourier(rows, decay=0.05).select("cluster_id", "timestamp", F.col("expose_score").alias("near")), ["cluster_id", "timestamp"])
    assert both.count() == 900 and both.filter("abs(expose_score - near) > 0.03").count() == 0 and "note" in both.columns


def test_loda_scores_outliers_highest(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(300)] + [(999, 9.0, -9.0, 9.0)]
    s = {r.id: r.loda_score for r in anomaly.loda(spark.createDataFrame(rows, "id long, a double, b double, c double"), "id", ["a", "b", "c"]).collect()}
    assert max(s, key=s.get) == 999 and all(0 <= v <= math.log(301) + 1e-9 for v in s.values())


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2))
    rows = [(i, float(a), float(b), float(3 * a - 2 * b + rng.normal(0, 0.1)), int(a + b > 0), i % 3) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, b double, y double, label int, fold int").cache()


@pytest.mark.parametrize("kind", sorted(models.REGRESSORS))
def test_regressors_learn_a_line(linear, kind):
    out = models.regress(linear.filter("id < 150"), linear.filter("id >= 150"), ["a", "b"], "y", "id", kind)
    assert out.count() == 50 and out.stat.corr("y", "prediction") > 0.85


def test_ridge_equals_the_normal_equations(linear):
    rows = linear.orderBy("id").collect()
    x, y = np.array([(r.a, r.b) for r in rows]), np.array([r.y for r in rows])
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
    want = xc @ w + y.mean()
    got = [r.prediction for r in models.regress(linear, linear, ["a", "b"], "y", "id", "ridge").orderBy("id").collect()]
    assert np.allclose(got, want, atol=1e-3)


@pytest.mark.parametrize("kind", ["logistic", "boosted"])
def test_classifiers_rank_the_classes(linear, kind):
    out = models.classify(linear.filter("id < 150"), linear.filter("id >= 150"), ["a", "b"], "label", "id", kind, positive=3.0 if kind == "boosted" else None)
    mean = {r.label: r.p for r in out.groupBy("label").agg(F.avg("prob").alias("p")).collect()}
    assert out.count() == 50 and mean[1] > mean[0] + 0.5
    assert models.classify(linear.filter("label = 1"), linear, ["a", "b"], "label", "id", kind).count() == 0


def test_principal_components_equal_the_decomposition(spark):
    x = np.random.default_rng(5).normal(size=(80, 4)) @ np.diag([5, 2, 1, 0.1])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = np.array([r.pca for r in models.principal_components(rows, "v", 3).orderBy("id").collect()])
    _, _, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(x @ vt[:3].T), atol=1e-6)


def test_grid_search_names_the_best(linear):
    rows = models.grid_search(linear, ["a", "b"], "y", "fold", [0.01, 50.0], [0.0, 1.0], folds=3).collect()
    assert len(rows) == 4 and sum(r.is_best for r in rows) == 1
    best = next(r for r in rows if r.is_best)
    assert best.mean_rho == max(r.mean_rho for r in rows) > 0.9


def test_stacking_and_voting(linear):
    train, test = linear.filter("id < 150"), linear.filter("id >= 150")
    stacked = models.stack(train, test, ["a", "b"], "y", "id", "fold", ["ridge", "forest"])
    assert stacked.count() == 50 and stacked.stat.corr("y", "prediction") > 0.95
    parts = [models.regress(train, test, ["a", "b"], "y", "id", k) for k in ("ridge", "forest")]
    each = {r.id: [r.prediction] for r in parts[0].collect()}
    for r in parts[1].collect():
        each[r.id].append(r.prediction)
    voted = {r.id: r.prediction for r in models.vote(parts, "id", "y").collect()}
    assert voted.keys() == each.keys() and all(voted[i] == pytest.approx(sum(v) / 2) for i, v in each.items())


def test_csv_hazards_survive(spark, tmp_path):
    hard = [(1, 'say "x", twice'), (2, "line\nbreak"), (3, "carriage\rreturn\r\nboth"), (4, "  edges\t "), (5, ""), (6, None), (7, '"'), (8, "a\\b\\"), (9, ",,;"), (10, "é漢\U0001f600")]
    df = spark.createDataFrame(hard, "idx long, post string").withColumn("normalized claim", F.lit(None).cast("string"))
    for sep, name in ((",", "c"), ("\t", "t")):
        files.write_posts_csv(df, f"{tmp_path}/{name}", sep)
        got = files.read_posts_csv(spark, f"{tmp_path}/{name}", sep, line_sep="\n")
        assert sorted(((int(r.idx), r.post) for r in got.collect()), key=str) == sorted(hard, key=str) and got.filter("gold_claim is not null").isEmpty()


def test_file_profile_and_manifest(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    p = files.file_profile(spark, f"{tmp_path}/t", ["id", "lang"]).filter("name like '%.parquet'").first()
    assert p.length > 0 and p.n_columns == 2 and p.has_language
    listed = files.manifest(spark, str(tmp_path)).cache()
    assert {r.status for r in files.check_manifest(spark, str(tmp_path), listed).filter("name like '%.parquet'").collect()} == {"ok"}


@pytest.fixture
def small_blocks(spark, monkeypatch):
    monkeypatch.setattr(files, "WHOLE", 0, raising=False)
    monkeypatch.setattr(files, "CHUNK", 1 << 20, raising=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 18)
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 10)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_manifest_of_files_in_blocks(spark, tmp_path, small_blocks):
    rng = random.Random(2)
    mark = b"\xef\xbb\xbf"
    have = {
        "random": rng.randbytes(3_000_000), "long lines": b"\n".join(rng.randbytes(700_000).replace(b"\n", b"x") for _ in range(6)), "one line": bytes(2_500_000), "breaks": b"\n" * 600_000, "returns": b"a\r\n\r\rb" * 100_000,
        "mark": mark + b"a,b\n1,2\n", "mark, no break": mark + rng.randbytes(900_000) + b"x", "marks": mark * 3 + b"\n" + mark, "only mark": mark, "mark and break": mark + b"\n", "break": b"\n", "one": b"x", "half mark": mark[:2],
        "sub folder/a%20b é=1.csv": b"x\n" * 200_000, "sub folder/text.gz": gzip.compress(b"text " * 1000), "no.gz": b"plain\n" * 50_000, "sub folder/same": b"\n\nx" * 1000, "same": b"\n\nx" * 1000,
    }
    for name, data in have.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = [tuple(r) for r in files.manifest(spark, str(tmp_path), "*").collect()]
    assert sorted(got) == sorted((name, hashlib.sha256(data).hexdigest()) for name, data in have.items())


def test_no_task_reads_a_whole_large_file(spark, tmp_path, small_blocks, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/large").write_bytes(random.Random(3).randbytes(6 << 20))
    rounds = []
    monkeypatch.setattr(files, "cut", lambda df, *by, **kw: rounds.append(df.columns) or cut(df, *by, **kw), raising=False)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 5 << 20)
    try:
        with pytest.raises(Exception, match="maxLength|exceeds"):
            spark.read.format("binaryFile").load(str(tmp_path / "in")).select("content").collect()  # what reads a whole file fails
        assert files.manifest(spark, str(tmp_path / "in"), "*").first().digest == hashlib.sha256((tmp_path / "in/large").read_bytes()).hexdigest()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert rounds.count(["path", "state"]) == 6  # of a chunk each


@pytest.mark.parametrize("library", [True, False])
def test_sha256_goes_on_from_its_state(monkeypatch, library):
    if not library:
        monkeypatch.setattr(digest, "_library", lambda: None)
    rng = random.Random(1)
    for size in (0, 1, 55, 56, 63, 64, 65, 119, 120, 128, 1000):
        data, at, state = rng.randbytes(size), 0, None
        while True:
            h, step = digest.Sha256(state), rng.choice([0, 1, 5, 63, 64, 65, 200])
            h.update(data[at : at + step])
            at, state = at + step, h.state()
            if at >= size:
                break
        assert digest.Sha256(state).hexdigest() == h.hexdigest() == hashlib.sha256(data).hexdigest()


def test_conformance_counts_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "id long, t string")
    got = {r["column"]: (r.status, r.n_rows, r.n_null) for r in quality.conformance(df, {"id": "bigint", "t": "int", "no": "int"}, 1).collect()}
    assert got == {"id": ("ok", 2, 0), "t": ("wrong type", 2, 1), "no": ("missing", None, None), "feat_*": ("wrong number", None, None)}


def test_values_at_any_number_of_digits(spark):
    a = spark.createDataFrame([("a", 1.2344), ("b", 2.5), ("c", 1.0)], "name string, actual double")
    e = spark.createDataFrame([("a", 1.2341, None, 3), ("b", 2.0, None, 0), ("c", 1.05, 0.1, None), ("d", 1.0, None, None)], "name string, value double, tol double, digits int")
    assert {r.name: r.status for r in quality.value_checks(a, e).collect()} == {"a": "OK", "b": "OK", "c": "OK", "d": "MISSING"}


def test_three_forms_of_a_prompt(spark):
    q = spark.createDataFrame([(1, "p1", ["figures", "several"]), (2, "p2", None)], "idx long, post string, groups array<string>")
    good = spark.createDataFrame([(1, 2, "g2", "c2"), (1, 1, "g1", "c1")], "idx long, rank int, post string, claim string")
    bad = spark.createDataFrame([(1, 1, "b1", "w1", "r1")], "idx long, rank int, post string, wrong string, claim string")
    plain, few, both = ({r.idx: r for r in ingest.prompts(q, g, b, "Do.", style=s).collect()} for g, b, s in ((None, None, None), (good, None, "short"), (good, bad, "tagged")))
    assert plain[1].system == "Do." and plain[1].user == "Post: p1"
    assert few[1].user == "Example 1\nPost: g1\nClaim: c1\n\nExample 2\nPost: g2\nClaim: c2\n\nPost: p1" and few[2].user == "Post: p2"
    assert "Mistake 1\nPost: b1\nWrong: w1\nRight: r1" in both[1].user and both[1].user.endswith("Post: p1")
    assert few[1].system == f"Do. {ingest.GROUP_HINTS['several']}" and both[2].system == f"<task>Do.</task>\n<hint>{ingest.GROUP_HINTS['other']}</hint>"


def _vectors(spark, tmp_path, batches, key, more=""):
    for part in batches:
        spark.createDataFrame(part, f"{key} long{more}, vec array<double>").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return jobs.replay(spark, f"{tmp_path}/in", f"{key} long{more}, vec array<double>", 1)


def _last(spark, path, n):
    return spark.read.parquet(f"{path}/version={n}").collect()


def test_clusters_over_batches_and_over_the_cap(spark, tmp_path):
    first = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None)]
    second = [(5, [1.0, 0.02, 0.0]), (6, [0.0, 0.1, 1.0]), (7, [0.0, 0.1, 1.01])]
    stream = _vectors(spark, tmp_path, [first, second], "vec_id")
    jobs.cluster_batches(stream, f"{tmp_path}/s", f"{tmp_path}/c", 0.9, most=2).awaitTermination()
    got = {r.cluster_id: (r.size, tuple(r.representatives)) for r in _last(spark, f"{tmp_path}/s", 1)}
    assert got == {1: (3, ("1", "2", "5")), 3: (3, ("3",))}  # 6 and 7 find no room and go to the nearest
    jobs.cluster_batches(stream, f"{tmp_path}/s2", f"{tmp_path}/c2", 0.9).awaitTermination()
    free = {r.cluster_id: r.size for r in _last(spark, f"{tmp_path}/s2", 1)}
    assert free == {1: 3, 3: 1, 6: 2}


def test_registry_over_batches(spark, tmp_path):
    first = [(1, 10, [1.0, 0.0]), (2, 11, [1.0, 0.01]), (3, 12, [0.0, 1.0])]
    second = [(4, 13, [1.0, 0.02]), (5, 12, [0.01, 1.0]), (6, 14, [-1.0, 0.0])]
    stream = _vectors(spark, tmp_path, [first, second], "claim_id", ", cluster_id long")
    jobs.register_claims(stream, f"{tmp_path}/s", f"{tmp_path}/c", 0.9).awaitTermination()
    got = {r.registry_id: (r.n_claims, r.clusters) for r in _last(spark, f"{tmp_path}/s", 1)}
    assert got == {1: (3, [10, 11, 13]), 3: (2, [12]), 6: (1, [14])}


def test_heartbeat_closes_the_last_hours(spark, tmp_path):
    from datetime import datetime, timedelta

    rows = [(i, i % 5, datetime(2024, 1, 1) + timedelta(minutes=17 * i), i % 3, 1, 1) for i in range(60)]
    posts = spark.createDataFrame(rows, "id long, user_id long, created_at timestamp, cluster_id long, like_count long, retweet_count long")
    posts.coalesce(1).write.parquet(f"{tmp_path}/in")
    jobs.heartbeat(posts).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.hourly(jobs.replay(spark, f"{tmp_path}/in", posts.schema, 5))
    q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out")
    q.awaitTermination()
    got = {(r.cluster_id, r.timestamp): r.tweet_count for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()}
    want = {}
    for r in rows:
        k = (r[3], r[2].replace(minute=0))
        want[k] = want.get(k, 0) + 1
    assert got == want


def test_counters_become_rows(spark, tmp_path):
    spark.range(10).withColumn("like_count", F.col("id")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = jobs.with_counters(jobs.replay(spark, f"{tmp_path}/in", "id long, like_count long", 1), "stages", "like_count >= 3")
    q = stream.writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).format("noop").start()
    q.awaitTermination()
    table = spark.createDataFrame(jobs.counter_rows(q), jobs.COUNTERS)
    assert {(r.counter, r.v) for r in table.groupBy("counter").agg(F.sum("value").alias("v")).collect()} == {("processed", 10), ("passed", 7)}
