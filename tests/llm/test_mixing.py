import hashlib
import math
from collections import Counter

import pytest

from claimscope.llm import mixing
from tests.llm.helpers import edge_texts

SCHEMA = "doc_id long, text string, source string, n long"


def table(spark, sources):
    return spark.createDataFrame([(i, f"t{i}", s, 1) for i, s in enumerate(sources)], SCHEMA)


def count(doc_id, rate, seed=17):
    u = int(hashlib.md5(f"{seed}|{doc_id}".encode()).hexdigest()[:12], 16) / 2**48
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_counts_invert_the_distribution(spark):
    sources = ["a"] * 300 + ["b"] * 30 + [None] * 3
    got = Counter(r.doc_id for r in mixing.mix(table(spark, sources)).collect())
    w = {s: math.sqrt(n) for s, n in Counter(sources).items()}
    rate = {s: w[s] / sum(w.values()) * len(sources) / n for s, n in Counter(sources).items()}
    assert got == Counter({i: k for i, s in enumerate(sources) if (k := count(i, rate[s]))})


def test_shares_near_targets_and_missing_sources_go(spark):
    docs = table(spark, ["a"] * 4000 + ["b"] * 400 + ["c"] * 40)
    got = Counter(r.source for r in mixing.mix(docs, {"a": 0.5, "b": 0.5}, total=10_000).collect())
    assert "c" not in got and all(abs(got[s] - 5000) < 250 for s in "ab")


def test_large_rates_keep_their_mean(spark):
    n = mixing.mix(table(spark, ["a"] * 5), {"a": 1.0}, total=10_000).count()
    assert abs(n - 10_000) < 400


def test_salted_join_gives_the_same_rows(spark, monkeypatch):
    docs = table(spark, ["a"] * 50 + ["b"] * 5)
    one = sorted((r.doc_id, r.copy) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted((r.doc_id, r.copy) for r in mixing.mix(docs).collect()) == one


def test_edges(spark):
    docs = spark.createDataFrame([(i, t, None, 1) for i, t in edge_texts()], SCHEMA)
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "copy", "mix_key"]
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs, {}).count() == 0


def test_order_is_a_shuffle_by_key(spark):
    parts = mixing.mix(table(spark, ["a"] * 200)).rdd.glom().collect()
    assert all([r.mix_key for r in p] == sorted(r.mix_key for r in p) for p in parts)


@pytest.mark.parametrize("rate", [0.0, 0.3, 1.0, 7.5])
def test_cdf_ends_at_one(spark, rate):
    from pyspark.sql import functions as F

    cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(rate)).alias("c")).first().c
    assert cdf[0] == pytest.approx(math.exp(-rate)) and cdf[-1] == pytest.approx(1.0) and cdf == sorted(cdf)


def test_large_rates_keep_their_variance(spark):
    """At a mean of 4,000 the standard deviation is 63; a draw of mean 500 on whole repeats has 22."""
    got = Counter(r.doc_id for r in mixing.mix(table(spark, ["a"] * 100), {"a": 1.0}, total=400_000).select("doc_id").collect())
    mean = sum(got.values()) / 100
    assert abs(mean - 4000) < 25 and 45 < math.sqrt(sum((n - mean) ** 2 for n in got.values()) / 99) < 82


def test_columns_with_the_names_of_the_results_are_replaced(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "a", "old", "old", 5) for i in range(50)], "doc_id long, text string, source string, copy string, mix_key string, _mix_n int")
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "text", "source", "copy", "mix_key"] and dict(out.dtypes)["copy"] == "int"
    plain = mixing.mix(docs.select("doc_id", "text", "source"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, plain.collect()))


def test_large_distributions_are_not_broadcast(spark, monkeypatch):
    docs = table(spark, ["a"] * 50 + ["b"] * 5)
    one = sorted((r.doc_id, r.copy) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_NUMBERS", 1)
    assert sorted((r.doc_id, r.copy) for r in mixing.mix(docs).collect()) == one
