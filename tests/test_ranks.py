"""Average ranks against a sort of each whole group."""

import random

import pytest
from pyspark.sql import functions as F

from claimscope.operators import evaluate, ranks


def plain(values: list) -> list[float]:
    """Average rank of each value; None first, NaN last and equal to itself."""
    key = lambda v: (0, 0.0) if v is None else (2, 0.0) if v != v else (1, v)
    ordered = sorted(map(key, values))
    return [(2 * ordered.index(key(v)) + ordered.count(key(v)) + 1) / 2 for v in values]


def rows_with_ties(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    value = lambda: rng.choice([0.5, 0.5, 0.5, None, float("nan"), float("inf"), -float("inf"), rng.randrange(30) / 7, rng.gauss(0, 3)])
    groups = ["a"] * 300 + ["b"] * 40 + [None] * 30 + ["one"]
    return [(i, g, value(), "n", 1.0) for i, g in enumerate(groups)]


@pytest.mark.parametrize("heavy", [1_000, 20, 1])
@pytest.mark.parametrize("size", [7, 1 << 17])
def test_ranks_in_several_ranges(spark, monkeypatch, size, heavy):
    monkeypatch.setattr(ranks, "RANGE_ROWS", size)
    monkeypatch.setattr(ranks, "HEAVY", heavy)
    rows = rows_with_ties(size)
    df = spark.createDataFrame(rows, "id long, g string, x double, _n_note string, rank_before double").repartition(4)
    got = {r.id: (r["rank"], r.of) for r in ranks.average_ranks(df, ["g"], "x", of="of").collect()}
    assert len(got) == len(rows) == ranks.average_ranks(df, ["g"], "x").count()
    for g in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == g]
        assert [got[r[0]] for r in own] == [(k, len(own)) for k in plain([r[2] for r in own])]


def test_ranges_are_bounded_and_no_window_spans_a_group(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE_ROWS", 50)
    df = spark.range(5000).select(F.lit("all").alias("g"), (F.col("id") % 2500).alias("x"))
    counts = df.groupBy(F.col("g").alias("_k0"), F.col("x").alias("_v")).agg(F.count("*").alias("_n"))
    sizes = [r["count"] for r in ranks.ranged(counts, 50).groupBy("_range").count().collect()]
    assert len(sizes) >= 40 and max(sizes) < 200


def test_spearman_with_ties_in_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE_ROWS", 9)
    monkeypatch.setattr(ranks, "HEAVY", 10)
    rng = random.Random(3)
    rows = [(g, rng.randrange(40) / 8, rng.randrange(3)) for g in "pq" for _ in range(150)] + [("flat", 1.0, i % 2) for i in range(5)]
    got = {r.g: (r.rho, r.n) for r in evaluate.spearman(spark.createDataFrame(rows, "g string, x double, y long"), ["g"], "x", "y").collect()}
    for g in "pq":
        x, y = plain([r[1] for r in rows if r[0] == g]), plain([r[2] for r in rows if r[0] == g])
        m = sum(x) / len(x)
        rho = sum((a - m) * (b - m) for a, b in zip(x, y)) / (sum((a - m) ** 2 for a in x) * sum((b - m) ** 2 for b in y)) ** 0.5
        assert got[g] == (pytest.approx(rho), 150)
    assert got["flat"] == (0.0, 5)


def test_empty_table(spark):
    assert ranks.average_ranks(spark.createDataFrame([], "g string, x double"), ["g"], "x").count() == 0
