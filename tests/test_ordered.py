"""Gaps by ranges against each whole group in order."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from claimscope.operators import features, ordered, ranks, sequences

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def posts(seed: int) -> list[tuple]:
    """One cluster has most rows; many share a time; some have none."""
    rng = random.Random(seed)
    rows = [(i, 7, rng.choice([rng.randrange(3), rng.randrange(5000), rng.randrange(10**6)])) for i in range(500)]
    rows += [(1000 + i, i % 5, rng.randrange(9000)) for i in range(23)] + [(2000, 50, 5), (2001, 51, None), (2002, 7, None), (2003, None, 3), (2004, None, 9), (2005, 52, 4), (2006, 52, 4)]
    return [(i, c, None if t is None else START + timedelta(seconds=t, microseconds=17 * t % 1000)) for i, c, t in rows]


@pytest.mark.parametrize("size", [6, 1 << 17])
def test_gaps_in_several_ranges(spark, monkeypatch, size):
    monkeypatch.setattr(ranks, "RANGE_ROWS", size)
    rows = posts(size)
    df = spark.createDataFrame(rows, "id long, cluster_id long, created_at timestamp").repartition(4)
    got = {r.cluster_id: (r.n, r.m, r.s) for r in ordered.gap_statistics(df, "cluster_id", F.col("created_at")).collect()}
    assert set(got) == {c for _, c, _ in rows}
    for c, (n, m, s) in got.items():
        own = [t for _, k, t in rows if k == c]
        at = sorted(t.timestamp() for t in own if t is not None)
        gaps = [b - a for a, b in zip(at, at[1:])]
        assert n == len(own)
        if not gaps:
            assert m is None and s is None
            continue
        mean = sum(gaps) / len(gaps)
        assert m == pytest.approx(mean, abs=1e-6) and s == pytest.approx((sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5, rel=1e-6, abs=1e-6)


def test_one_cluster_with_all_rows(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE_ROWS", 500)
    df = spark.range(6000).select("id", F.lit(1).alias("cluster_id"), F.timestamp_seconds(F.col("id") * F.col("id") % 7919).alias("created_at"))
    r = features.arrival_features(df).first()
    at = sorted(i * i % 7919 for i in range(6000))
    gaps = [b - a for a, b in zip(at, at[1:])]
    mean = sum(gaps) / len(gaps)
    sd = (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5
    assert (r.inter_arrival_mean, r.inter_arrival_std, r.burstiness) == (pytest.approx(mean), pytest.approx(sd), pytest.approx((sd - mean) / (sd + mean)))


def test_offsets_by_hour(spark):
    rows = [r for r in posts(3) if r[2] is not None and r[1] is not None]
    df = spark.createDataFrame(rows, "id long, cluster_id long, created_at timestamp")
    got: dict = {}
    for r in sequences.arrival_offsets(df).orderBy("cluster_id", "hour").collect():
        got.setdefault(r.cluster_id, []).extend(r.offsets)
    figures = {r.cluster_id: r.last_offset for r in sequences.arrival_figures(df, 2).collect()}
    for c in {c for _, c, _ in rows}:
        at = sorted(t.timestamp() for _, k, t in rows if k == c)
        assert got[c] == pytest.approx([t - at[0] for t in at], abs=1e-6)
        assert len(at) < 2 or figures[c] == pytest.approx(at[-1] - at[0], abs=1e-6)
