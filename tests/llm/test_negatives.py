"""Hard negatives against every pair, and the parts that choose blocks."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimscope.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, slot string, block int, part string, score double"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "p", 0.5) for r in rows], SCHEMA).repartition(3)


def plain(rows, asked, scale=256, k=5):
    """Every row is compared with every anchor."""
    good = [(i, [math.floor(scale * float(np.float32(x))) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v, y in good:
        if asked(i):
            first[i] = min(first.get(i, (y, v)), (y, v))
    out = []
    for a, (label, q) in first.items():
        scored = [(sum(x * z for x, z in zip(q, v)), i, y) for i, v, y in good if i != a]
        near = sorted((-s, i) for s, i, y in scored if y == label)[:k]
        for p, positive in near:
            hard = sorted((-s, i) for s, i, y in scored if y != label and 80 * -p <= 100 * s <= 100 * -p)[:k]
            out += [(a, positive, n + 1, i, -p, -s) for n, (s, i) in enumerate(hard)]
    return sorted(out)


def vectors(seed, n=260, dim=6, labels=4):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.15) for c in rng.choice(centres)], 0 if rng.random() < 0.4 else rng.randrange(labels)) for i in range(n)]
    rows += [(1000 + i, rows[i % 20][1], rng.randrange(labels)) for i in range(40)]  # ties
    rows += [rows[10], rows[10], (20, rows[3][1], 1), (20, rows[4][1], 2)]  # repeated rows, an anchor's id with other vectors
    rows += [(None, rows[0][1], 1), (2000, None, 1), (2010, [0.1, None] * 3, 1), (2020, [0.1, float("nan")] * 3, 1), (2030, [float("inf")] * 6, 1), (2040, rows[0][1], None)]
    return rows + [(2050, [], 0), (2060, [0.3, 0.4], 1), (2070, [0.0] * dim, 2), (2080, [-x for x in rows[1][1]], 9)]


@pytest.mark.parametrize(("block_rows", "group", "chunk", "part"), [(16, 4, 7, 64), (1024, 2048, 512, 1 << 14)])
def test_equals_all_pairs(spark, monkeypatch, block_rows, group, chunk, part):
    for name, value in (("GROUP", group), ("CHUNK", chunk), ("PART_ROWS", part)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(block_rows)
    found = negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0, block_rows=block_rows)
    expected = plain(rows, lambda i: i % 10 == 0)
    assert len(expected) > 100
    assert sorted(tuple(r) for r in found.collect()) == expected


def test_large_numbers_and_more_folders_than_listed(spark, monkeypatch):
    monkeypatch.setattr(negatives, "FOLDERS", 0)
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-(10**6), 10**6)) for _ in range(4)], i % 3) for i in range(60)]
    found = negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0, block_rows=8)
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, lambda i: i % 10 == 0)


def test_query_on_edges_and_an_empty_table(spark, tmp_path):
    rows = vectors(9, n=120)
    table(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    noisy = [(i, v, (y + 1) % 10 if i is not None and y is not None and i % 7 == 0 else y) for i, v, y in rows]
    assert sorted(tuple(r) for r in queries.op13_negatives(spark, str(tmp_path)).collect()) == plain(noisy, lambda i: i % 100 == 0)
    assert negatives.mine(table(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mine(table(spark, rows), F.lit(False)).count() == 0


def test_hilbert_curve_visits_neighbours():
    bits, dims = 2, 3
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    place = negatives.hilbert(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_intervals_hold_every_row_of_a_block():
    rng = np.random.default_rng(4)
    x, q = rng.integers(-500, 500, (5, 40, 8)), rng.integers(-500, 500, (30, 8))
    least, most = negatives.intervals(q, x.min(axis=1), x.max(axis=1))
    scores = np.einsum("qd,brd->qbr", q, x)
    assert (least <= scores.min(axis=2)).all() and (scores.max(axis=2) <= most).all()


def test_blocks_out_of_reach_are_not_read(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [10.0 * (i % 20 == d) + rng.gauss(0, 0.01) for d in range(20)], i % 2) for i in range(2000)]
    usable = table(spark, rows).select("vec_id", F.col("label").cast("long").alias("label"), negatives.quantise(F.col("embedding"), 256).alias("v"))
    blocks = negatives.write_blocks(usable, 20, 50)
    asks = usable.filter("vec_id < 20").select(F.col("vec_id").alias("anchor"), F.lit(0).alias("slot"), "label", F.col("v").alias("q"), F.lit(-negatives.ANY).alias("least"), F.lit(negatives.ANY).alias("most"))
    read = []
    true_cut = negatives.cut

    def seen(df, *by):
        out = true_cut(df, *by)
        if "reached" in out.columns and "block" in out.columns:
            read.append(out.agg(F.sum(F.size("anchor"))).first()[0] or 0)
        return out

    monkeypatch.setattr(negatives, "cut", seen)
    assert negatives.search(blocks, asks, 20, True, 5).count() == 100
    assert sum(read) <= 20 * (negatives.FIRST + 5) < 20 * blocks.count() / 3


def test_chosen_pairs_are_bits_and_each_ask_gets_its_best_rows():
    """Vectors that no bound rules out: what is chosen does not repeat the asks' vectors, so it stays small."""
    rng = np.random.default_rng(8)
    dim, k, n_asks, n_blocks = 64, 5, 700, 40
    x, labels, q = rng.integers(-99, 99, (n_blocks, 16, dim)), rng.integers(0, 3, (n_blocks, 16)), rng.integers(-99, 99, (n_asks, dim))
    anchor, own = rng.permutation(n_asks), rng.integers(0, 3, n_asks)
    lists = lambda a: pa.array(a.tolist(), pa.list_(pa.int64()))
    zones = pa.table({"part": pa.array([7] * n_blocks, pa.int32()), "block": range(n_blocks), "low_label": labels.min(axis=1), "high_label": labels.max(axis=1), "low": lists(x.min(axis=1)), "high": lists(x.max(axis=1))})
    asks = pa.table({"anchor": anchor, "slot": pa.array([0] * n_asks, pa.int32()), "label": own, "q": lists(q), "least": [-negatives.ANY] * n_asks, "most": [negatives.ANY] * n_asks, "reached": [-negatives.ANY] * n_asks})
    key = pa.scalar(0, pa.int32()), pa.scalar(2, pa.int32())
    first, rest = (negatives._choose(False, again, dim)(key, zones, asks) for again in (False, True))
    assert first.nbytes + rest.nbytes < n_asks * n_blocks
    blocks = {"ids": lists(np.arange(n_blocks * 16).reshape(n_blocks, 16)), "labels": lists(labels), "v": lists(x.reshape(n_blocks, -1))}
    got = []
    for chosen in (first, rest):
        assert set(chosen.column("chunk").to_pylist()) == {2} and set(chosen.column("part").to_pylist()) == {7}
        read = chosen
        for name, values in blocks.items():
            read = read.append_column(name, values.take(chosen.column("block")))
        found = negatives._scan(False, k, dim)(key, read.take(list(range(len(read)))[::-1]), asks.take(rng.permutation(n_asks)))
        got += zip(*(found.column(c).to_pylist() for c in ("anchor", "score", "vec_id")), strict=True)
    score, where = np.einsum("qd,rd->qr", q, x.reshape(-1, dim)), labels.ravel()
    for a, i in enumerate(anchor.tolist()):
        want = sorted((-int(score[a, r]), r) for r in range(n_blocks * 16) if where[r] != own[a] and r != i)[:k]
        assert sorted((-s, r) for j, s, r in got if j == i)[:k] == want


def test_pairs_beyond_the_broadcast_bound_are_joined(spark, monkeypatch):
    for name, value in (("PAIRS", 0), ("SLICE", 3), ("CHUNK", 8), ("PART_ROWS", 64)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(2, n=120)
    assert sorted(tuple(r) for r in negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0, block_rows=16).collect()) == plain(rows, lambda i: i % 10 == 0)


def test_asks_are_chosen_for_few_blocks_where_bounds_tell(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [10.0 * (i % 20 == d) + rng.gauss(0, 0.01) for d in range(20)], i % 2) for i in range(2000)]
    usable = table(spark, rows).select("vec_id", F.col("label").cast("long").alias("label"), negatives.quantise(F.col("embedding"), 256).alias("v"))
    blocks = negatives.write_blocks(usable, 20, 50)
    asks = usable.filter("vec_id < 20").select(F.col("vec_id").alias("anchor"), F.lit(0).alias("slot"), "label", F.col("v").alias("q"), F.lit(-negatives.ANY).alias("least"), F.lit(negatives.ANY).alias("most"))
    chosen = []
    true_cut = negatives.cut

    def seen(df, *by):
        out = true_cut(df, *by)
        if "asked" in out.columns:
            chosen.extend(sum(byte.bit_count() for byte in r.asked) for r in out.select("asked").collect())
        return out

    monkeypatch.setattr(negatives, "cut", seen)
    assert negatives.search(blocks, asks, 20, True, 5).count() == 100
    assert 20 <= sum(chosen) <= 20 * (negatives.FIRST + 5) < 20 * blocks.count() / 3
