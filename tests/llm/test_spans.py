"""Repeated 200-byte strings against their plain definition, and the merged transforms against sorted suffixes."""

from __future__ import annotations

import hashlib
import random
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimscope import session
from claimscope.llm import queries, spans
from tests.llm.helpers import documents, edge_texts


def plain(rows: list[tuple]) -> list[tuple]:
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[k : k + 200] for _, t in raw for k in range(len(t) - 199))
    out = []
    for i, t in raw:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for k in range(len(t) - 199):
            if count[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(b for b, g in zip(t, gone.tolist()) if not g)
        out.append((i, len(t), int(gone.sum()), int((np.diff(gone, prepend=False) & gone).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, tmp_path):
    documents(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return sorted((tuple(r) for r in queries.op12_spans(spark, str(tmp_path)).collect()), key=str)


def passages(seed: int, letters: str, n: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    text = lambda size: "".join(rng.choice(letters) for _ in range(size))
    base = text(900)
    rows = []
    for i in range(n):
        parts = [text(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            a = rng.randrange(700)
            parts += [base[a : a + rng.randrange(150, 320)], text(rng.randrange(60))]
        rows.append((i, "".join(parts)))
    return [*rows, (7, rows[3][1]), (7, rows[7][1]), (None, base[100:310]), (None, base[100:310])]


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefghijklmnopqrstuvwxyz  ", "aé漢\U0001f600 "])
def test_equals_plain_definition(spark, tmp_path, letters):
    rows = passages(len(letters), letters)
    expected = plain(rows)
    assert sum(r[2] for r in expected) > 2000
    assert found(spark, rows, tmp_path) == expected


def test_hot_cores_are_cut_into_windows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spans, "HOT", 3)
    rng = random.Random(4)
    text = lambda size: "".join(rng.choice("abcdefgh ") for _ in range(size))
    passage = text(230)
    rows = [(i, text(50) + passage + text(50)) for i in range(60)] + [(100 + i, passage[5:204]) for i in range(5)] + [(200, "xy" * 400)]
    assert found(spark, rows, tmp_path) == plain(rows)


def test_edges(spark, tmp_path):
    rows = [*edge_texts(), (50, "b" * 199), (51, "b" * 199), (52, "c" * 200), (53, "d" * 201), (54, "e" * 200), (55, "e" * 200), (56, "é" * 100), (57, "x" + "é" * 100)]
    assert found(spark, rows, tmp_path) == plain(rows)
    assert spans.remove_repeats(documents(spark, [])).count() == 0


def test_long_texts_come_in_pieces():
    piece, spans.PIECE = spans.PIECE, 300
    try:
        rng = random.Random(3)
        texts = ["".join(rng.choice("ab") for _ in range(1500)), "", None, "a" * 900]
        windows = [[], [], [], []]
        for data, text, base, ends in spans.pieces(texts):
            _, first, count, _, _ = spans.fragments(data, ends)
            for f, n in zip(first.tolist(), count.tolist()):
                piece_of = int(np.searchsorted(ends, f, side="right"))
                start = f - (int(ends[piece_of - 1]) if piece_of else 0) + int(base[piece_of])
                windows[int(text[piece_of])] += range(start, start + n)
        assert [sorted(w) for w in windows] == [list(range(1301)), [], [], list(range(701))]
    finally:
        spans.PIECE = piece


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_merged_transforms_equal_sorted_suffixes(depth):
    rng = random.Random(6)
    strings = [[rng.randrange(1, 3) for _ in range(rng.randrange(1, 30))] + [0] for _ in range(20)]
    size = np.array([len(s) for s in strings])
    begins = np.cumsum(size) - size
    grams, before = spans.ranked_grams(np.array(sum(strings, []), dtype=np.uint16), begins, size)
    shards, offsets = [], []
    for lo in range(0, 20, 7):
        where = slice(begins[lo], begins[min(lo + 7, 20) - 1] + size[min(lo + 7, 20) - 1])
        shards.append(spans.Shard(grams[where], before[where] - begins[lo], depth))
        offsets.append(shards[-1].order + begins[lo])
    place, interval, prefix = spans.merge(shards, depth)
    rotations = [tuple((s * 40)[k : k + depth * spans.GRAM]) for s in strings for k in range(len(s))]
    merged = [rotations[i] for i in np.concatenate(offsets)[place]]
    assert merged == sorted(rotations)
    units = [[r[k : k + spans.GRAM] for k in range(0, len(r), spans.GRAM)] for r in merged]
    common = [next((d for d in range(depth) if a[d] != b[d]), depth) for a, b in zip(units, units[1:])]
    assert prefix[1:].tolist() == common
    assert interval.tolist() == np.cumsum([0, *(c < depth for c in common)]).tolist()


def test_kept_bytes_and_spans(spark):
    same = "".join(random.Random(9).choice("abcdef ") for _ in range(250))
    rows = {r.doc_id: r for r in spans.remove_repeats(documents(spark, [(1, "one " + same), (2, same + " two"), (3, "three")])).collect()}
    assert bytes(rows[1].kept) == b"one " and [tuple(s) for s in rows[1].spans] == [(4, 254)]
    assert bytes(rows[2].kept) == b" two" and bytes(rows[3].kept) == b"three" and rows[3].spans == []


def test_steps_leave_no_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spans, "HOT", 3)  # so that windows are a table, too
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    rng = random.Random(4)
    text = lambda size: "".join(rng.choice("abcdefgh ") for _ in range(size))
    passage = text(230)
    rows = documents(spark, [(i, text(50) + passage + text(50)) for i in range(60)])
    gone = spans.removals(rows.select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("row"), "text"))
    assert len(list(tmp_path.iterdir())) == 1 and gone.count() == 60
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_cut_frees_its_shuffles(spark):
    root = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    before = set(root.rglob("shuffle_*.data"))
    left = lambda: [p for p in root.rglob("shuffle_*.data") if p not in before]
    counts = session.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), free=True)
    end = time.time() + 5
    while left() and time.time() < end:  # files go in the background
        time.sleep(0.1)
    assert not left() and counts.count() == 7
    session.discard(counts)
