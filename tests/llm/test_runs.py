"""Periodic runs against their plain definition."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from claimscope.llm import queries, runs


def plain_lyndon(w: list) -> list[int]:
    """Length of the longest Lyndon word at each position."""
    return [max(j - i for j in range(i + 1, len(w) + 1) if all(w[i:j] < w[k:j] for k in range(i + 1, j))) for i in range(len(w))]


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    """Every period is tried over the whole sequence."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        s = 0
        while s + q < len(w):
            e = s
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            x = w[s : e + q]
            if e > s and len(x) >= max(6, 4 * q) and all(x[r:] != x[:-r] for r in range(1, q)):
                out.append((s, len(x), q))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id: int | None, text: str | None) -> tuple:
    """The query's row by its contract."""
    w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    n = len(w)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def random_words(rng: random.Random) -> list[int]:
    n, k = rng.randint(1, 40), rng.choice([1, 2, 2, 3, 4])
    w = [rng.randrange(k) for _ in range(n)]
    if rng.random() < 0.5:
        w = (w[: rng.randint(1, 6)] * 40)[:n]
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(n)] = rng.randrange(k)
    return w


def test_groups_are_lyndon_words():
    rng = random.Random(5)
    for _ in range(300):
        w = random_words(rng)[:16]
        ranks = np.unique(w, return_inverse=True)[1]
        group, length = runs.lyndon_groups(ranks)
        assert length.tolist() == plain_lyndon(ranks.tolist())
        roots = {(int(g), tuple(ranks[i : i + n])) for i, (g, n) in enumerate(zip(group, length, strict=True))}
        assert len(roots) == len({g for g, _ in roots}) == len({r for _, r in roots})


def test_runs_equal_their_definition():
    rng = random.Random(6)
    for _ in range(600):
        w = random_words(rng)
        assert runs.runs_of(np.array(w)) == plain_runs(w)


def test_stretches_lose_no_run_and_do_not_cross_texts():
    rng = random.Random(7)
    for _ in range(300):
        texts = [random_words(rng) for _ in range(4)]
        words, at = np.array(sum(texts, []), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.cumsum([0, *map(len, texts)])
        found = [[] for _ in texts]
        for t, lo, hi in runs.stretches(words, at):
            found[t] += [(lo - int(at[t]) + s, n, q) for s, n, q in runs.runs_of(words[lo:hi])]
        assert found == [plain_runs(t) for t in texts]


@pytest.fixture(scope="module")
def edge_rows() -> list[tuple]:
    rng = random.Random(8)
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:12] + list(range(3000, 3020))
    rows = [(i, " ".join(f"w{x}" for x in random_words(rng))) for i in ids]
    rows += [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 300)))) for i in ids]  # repeated ids with texts of their own
    rows += [(1, None), (2, ""), (3, " \t\n"), (None, "a b a b a b a b a b"), (None, None), (4, "x " * 5), (5, "x " * 6), (5, "x " * 6), (6, "é b   c " * 9), (7, "na\x0bna\x0cna\rna\nna na")]
    rows.append((9, "long text here " * 20_000 + "and its end"))
    return rows


def test_query_equals_its_contract(spark, edge_rows, tmp_path):
    spark.createDataFrame([(*r, [1], "x") for r in edge_rows], "doc_id long, text string, runs array<int>, start string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op11_runs(spark, str(tmp_path)).collect()]
    last = str(edge_rows[-1][1])
    key = lambda r: tuple((x is None, x) for x in r)
    short = [r for r in edge_rows if r[1] != last]
    long = next(r for r in got if r[0] == 9)
    assert sorted((r for r in got if r[0] != 9), key=key) == sorted((plain_row(*r) for r in short), key=key)
    if zlib.crc32(b"9") % 10:
        assert long[1:6] == (1, 0, 60_000, 3, 20_000_000)


def test_empty_table(spark):
    assert runs.find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
