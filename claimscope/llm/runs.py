"""Periodic runs of words: maximal stretches that repeat one root, found through Lyndon roots.

1. Every stretch of words whose 5-grams all recur in it is taken out of its text. A run of at least four roots and six words
   consists of such 5-grams, so each run lies whole inside one stretch, and most prose has none.
2. Baier grouping sorts the positions of a stretch by first word into groups and takes the groups from the greatest down. Each
   member hands its group's context to the nearest position on its left that is still open, and positions that receive equally
   much leave their group for one just above it. What a position holds when its group is taken is the longest Lyndon word that starts there:
   the Lyndon array, without sorting suffixes. It is run under the order of words and under its reverse.
3. The roots of a run are Lyndon words under one of the orders, in one group and a period apart. The first root of such a chain
   is extended to both sides by longest common extensions.

All work is inside one task a text and linear in its length but for sorting 5-grams; nothing is shuffled.

Defined cases: null or empty text has no words and no runs; rows are judged each, whatever their ids; an empty table gives no rows.
Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from claimscope.llm.hashing import chunks, few_rows, gram_hashes, mix64, word_hashes

GRAM, MIN_ROOTS, MIN_WORDS = 5, 4, 6


def lyndon_groups(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, length) of the longest Lyndon word at each position; ``ranks`` are 0 .. k - 1, all of them used. Equal groups are equal words."""
    n, k = len(ranks), int(ranks.max()) + 1 if len(ranks) else 0
    of = ranks.tolist()
    members: list[list[int]] = [[] for _ in range(k)]
    for i, r in enumerate(of):
        members[r].append(i)
    size = [len(m) for m in members]
    length, lower, higher = [1] * k, list(range(-1, k - 1)), list(range(1, k + 1))
    closed = [False] * (n + 1)  # closed[-1] stays False: there is nothing left of the first position
    left = list(range(-1, n - 1))
    words = [1] * n
    g = k - 1
    while g >= 0:
        own = [i for i in members[g] if of[i] == g]
        members[g] = own
        for i in own:
            closed[i] = True
        context, received = length[g], {}
        for i in own:
            words[i] = context
            p = i - 1
            while closed[p]:
                p = left[p]
            left[i] = p
            if p >= 0:
                received[p] = received.get(p, 0) + 1
        if len(received) == 1:
            by = [(received[p], [p]) for p in received]
        else:
            alike: dict[int, list[int]] = {}
            for p, times in received.items():
                alike.setdefault(times, []).append(p)
            by = sorted(alike.items(), reverse=True)
        for times, places in by:
            fresh: dict[int, int] = {}
            for p in places:
                o = of[p]
                new = fresh.get(o)
                if new is None and size[o] == 1:
                    length[o] += times * context
                    continue
                if new is None:
                    new = fresh[o] = len(length)
                    up = higher[o]
                    length.append(length[o] + times * context)
                    members.append([])
                    size.append(0)
                    lower.append(o)
                    higher.append(up)
                    higher[o] = new
                    if up < len(lower):
                        lower[up] = new
                of[p] = new
                members[new].append(p)
                size[o] -= 1
                size[new] += 1
        g = lower[g]
    return np.array(of, dtype=np.int64), np.array(words, dtype=np.int64)


def common_extension(w: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from a and b on agree, to the right (step 1) or, from those before them, to the left (step -1); a < b."""
    room = len(w) - b if step > 0 else a
    done, width = 0, 32
    while done < room:
        m = min(width, room - done)
        x, y = (w[a + done : a + done + m], w[b + done : b + done + m]) if step > 0 else (w[a - done - m : a - done][::-1], w[b - done - m : b - done][::-1])
        differ = x != y
        if differ.any():
            return done + int(differ.argmax())
        done, width = done + m, 2 * width
    return done


def runs_of(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a sequence of word numbers, sorted by start and period."""
    if len(w) < MIN_WORDS:
        return []
    ranks = np.unique(w, return_inverse=True)[1]
    found = set()
    for order in (ranks, ranks.max() - ranks):
        group, q = lyndon_groups(order)
        at = np.arange(len(w))
        third = at + 2 * q
        at = at[third < len(w)]
        at = at[(group[at] == group[at + q[at]]) & (group[at] == group[third[at]])]
        before = at - q[at]
        for i in at[(before < 0) | (group[before] != group[at])].tolist():
            period = int(q[i])
            back = common_extension(w, i, i + period, -1)
            size = back + period + common_extension(w, i, i + period, 1)
            if size >= max(MIN_WORDS, MIN_ROOTS * period):
                found.add((i - back, size, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _recurring(words: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the longest stretches of words whose 5-grams, each inside one part, all occur there again. ``part`` numbers the part of each word."""
    n = len(words) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = np.flatnonzero(part[:n] == part[GRAM - 1 :])
    keys = gram_hashes(words, GRAM)[inside] ^ mix64(part[inside].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    again = keys[order[1:]] == keys[order[:-1]]
    known = np.zeros(n + 2, dtype=bool)
    known[1 + inside[order[1:][again]]] = known[1 + inside[order[:-1][again]]] = True
    break_ = np.concatenate([[True], (part[1:] != part[:-1])[: n - 1], [True]])  # grams of different parts don't join
    starts = np.flatnonzero(known[1:-1] & (~known[:-2] | break_[:-1]))
    ends = np.flatnonzero(known[1:-1] & (~known[2:] | break_[1:])) + GRAM
    long = ends - starts >= MIN_WORDS
    return starts[long], ends[long]


def stretches(words: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, first, end) of the stretches of several texts that may hold runs; ``at`` has the offsets of the texts' words."""
    part = np.repeat(np.arange(len(at) - 1), np.diff(at))
    first, end = _recurring(words, part)
    while len(first):  # again inside each stretch, as long as that leaves less
        size = end - first
        part = np.repeat(np.arange(len(first)), size)
        place = np.arange(len(part)) + np.repeat(first - np.cumsum(size) + size, size)
        lo, hi = _recurring(words[place], part)
        first, end = (place[lo], place[hi - 1] + 1) if len(lo) else (lo, hi)
        if (end - first).sum() > 0.9 * size.sum():
            break
    text = np.searchsorted(at, first, side="right") - 1
    return list(zip(text.tolist(), first.tolist(), end.tolist(), strict=True))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    for batch in few_rows(batches):
        texts = batch.column("text").to_pylist()
        for lo, hi in chunks(texts):
            words, at = word_hashes(texts[lo:hi])
            found: list[list[tuple[int, int, int]]] = [[] for _ in range(lo, hi)]
            for t, first, end in stretches(words, at):
                found[t] += [(first - int(at[t]) + s, n, q) for s, n, q in runs_of(words[first:end])]
            collapsed = [_collapse(text, runs) for text, runs in zip(texts[lo:hi], found, strict=True)]
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(rows, kind), pa.array(collapsed, pa.string())], ["doc_id", "runs", "collapsed"])


def _collapse(text: str | None, runs: list[tuple[int, int, int]]) -> str:
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if runs:
        gone = np.zeros(len(words) + 1, dtype=np.int64)
        for start, size, period in runs:
            gone[start + period] += 1
            gone[start + size] -= 1
        words = [w for w, n in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not n]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) for each row of ``docs`` (doc_id, text): ``runs`` holds (start, length, period) in words by start and
    period, ``collapsed`` the words without those that repeat a run's first root, joined by one space."""
    return docs.select("doc_id", "text").mapInArrow(_runs, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
