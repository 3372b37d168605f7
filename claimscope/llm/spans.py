"""Exact removal of every byte that a repeated 200-byte string covers, by merging Burrows-Wheeler transforms.

1. Each 200-byte window picks its core, the 169-byte string inside it with the smallest hash. Equal windows pick the same core at the same place, so a
   window can only repeat where its core does. One aggregation of core hashes finds those; a bitmap of them of at most 64 MB is
   broadcast as a filter, and above that size a join takes its place.
2. Neighbouring windows with one core form a fragment: the core, as one symbol, with at most 31 bytes on either side. A task sends each wording of a fragment once, and once more
   if it repeats. Fragments meet by core. Cores with more than ``HOT`` wordings are cut into their windows, each of them a core of its own.
3. Fragments of some cores form a collection, dealt into shards. Each shard's suffixes are sorted to the length of a window (32 symbols, taken four at a time as one) into a Burrows-Wheeler transform;
   the transforms are merged by refining the interleave: a stable distribution of its entries by the symbols of the transforms
   orders them by one symbol more, and an entry whose symbol or former interval differs from its predecessor's starts a new interval, whose common prefix is the number of the pass. No suffix is sorted again.
   After eight passes the intervals are the classes of equal windows, and those with two members or more are the repeated ones.
4. Covered spans go back to the documents by wording, are merged by document, and the bytes are removed.

Cores and wordings are compared by 64-bit hashes. Defined cases: null or empty text has no bytes; texts below 200 bytes keep all; rows are
compared and reported each, whatever their ids (null ids included): a repeated row repeats all its windows; what is left may be no valid UTF-8; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.bitmap import Filter, bitmap, touched
from claimscope.llm.hashing import few_rows, mix64, polynomials
from claimscope.session import cut, discard

WINDOW, STEPS = 200, 32
CORE = WINDOW - STEPS + 1
HOT, GRAM, SYMBOLS, SHARDS, SEEN, PIECE, SLICE = 8_192, 4, 1 << 16, 4, 1 << 19, 1 << 20, 1 << 18
_AT = 28  # bits of a place in a slice


def pieces(texts: list[str | None], limit: int = SLICE) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of several texts in slices of bounded size: (bytes, text of each piece, its offset in the text, its ends in the slice).

    Long texts come in pieces that overlap, so that each window lies whole in one of them.
    """
    held, text, base, size = [], [], [], 0
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass") if t else b""
        for lo in range(0, max(len(raw) - WINDOW + 1, 0), PIECE):
            held.append(raw[lo : lo + PIECE + WINDOW - 1])
            text.append(i)
            base.append(lo)
            size += len(held[-1])
            if size >= limit:
                yield b"".join(held), np.array(text), np.array(base), np.cumsum([len(h) for h in held])
                held, text, base, size = [], [], [], 0
    if held:
        yield b"".join(held), np.array(text), np.array(base), np.cumsum([len(h) for h in held])


def fragments(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(core hash, first window, number of windows, place of the core, hash of the wording) of each fragment of a slice."""
    buf = np.frombuffer(data, dtype=np.uint8)
    total, inverse = polynomials(buf)
    n = len(buf) - WINDOW + 1
    h = mix64((total[CORE:] - total[:-CORE]) * inverse[: len(buf) - CORE + 1])
    low = ((h >> np.uint64(_AT + 1)) << np.uint64(_AT)).view(np.int64) + np.arange(len(h))
    for width in (1, 2, 4, 8, 16):
        low = np.minimum(low[:-width], low[width:])
    core = low & ((1 << _AT) - 1)
    new = np.empty(n, dtype=bool)
    new[0] = True
    np.not_equal(core[1:], core[:-1], out=new[1:])
    new[ends[ends < n]] = True
    inside = np.ones(n, dtype=bool)
    for e in ends.tolist():  # windows over the end of a piece
        inside[max(e - WINDOW + 1, 0) : e] = False
        if e - WINDOW + 1 < n:
            new[max(e - WINDOW + 1, 0)] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], n)
    first, last = first[inside[first]], last[inside[first]]
    at, count = core[first], last - first
    end = last + WINDOW - 1
    same = mix64((total[end] - total[first]) * inverse[first] + (end - first).astype(np.uint64))
    return h[at], first, count, at, same


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in few_rows(batches):
        for data, text, base, ends in pieces(batch.column("text").to_pylist()):
            yield batch, data, text, base, ends, *fragments(data, ends)


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, _, _, _, h, *_ in _slices(batches):
        once, times = np.unique(h, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(once.view(np.int64)), pa.array(times)], ["h", "n"])


def _windows(data: bytes, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Like ``fragments``, but for the windows of some fragments, each a core of its own."""
    total, inverse = polynomials(np.frombuffer(data, dtype=np.uint8))
    at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    h = mix64((total[at + WINDOW] - total[at]) * inverse[at] + np.uint64(1))
    return h, at, np.ones(len(at), dtype=np.int64), at, h


def _fragments(shared, hot=None):
    """The fragments of each slice whose cores repeat, or the windows of those of hot cores. A task sends what stands before and after the core once, and once more that it came again:
    a byte for the times and, the first time, one for the length of what stands before, and both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch, data, text, base, ends, *found in _slices(batches):
            keep = shared.value(found[0]) & (hot.value(found[0]) if hot else True)
            h, first, count, at, same = _windows(data, *(a[keep] for a in found[1:3])) if hot else (a[keep] for a in found)
            size = WINDOW if hot else CORE
            if len(seen) > SEEN:  # a bound on memory only: what was forgotten is sent again
                seen.clear()
            times, again = [0] * len(h), [False] * len(h)
            _, where, many = np.unique(mix64(h) ^ same, return_index=True, return_counts=True)
            for i, key, n in zip(where.tolist(), (mix64(h[where]) ^ same[where]).tolist(), many.tolist(), strict=True):
                known = seen.get(key, 0)
                if known < 2:
                    times[i] = min(n, 2 - known)
                    seen[key] = known + times[i]
                    again[i] = known > 0
            piece = np.searchsorted(ends, first, side="right")
            rows, start, end = pa.array(text[piece]), first - np.append(0, ends)[piece] + base[piece], first + count + WINDOW - 1
            wording: list[bytes | None] = [None] * len(h)
            for i in np.flatnonzero(times).tolist():
                a, core = int(first[i]), int(at[i])
                wording[i] = bytes([times[i]]) if again[i] else bytes([times[i], core - a]) + data[a:core] + data[core + size : end[i]]
            cols = [*(batch.column(c).take(rows) for c in ("doc", "row")), *(pa.array(a.view(np.int64)) for a in (h, same)), pa.array(start), pa.array(wording, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc", "row", "h", "same", "start", "wording"])

    return run


class Shard:
    """Symbol strings with their Burrows-Wheeler transform; the alphabet is ``GRAM`` symbols wide, so a suffix is extended by GRAM places at a time.

    Strings are circular and end in 0, which occurs nowhere else. ``grams`` ranks the GRAM symbols from each place on.
    """

    def __init__(self, grams: np.ndarray, before: np.ndarray, depth: int):
        self.order = np.arange(len(grams))
        for _ in range(depth):  # stable by the symbol in front: sorted by one more
            self.order = before[self.order]
            self.order = self.order[np.argsort(grams[self.order], kind="stable")]
        self.transform = grams[before[self.order]]


def ranked_grams(text: np.ndarray, begins: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of the GRAM symbols from each place on, place GRAM before it), both around the ends of circular strings."""
    at, begin, length = np.arange(len(text)), np.repeat(begins, size), np.repeat(size, size)
    packed = np.zeros(len(text), dtype=np.uint64)
    for k in range(GRAM):
        packed = packed << np.uint64(16) | text[begin + (at - begin + k) % length].astype(np.uint64)
    names, ranks = np.unique(packed, return_inverse=True)
    return ranks.astype(np.uint16 if len(names) <= 1 << 16 else np.uint32), begin + (at - begin - GRAM) % length


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, interval, prefix) of the merged order of all suffixes: its place among the shards' suffixes laid end to end, the number of its interval of
    suffixes that agree in ``depth`` symbols, and how many symbols it shares with the suffix before it, ``depth`` at most."""
    transform = np.concatenate([s.transform for s in shards])
    n = len(transform)
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s.transform) for s in shards])
    place, interval, prefix = np.arange(n), np.zeros(n, dtype=np.int32), np.full(n, depth, dtype=np.int32)
    prefix[:1] = 0
    for done in range(depth):
        symbols = transform[place]
        moved = np.argsort(symbols, kind="stable")
        symbols, former, interleave = symbols[moved], interval[moved], interleave[moved]
        new = (symbols[1:] != symbols[:-1]) | (former[1:] != former[:-1])
        prefix[1:][new & (prefix[1:] == depth)] = done
        interval[0] = 0
        np.cumsum(new, out=interval[1:])
        place[np.argsort(interleave, kind="stable")] = np.arange(n)
    return place, interval, prefix


def repeated(found: list[tuple[int, bytes, bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether the window at each place of a collection of fragments (core, left, right, times) occurs twice or more; each fragment's first place, and its
    number of windows. At most 2**16 - 257 cores."""
    names = {core: i for i, core in enumerate(dict.fromkeys(f[0] for f in found))}
    left = np.array([len(f[1]) for f in found])
    size = left + [len(f[2]) + 2 for f in found]
    text = np.frombuffer(b"".join(f[1] + b"\0" + f[2] + b"\0" for f in found), dtype=np.uint8).astype(np.uint16) + np.uint16(1)
    ends = np.cumsum(size)
    begins = ends - size
    text[ends - 1] = 0
    text[begins + left] = np.array([257 + names[f[0]] for f in found], dtype=np.uint16)
    grams, before = ranked_grams(text, begins, size)
    part = np.unique(np.append(np.searchsorted(ends, np.arange(1, SHARDS) * ends[-1] / SHARDS), len(found)))
    shards, offsets, lo = [], [], 0
    for hi in part[part > 0].tolist():
        where = slice(begins[lo], ends[hi - 1])
        shards.append(Shard(grams[where], before[where] - begins[lo], STEPS // GRAM))
        offsets.append(shards[-1].order + begins[lo])
        lo = hi
    place, interval, _ = merge(shards, STEPS // GRAM)
    at = np.concatenate(offsets)[place]
    of = np.repeat(np.arange(len(found)), size)[at]
    count = np.maximum(size - 2 - (STEPS - 1) + 1, 1)  # a window that is its own core has no sides
    window = at - begins[of] < count[of]
    weight = np.bincount(interval[window], weights=np.array([f[3] for f in found])[of[window]], minlength=int(interval[-1]) + 1)
    again = np.zeros(len(text), dtype=bool)
    again[at[window]] = weight[interval[window]] >= 2
    return again, begins, count


def _spans(again: np.ndarray, begins: np.ndarray, count: np.ndarray) -> dict[int, list[int]]:
    """Covered bytes of each fragment with repeated windows, as start, end, start, end ..."""
    total = np.append(0, np.cumsum(again))
    many = total[begins + count] - total[begins]
    whole = many == count
    spans = {i: [0, n + WINDOW - 1] for i, n in zip(np.flatnonzero(whole).tolist(), count[whole].tolist(), strict=True)}
    for i in np.flatnonzero((many > 0) & ~whole).tolist():
        edge = np.flatnonzero(np.diff(again[begins[i] : begins[i] + count[i]], prepend=False, append=False))
        starts, ends = edge[0::2], edge[1::2] + WINDOW - 1
        split = np.flatnonzero(starts[1:] > ends[:-1])
        spans[i] = np.stack([starts[np.append(0, split + 1)], ends[np.append(split, len(ends) - 1)]], axis=1).ravel().tolist()
    return spans


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by core: collections of whole cores, of about SYMBOLS symbols; a core may straddle batches."""
    held: dict[tuple, list] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        spans, keys = _spans(*repeated([(h, *f) for (h, _), f in held.items()])), list(held)
        rows = [(*keys[i], s) for i, s in spans.items()]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["h", "same", "spans"])

    core = None
    for large in batches:
        for batch in few_rows([large], 4_096):
            for h, same, wording in zip(*(batch.column(c).to_pylist() for c in ("h", "same", "wording")), strict=True):
                if h != core and size >= SYMBOLS:
                    yield flush()
                    held, size = {}, 0
                core = h
                known = held.setdefault((h, same), [None, None, 0])
                known[2] += wording[0]
                if len(wording) > 1 and known[0] is None:
                    at = 2 + wording[1]
                    known[0], known[1] = wording[2:at], wording[at:]
                    size += len(wording)
    if held:
        yield flush()


_FRAGMENT = "doc long, row long, h long, same long, start long, wording binary"


def removals(keyed: DataFrame) -> DataFrame:
    """(doc, row, spans): spans of bytes to remove, as start, end, start, end ..., for texts that have any. ``keyed`` has doc, row and text.

    Each step is a table that replaces the shuffles and tables it was made of, so that the disk holds one step's at a time.
    """
    broadcast = keyed.sparkSession.sparkContext.broadcast
    texts = keyed.filter("text is not null")
    cores = cut(texts.select("text").mapInArrow(_cores, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"), free=True)
    bits = bitmap(cores)
    known = broadcast(Filter(bits))
    found = texts.mapInArrow(_fragments(known), _FRAGMENT)
    found = cut(found if bits is not None else found.join(cores, "h", "left_semi").select(*found.columns), compression="zstd", free=True)
    parts = [found]
    wordings = found.filter("wording is not null").select("h", "same", "wording")
    hot = cut(wordings.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("h"), free=True)
    if not hot.isEmpty():
        split = broadcast(Filter(bitmap(hot)))
        single = cut(texts.mapInArrow(_fragments(known, split), _FRAGMENT), compression="zstd")
        parts.append(single)
        found = found.mapInArrow(_outside(split), _FRAGMENT).unionByName(single)
        wordings = found.filter("wording is not null").select("h", "same", "wording")
    merged = cut(wordings.repartition("h").sortWithinPartitions("h").mapInArrow(_merged, "h long, same long, spans array<int>"), compression="zstd", free=True)
    covered = found.select("doc", "row", "start", "h", "same").join(merged, ["h", "same"])
    placed = covered.select("doc", "row", F.transform("spans", lambda x: F.col("start") + x).alias("spans"))
    gone = cut(placed.groupBy("doc", "row").agg(F.flatten(F.collect_list("spans")).alias("spans")), free=True)
    discard(cores, hot, merged, *parts)
    return gone


def _outside(hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~hot.value(batch.column("h").to_numpy().view(np.uint64))))

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in few_rows(batches):
        spans, kept = [], []
        for text, flat in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            ends = np.array(flat or [], dtype=np.int64).reshape(-1, 2)
            ends = ends[np.argsort(ends[:, 0])]
            reach = np.maximum.accumulate(ends[:, 1])
            new = np.flatnonzero(np.append(True, ends[1:, 0] > reach[:-1])) if len(ends) else np.zeros(0, dtype=np.int64)
            lo, hi = ends[new, 0].tolist(), reach[np.append(new[1:] - 1, len(ends) - 1)].tolist() if len(ends) else []
            spans.append([{"start": a, "end": b} for a, b in zip(lo, hi, strict=True)])
            kept.append(b"".join(raw[a:b] for a, b in zip([0, *hi], [*lo, len(raw)], strict=True)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, kept) for each row of ``docs`` (doc_id, text): the removed spans (start, end) of the text's UTF-8 bytes, longest runs, and the bytes that stay.

    Only texts that may lose bytes, by a bitmap of their keys, are shuffled to their spans.
    """
    once = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty()
    row = F.lit(0).cast("long") if once else F.xxhash64("text")  # tells apart rows of one id
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), row.alias("row"))
    gone, key = removals(keyed.select("doc", "row", "text")), F.xxhash64("doc", "row").alias("h")
    shared = docs.sparkSession.sparkContext.broadcast(Filter(bitmap(gone.select(key), 64)))
    texts = keyed.select("doc_id", "text", "doc", "row", key)
    lost = texts.filter("text is not null").mapInArrow(touched(shared), "doc_id long, text string, doc long, row long").join(gone, ["doc", "row"], "left")
    kind = "array<struct<start: long, end: long>>"
    lost = lost.select("doc_id", "text", "spans").mapInArrow(_kept, f"doc_id long, spans {kind}, kept binary")
    whole = texts.filter("text is not null").select("doc_id", "text", "h").mapInArrow(touched(shared, False), "doc_id long, text string").unionByName(texts.filter("text is null").select("doc_id", "text"))
    whole = whole.select("doc_id", F.array().cast(kind).alias("spans"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("kept"))
    return lost.unionByName(whole)
