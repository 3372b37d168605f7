"""Near-duplicate classes with DartMinHash.

A document is the weighted set of its five-word shingles (the whole text if shorter), weight = number of occurrences;
words are split at white space. DartMinHash (Christiani 2020): every unit of weight of every shingle has a hashed Poisson process
of darts along the rank axis, so an element of weight w is a region of width w in which its darts fall; a document sees the darts of its own
region up to a rank that yields about k ln k + 5k of them, and keeps the earliest dart of each of k coordinates. Two documents agree on a
coordinate with probability equal to their weighted Jaccard similarity. Signatures are banded (24 bands of 5) and joined by band.

Nothing is lost after the banding, which finds a pair at 0.8 with probability 0.9999:

1. Exact copies collapse by content fingerprint. Of buckets with the same members, told by number, sum and exclusive or of member hashes, one stays.
2. A bucket is dealt into blocks of about ``BLOCK`` texts; all pairs of a block are compared exactly, by counting common units. Most buckets
   are one block. What leaves a block is its components.
3. After the components of these links, a bucket of several blocks may still hold several classes. Its members outside its largest class are
   compared with all its members, block by block; the links found join classes. So the work is linear in a group of near copies but for those members that are no near copies
   of the rest.

Units are compared by 32-bit hashes, whose collisions change a similarity by less than one unit in 10,000.

Defined cases: null or empty text, or white space only, is a class of its own; null doc_id rows are left out; the rows of a repeated doc_id
give one row, with the smallest class; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm.bitmap import Filter, bitmap, touched
from claimscope.llm.hashing import chunks, few_rows, gram_hashes, mix64, word_hashes
from claimscope.operators.graph import connected_components
from claimscope.operators.keyed import number_rows
from claimscope.session import cut, discard

SHINGLE, BANDS, ROWS, BLOCK = 5, 24, 5, 256
K = BANDS * ROWS
_COLUMNS, _STEP = 4_096, 32  # units and texts of a side compared at once
_FIRST = 2.0**-8  # width of the first rank cell; each further cell doubles the rank
_UNIT = np.uint64(0xA24BAED4963EE407)


def shingle_units(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All units of weight: (doc index, unit hash), by doc and hash, and two fingerprints of each doc's word sequence.

    The v-th occurrence of a shingle is a unit of its own, so set similarity of units is weighted similarity of shingles.
    """
    words, at = word_hashes(texts)
    n = np.diff(at)
    g = gram_hashes(words, SHINGLE)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, 0)
    doc = np.repeat(np.arange(len(texts)), count)
    first = np.repeat(at[:-1], count) + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    h = g[first] if len(doc) else np.zeros(0, dtype=np.uint64)
    prints = np.zeros((len(texts), 2), dtype=np.uint64)
    place = np.arange(len(words), dtype=np.uint64) - np.repeat(at[:-1], n).astype(np.uint64)
    for j, salt in enumerate((0x51ED2701, 0x2545F491)):
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix64(words + mix64(place + np.uint64(salt))), dtype=np.uint64)])
        prints[:, j] = mix64(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64))
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    doc, h = np.concatenate([doc, short]), np.concatenate([h, prints[short, 0]])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    same = np.concatenate([[False], (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])]) if len(h) else np.zeros(0, dtype=bool)
    run = np.arange(len(h)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(h)))) if len(h) else np.zeros(0, dtype=np.int64)
    return doc, np.where(run > 0, mix64(h + run.astype(np.uint64) * _UNIT), h), prints


def _poisson_thresholds(area: float) -> np.ndarray:
    p, c, out = np.exp(-area), np.exp(-area), []
    k = 0
    while c < 1 - 1e-15 and k < 40 + 12 * area:
        out.append(c)
        k += 1
        p *= area / k
        c += p
    return np.array(out)


def _throw(doc: np.ndarray, unit: np.ndarray, theta: np.ndarray, best: np.ndarray) -> None:
    """Keep in ``best`` (docs x coordinates, packed rank and dart id) the earliest dart per coordinate below rank theta[doc]."""
    k = best.shape[1]
    lo, hi, cell, limit = 0.0, _FIRST, 0, theta[doc]
    while True:
        reach = np.flatnonzero(limit > lo)
        if not len(reach):
            return
        key = mix64(unit[reach] + mix64(np.full(1, cell + 1, dtype=np.uint64)))
        u = (key >> np.uint64(11)).astype(np.float64) / 2.0**53
        n = np.searchsorted(_poisson_thresholds(hi - lo), u, side="right")
        some = n > 0
        key, who, n = key[some], reach[some], n[some]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        dart = mix64(np.repeat(key, n) ^ mix64(nth.astype(np.uint64) + np.uint64(0x632BE5AB)))
        who = np.repeat(who, n)
        rank = lo + (hi - lo) * ((dart >> np.uint64(40)).astype(np.float64) / 2.0**24)
        ok = rank < limit[who]
        dart, who, rank = dart[ok], who[ok], rank[ok]
        again = mix64(dart)
        packed = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (again >> np.uint64(32))
        np.minimum.at(best.reshape(-1), doc[who] * k + (again & np.uint64(0xFFFFFFFF)).astype(np.int64) % k, packed)
        lo, hi, cell = hi, hi * 2, cell + 1


def signatures(doc: np.ndarray, unit: np.ndarray, n_docs: int, k: int = K) -> np.ndarray:
    """(n_docs, k) int32 signature values; documents without units keep zeros."""
    none = np.iinfo(np.uint64).max
    best = np.full((n_docs, k), none, dtype=np.uint64)
    size = np.bincount(doc, minlength=n_docs)
    theta = np.where(size > 0, k * (np.log(k) + 5) / np.maximum(size, 1), 0.0)
    _throw(doc, unit, theta, best)
    while (open_ := (size > 0) & (best == none).any(axis=1)).any():  # a coordinate without a dart: look further
        theta = np.where(open_, theta * 2, 0.0)
        _throw(doc[open_[doc]], unit[open_[doc]], theta, best)
    best[size == 0] = 0
    return mix64(best).astype(np.uint32).view(np.int32)


def band_values(sig: np.ndarray) -> np.ndarray:
    """(docs, BANDS) hashes of each band's coordinates and number."""
    parts = sig.view(np.uint32).astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    g = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for j in range(ROWS):
        g = mix64(g * _UNIT + parts[:, :, j])
    return g


def _list(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, type=kind))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints and band values of each document; null where it has no words."""
    for batch in few_rows(batches):
        ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
        for lo, hi in chunks(texts):
            doc, unit, prints = shingle_units(texts[lo:hi])
            n = hi - lo
            values, none = band_values(signatures(doc, unit, n)).reshape(-1), np.bincount(doc, minlength=n) == 0
            cols = [ids.slice(lo, n), *(pa.array(prints[:, j].view(np.int64), mask=none) for j in (0, 1)), _list(values.view(np.int64), np.full(n, BANDS), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "fp1", "fp2", "bands"])


def _members(shared):
    """(h, rep) of the band values in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("bands").flatten().to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(shared.value(values.view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(values[keep]), batch.column("rep").take(pa.array(keep // BANDS))], ["h", "rep"])

    return run


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in few_rows(batches):
        ids, texts = batch.column("rep"), batch.column("text").to_pylist()
        for lo, hi in chunks(texts):
            doc, unit, _ = shingle_units(texts[lo:hi])
            cols = [ids.slice(lo, hi - lo), _list((unit >> np.uint64(32)).astype(np.uint32).view(np.int32), np.bincount(doc, minlength=hi - lo), pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["rep", "units"])


def _coded(side: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(doc, unit) of all units; a value that collides within a text gets a number, so that each is its own."""
    sizes = np.array([len(u) for u in side])
    doc, unit = np.repeat(np.arange(len(side)), sizes), np.concatenate(side).view(np.uint32).astype(np.uint64)
    order = np.lexsort((unit, doc))
    doc, unit = doc[order], unit[order]
    same = np.concatenate([[False], (doc[1:] == doc[:-1]) & (unit[1:] == unit[:-1])])[: len(doc)]
    run = np.arange(len(doc)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(doc)))) if len(doc) else np.zeros(0, dtype=np.int64)
    return doc, unit + (run.astype(np.uint64) << np.uint64(32))


def common_units(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """(left, right) numbers of common units; within one side (the diagonal is not filled) if there is no other. Bit sets, by slices of the units that can be common."""
    ld, lu = _coded(left)
    if right is None:
        right, rd, ru = left, ld, lu
        both, n = np.unique(lu, return_counts=True)
        both = both[n > 1]
    else:
        rd, ru = _coded(right)
        both = np.intersect1d(lu, ru)
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    if not len(both):
        return out
    places = []
    for d, u in ((ld, lu), (rd, ru)):
        p = np.minimum(np.searchsorted(both, u), len(both) - 1)
        ok = both[p] == u
        places.append((d[ok], p[ok]))
    for lo in range(0, len(both), _COLUMNS):
        width = min(_COLUMNS, len(both) - lo)
        words = -(-width // 64)
        sides = []
        for n, (d, p) in zip((len(left), len(right)), places, strict=True):
            at = (p >= lo) & (p < lo + width)
            m = np.zeros((n, words * 64), dtype=np.uint8)
            m[d[at], p[at] - lo] = 1
            sides.append(np.packbits(m, axis=1).view(np.uint64))
        for i in range(0, len(left), _STEP):
            out[i : i + _STEP] += np.bitwise_count(sides[0][i : i + _STEP, None, :] & sides[1][None, :, :]).sum(axis=2, dtype=np.int64)
    return out


def _similar(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    n, m = (np.array([len(u) for u in side]) for side in (left, left if right is None else right))
    inter = common_units(left, right)
    return inter / np.maximum(n[:, None] + m[None, :] - inter, 1) >= threshold


def _smallest_reachable(linked: np.ndarray, ids: list) -> list:
    """For each row of a symmetric link matrix the smallest id of its component."""
    low = [None] * len(ids)
    for start in sorted(range(len(ids)), key=ids.__getitem__):
        if low[start] is not None:
            continue
        reached = np.zeros(len(ids), dtype=bool)
        reached[start] = True
        edge = reached
        while edge.any():
            more = linked[edge].any(axis=0) & ~reached
            reached |= more
            edge = more
        for i in np.flatnonzero(reached):
            low[i] = ids[start]
    return low


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[list[tuple]]:
    """Rows of each group of a stream sorted by ``keys``; a group may straddle batches."""
    group, held = None, []
    for batch in batches:
        units = batch.column("units")
        offsets, values = units.offsets.to_numpy(), units.values.to_numpy(zero_copy_only=False)
        for i, (*key, rest) in enumerate(zip(*(batch.column(c).to_pylist() for c in keys), zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True)):
            if key != group:
                if held:
                    yield held
                group, held = key, []
            held.append((*rest, values[offsets[i] : offsets[i + 1]].copy()))
    if held:
        yield held


def _within(threshold: float):
    """Links (a, b) that span the components of each block: every member to the smallest of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["h", "block"], ["rep"]):
            if len(rows) < 2:
                continue
            ids, units = [r[0] for r in rows], [r[1] for r in rows]
            found = [(i, low) for i, low in zip(ids, _smallest_reachable(_similar(units, None, threshold), ids), strict=True) if i != low]
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(a, pa.int64())], ["a", "b"])

    return run


def _across(threshold: float):
    """Pairs of classes (a, b) with a link between the two sides of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["h", "p", "q"], ["side", "class"]):
            left, right = ([r for r in rows if r[0] == side] for side in (0, 1))
            if not left or not right:
                continue
            i, j = np.nonzero(_similar([r[2] for r in left], [r[2] for r in right], threshold))
            found = sorted({(min(x, y), max(x, y)) for x, y in ((left[x][1], right[y][1]) for x, y in zip(i.tolist(), j.tolist(), strict=True)) if x != y})
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _blocks(n: Column) -> Column:
    """Number of blocks of a bucket (or part of one) with ``n`` members; 1 if unknown, for only large ones are told."""
    return F.coalesce(F.ceil(n / BLOCK), F.lit(1)).cast("int")


def _deal(blocks: Column, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "rep"), blocks).cast("int")


def _joined_classes(members: DataFrame, big: DataFrame, units: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): classes with a link in a bucket of several blocks that step 2 could not see."""
    held = members.join(big, "h").join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("h", "rep", "n", F.coalesce("component", "rep").alias("class"))
    held = cut(held)
    sizes = held.groupBy("h", "class").agg(F.count("*").alias("c"))
    main = sizes.groupBy("h").agg(F.max_by("class", F.struct("c", -F.col("class"))).alias("main"), (F.sum("c") - F.max("c")).alias("n_rest")).filter("n_rest > 0")
    held = held.join(main, "h").join(units, "rep")
    count = lambda n: F.sequence(F.lit(0), _blocks(F.col(n)) - 1)
    rest = held.filter("class <> main").select("h", _deal(_blocks(F.col("n_rest"))).alias("p"), F.explode(count("n")).alias("q"), F.lit(0).alias("side"), "class", "units")
    every = held.select("h", F.explode(count("n_rest")).alias("p"), _deal(_blocks(F.col("n"))).alias("q"), F.lit(1).alias("side"), "class", "units")
    dealt = rest.unionByName(every).repartition("h", "p", "q").sortWithinPartitions("h", "p", "q")
    return dealt.mapInArrow(_across(threshold), "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, class_id): class_id is the smallest doc_id of the document's class of near-duplicates."""
    texts = docs.filter("doc_id is not null").select("doc_id", "text")
    broadcast = docs.sparkSession.sparkContext.broadcast
    signed = cut(texts.mapInArrow(_sign, "doc_id long, fp1 long, fp2 long, bands array<long>"))
    reps = cut(signed.filter("fp1 is not null").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))

    values = reps.select("rep", F.explode("bands").alias("h"))
    shared = values.groupBy("h").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.hash("rep").cast("long")).alias("s")).filter("n > 1")
    buckets = cut(shared.groupBy("n", "x", "s").agg(F.min("h").alias("h")).select("h", "n"))
    bits = bitmap(buckets.select("h"), 256)
    members = reps.select("rep", "bands").mapInArrow(_members(broadcast(Filter(bits))), "h long, rep long")
    members = cut(members if bits is not None else members.join(buckets, "h", "left_semi"))

    key = F.xxhash64("rep").alias("h")
    bits = bitmap(members.select(key))
    some = texts.select(F.col("doc_id").alias("rep"), "text").filter("text is not null").select("rep", "text", key).mapInArrow(touched(broadcast(Filter(bits))), "rep long, text string")
    some = some if bits is not None else some.join(members.select("rep").distinct(), "rep", "left_semi")
    units = cut(some.mapInArrow(_units, "rep long, units array<int>"))

    big = buckets.filter(F.col("n") > BLOCK)
    dealt = members.join(big, "h", "left").select("h", "rep", _deal(_blocks(F.col("n"))).alias("block")).join(units, "rep")
    links = dealt.select("h", "block", "rep", "units").repartition("h", "block").sortWithinPartitions("h", "block").mapInArrow(_within(threshold), "a long, b long")
    classes = connected_components(links, "a", "b")

    late = cut(_joined_classes(members, big, units, classes, threshold).distinct())
    if not late.isEmpty():  # join classes, not documents: a graph of few nodes
        merged = connected_components(late, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("lower"))
        alone = merged.select(F.col("component").alias("node"), F.col("component"))  # classes of one document
        classes = classes.union(alone).distinct().join(merged, "component", "left").select("node", F.coalesce("lower", "component").alias("component"))
    of_print = reps.select("fp1", "fp2", "rep").join(classes, F.col("rep") == F.col("node"), "left").select("fp1", "fp2", F.coalesce("component", "rep").alias("class_id"))
    found = signed.select("doc_id", "fp1", "fp2").join(of_print, ["fp1", "fp2"], "left")
    discard(members, units, buckets, late)
    return found.groupBy("doc_id").agg(F.min(F.coalesce("class_id", "doc_id")).alias("class_id"))


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the rows whose class has a smaller doc_id. Rows with null doc_id stay, and repeated rows stay together.

    Where one id has several texts each of them is judged: they are numbered in the order of ids, and the numbers take the place of ids.
    """
    row = F.xxhash64("text")
    twice = docs.filter("doc_id is not null").select("doc_id", row.alias("row")).groupBy("doc_id").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).filter("not lo <=> hi")
    if twice.isEmpty():
        gone = near_duplicates(docs, threshold).filter("class_id < doc_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    texts = docs.select("doc_id", "text").filter("doc_id is not null").withColumn("row", row)
    numbers = cut(number_rows(texts.select("doc_id", "row").distinct(), "doc_id", "number"))
    found = near_duplicates(texts.join(numbers, ["doc_id", "row"]).select(F.col("number").alias("doc_id"), "text"), threshold)
    first = numbers.select(F.col("number").alias("class_id"), F.col("doc_id").alias("first"))
    gone = found.withColumnRenamed("doc_id", "number").join(first, "class_id").join(numbers, "number").filter("first < doc_id").select(F.col("doc_id").alias("_gone_id"), F.col("row").alias("_gone_row"))
    return docs.join(gone, (F.col("doc_id") == F.col("_gone_id")) & (row == F.col("_gone_row")), "left_anti")
