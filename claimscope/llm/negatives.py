"""Hard negatives from vectors: for each anchor and positive the best rows of other labels inside a window of scores.

1. Candidates are sorted by label and by their place on a Hilbert curve through the dimensions that vary most, and written as a Parquet table
   with one row a block of ``BLOCK_ROWS`` neighbours, in folders of some blocks. A block carries its zone map: the
   smallest and the largest value of every dimension and of the label.
2. An ask is a query vector with a window of scores and a wish for its own label or for others. Interval arithmetic over the zone maps bounds the scores that
   a block can give: the sum over dimensions of q * low or q * high. Blocks whose interval misses the window or whose labels don't fit are not read.
3. The rest is read in two passes: first the ``FIRST`` blocks with the highest bounds in each group of zone maps; then those whose bound reaches the
   k-th score found so far. Only folders with chosen blocks are read. What a pass chooses is a bit for each block and ask; vectors are not repeated there.
   A folder's chosen blocks meet a chunk's asks as one group, which keeps the k best rows of an ask.
4. Positives are asks for an anchor's own label without a window; each positive then gives an ask for other labels with its window.

Zone maps and asks meet in groups of bounded size (``GROUP`` blocks, ``CHUNK`` asks), and so do blocks and asks (``PART_ROWS`` rows, ``CHUNK`` asks), ``SLICE`` asks at a time. No group grows with
the table; lists of pairs are broadcast up to ``PAIRS`` rows.

Defined cases: rows with a null id or label, a null vector or a null or non-finite component take no part; shorter vectors count as padded with
zeros; rows with a repeated id are candidates each, an anchor's own id is never its positive or negative, and a repeated anchor id is asked once, with its
smallest (label, vector); ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.llm.hashing import few_rows
from claimscope.llm.topk import quantise, usable
from claimscope.session import cut, discard, rows_up_to

BLOCK_ROWS, PART_ROWS, GROUP, CHUNK, SLICE, FIRST, PAIRS = 1_024, 1 << 14, 2_048, 1 << 14, 256, 4, 4_096
CURVE_DIMS, CURVE_BITS, FOLDERS, ANY = 8, 4, 10_000, 1 << 62

_BLOCK = "part int, block long, low_label long, high_label long, low array<long>, high array<long>, ids array<long>, labels array<long>, v array<long>"
_NEED = "part int, chunk int, block long, asked binary"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers (rows x dimensions, ``bits`` bits each)."""
    x, n = cells.astype(np.int64).copy(), cells.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            here = (x[:, i] & q) != 0
            swap = np.where(here, 0, (x[:, 0] ^ x[:, i]) & (q - 1))
            x[:, 0] ^= np.where(here, q - 1, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn, q = np.zeros(len(x), dtype=np.int64), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[:, n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    place = np.zeros(len(x), dtype=np.int64)
    for b in reversed(range(bits)):
        for i in range(n):
            place = place << 1 | (x[:, i] >> b & 1)
    return place


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of one length as a matrix of long."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), dim)


def _placed(dim: int, chosen: np.ndarray, low: np.ndarray, width: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dim)[:, chosen]
            cells = np.clip((x - low) / width, 0, (1 << CURVE_BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(cells, CURVE_BITS))], [*batch.schema.names, "place"])

    return run


def _blocks(dim: int, size: int):
    """Sorted rows of a partition as blocks with their zone maps."""

    def block(part: int, number: int, ids: list, labels: list, x: list) -> pa.RecordBatch:
        ids, labels, x = np.concatenate(ids), np.concatenate(labels), np.concatenate(x)
        order = np.argsort(ids, kind="stable")
        ids, labels, x = ids[order], labels[order], x[order]
        cols = [[part], [part * (1 << 32) + number], [labels.min()], [labels.max()], *([a] for a in (x.min(axis=0), x.max(axis=0), ids, labels, x.ravel()))]
        kinds = [pa.int32(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "block", "low_label", "high_label", "low", "high", "ids", "labels", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, rows = TaskContext.get().partitionId(), 0, ([], [], []), 0
        for large in batches:
            for batch in few_rows([large], min(size, 256)):
                for to, a in zip(held, (batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), _matrix(batch.column("v"), dim)), strict=True):
                    to.append(a)
                rows += batch.num_rows
                if rows >= size:
                    yield block(part, number, *held)
                    number, held, rows = number + 1, ([], [], []), 0
        if rows:
            yield block(part, number, *held)

    return run


def write_blocks(rows: DataFrame, dim: int, size: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, label, v) in Hilbert order within labels, as a table of blocks of about ``size`` rows."""
    each = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    spread = sorted(each.collect(), key=lambda r: (-r.sd, r.d))[:CURVE_DIMS]  # a row a dimension
    chosen, mean, sd = (np.array([getattr(r, c) for r in spread]) for c in ("d", "mean", "sd"))
    width = np.maximum(4 * sd / (1 << CURVE_BITS), 1e-9)
    placed = rows.mapInArrow(_placed(dim, chosen.astype(np.int64), mean - 2 * sd, width), "vec_id long, label long, v array<long>, place long")
    parts = max(1, -(-rows.count() // PART_ROWS))
    order = ("label", "place", "vec_id")
    return cut(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_blocks(dim, size), _BLOCK), "part")


def intervals(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest inner product of each row of q with any vector between ``low`` and ``high``; outward if sums leave exact doubles."""
    up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    low, high = low.astype(np.float64).T, high.astype(np.float64).T
    least, most = up @ low + down @ high, up @ high + down @ low
    size = up @ np.maximum(np.abs(low), np.abs(high)) - down @ np.maximum(np.abs(low), np.abs(high))
    slack = np.where(size < 2.0**52, 0, size * 1e-12)
    return least - slack, most + slack


def _in_order(asks: pa.Table) -> pa.Table:
    """Asks of a chunk as the bits of ``asked`` count them."""
    return asks.sort_by([("anchor", "ascending"), ("slot", "ascending")]).combine_chunks()


def _choose(same: bool, again: bool, dim: int):
    """For a group of zone maps and a chunk of asks: each block with a bit for each ask that must read it, in the first pass or again."""

    def run(key, zones: pa.Table, asks: pa.Table) -> pa.Table:
        zones, asks = zones.sort_by("block"), _in_order(asks)
        taken = np.zeros((len(asks), len(zones)), dtype=bool)
        if len(zones) and len(asks):
            lowest, highest = (_matrix(zones.column(c), dim) for c in ("low", "high"))
            low, high = (zones.column(c).to_numpy()[None, :] for c in ("low_label", "high_label"))
            for lo in range(0, len(asks), SLICE):
                some = asks.slice(lo, SLICE).combine_chunks()
                least, most = intervals(_matrix(some.column("q"), dim), lowest, highest)
                own, floor, ceil = (some.column(c).to_numpy()[:, None] for c in ("label", "least", "most"))
                fits = (low <= own) & (own <= high) if same else (low != own) | (high != own)
                fits &= (most >= floor) & (least <= ceil)
                best = np.where(fits, np.minimum(most, ceil), -np.inf)
                first = np.zeros(best.shape, dtype=bool)
                np.put_along_axis(first, np.argsort(-best, axis=1, kind="stable")[:, :FIRST], True, axis=1)
                taken[lo : lo + SLICE] = fits & ~first & (best >= some.column("reached").to_numpy()[:, None]) if again else fits & first
        need = np.flatnonzero(taken.any(axis=0))
        asked = pa.array([np.packbits(taken[:, b]).tobytes() for b in need.tolist()], pa.binary())
        chunk = pa.array(np.full(len(need), key[1].as_py(), dtype=np.int32))
        return pa.table([zones.column("part").take(pa.array(need)), chunk, zones.column("block").take(pa.array(need)), asked], ["part", "chunk", "block", "asked"])

    return run


def _scan(same: bool, k: int, dim: int):
    """For chosen blocks of a folder and a chunk of asks: each ask's k best rows of the blocks that it must read."""

    def run(key, blocks: pa.Table, asks: pa.Table) -> pa.Table:
        asks = _in_order(asks)
        anchor, slot, own, least, most, reached = (asks.column(c).to_numpy() for c in ("anchor", "slot", "label", "least", "most", "reached"))
        q, n = _matrix(asks.column("q"), dim), len(asks)
        widest, floor = np.abs(q.astype(np.float64)).max(initial=0), np.maximum(least, reached)
        score, row_id, count = np.zeros((n, k), dtype=np.int64), np.zeros((n, k), dtype=np.int64), np.zeros(n, dtype=np.int64)
        for block in blocks.sort_by("block").to_batches(max_chunksize=1) if n else ():
            ids, labels, x = (block.column(c).flatten().to_numpy() for c in ("ids", "labels", "v"))
            x = x.reshape(-1, dim)
            most_sum = widest * np.abs(x.astype(np.float64)).max(initial=0) * dim
            exact = np.float32 if most_sum < 2.0**23 else np.float64 if most_sum < 2.0**52 else np.int64  # in which sums are whole numbers
            x = x.T.astype(exact)
            asked = np.flatnonzero(np.unpackbits(np.frombuffer(block.column("asked")[0].as_py(), dtype=np.uint8), count=n))
            for lo in range(0, len(asked), SLICE):
                at = asked[lo : lo + SLICE]
                product = q[at].astype(exact) @ x
                ask, row = np.nonzero(product >= floor[at].astype(exact)[:, None])
                found, whose = product[ask, row].astype(np.int64), at[ask]
                fits = (found >= floor[whose]) & (found <= most[whose]) & (ids[row] != anchor[whose]) & ((labels[row] == own[whose]) == same)
                old, place = np.nonzero(np.arange(k) < count[at][:, None])
                ask, found, new = np.append(ask[fits], old), np.append(found[fits], score[at[old], place]), np.append(ids[row[fits]], row_id[at[old], place])
                order = np.lexsort((new, -found, ask))
                ask, found, new = ask[order], found[order], new[order]
                place = np.arange(len(ask)) - np.searchsorted(ask, ask)
                ask, found, new, place = (c[place < k] for c in (ask, found, new, place))
                score[at[ask], place], row_id[at[ask], place] = found, new
                count[at] = np.bincount(ask, minlength=len(at))
                full = at[count[at] == k]
                floor[full] = np.maximum(floor[full], score[full, k - 1])
        ask, place = np.nonzero(np.arange(k) < count[:, None])
        cols = [anchor[ask], slot[ask], row_id[ask, place], score[ask, place]]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["anchor", "slot", "vec_id", "score"])

    return run


def search(blocks: DataFrame, asks: DataFrame, dim: int, same: bool, k: int) -> DataFrame:
    """(anchor, slot, rank, vec_id, score): the k best rows for each ask (anchor, slot, label, q, least, most), of its own label or, if not ``same``, of others.

    An anchor and slot occur once.
    """
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    few = lambda pairs: pairs if rows_up_to(pairs, PAIRS) is None else F.broadcast(pairs)
    groups, chunks = max(1, -(-blocks.count() // GROUP)), max(1, -(-asks.count() // CHUNK))
    zones = blocks.select("part", "block", "low_label", "high_label", "low", "high", deal(groups, "block").alias("group"), everywhere(chunks).alias("chunk"))
    ranked = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id"))

    def read(asks: DataFrame, again: bool) -> DataFrame:
        needs = cut(zones.groupBy("group", "chunk").cogroup(asks.withColumn("group", everywhere(groups)).groupBy("group", "chunk")).applyInArrow(_choose(same, again, dim), _NEED))
        folders, cells = needs.select("part").distinct(), needs.select(F.col("part").alias("part"), F.col("chunk").alias("chunk")).distinct()
        table = blocks.filter(F.col("part").isin([r.part for r in folders.collect()])) if rows_up_to(folders, FOLDERS) is not None else blocks
        chosen = table.select("block", "ids", "labels", "v").join(few(needs), "block").groupBy("part", "chunk")
        asking = asks.join(few(cells), "chunk").groupBy("part", "chunk")
        found = cut(chosen.cogroup(asking).applyInArrow(_scan(same, k, dim), "anchor long, slot int, vec_id long, score long"))
        discard(needs)
        return found

    asks = asks.withColumn("chunk", deal(chunks, "anchor"))
    first = read(asks.withColumn("reached", F.lit(-ANY)), False)
    kth = first.withColumn("rank", ranked).filter(F.col("rank") == k).select("anchor", "slot", F.col("score").alias("reached"))
    again = cut(asks.join(kth, ["anchor", "slot"], "left").withColumn("reached", F.coalesce("reached", F.lit(-ANY))))
    rest = read(again, True)
    discard(again)
    return first.unionByName(rest).withColumn("rank", ranked).filter(F.col("rank") <= k).select("anchor", "slot", "rank", "vec_id", "score")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``vectors`` where ``is_anchor`` holds.

    Positives are the ``positives`` best other rows of the anchor's label. For each of them the ``negatives`` best rows of other labels follow whose
    score is from four fifths of the positive's score up to that score.
    """
    known = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(F.col(vector_col)))
    rows = known.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), quantise(F.col(vector_col), scale).alias("v"), is_anchor.alias("asked"))
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    dim = max(dim, 1)
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))))
    blocks = write_blocks(rows.select("vec_id", "label", "v"), dim, block_rows)
    anchors = cut(rows.filter("asked").groupBy(F.col("vec_id").alias("anchor")).agg(F.min(F.struct("label", F.col("v").alias("q"))).alias("a")).select("anchor", "a.label", "a.q"))
    wide = anchors.withColumns({"slot": F.lit(0), "least": F.lit(-ANY), "most": F.lit(ANY)})
    near = cut(search(blocks, wide, dim, True, positives).select("anchor", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    least = F.ceil(F.col("positive_score").cast("decimal(20,0)") * 4 / 5).cast("long")
    windows = near.join(anchors, "anchor").withColumns({"least": least, "most": F.col("positive_score")}).filter("least <= most")
    hard = search(blocks, cut(windows.select("anchor", "slot", "label", "q", "least", "most")), dim, False, negatives)
    return near.join(hard, ["anchor", "slot"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
