"""Similarity joins, clusters and topics over vectors.

Tables have an id and a ``vec`` column (array). The batch operators do not depend on row order. A similarity join within one
table is exact: pairs are left out only where angles to pivots prove that they are not similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.functions.vectors import cosine, euclid, norm, normalize
from claimscope.operators.graph import connected_components
from claimscope.session import cut, discard, rows_up_to

#: Least rows of a block (all pairs of two blocks are compared at once), rows of it multiplied in one step, and rows of a corpus that may be broadcast.
BRUTE_FORCE, STEP, BROADCAST = 2_000, 256, 8_192
#: Blocks that a table is dealt into, so that a row is sent to as many at every size; a block's vectors have at most this many bytes, beyond which there are more blocks.
LAYOUT, BLOCK_BYTES = 16, 1 << 24
#: Pairs that a task passes on at once.
EMIT = 1 << 18
#: Pivots, rows they are chosen from, and blocks whose spans are compared at once.
PIVOTS, SAMPLE, ZONES = 16, 2_048, 1_024


def centroids(rows: DataFrame, by: str, unit: bool = True) -> DataFrame:
    """(by, centroid, size): mean per dimension, normalised to unit length if asked. Sums are taken per dimension before the shuffle."""
    each = rows.select(by, F.posexplode("vec").alias("d", "x"))
    sums = each.groupBy(by, "d").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    g = sums.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("centroid"), F.max("n").alias("size"))
    return g.withColumn("centroid", normalize(F.col("centroid"))) if unit else g


def _block_rows(n: int, width: int) -> int:
    """Rows of a block of ``n`` vectors of ``width`` components."""
    return max(BRUTE_FORCE, min(-(-n // LAYOUT), BLOCK_BYTES // (8 * max(width, 1))))


def _pairs_of_blocks(own: bool, batches: Iterator[pa.RecordBatch], least: float) -> Iterator[tuple]:
    """First the ids of a block pair's rows (id, v, other), in order, then places (i, j) and similarities of pairs that reach ``least``: of rows with ``other`` ones, or a block's own pairs once."""
    table = pa.Table.from_batches(batches)
    table = table.sort_by("id") if table.num_rows else table
    other, width, v = table.column("other").to_numpy(), np.asarray(pc.list_value_length(table.column("v"))), table.column("v")
    yield table.column("id")
    flat = lambda at: _matrix(v.take(pa.array(at)).combine_chunks())
    for n in np.unique(width):
        rows = np.flatnonzero((width == n) & ~other)
        cols = rows if own else np.flatnonzero((width == n) & other)
        if not len(rows) or not len(cols):
            continue
        left, right = flat(rows), flat(cols).T
        for lo in range(0, len(rows), STEP):
            s = left[lo : lo + STEP] @ right
            i, j = np.divmod(np.flatnonzero(s >= least - 1e-9), len(cols))
            s = s[i, j]
            keep = np.round(s, 9) >= least
            if own:
                keep &= lo + i < j
            yield rows[lo + i[keep]], cols[j[keep]], s[keep]


def _compare(threshold: float):
    """Similar pairs (x, y) between the rows of a block pair; the block's own pairs once."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _pairs_of_blocks(key[0] == key[1], batches, threshold)
        ids = next(found).combine_chunks()
        for i, j, s in found:
            for lo in range(0, len(i), EMIT):
                x, y = (ids.take(pa.array(c[lo : lo + EMIT])) for c in (i, j))
                yield pa.RecordBatch.from_arrays([x, y, pa.array(s[lo : lo + EMIT])], ["x", "y", "similarity"])

    return run


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of each pair (i, j); ``root`` holds the first member of each row's set."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        root[np.maximum(a, b)] = np.minimum(a, b)
        while not np.array_equal(up := root[root], root):
            root[:] = up


def _joined(thresholds: list[float]):
    """For each threshold (level), links (x, y) that join the same rows of a block pair as all its similar pairs do: each row of a set with the set's first, so fewer than rows."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _pairs_of_blocks(key[0] == key[1], batches, min(thresholds))
        ids = next(found).combine_chunks()
        roots = [np.arange(len(ids)) for _ in thresholds]
        for i, j, s in found:
            s = np.round(s, 9)
            for t, root in zip(thresholds, roots, strict=True):
                _join(root, i[s >= t], j[s >= t])
        for level, root in enumerate(roots):
            i = np.flatnonzero(root < np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), level, dtype=np.int32)), ids.take(pa.array(root[i])), ids.take(pa.array(i))], ["level", "x", "y"])

    return run


def _reach(threshold: float) -> float:
    """The angle of a similarity, a little wider than rounding."""
    return float(np.arccos(np.clip(threshold - 1e-9, -1, 1))) + 1e-6


def _sample(unit: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The SAMPLE rows with the smallest hashes, padded to ``width``, and their lengths. They steer the work only: no result depends on them."""
    sample = unit.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v").to_pylist()
    return np.array([np.pad(np.asarray(v, dtype=np.float64), (0, width - len(v))) for v in sample]), np.array([len(v) for v in sample])


def _pivots(x: np.ndarray) -> np.ndarray:
    """PIVOTS rows of a sample that lie far apart."""
    chosen, far = [0], np.arccos(np.clip(x @ x[0], -1, 1))
    while len(chosen) < min(PIVOTS, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.arccos(np.clip(x @ x[chosen[-1]], -1, 1)))
    return x[chosen]


def _hubs(x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a sample in its large components at a threshold, at most LAYOUT of them, and the number of each row's component."""
    root = np.arange(len(x))
    for lo in range(0, len(x), STEP):
        i, j = np.nonzero(x[lo : lo + STEP] @ x.T >= threshold + 1e-9)
        _join(root, lo + i, j)
    size = np.bincount(root, minlength=len(x))
    large = np.flatnonzero(size >= max(2, -(-len(x) // LAYOUT)))
    rows = np.flatnonzero(np.isin(root, large))
    return x[rows], np.searchsorted(large, root[rows]).astype(np.int32)


def _angles(pivots: np.ndarray, hubs: np.ndarray, parts: np.ndarray, threshold: float):
    """Adds each row's angles to the pivots, its part, its region (a part's rows about a pivot) and the angle to the nearest pivot. Shorter vectors are padded with zeros.

    A row that is similar to a hub has the hub's part: a part's rows are of one component. Other rows have part -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, flat = np.asarray(pc.list_value_length(batch.column("v"))), batch.column("v").flatten().to_numpy(zero_copy_only=False)
            x = np.zeros((batch.num_rows, pivots.shape[1]))
            x[np.arange(pivots.shape[1])[None, :] < size[:, None]] = flat
            angle = np.arccos(np.clip(x @ pivots.T, -1, 1))
            angles = pa.FixedSizeListArray.from_arrays(pa.array(angle.ravel()), len(pivots)).cast(pa.list_(pa.float64()))
            part, left = np.full(batch.num_rows, -1, dtype=np.int32), np.flatnonzero(size == pivots.shape[1])
            for lo in range(0, len(hubs), STEP):
                hit = x[left] @ hubs[lo : lo + STEP].T >= threshold + 1e-9
                some = hit.any(axis=1)
                part[left[some]] = parts[lo + hit[some].argmax(axis=1)]
                left = left[~some]
            region = ((part + 1) * len(pivots) + angle.argmin(axis=1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, angles, pa.array(part), pa.array(region), pa.array(angle.min(axis=1))], ["id", "v", "angles", "part", "region", "near"])

    return run


def _numbered(most: int):
    """Rows sorted by region and angle get the number of their block: at most ``most`` neighbours of one region and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, last = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            region = batch.column("region").to_numpy()
            numbers, lo = np.empty(len(region), dtype=np.int64), 0
            while lo < len(region):
                if region[lo] != last or size >= most:
                    block, size, last = block + 1, 0, region[lo]
                hi = min(lo + most - size, int(np.searchsorted(region, last, side="right")))
                numbers[lo:hi] = block
                size, lo = size + hi - lo, hi
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "v", "angles", "part")), pa.array(numbers)], ["id", "v", "angles", "part", "block"])

    return run


def _within_reach(reach: float, pivots: int):
    """Pairs of blocks (p <= q), not of one part, whose angles to every pivot lie within ``reach``, with what each side spans."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        sides = [(t.column("block").to_numpy(), t.column("part").to_numpy(), *(_matrix(t.column(c).combine_chunks()) for c in ("low", "high"))) for t in (left, right)]
        (p, p_part, p_low, p_high), (q, q_part, q_low, q_high) = sides
        near = (p[:, None] <= q[None, :]) & ((p_part[:, None] != q_part[None, :]) | (p_part[:, None] < 0))
        for d in range(pivots):
            near &= (p_low[:, d, None] - q_high[None, :, d] <= reach) & (q_low[None, :, d] - p_high[:, d, None] <= reach)
        i, j = np.nonzero(near)
        lists = [pa.array(list(m), pa.list_(pa.float64())) for m in (p_low[i], p_high[i], q_low[j], q_high[j])]
        return pa.table([pa.array(p[i]), pa.array(q[j]), *lists], ["p", "q", "p_low", "p_high", "q_low", "q_high"])

    return run


def blocks_within_reach(unit: DataFrame, threshold: float, joined: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Unit vectors (id, v) in blocks of neighbours (id, v, angles, part, block), and the pairs of blocks that may hold similar rows.

    The angle between two vectors is at least the difference of their angles to any third. So pairs whose angles to a pivot are farther apart than
    the threshold's angle are left out. With ``joined``, rows that are similar at that threshold to rows of one large component of a sample form a part, and
    pairs of blocks of one part are left out too: its rows are of one component.
    """
    width = unit.agg(F.max(F.size("v"))).first()[0]
    sample, length = _sample(unit, width)
    pivots = _pivots(sample)
    hubs, parts_of = _hubs(sample[length == width], joined) if joined is not None else (sample[:0], np.zeros(0, dtype=np.int32))
    kind = f"id {unit.schema['id'].dataType.simpleString()}, v array<double>, angles array<double>, part int"
    placed = unit.mapInArrow(_angles(pivots, hubs, parts_of, joined or 0.0), f"{kind}, region int, near double")
    written = []
    if len(hubs):
        placed = cut(placed)
        written = [placed]
        n, free = placed.agg(F.count("*"), F.count(F.when(F.col("part") < 0, 1))).first()
        if free <= BRUTE_FORCE:  # one block
            placed = placed.withColumn("region", F.when(F.col("part") < 0, 0).otherwise(F.col("region")))
    else:
        n = unit.count()
    order = ("region", "near", "id")
    most = _block_rows(n, width)
    parts = max(1, min(LAYOUT // 2, -(-n // (8 * BRUTE_FORCE))), -(-n // (4 * most)) if n > LAYOUT * most else 0)
    blocks = cut(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_numbered(most), f"{kind}, block long"))
    discard(*written)
    each = lambda f: F.array(*[f(F.get("angles", F.lit(d))) for d in range(len(pivots))])
    zones = cut(blocks.groupBy("block").agg(F.min("part").alias("part"), each(F.min).alias("low"), each(F.max).alias("high")))
    groups = max(1, -(-zones.count() // ZONES))
    group = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")
    dealt, others = zones.withColumn("g", group), F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    own = [F.col(c).alias(c) for c in ("block", "part", "low", "high")]
    left, right = dealt.select(*own, F.col("g"), others.alias("h")), dealt.select(*own, F.col("g").alias("h"), others.alias("g"))
    found = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(_within_reach(_reach(threshold), len(pivots)), "p long, q long, " + ", ".join(f"{n} array<double>" for n in ("p_low", "p_high", "q_low", "q_high")))
    return blocks, cut(found)


def _reaching(blocks: DataFrame, pairs: DataFrame, side: str, other: str, reach: float) -> DataFrame:
    """The rows of each pair's block ``side`` that may be similar to a row of the other."""
    spans = pairs.select("p", "q", F.col(side).alias("block"), F.col(f"{other}_low").alias("low"), F.col(f"{other}_high").alias("high"))
    outside = F.exists(F.arrays_zip("angles", "low", "high"), lambda z: (z["angles"] < z["low"] - reach) | (z["angles"] > z["high"] + reach))
    return blocks.join(spans, "block").filter(~outside).select(*[F.col(c).alias(c) for c in ("id", "v", "p", "q")])  # attributes of their own on each side


def _unit_rows(rows: DataFrame, key: str) -> DataFrame:
    """Unit vectors (id, v). Rows without a vector, or with a missing or non-finite component, take no part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.filter(F.col(key).isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", bad)).select(F.col(key).alias("id"), normalize(F.col("vec")).alias("v"))


def _one_block(unit: DataFrame) -> DataFrame | None:
    """The rows of ``_block_pairs`` if one block has room for all."""
    return unit.select("id", "v", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(False).alias("other")) if rows_up_to(unit, BRUTE_FORCE) is not None else None


def _sent(blocks: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    left, right = (_reaching(blocks, of, *sides, _reach(threshold)) for of, sides in ((pairs, ("p", "q")), (pairs.filter("p <> q"), ("q", "p"))))
    return left.withColumn("other", F.lit(False)).unionByName(right.withColumn("other", F.lit(True)))


def _block_pairs(rows: DataFrame, key: str, threshold: float) -> DataFrame:
    """Unit vectors (id, v, p, q, other) of each pair of blocks (p, q) that may hold similar rows; of a block with itself only once.

    Rows are laid out in blocks of neighbours; pairs of blocks that angles to a few pivots rule out are skipped, and a row goes only to
    blocks that it can reach. Each pair of blocks is one group, so no table is broadcast. There are about LAYOUT blocks and as many as there are pivots at most sizes, so what is sent grows
    with the rows; a block's size is bounded by BLOCK_BYTES.
    """
    unit = _unit_rows(rows, key)
    if (one := _one_block(unit)) is not None:
        return one
    return _sent(*blocks_within_reach(cut(unit), threshold), threshold)


def similar_pairs(rows: DataFrame, key: str, threshold: float) -> DataFrame:
    """(a, b, similarity) with a < b and cosine at or above the threshold: all of them, at every size.

    Rows of ``_block_pairs`` are compared; vectors of different length are not similar. Pairs leave a task as they are found. If an id occurs twice, its pairs are made distinct.
    """
    kind = rows.schema[key].dataType.simpleString()
    found = _block_pairs(rows, key, threshold).groupBy("p", "q").applyInArrow(_compare(threshold), f"x {kind}, y {kind}, similarity double")
    pairs = found.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    return pairs if rows.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").isEmpty() else pairs.distinct()


def joining_links(rows: DataFrame, key: str, thresholds: list[float]) -> DataFrame:
    """(level, a, b): for the threshold of each number (level), links that have the components of all its similar pairs, in a table of the shared folder.

    Rows are compared once for all thresholds, but not with rows of their own part (``blocks_within_reach``), which the part's smallest id joins: where most rows are
    of a few large components, the work grows with the rows. A pair of blocks gives fewer links than it has rows, so their number grows with the rows and not with the pairs.
    """
    kind, held, unit = rows.schema[key].dataType.simpleString(), [], _unit_rows(rows, key)
    if (sent := _one_block(unit)) is None:
        whole = cut(unit)
        blocks, pairs = blocks_within_reach(whole, min(thresholds), max(thresholds))
        sent, held = _sent(blocks, pairs, min(thresholds)), [whole, blocks, pairs]
    found = sent.groupBy("p", "q").applyInArrow(_joined(thresholds), f"level int, x {kind}, y {kind}").filter("x <> y").select("level", F.col("x").alias("a"), F.col("y").alias("b"))
    if held:
        parts = blocks.filter("part >= 0")
        first = F.broadcast(parts.groupBy("part").agg(F.min("id").alias("a")))  # at most LAYOUT rows
        stars = parts.join(first, "part").filter("a <> id").select(F.explode(F.array(*[F.lit(n) for n in range(len(thresholds))])).alias("level"), "a", F.col("id").alias("b"))
        found = found.unionByName(stars)
    out = cut(found, "level")
    discard(*held)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def _best(q: np.ndarray, c: np.ndarray, ids: np.ndarray, own: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, corpus place, similarity) of the ``k`` best corpus rows of each query, ties to the smaller id; ``ids`` ascend.

    Only rows that may reach the k-th similarity are rounded and sorted: columns are taken ``fold`` at a time, and the k-th of their maxima is at most the k-th similarity.
    """
    found, n = [], c.shape[0]
    fold = max(1, min(64, n // (4 * k)))
    wide = n // fold
    for lo in range(0, len(q), STEP):
        s = q[lo : lo + STEP] @ c.T
        if own is not None:
            at = np.searchsorted(ids, own[lo : lo + STEP])
            last = np.searchsorted(ids, own[lo : lo + STEP], side="right")
            for row in np.flatnonzero(last > at):
                s[row, at[row] : last[row]] = -np.inf
        tops = s[:, : wide * fold].reshape(len(s), fold, wide).max(axis=1)
        floor = np.full(len(s), -np.inf) if n <= k else np.partition(tops, wide - k, axis=1)[:, wide - k]
        i, j = np.divmod(np.flatnonzero(s >= floor[:, None] - 2e-9), n)
        top = np.round(s[i, j], 9)
        order = np.lexsort((j, -top, i))
        i, j, top = i[order], j[order], top[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = (place < k) & (top > -np.inf)
        found.append((i[keep] + lo, j[keep], top[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),)


def _sorted_matrix(table: pa.Table, column: str) -> tuple[pa.Table, np.ndarray]:
    table = table.sort_by("id")
    return table, _matrix(table.column(column).combine_chunks())


def _best_of(shared, k: int, same_key: bool):
    """Each query's best rows of a shared corpus (ids, matrix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c = shared.value
        for batch in batches:
            if batch.num_rows and len(ids):
                q, own = _matrix(batch.column("qv")), batch.column("q").to_numpy(zero_copy_only=False)
                i, j, s = _best(q, c, ids, own if same_key else None, k)
                yield pa.RecordBatch.from_arrays([batch.column("q").take(pa.array(i)), pa.array(ids[j]), pa.array(s)], ["q", "id", "similarity"])

    return run


def _best_of_blocks(k: int, same_key: bool):
    def run(key, queries: pa.Table, corpus: pa.Table) -> pa.Table:
        if not queries.num_rows or not corpus.num_rows:
            return pa.table({"q": queries.column("q").slice(0, 0), "id": corpus.column("id").slice(0, 0), "similarity": pa.array([], pa.float64())})
        corpus, c = _sorted_matrix(corpus, "cv")
        q, own = _matrix(queries.column("qv").combine_chunks()), queries.column("q").to_numpy()
        i, j, s = _best(q, c, corpus.column("id").to_numpy(), own if same_key else None, k)
        return pa.table({"q": queries.column("q").take(pa.array(i)), "id": corpus.column("id").take(pa.array(j)), "similarity": pa.array(s)})

    return run


def _usable(vector: Column, width: int) -> Column:
    return vector.isNotNull() & (F.size(vector) == width) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def grid(queries: int, corpus: int, width: int) -> tuple[int, int]:
    """Blocks of queries and of a corpus: few blocks of the corpus, so that queries are sent to as many at every size until a block would have more than BLOCK_BYTES."""
    most = max(1, BLOCK_BYTES // (8 * max(width, 1)))
    count = lambda n, few: max(1, min(few, -(-n // BRUTE_FORCE)), -(-n // most))
    return count(queries, 2 * LAYOUT), count(corpus, LAYOUT // 4)


def nearest(queries: DataFrame, corpus: DataFrame, k: int, same_key: bool = True, block: int = BROADCAST) -> DataFrame:
    """(q, id, similarity, rank): the k most similar corpus rows (id, v) of each query (q, v), ties to the smaller id; with ``same_key`` a row is not its own answer.

    A corpus of at most ``block`` rows is broadcast and the queries are not shuffled. Beyond that both sides are dealt into blocks by ``grid``: each pair of blocks
    gives at most k rows a query, which are merged. Keys are numbers. Rows without a vector, with a missing or non-finite component, or of another length than the
    corpus's longest take no part.
    """
    width = corpus.agg(F.max(F.size("v"))).first()[0] or 0
    held = corpus.filter(F.col("id").isNotNull() & _usable(F.col("v"), width)).select("id", normalize(F.col("v")).alias("cv"))
    asked = queries.filter(F.col("q").isNotNull() & _usable(F.col("v"), width)).select("q", normalize(F.col("v")).alias("qv"))
    kinds = {"q": queries.schema["q"].dataType.simpleString(), "id": corpus.schema["id"].dataType.simpleString()}
    schema = f"q {kinds['q']}, id {kinds['id']}, similarity double"
    if rows_up_to(held.select("id"), block) is not None:
        table, c = _sorted_matrix(held.toArrow(), "cv")  # at most ``block`` rows
        shared = held.sparkSession.sparkContext.broadcast((table.column("id").to_numpy(), c))
        found = asked.mapInArrow(_best_of(shared, k, same_key), schema)
    else:
        n_q, n_c = grid(asked.count(), held.count(), width)
        number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = asked.withColumn("p", F.pmod(F.xxhash64("q"), F.lit(n_q)).cast("int")).withColumn("r", number(n_c))
        right = held.withColumn("r", F.pmod(F.xxhash64("id"), F.lit(n_c)).cast("int")).withColumn("p", number(n_q))
        found = left.groupBy("p", "r").cogroup(right.groupBy("p", "r")).applyInArrow(_best_of_blocks(k, same_key), schema)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def assign(rows: DataFrame, key: str, cents: DataFrame, threshold: float) -> DataFrame:
    """(key, cluster_id, similarity): best centroid by cosine at or above the threshold, else -1; rows without a vector get -1 and 0.

    Ties go to the smaller cluster id. Centroids are compared as by ``nearest``.
    """
    best = nearest(rows.select(F.col(key).alias("q"), F.col("vec").alias("v")), cents.select(F.col("cluster_id").alias("id"), F.col("centroid").alias("v")), 1, same_key=False)
    out = rows.select(key).join(best.select(F.col("q").alias(key), F.col("id").alias("c"), F.col("similarity").alias("s")), key, "left")
    return out.select(key, F.when(F.col("s") >= threshold, F.col("c")).otherwise(F.lit(-1)).alias("cluster_id"), F.coalesce("s", F.lit(0.0)).alias("similarity"))


def update_state(state: DataFrame, rows: DataFrame, key: str, assigned: DataFrame, most: int = 10) -> DataFrame:
    """The state (cluster_id, centroid, size, representatives) after a batch: (c * n + sum e) / (n + m), renormalised; first ``most`` ids kept."""
    joined = rows.join(assigned.filter("cluster_id >= 0").select(key, "cluster_id"), key).select("cluster_id", key, normalize(F.col("vec")).alias("vec"))
    new = centroids(joined, "cluster_id", unit=False).select("cluster_id", F.col("centroid").alias("mean"), F.col("size").alias("m"))
    ranked = joined.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(key))).filter(F.col("r") <= most)
    ids = ranked.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.col(key).cast("string"))).alias("ids"))
    s = state.join(new, "cluster_id", "left").join(ids, "cluster_id", "left")
    moved = F.zip_with("centroid", "mean", lambda c, e: (c * F.col("size") + e * F.col("m")) / (F.col("size") + F.col("m")))
    return s.select("cluster_id", F.when(F.col("m").isNull(), F.col("centroid")).otherwise(normalize(moved)).alias("centroid"), (F.col("size") + F.coalesce("m", F.lit(0))).alias("size"), F.slice(F.concat("representatives", F.coalesce("ids", F.array().cast("array<string>"))), 1, most).alias("representatives"))


def form_clusters(rows: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, cluster_id): components of rows that are similar; a cluster is named by its smallest id."""
    return form_clusters_at(rows, key, [threshold])[0]


def form_clusters_at(rows: DataFrame, key: str, thresholds: list[float]) -> list[DataFrame]:
    """``form_clusters`` at each threshold; rows are compared once for all of them."""
    links, out = joining_links(rows, key, thresholds), []
    for level in range(len(thresholds)):
        components = connected_components(links.filter(F.col("level") == level), "a", "b")
        out.append(rows.select(key).join(components, F.col(key) == F.col("node"), "left").select(key, F.coalesce("component", key).alias("cluster_id")))
    discard(links)
    return out


def cap_clusters(formed: DataFrame, key: str, most: int) -> DataFrame:
    """Keeps the ``most`` largest clusters (ties: smaller id); rows of the others get ``over_cap`` true and are to be assigned to the nearest."""
    sizes = formed.groupBy("cluster_id").agg(F.count("*").alias("size"))
    kept = sizes.orderBy(F.desc("size"), "cluster_id").limit(most).select("cluster_id", F.lit(False).alias("over_cap"))
    return formed.join(kept, "cluster_id", "left").select(key, "cluster_id", F.coalesce("over_cap", F.lit(True)).alias("over_cap"))


def assign_over_cap(capped: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, cluster_id, over_cap, similarity): rows of clusters over the cap go to the nearest kept cluster, whose centroid is not moved by them.

    The similarity to the cluster's centroid is the true one, however low. Rows without a vector keep no cluster: -1 and 0.
    """
    joined = rows.join(capped, key)
    kept = joined.filter(~F.col("over_cap"))
    cents = centroids(kept.filter("vec is not null").select("cluster_id", normalize(F.col("vec")).alias("vec")), "cluster_id").select("cluster_id", "centroid")
    moved = assign(joined.filter("over_cap").select(key, "vec"), key, cents, -1.0)
    stay = kept.join(cents, "cluster_id", "left").select(key, "cluster_id", F.lit(False).alias("over_cap"), F.coalesce(F.round(cosine(F.col("vec"), F.col("centroid")), 9), F.lit(0.0)).alias("similarity"))
    return stay.unionByName(moved.withColumn("over_cap", F.lit(True)))


def size_statistics(sizes: DataFrame, least: int = 5) -> DataFrame:
    return sizes.agg(
        F.count("*").alias("n_clusters"),
        F.sum("size").alias("total"),
        F.avg("size").alias("mean_size"),
        F.percentile("size", F.lit(0.5)).alias("median_size"),
        F.max("size").alias("max_size"),
        F.min("size").alias("min_size"),
        F.sum((F.col("size") == 1).cast("int")).alias("n_singletons"),
        F.sum((F.col("size") >= least).cast("int")).alias("n_large"),
    )


def threshold_profile(sizes: DataFrame, by: str) -> DataFrame:
    """Size bands, yield and singleton share of clusterings at several thresholds."""
    s = F.col("size")
    n = lambda c: F.sum(c.cast("int"))
    g = sizes.groupBy(by).agg(
        F.count("*").alias("n_clusters"),
        F.sum("size").alias("total"),
        n(s == 1).alias("size_1"),
        n(s.between(2, 5)).alias("size_2_5"),
        n(s.between(6, 20)).alias("size_6_20"),
        n(s.between(21, 100)).alias("size_21_100"),
        n(s > 100).alias("size_over_100"),
    )
    return g.withColumn("yield_pct", 100 * (F.col("total") - F.col("size_1")) / F.col("total")).withColumn("singleton_pct", 100 * F.col("size_1") / F.col("n_clusters"))


def intra_similarity(rows: DataFrame, by: str) -> DataFrame:
    """(by, similarity): mean cosine of members to their centroid, for clusters of two and more."""
    c = centroids(rows, by).filter("size > 1")
    return rows.join(c, by).groupBy(by).agg(F.avg(cosine(F.col("vec"), F.col("centroid"))).alias("similarity"))


def similarity_statistics(rows: DataFrame, by: str, most: int = 200) -> DataFrame:
    """One row: number, mean and population deviation of intra-cluster similarity over at most ``most`` clusters of two and more, the first by id."""
    return intra_similarity(rows, by).orderBy(by).limit(most).agg(F.count("*").alias("n"), F.avg("similarity").alias("mean_similarity"), F.stddev_pop("similarity").alias("std_similarity"))


def embedding_statistics(rows: DataFrame) -> DataFrame:
    n = norm(F.col("vec"))
    return rows.filter("vec is not null").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"), F.avg(n).alias("mean_norm"), F.stddev_pop(n).alias("std_norm"), F.min(n).alias("min_norm"), F.max(n).alias("max_norm"))


def assign_topics(rows: DataFrame, key: str, cents: DataFrame) -> DataFrame:
    """(key, topic): nearest of a few centroids (topic, c) by Euclidean distance, ties to the smaller topic. The centroids are broadcast: one a topic."""
    scored = rows.crossJoin(F.broadcast(cents)).select(key, "topic", F.round(euclid(F.col("vec"), F.col("c")), 9).alias("d"))
    return scored.groupBy(key).agg(F.min_by("topic", F.struct("d", "topic")).alias("topic"))


def topic_model(rows: DataFrame, k: int, seed: int = 42):
    """K-means centroids (topic, c), by MLlib."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, featuresCol="f").fit(rows.select(array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("f")))
    return rows.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "topic int, c array<double>")
