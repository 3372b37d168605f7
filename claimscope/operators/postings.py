"""An inverted index of word counts with score bounds by block of documents, and the exact best documents from it.

The corpus is tokenised once and written in files of a shard: ``SHARD_BLOCKS`` blocks of ``BLOCK_DOCS`` documents, as they come, so that words are not shuffled. A posting list is one row for a word and
shard, in order of blocks, and carries for each block the highest BM25 part and the highest share of a document's length. For a query
the bounds of its words add up to a bound for each block; blocks are scored from the highest bound down until it falls below the k-th score found.
Groups hold a shard and about ``QUERIES`` queries; lists of words that no query of the group has are not sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimscope.session import cut, discard, rows_up_to

BLOCK_DOCS, SHARD_BLOCKS, QUERIES, WORDS = 128, 8, 128, 65_536  # words: of all groups, that may be broadcast


#: What a list holds of a document, and of a block of them: packed, for lists are many and most of them short.
POSTING = np.dtype([("id", "<i8"), ("part", "<f8"), ("share", "<f8")])
BOUND = np.dtype([("block", "<i4"), ("size", "<i4"), ("top_part", "<f8"), ("top_share", "<f8")])


class Index(NamedTuple):
    """Posting lists (w, shard, df, postings, bounds), the number of documents, and the type of ids."""

    lists: DataFrame
    documents: int
    kind: str


def _packed(dtype: np.dtype, offsets: np.ndarray, **columns: np.ndarray) -> pa.BinaryArray:
    """The records between each two offsets as bytes."""
    records = np.empty(int(offsets[-1]), dtype=dtype)
    for name, values in columns.items():
        records[name] = values
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * dtype.itemsize).astype(np.int32).tobytes()), pa.py_buffer(records.tobytes())])


def _unpacked(column: pa.ChunkedArray, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All records of a column, and the number of each row's."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype), pc.binary_length(column).to_numpy() // dtype.itemsize


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``sizes`` of them."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _shard_lists(shard: int, rows: list[pa.RecordBatch], block_docs: int, avgdl: float, k1: float, b: float) -> pa.RecordBatch | None:
    """The posting lists of one shard's documents (id, words)."""
    table = pa.Table.from_batches(rows).combine_chunks()
    words = table.column("words").combine_chunks()
    flat, parent = pc.list_flatten(words), pc.list_parent_indices(words)
    known = pc.is_valid(flat)
    coded, parent = flat.filter(known).dictionary_encode(), parent.filter(known).to_numpy().astype(np.int64)
    if not len(coded):
        return None
    docs, length = table.num_rows, pc.list_value_length(words).to_numpy()
    key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * docs + parent, return_counts=True)  # by word, then block
    word, doc = key // docs, key % docs
    norm = np.sqrt(np.bincount(doc, weights=tf.astype(float) ** 2, minlength=docs))
    part, share = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / avgdl)), tf / norm[doc]
    block = doc // block_docs
    new = np.append(True, (word[1:] != word[:-1]) | (block[1:] != block[:-1]))
    at = np.flatnonzero(new)
    sizes = np.diff(np.append(at, len(word)))
    edges = np.searchsorted(word, np.arange(len(coded.dictionary) + 1))
    postings = _packed(POSTING, edges, id=table.column("id").to_numpy()[doc], part=part, share=share)
    bounds = _packed(BOUND, np.searchsorted(at, edges), block=block[at], size=sizes, top_part=np.maximum.reduceat(part, at), top_share=np.maximum.reduceat(share, at))
    cols = [coded.dictionary, pa.array(np.full(len(edges) - 1, shard, dtype=np.int64)), pa.array(np.diff(edges).astype(np.int32)), postings, bounds]
    return pa.RecordBatch.from_arrays(cols, ["w", "shard", "df", "postings", "bounds"])


def _lists(block_docs: int, blocks: int, avgdl: float, k1: float, b: float):
    """Each ``blocks`` times ``block_docs`` documents of a partition are a shard; a shard may straddle batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, room, held = TaskContext.get().partitionId() << 32, block_docs * blocks, []
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, room))
                room, batch = room - held[-1].num_rows, batch.slice(held[-1].num_rows)
                if not room:
                    if (out := _shard_lists(shard, held, block_docs, avgdl, k1, b)) is not None:
                        yield out
                    shard, room, held = shard + 1, block_docs * blocks, []
        if held and (out := _shard_lists(shard, held, block_docs, avgdl, k1, b)) is not None:
            yield out

    return run


def build(corpus: DataFrame, k1: float = 1.5, b: float = 0.75) -> Index:
    """Index of a corpus (id, words); ids are numbers and occur once, rows with a null id or null words take no part, null words count in the length only."""
    kind = corpus.schema["id"].dataType.simpleString()
    tokens = cut(corpus.filter("words is not null and id is not null").select(F.col("id").cast("long").alias("id"), "words"), rows=BLOCK_DOCS * SHARD_BLOCKS)
    n, avgdl = tokens.agg(F.count("*"), F.avg(F.size("words"))).first()
    lists = cut(tokens.mapInArrow(_lists(BLOCK_DOCS, SHARD_BLOCKS, avgdl or 1.0, k1, b), "w string, shard long, df int, postings binary, bounds binary"))
    discard(tokens)
    return Index(lists, n, kind)


def term_weights(index: Index, queries: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """(q, w, qf, idf) of the words of queries (q, words) that the index has: idf = ln(N - df + .5) - ln(df + .5), negative ones epsilon times the mean of all words."""
    df = index.lists.groupBy("w").agg(F.sum("df").alias("df"))
    idf = cut(df.select("w", (F.log(F.lit(index.documents) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")))  # read for the mean, and for each use of the weights
    mean = idf.agg(F.avg("raw")).first()[0] or 0.0
    qf = queries.filter("q is not null").select("q", F.explode("words").alias("w")).groupBy("q", "w").agg(F.count("*").alias("qf"))
    return qf.join(idf, "w").select("q", "w", "qf", F.when(F.col("raw") < 0, epsilon * F.lit(mean)).otherwise(F.col("raw")).alias("idf"))


def _traverse(k: int, a: float, c: float):
    def run(key, lists: pa.Table, asked: pa.Table) -> pa.Table:
        out_q, out = [], ([], [], [], [])
        kinds = [asked.schema.field("q").type, pa.int64(), *[pa.float64()] * 3]
        if len(lists) and len(asked):
            asked = asked.to_pandas()
            place = {w: i for i, w in enumerate(lists.column("w").to_pylist())}
            flat, _ = _unpacked(lists.column("postings"), POSTING)
            bounds, own = _unpacked(lists.column("bounds"), BOUND)
            first = np.append(0, np.cumsum(own))  # a word's blocks
            size, top_part, top_share = (np.ascontiguousarray(bounds[n]) for n in ("size", "top_part", "top_share"))
            begin = np.cumsum(size) - size
            ids, doc = np.unique(flat["id"], return_inverse=True)
            blocks, at_block = np.unique(bounds["block"], return_inverse=True)
            for q, words in asked.groupby("q", sort=False):
                words = words[words["w"].isin(place)]
                terms = words["w"].map(place).to_numpy(dtype=np.int64)
                count = first[terms + 1] - first[terms]
                rows = _ranges(first[terms], count)
                on_part, on_share = (np.repeat(words[n].to_numpy(dtype=float), count) for n in ("on_part", "on_share"))
                bound = np.bincount(at_block[rows], weights=a * np.maximum(on_part, 0) * top_part[rows] + c * np.maximum(on_share, 0) * top_share[rows], minlength=len(blocks))
                some = np.unique(at_block[rows])
                some = some[np.argsort(-bound[some], kind="stable")]
                best, done, step, floor = (np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0, dtype=np.int64)), 0, 2, -np.inf
                while done < len(some) and bound[some[done]] >= floor - 1e-8:
                    now = np.zeros(len(blocks), dtype=bool)
                    now[some[done : done + step]] = True
                    use = now[at_block[rows]]
                    sizes = size[rows[use]]
                    at = _ranges(begin[rows[use]], sizes)
                    found, inverse = np.unique(doc[at], return_inverse=True)
                    p = np.bincount(inverse, weights=np.repeat(on_part[use], sizes) * flat["part"][at])
                    s = np.bincount(inverse, weights=np.repeat(on_share[use], sizes) * flat["share"][at])
                    best = tuple(np.append(x, y) for x, y in zip(best, (np.round(a * p + c * s, 9), p, s, found), strict=True))
                    keep = np.lexsort((best[3], -best[0]))[:k]
                    best = tuple(x[keep] for x in best)
                    floor = best[0][-1] if len(keep) == k else -np.inf
                    done, step = done + step, 2 * step
                out_q += [q] * len(best[0])
                for to, x in zip(out, (ids[best[3].astype(np.int64)], *best[:3]), strict=True):
                    to.append(x)
        cols = [out_q, *(np.concatenate(x) if x else [] for x in out)]
        return pa.table([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], ["q", "id", "score", "part", "share"])

    return run


def search(index: Index, weights: DataFrame, k: int, a: float = 1.0, c: float = 0.0) -> DataFrame:
    """(q, id, rank, score, part, share): the ``k`` best documents that share a word with a query, by score = a * part + c * share to nine decimals, ties to the smaller id.

    ``weights`` is (q, w, on_part, on_share); part and share are the weighted sums over the words of what the posting lists hold.
    """
    weights = cut(weights)
    groups = max(1, -(-weights.select("q").distinct().count() // QUERIES))
    asked = weights.withColumn("g", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int"))
    words = cut(asked.select("w", "g").distinct())
    needed = index.lists.join(words if rows_up_to(words, WORDS) is None else F.broadcast(words), "w")  # else all lists would be shuffled
    shards = F.broadcast(index.lists.select(F.col("shard").alias("shard")).distinct())  # a row about a thousand documents
    everywhere = asked.crossJoin(shards).select(*[F.col(x).alias(x) for x in ("q", "w", "on_part", "on_share", "g", "shard")])
    kind = weights.schema["q"].dataType.simpleString()
    found = needed.groupBy("shard", "g").cogroup(everywhere.groupBy("shard", "g")).applyInArrow(_traverse(k, a, c), f"q {kind}, id long, score double, part double, share double")
    found = found.withColumn("id", F.col("id").cast(index.kind))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
