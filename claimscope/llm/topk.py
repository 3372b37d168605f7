"""Exact top-k inner-product search with MaxScore over shards.

A vector is a document whose terms are its dimensions. Each shard keeps, per dimension and sign, the largest
absolute value (the bound of a posting list). For a query the dimensions are ordered by the bound of their
contribution; the non-essential ones are the longest tail whose bounds sum to less than the current k-th score.
A row that gains nothing from any essential list cannot enter the top k. The essential postings are traversed;
the other dimensions are probed, strongest bound first, only for rows whose score so far plus the remaining bound
still reaches the k-th score. Shard results are merged with a window.

Shards hold a bounded number of rows and query blocks a bounded number of queries; each (shard, block) pair is one
group. So no table is broadcast, and memory stays the same at any size.

Defined cases: null vectors, vectors with a null or non-finite component and rows with null id take no part; shorter
vectors count as padded with zeros; rows with a repeated id are candidates each, and a repeated query id is asked once, with
its smallest vector; an empty table gives no rows; fewer than k candidates are all returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, BLOCK_QUERIES, CHUNK = 8_192, 4_096, 16


def quantise(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, in double arithmetic."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """Not null and without a null or non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _matrix(rows: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def maxscore(ids: np.ndarray, x: np.ndarray, own: int, q: np.ndarray, k: int, theta: float = -np.inf) -> list[tuple[int, int]]:
    """The k best (score, id) of a shard's rows for one query, ties to smaller id. ``ids`` ascend; x and q are integers."""
    bound = np.maximum(np.where(q > 0, q * x.max(axis=0), q * x.min(axis=0)), 0)
    order = np.argsort(-bound, kind="stable")
    tail = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # tail[i]: most that order[i:] can add
    best: list[tuple[int, int]] = []
    for lo in range(0, len(ids), 1024):
        at = np.arange(lo, min(lo + 1024, len(ids)))
        at = at[ids[at] != own]
        n_ess = int(np.searchsorted(-tail, -theta, side="right")) if np.isfinite(theta) else len(order)
        ess = order[: min(max(n_ess, 1), len(order))]  # the rest sums to less than theta
        part = x[np.ix_(at, ess)] * q[ess]
        keep = (part > 0).any(axis=1) if np.isfinite(theta) and theta > 0 else np.ones(len(at), dtype=bool)
        at, score = at[keep], part[keep].sum(axis=1)
        for i in range(len(ess), len(order), CHUNK):
            live = score + tail[i] >= theta
            at, score = at[live], score[live]
            dims = order[i : i + CHUNK]
            score = score + x[np.ix_(at, dims)] @ q[dims]
        live = score >= theta
        best = sorted([*best, *zip(score[live].tolist(), ids[at[live]].tolist(), strict=True)], key=lambda p: (-p[0], p[1]))[:k]
        if len(best) == k:
            theta = max(theta, best[-1][0])
    return best


def _search(k: int):
    def run(key, docs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(docs) and len(queries):
            docs = docs.sort_values("vec_id", kind="stable")
            dim = max(docs["v"].map(len).max(), queries["v"].map(len).max(), 1)
            ids, x, asked = docs["vec_id"].to_numpy(), _matrix(docs["v"], dim), _matrix(queries["v"], dim)
            for own, q in zip(queries["vec_id"].tolist(), asked, strict=True):
                out += [(own, i, s) for s, i in maxscore(ids, x, own, q, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each row of ``queries``, its own id left out."""
    docs = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), quantise(F.col(vector_col), scale).alias("v"))
    asked = queries.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), quantise(F.col(vector_col), scale).alias("v"))
    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v"))
    shards = max(1, -(-docs.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(n)).cast("int")
    docs = docs.withColumn("shard", deal(shards, 1)).withColumn("block", everywhere(blocks))
    asked = asked.withColumn("block", deal(blocks, 2)).withColumn("shard", everywhere(shards))
    found = docs.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
