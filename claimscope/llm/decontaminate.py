"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised (lower case, letters and digits, other runs become one space). An item of m characters
has an error budget of floor(``error_rate`` * m) edits and is split into budget + 1 pieces: a passage within the budget has one of them
unchanged. Pieces are found exactly with one Aho-Corasick automaton; each hit opens the window the item could
occupy, and Myers' bit-parallel algorithm gives the smallest edit distance of the item to any part of it.

Items are read in blocks of bounded size, so the automaton never outgrows a worker; each block is one pass over the documents, and of several the hits
are written before the next is read, so one block is broadcast at a time.
Defined cases: null texts and items without letters or digits match nothing; items so short that their budget is 0 must occur
between spaces, for a word inside another is no passage; null ids are kept; repeated rows are judged each; empty tables give no hits.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.hashing import few_rows
from claimscope.session import cut

ERROR_RATE, BLOCK_CHARS = 0.05, 4_000_000
SHORT = math.ceil(1 / ERROR_RATE)  # shorter items have no edit in their budget
_WORDS = re.compile(r"[^\W_]+")


def normalise(text: str | None) -> str:
    return " ".join(_WORDS.findall(text.lower())) if text else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): ``budget`` + 1 parts that cover the item, as equal as can be."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of ``pattern`` in ``text`` with at most ``limit`` edits, first end on ties; else None."""
    m = len(pattern)
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        where[c] |= 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, None
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        if score <= limit and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Matcher:
    """Finds items of a block in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, short: int):
        self.items, self.ids, self.automaton = {}, [no for no, _ in items], ahocorasick.Automaton()
        held: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for no, (_, raw) in enumerate(items):  # a repeated id may have several texts
            item = normalise(raw)
            if not item:
                continue
            budget = int(error_rate * len(item)) if len(item) >= short else 0
            self.items[no] = (item, budget)
            for offset, piece in pieces(item, budget):
                held[piece].append((no, offset))
        for piece, uses in held.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.short = short
        if held:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        """Smallest distance by item id."""
        found: dict[int, int] = {}
        if not self.items or not text:
            return found
        done: dict[int, tuple[int, int]] = {}  # last window verified, by item
        for end, (size, uses) in self.automaton.iter(text):
            for no, offset in uses:
                item, budget = self.items[no]
                if found.get(no) == 0:
                    continue
                start = end + 1 - size - offset
                lo, hi = max(0, start - budget), min(len(text), start + len(item) + budget)
                if len(item) < self.short:
                    if (lo == 0 or text[lo - 1] == " ") and (hi == len(text) or text[hi] == " "):
                        found[no] = 0
                    continue
                if text.startswith(item, max(0, start)):
                    found[no] = 0
                    continue
                if done.get(no) == (lo, hi):
                    continue
                done[no] = (lo, hi)
                if (hit := myers(item, text[lo:hi], budget)) and hit[0] < found.get(no, budget + 1):
                    found[no] = hit[0]
        out: dict[int, int] = {}
        for no, distance in found.items():
            out[self.ids[no]] = min(distance, out.get(self.ids[no], distance))
        return out


@lru_cache(maxsize=2)
def _matcher(items: tuple, error_rate: float, short: int) -> Matcher:
    return Matcher(list(items), error_rate, short)


def _scan(shared, error_rate: float, short: int, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared.value, error_rate, short)
        for batch in few_rows(batches):
            rows, nos, distances = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for no, distance in matcher.find(normalise(text)).items():
                    rows.append(i)
                    nos.append(no)
                    distances.append(distance)
            held = [batch.column(c).take(pa.array(rows, pa.int32())) for c in keys]
            yield pa.RecordBatch.from_arrays([*held, pa.array(nos, pa.int64()), pa.array(distances, pa.int64())], [*keys, "item_id", "distance"])

    return run


def hits(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, short: int | None = None, block_chars: int = BLOCK_CHARS, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, item_id, distance), with other ``keys`` in place of doc_id: every document and item it holds within the item's budget; items below ``short`` characters, by default those whose budget is 0, have none."""
    spark = docs.sparkSession
    short = math.ceil(1 / error_rate) if short is None and error_rate > 0 else short or 0
    items = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    out = None
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toLocalIterator()  # about block_chars characters
        shared = spark.sparkContext.broadcast(tuple(sorted((r.item_id, r.text) for r in rows)))
        texts = docs.select(*[F.col(c).cast("long").alias(c) for c in keys], "text").filter("text is not null")
        found = texts.mapInArrow(_scan(shared, error_rate, short, list(keys)), ", ".join(f"{c} long" for c in (*keys, "item_id", "distance")))
        if blocks > 1:
            found = cut(found)
            shared.unpersist()
        out = found if out is None else out.union(found)
    return out


def contaminated(docs: DataFrame, items: DataFrame, **params) -> DataFrame:
    """One row per document with a hit: doc_id, n_items, item_ids (ascending), min_distance."""
    found = hits(docs, items, **params).groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.min("distance").alias("min_distance"))


def decontaminate(docs: DataFrame, items: DataFrame, **params) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; other texts of their ids stay. Rows with null doc_id stay."""
    row = F.xxhash64("text")
    found = hits(docs.select("doc_id", row.alias("row"), "text"), items, keys=("doc_id", "row"), **params)
    gone = found.select(F.col("doc_id").alias("_gone_id"), F.col("row").alias("_gone_row")).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col("_gone_id")) & (row == F.col("_gone_row")), "left_anti")
