"""Exact substring dedup across documents with suffix automata of reference shards.

A window is 13 consecutive words. A word goes if a window that covers it also starts in a document with a smaller id.

1. Each window picks its minimizer, the smallest hash among its six 8-word grams. Equal windows pick the same one, so a window
   can only repeat where its minimizer is in at least two documents. One aggregation of minimizer hashes finds those.
2. Neighbouring windows with one minimizer form an anchor: 13 to 18 words. Anchors whose minimizer repeats are kept. Those of a minimizer in more than
   ``HOT`` documents are cut into their windows, so that a passage that very many documents share in different contexts is one anchor.
3. The anchors, each wording once a task with its smallest document, are the reference text. It is dealt into shards by minimizer and, for hot minimizers,
   by window. Each shard becomes suffix automata of bounded size whose states carry the smallest document; the anchors are
   streamed through, and the matching statistics give for each window the smallest document that has it.
4. Decisions go back to the documents by id and the covered words are removed.

The automata are co-located with what they are matched against instead of broadcast: the reference grows with the corpus, and a
broadcast of it has no bound. A bitmap of repeated minimizer hashes of at most 64 MB is broadcast as a
filter only; what passes it by chance is matched with itself alone, and above that size a join takes its place.

Minimizers are compared by 64-bit and words by 40-bit hashes. Defined cases: null or empty text has no words, n_words 0; documents below 13 words keep all;
null doc_id rows are compared with no one and lose nothing; a repeated id is one document to the rule (its rows do not count as
smaller), and each of its rows is reported; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.bitmap import Filter, bitmap, touched
from claimscope.llm.hashing import chunks, few_rows, gram_hashes, mix64, word_hashes
from claimscope.session import cut

WINDOW, GRAM = 13, 8
GRAMS = WINDOW - GRAM + 1
WORD, HOT, AUTOMATON_WORDS, SEEN = 5, 2_048, 20_000, 1 << 18


def anchors(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc index, minimizer hash, first window, number of windows) of each anchor; windows are word positions in ``words``."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = doc[:n] == doc[WINDOW - 1 :]
    g = gram_hashes(words, GRAM)
    low, place = g[GRAMS - 1 : GRAMS - 1 + n].copy(), np.arange(n) + GRAMS - 1
    for k in range(GRAMS - 2, -1, -1):
        less = g[k : k + n] <= low
        low, place = np.where(less, g[k : k + n], low), np.where(less, np.arange(n) + k, place)
    new = np.ones(n, dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | ~inside[:-1] | (doc[1:n] != doc[: n - 1])
    first = np.flatnonzero(new & inside)
    ends = np.flatnonzero(np.concatenate([new[1:] | ~inside[1:], [True]]) & inside)
    return doc[first], low[first], first, ends - first + 1


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in few_rows(batches):
        ids, rows, texts = batch.column("doc_id"), batch.column("row"), batch.column("text").to_pylist()
        for lo, hi in chunks(texts):
            words, at = word_hashes(texts[lo:hi])
            yield ids.slice(lo, hi - lo), rows.slice(lo, hi - lo), words, at, *anchors(words, at)


def _minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, _, _, doc, h, _, _ in _texts(batches):
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        once = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, dtype=bool)
        yield pa.RecordBatch.from_arrays([pa.array(h[once].view(np.int64))], ["h"])


def _context(words: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """The words from ``first`` on, ``size`` of them, as WORD bytes each."""
    ends = np.cumsum(size)
    at = np.repeat(first, size) + np.arange(ends[-1] if len(size) else 0) - np.repeat(ends - size, size)
    offsets = np.concatenate([[0], ends * WORD]).astype(np.int32)
    data = np.ascontiguousarray(words[at].view(np.uint8).reshape(-1, 8)[:, :WORD])
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _wordings(words: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A number that is equal for equal anchors."""
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(gram_hashes(words, WINDOW), dtype=np.uint64)])
    return total[first + count] - total[first] + count.astype(np.uint64)


def _repeated(shared, hot):
    """For the anchors of a slice whose minimizers are shared, those of hot ones cut into windows: their documents, rows and the arrays of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for ids, rows, words, at, doc, h, first, count in _texts(batches):
            keep = shared.value(h)
            doc, h, first, count = doc[keep], h[keep], first[keep], count[keep]
            if hot.value.bits is not None:
                split = hot.value(h)
                pieces = np.where(split, count, 1)
                offset = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                doc, h, first, count, split = (np.repeat(x, pieces) for x in (doc, h, first, count, split))
                first, count = first + offset, np.where(split, 1, count)
            else:
                split = np.zeros(len(h), dtype=bool)
            yield ids, rows, words, at, doc, h, _wordings(words, first, count), first, count, split

    return run


def _places(shared, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows, _, at, doc, h, same, first, count, _ in _repeated(shared, hot)(batches):
            cols = [ids.take(pa.array(doc)), rows.take(pa.array(doc)), *(pa.array(x.view(np.int64)) for x in (h, same)), *(pa.array(x.astype(np.int32)) for x in (first - at[doc], count))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row", "h", "same", "start", "n"])

    return run


def _references(shared, hot, salts: int):
    """Anchors with their words, a wording again only for a smaller document; those of hot minimizers are salted by wording."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for ids, _, words, _, doc, h, same, first, count, split in _repeated(shared, hot)(batches):
            owner = ids.to_numpy(zero_copy_only=False)[doc]
            order = np.lexsort((owner, same, h))
            h, same, first, count, owner, split = (x[order] for x in (h, same, first, count, owner, split))
            once = np.ones(len(h), dtype=bool)
            once[1:] = (h[1:] != h[:-1]) | (same[1:] != same[:-1])
            if len(seen) > SEEN:  # a bound on memory only: what was forgotten is sent again
                seen.clear()
            at = np.flatnonzero(once)
            new = []
            for i, key, d in zip(at.tolist(), (mix64(h[at]) ^ same[at]).tolist(), owner[at].tolist(), strict=True):
                if d < seen.get(key, d + 1):
                    seen[key] = d
                    new.append(i)
            h, same, first, count, owner, split = (x[new] for x in (h, same, first, count, owner, split))
            salt = np.where(split, 1 + (same % np.uint64(salts)).astype(np.int64), 0) if len(h) else np.zeros(0)
            cols = [*(pa.array(x.view(np.int64)) for x in (h, same)), pa.array(salt.astype(np.int32)), _context(words, first, count + WINDOW - 1), pa.array(owner)]
            yield pa.RecordBatch.from_arrays(cols, ["h", "same", "salt", "context", "doc"])

    return run


class SuffixAutomaton:
    """Of several word strings; each state knows the smallest document that has its substrings."""

    def __init__(self):
        self.next, self.link, self.length, self.doc = [{}], [-1], [0], [None]

    def add(self, words: list[int], doc: int) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)
            if self.doc[last] is None or doc < self.doc[last]:
                self.doc[last] = doc

    def _clone(self, p: int, w: int, q: int) -> int:
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.doc.append(None)
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # another string has this prefix already
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        cur = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        self.doc.append(None)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return cur

    def close(self) -> None:
        """Carry the smallest document from longer substrings to their suffixes."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            d, p = self.doc[s], self.link[s]
            if p > 0 and d is not None and (self.doc[p] is None or d < self.doc[p]):
                self.doc[p] = d

    def match(self, words: list[int], size: int) -> list[int | None]:
        """For each window of ``size`` words the smallest document that has it, by matching statistics."""
        out, state, n = [], 0, 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            while state and self.length[self.link[state]] >= size:
                state = self.link[state]
                n = self.length[state]
            if i >= size - 1:
                out.append(self.doc[state] if n >= size else None)
        return out


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, salt): automata of whole groups, of about AUTOMATON_WORDS words; a group may straddle batches."""
    held: dict[tuple, list] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        automaton = SuffixAutomaton()
        for words, doc in held.values():
            automaton.add(words, doc)
        automaton.close()
        firsts = [automaton.match(words, WINDOW) for words, _ in held.values()]
        cols = [pa.array([k[i] for k in held], type=pa.int64()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(firsts, type=pa.list_(pa.int64()))], ["h", "same", "firsts"])

    group = None
    for large in batches:
        for batch in few_rows([large], 4_096):
            for h, same, salt, context, doc in zip(*(batch.column(c).to_pylist() for c in ("h", "same", "salt", "context", "doc")), strict=True):
                if (h, salt) != group and size >= AUTOMATON_WORDS:
                    yield flush()
                    held, size = {}, 0
                group = (h, salt)
                if (known := held.get((h, same))) is not None:
                    known[1] = min(known[1], doc)
                    continue
                raw = np.zeros((len(context) // WORD, 8), dtype=np.uint8)
                raw[:, :WORD] = np.frombuffer(context, dtype=np.uint8).reshape(-1, WORD)
                held[h, same] = [raw.view(np.int64).ravel().tolist(), doc]
                size += len(raw)
    if held:
        yield flush()


def _keyed(docs: DataFrame) -> DataFrame:
    """``row`` tells apart rows of one id with different texts, if there are any."""
    unique = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    return docs.select("doc_id", "text", (F.lit(0) if unique else F.hash("text")).alias("row"))


def removals(keyed: DataFrame) -> DataFrame:
    """(doc_id, row, windows): first words of the windows to remove, for documents that have any."""
    broadcast = keyed.sparkSession.sparkContext.broadcast
    texts = keyed.filter("doc_id is not null and text is not null")
    repeated = cut(texts.mapInArrow(_minimizers, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    bits = bitmap(repeated.select("h"))
    hot = repeated.filter(F.col("n") > HOT)
    most = hot.agg(F.max("n")).first()[0] or 0
    hot_bits = bitmap(hot.select("h"), 64) if most else None
    known, split = broadcast(Filter(bits)), broadcast(Filter(hot_bits))

    reference = texts.mapInArrow(_references(known, split, 1 + 6 * most // HOT), "h long, same long, salt int, context binary, doc long")
    found = texts.mapInArrow(_places(known, split), "doc_id long, row int, h long, same long, start int, n int")
    if bits is None:
        reference, found = (df.join(repeated.select("h"), "h", "left_semi").select(*df.columns) for df in (reference, found))
    matched = reference.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(_match, "h long, same long, firsts array<long>")

    key = F.xxhash64("h", "same").alias("key")
    judged = found.select("doc_id", "row", "start", key).join(matched.select("firsts", key), "key")
    gone = F.filter(F.transform("firsts", lambda d, i: F.when(d < F.col("doc_id"), F.col("start") + i)), lambda x: x.isNotNull())
    judged = judged.select("doc_id", "row", gone.alias("windows")).filter(F.size("windows") > 0)
    return judged.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("windows")).alias("windows"))


def _keep(with_text: bool, touching=None):
    """Rows with what is left of them; with ``touching`` only those that the filter rules out, in the same process."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = touched(touching, False)(batches) if touching else batches
        for batch in few_rows(batches):
            rows = []
            for text, windows in zip(batch.column("text").to_pylist(), batch.column("windows").to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                kept = words
                if windows:
                    edge = np.zeros(len(words) + 1, dtype=np.int32)
                    starts = np.unique(windows)
                    edge[starts] += 1
                    np.subtract.at(edge, starts + WINDOW, 1)
                    kept = [w for w, c in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not c]
                joined = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), (text if not windows else joined.decode("utf-8", "surrogatepass")) if with_text else None))
            n_words, n_removed, digest, kept_text = zip(*rows, strict=True) if rows else ((), (), (), ())
            cols = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c not in ("text", "windows")), *cols], [*(c for c in batch.schema.names if c not in ("text", "windows")), "n_words", "n_removed", "kept_sha256", "text"])

    return run


def _judged(docs: DataFrame, with_text: bool) -> DataFrame:
    """Only the texts that may lose words, by a bitmap of their keys, are shuffled to their removals."""
    keyed, key = _keyed(docs), F.xxhash64("doc_id", "row").alias("h")
    gone = cut(removals(keyed))
    shared = docs.sparkSession.sparkContext.broadcast(Filter(bitmap(gone.select(key), 64)))
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"
    lost = keyed.select("doc_id", "text", "row", key).mapInArrow(touched(shared), "doc_id long, text string, row int").join(gone, ["doc_id", "row"], "left")
    whole = keyed.select("doc_id", "text", F.lit(None).cast("array<int>").alias("windows"), key).mapInArrow(_keep(with_text, shared), kind)
    return lost.select("doc_id", "text", "windows").mapInArrow(_keep(with_text), kind).unionByName(whole)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``docs``."""
    return _judged(docs, False).drop("text")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) for each row; where words were removed the kept ones are joined by one space."""
    return _judged(docs, True).select("doc_id", "text")
