"""Token counts by trie-shared dynamic programming over a unigram model.

Pieces and their order come from a sentencepiece model file, whose path is a parameter. A piece's log score is -ln(rank + 2): the
file's own scores are merge ranks, which are no probabilities. Bytes stand in for characters that no piece has, each at
``UNKNOWN``. A text's pre-tokens are its words at white space, each with the word-begin mark before it.

The distinct pre-tokens that a task meets are inserted in a trie in sorted order, those of a batch together. A node keeps the best score of its prefix and the number of
tokens that reach it, computed once from its ancestors; the terminal counts are kept and summed by document. Only the path to the
current node is held, for in sorted order no earlier branch is entered again, and at most ``KEPT`` terminal counts. So memory is bounded, and nothing is shuffled.

Ties in score go to the segmentation with fewer tokens, then to the longer last piece. Defined cases: null or blank text has 0; repeated rows
are counted each; a word may be of any length; null ids pass; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from claimscope.llm.hashing import chunks, few_rows

MARK, UNKNOWN, KEPT = "▁", -25.0, 1 << 20


def default_model() -> str:
    """The installed public vocabulary of 32,000 pieces."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> dict[str, float]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    return {sp.id_to_piece(i): -math.log(rank + 2) for rank, i in enumerate(normal)}


class Trie:
    """Forward scores along the path of the pre-token inserted last; insert in sorted order to share prefixes."""

    def __init__(self, pieces: dict[str, float]):
        self.ends: dict[str, float | None] = {p[i:]: None for p in pieces for i in range(1, len(p))}  # what a piece may end with, and the pieces
        self.ends |= pieces
        self.path, self.score, self.count = "", [0.0], [0]
        self.nodes = 0

    def insert(self, word: str) -> int:
        """Tokens of the best segmentation of ``word``."""
        path, score, count, get = self.path, self.score, self.count, self.ends.get
        keep, most = 0, min(len(path), len(word))
        while keep < most and path[keep] == word[keep]:
            keep += 1
        del score[keep + 1 :], count[keep + 1 :]
        for end in range(keep + 1, len(word) + 1):
            c = word[end - 1]
            n_bytes = 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
            best, tokens = score[end - 1] + UNKNOWN * n_bytes, count[end - 1] + n_bytes
            for start in range(end - 1, -1, -1):
                s = get(word[start:end], 0.0)  # piece scores are below 0
                if s == 0.0:
                    break
                if s is not None:
                    s += score[start]
                    if s > best or s == best and count[start] + 1 < tokens:
                        best, tokens = s, count[start] + 1
            score.append(best)
            count.append(tokens)
        self.nodes += len(word) - keep
        self.path = word
        return count[len(word)]


class Counts(dict):
    """Tokens of each pre-token seen by a worker; missing ones are inserted into the trie in sorted order."""

    def __init__(self, pieces: dict[str, float]):
        super().__init__()
        self.trie = Trie(pieces)

    def learn(self, found: set[str]) -> None:
        new = found - self.keys()
        if len(self) + len(new) > KEPT:  # a bound on memory only: what was forgotten is scored again
            self.clear()
            new = found
        insert = self.trie.insert
        for w in sorted(new):
            self[w] = insert(MARK + w)


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(shared.value)
        for batch in few_rows(batches):
            texts = batch.column("text").to_pylist()
            n_words, n_tokens = [], []
            for lo, hi in chunks(texts, 1 << 22):
                split = [(t or "").split() for t in texts[lo:hi]]
                counts.learn(set().union(*split))
                n_words += map(len, split)
                n_tokens += [sum(map(counts.__getitem__, ws)) for ws in split]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(model_path or default_model()))  # as large as its file
    return docs.select("doc_id", "text").mapInArrow(_count(shared), "doc_id long, n_pretokens long, n_tokens long")
