"""Word and n-gram hashes of many texts at once, with NumPy, for use inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE, _GRAM = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        tables = []
        for b in (_BASE, inverse):
            t = np.full(n + n // 4, b, dtype=np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


def polynomials(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the bytes' polynomial modulo 2**64, and the factors that take a difference of two of them to its first byte."""
    power, inverse = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=total[1:], dtype=np.uint64)
    return total, inverse


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+`` of the texts in order, and the offsets of each text's words.

    A word's hash is a polynomial of its UTF-8 bytes modulo 2**64, finalised.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    at = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=at[1:])
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1))
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _power_tables(len(buf))
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=total[1:], dtype=np.uint64)
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix64(h + (ends - starts).astype(np.uint64)), np.searchsorted(starts, at)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes; runs may cross texts, which the caller leaves out."""
    m = max(0, len(words) - n + 1)
    g = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        g = g * _GRAM + words[j : j + m]
    return mix64(g)


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small slices, so that Python holds few texts at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def chunks(texts: list[str | None], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters each; one longer text is a range of its own."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
