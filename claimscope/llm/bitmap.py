"""A bitmap of hashed keys: a filter of bounded size that may pass strangers but loses no member."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BITS = 1 << 29


class Filter:
    """Membership of hashes in a bitmap, or everything if there is none."""

    def __init__(self, bits: np.ndarray | None):
        self.bits = bits

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(h), dtype=bool)
        b = (h & np.uint64(len(self.bits) * 8 - 1)).astype(np.int64)
        return (self.bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1


def bitmap(hashes: DataFrame, each: int = 32) -> np.ndarray | None:
    """Bits of the column ``h``, at least ``each`` a hash and at most MAX_BITS; None above that. What reaches the driver is this bitmap alone."""
    n = hashes.count()
    size = max(1 << 20, 1 << (each * n).bit_length())
    if size > MAX_BITS:
        return None
    bit = F.col("h").bitwiseAND(F.lit(size - 1))
    parts = hashes.select(F.shiftright(bit, 15).alias("part"), bit.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(size // 8, dtype=np.uint8)
    for row in parts.collect():  # size / 8 bytes
        out[row.part * 4096 : row.part * 4096 + len(row.bits)] = np.frombuffer(row.bits, dtype=np.uint8)
    return out


def touched(shared, wanted: bool = True):
    """For mapInArrow: the rows whose hash, in the column ``h``, is in the filter or, if not ``wanted``, is not; without ``h``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(shared.value(h) == wanted)).drop_columns(["h"])

    return run
