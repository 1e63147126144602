"""A Bloom filter over the keys of a table, built by Spark and broadcast: proves that a key is absent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bound of the broadcast filter, in bits (16 MB). Larger key sets fill it further: more keys then pass it, and the
#: exact join behind it has more to do, but no result changes.
MAX_BITS = 1 << 27
SEGMENT = 1 << 16
HASHES = 5


def _bits(keys: int) -> int:
    """About 10 bits a key, a power of two between one segment and MAX_BITS."""
    return min(MAX_BITS, max(SEGMENT, 1 << max(0, int(keys * 10 - 1).bit_length())))


def _positions(h2: np.ndarray) -> Iterator[np.ndarray]:
    """Double hashing: HASHES positions of each key inside its segment."""
    h = h2.astype(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    for i in range(HASHES):
        yield (a + np.uint64(i) * b) & np.uint64(SEGMENT - 1)


def _hashes(key: Column, bits: int) -> list[Column]:
    """The segment of a key and the hash that places it there."""
    return [F.pmod(F.xxhash64(key), F.lit(bits // SEGMENT)).cast("int").alias("segment"), F.xxhash64(key, F.lit(0x5EED)).alias("_h")]


def build(df: DataFrame, key: Column, keys: int) -> tuple[Broadcast, int]:
    """(broadcast bitmap, number of its bits) of the non-null keys; keys: about how many there are.

    All bits of a key are in one segment of the bitmap. Keys are shuffled by segment, 12 bytes each, and every task sets
    the bits of its own segments as the keys stream by, so the shuffle doesn't grow with the number of tasks.
    """
    bits = _bits(keys)
    size = SEGMENT // 8

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            segment, h = b.column(0).to_numpy(), b.column(1).to_numpy()
            for s in np.unique(segment):
                bitmap = own.setdefault(int(s), np.zeros(size, np.uint8))
                for at in _positions(h[segment == s]):
                    np.bitwise_or.at(bitmap, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([m.tobytes() for m in own.values()], pa.binary())], ["segment", "bitmap"])

    parts = min(bits // SEGMENT, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.where(key.isNotNull()).select(*_hashes(key, bits)).repartition(parts, "segment")
    bitmap = bytearray(bits // 8)
    for r in placed.mapInArrow(fill, "segment int, bitmap binary").collect():  # MAX_BITS at most
        bitmap[r.segment * size : (r.segment + 1) * size] = r.bitmap
    return df.sparkSession.sparkContext.broadcast(bytes(bitmap)), bits


def might_contain(key: Column, filter_: tuple[Broadcast, int]) -> Column:
    """False where the key is certainly not among those of the filter; null keys are not."""
    shared, bits = filter_

    @F.pandas_udf("boolean")
    def probe(segment: pd.Series, h: pd.Series) -> pd.Series:
        bitmap = np.frombuffer(shared.value, np.uint8)
        start = segment.to_numpy(np.uint64) * np.uint64(SEGMENT)
        hit = np.ones(len(h), bool)
        for at in _positions(h.to_numpy(np.int64)):
            at = start + at
            hit &= (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return pd.Series(hit)

    return key.isNotNull() & probe(*_hashes(key, bits))
