"""Words of a task's texts as small integers, and fixed-size hash filters over words.

A filter holds one bit per hash value. It lets some other words through, never loses one of
its own, and its size does not depend on the number of words; whoever uses it compares the
words themselves later on.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter (4 MB); collecting one brings at most FILTER_BITS / 64 rows to the driver.
FILTER_BITS = 1 << 25


class Numbering(dict):
    """Numbers words in the order in which they are first looked up."""

    def __missing__(self, word):
        self[word] = i = len(self)
        return i


def word_hashes(words, space: str = "") -> np.ndarray:
    """64-bit hashes of words (bytes); equal words of different spaces (languages) differ."""
    seed = zlib.crc32(space.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of word pairs from the hashes of their words."""
    h = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second + (first >> np.uint64(29)))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _bits(bits):
    def run(batches):
        for b in batches:
            spaces, second = b.column("space").to_pylist(), b.column("w2")
            first = _row_hashes(b.column("w1").to_pylist(), spaces)
            h = first if second.null_count == len(second) else pair_hashes(first, _row_hashes(second.to_pylist(), spaces))
            at = np.unique(h & np.uint64(bits - 1))
            slots, starts = np.unique(at >> np.uint64(6), return_index=True)
            masks = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), starts) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(masks.view(np.int64))], ["slot", "mask"])
    return run


def _row_hashes(words, spaces):
    seeds = {s: zlib.crc32(s.encode()) for s in set(spaces)}
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode(), seeds[s]) for w, s in zip(words, spaces, strict=True)), np.uint64, len(words))


def word_filter(words: DataFrame, bits: int = FILTER_BITS):
    """A broadcast filter over the rows (space, w1, w2) of words (w2 null in every row) or of word pairs."""
    return _collected(words.select("space", "w1", "w2").mapInArrow(_bits(bits), "slot long, mask long"), bits)


def hash_filter(hashes: DataFrame, bits: int = FILTER_BITS):
    """A broadcast filter over a column h of 64-bit hashes."""
    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    return _collected(hashes.select(F.shiftrightunsigned(at, 6).alias("slot"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("mask")), bits)


def _collected(parts: DataFrame, bits: int):
    found = parts.groupBy("slot").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    table = np.zeros(bits >> 6, np.int64)
    table[found.column("slot").to_numpy()] = found.column("mask").to_numpy()
    return parts.sparkSession.sparkContext.broadcast(table.tobytes())


def passes(raw: bytes, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be one of the filter's."""
    table = np.frombuffer(raw, np.uint64)
    at = hashes & np.uint64((len(table) << 6) - 1)
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
