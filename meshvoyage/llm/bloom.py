"""Bloom filters over 64-bit hashes, built by tasks, merged by chunk, and broadcast."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROBES = 4
CHUNK = 1 << 16  # bytes of a filter that travel as one row
#: Largest filter (32 MB), the bound of what is broadcast.  Beyond it a filter lets more
#: through; what follows is exact in any case.
MAX_BITS = 1 << 28


def size_for(entries: int, bits_each: int = 16) -> int:
    return min(MAX_BITS, max(8 * CHUNK, 1 << (max(1, entries) * bits_each - 1).bit_length()))


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return (hashes[None, :] + np.arange(PROBES, dtype=np.uint64)[:, None] * step[None, :]) & np.uint64(bits - 1)


def packed(hashes: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits // 8, np.uint8)
    if len(hashes):
        at = np.unique(positions(hashes, bits).ravel())
        byte, bit = (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
        out[byte[first]] = np.bitwise_or.reduceat(bit, first)
    return out


def hits(filter_: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = positions(hashes, bits)
    return ((filter_[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def gathered(chunks: DataFrame, bits: int):
    """The broadcast of a filter from its rows (chunk, compressed bytes), at most MAX_BITS."""
    whole = np.zeros(bits // 8, np.uint8)
    for c, part in chunks.toLocalIterator():
        whole[c * CHUNK : (c + 1) * CHUNK] |= np.frombuffer(zlib.decompress(part), np.uint8)
    return chunks.sparkSession.sparkContext.broadcast(zlib.compress(whole.tobytes(), 1))


def opened(shared) -> np.ndarray:
    return np.frombuffer(zlib.decompress(shared.value), np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _build_members(bits: int):
    def run(batches):
        own = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        if own:
            whole = packed(mix(np.concatenate(own)), bits)
            for c in range(0, bits // 8, CHUNK):
                if whole[c : c + CHUNK].any():
                    yield pa.RecordBatch.from_arrays([pa.array([c // CHUNK], pa.int32()), pa.array([zlib.compress(whole[c : c + CHUNK].tobytes(), 1)], pa.binary())], ["chunk", "bits"])

    return run


def _merge_members(batches):
    seen: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(part), np.uint8)
            seen[c] = seen[c] | x if c in seen else x
    for c, x in seen.items():
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["chunk", "bits"])


def members(ids: DataFrame, bits: int):
    """The broadcast filter of a one-column table of integers, by their ``mix``."""
    plain = ids.select(F.col(ids.columns[0]).cast("bigint").alias("h")).where("h IS NOT NULL")
    parts = plain.mapInArrow(_build_members(bits), "chunk int, bits binary").repartition("chunk")
    return gathered(parts.mapInArrow(_merge_members, "chunk int, bits binary"), bits)
