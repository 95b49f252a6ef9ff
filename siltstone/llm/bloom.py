"""Bloom filters over 64-bit keys, built in slices on the executors and of a bounded size.

A filter only spares work: what passes is joined exactly afterwards, so false positives cost
shuffle and never rows. Its size follows the counted number of keys up to ``most_bits``; beyond
that it lets more through, and the exact join behind it still gives the whole result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICES = 1024
MOST_BITS = 1 << 29  # 64 MiB
COUNTER_BITS = 16  # bits of the filter for each one-byte counter


def bits_for(n_keys: int, most_bits: int = MOST_BITS) -> int:
    return min(most_bits, max(1 << 17, 1 << int(max(n_keys, 1) * 12).bit_length()))


def _slots(keys: np.ndarray, slice_bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(slice_bits - 1)
    return (keys & mask).astype(np.int64), ((keys >> np.uint64(27)) & mask).astype(np.int64)


def slice_column(key: str = "key"):
    """The filter's slice of a key: its top ten bits."""
    return F.shiftrightunsigned(F.col(key), 54).cast("int")


def _counters(keys: np.ndarray, slice_bits: int) -> np.ndarray:
    return ((keys >> np.uint64(13)) & np.uint64(slice_bits // COUNTER_BITS - 1)).astype(np.int64)


def build(keys: DataFrame, n_keys: int, most_bits: int = MOST_BITS, levels: bool = False):
    """Broadcast filter of the column ``key`` (bigint, already scrambled), which may be partitioned anyhow.

    At most ``SLICES`` rows, together ``bits_for(n_keys)`` bits, reach the driver; half as much again if ``levels``
    of the keys' numbers of occurrences (see ``level_of``) are asked for.
    """
    bits = bits_for(n_keys, most_bits)
    slice_bits = bits // SLICES
    spark = keys.sparkSession

    def fill(rows):
        filters: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for batch in rows:
            k = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            s = (k >> np.uint64(54)).astype(np.int64)
            order = np.argsort(s, kind="stable")
            k, s = k[order], s[order]
            edges = np.flatnonzero(np.diff(s)) + 1
            for part, at in zip(np.split(k, edges), s[np.concatenate(([0], edges))] if len(s) else []):
                bitmap = filters.setdefault(int(at), np.zeros(slice_bits, dtype=bool))
                for slot in _slots(part, slice_bits):
                    bitmap[slot] = True
                if levels:
                    own = counts.setdefault(int(at), np.zeros(slice_bits // COUNTER_BITS, dtype=np.int64))
                    own += np.bincount(_counters(part, slice_bits), minlength=len(own))
        for at, bitmap in filters.items():
            tall = np.log2(np.maximum(counts[at], 1)).astype(np.uint8).tobytes() if levels else b""
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(bitmap).tobytes()], pa.binary()), pa.array([tall], pa.binary())], ["slice", "bits", "levels"])

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = keys.select("key").repartition(width, slice_column()).mapInArrow(fill, "slice int, bits binary, levels binary").collect()
    whole = np.zeros((SLICES, slice_bits // 8), dtype=np.uint8)
    tall = np.zeros((SLICES, slice_bits // COUNTER_BITS if levels else 0), dtype=np.uint8)
    for row in slices:
        whole[row["slice"]] = np.frombuffer(row["bits"], dtype=np.uint8)
        tall[row["slice"]] = np.frombuffer(row["levels"], dtype=np.uint8)
    return spark.sparkContext.broadcast((slice_bits, whole.tobytes(), tall.tobytes()))


def might_have(shared, keys: np.ndarray) -> np.ndarray:
    """Which of the keys may be in the filter."""
    slice_bits, raw, _ = shared.value
    flat = np.frombuffer(raw, dtype=np.uint8)
    base = (keys >> np.uint64(54)).astype(np.int64) * slice_bits
    out = np.ones(len(keys), dtype=bool)
    for slot in _slots(keys, slice_bits):
        at = base + slot
        out &= ((flat[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)
    return out


def level_of(shared, keys: np.ndarray) -> np.ndarray:
    """Binary logarithm of how often a key was counted at the filter's building, or more where keys share a counter."""
    slice_bits, _, tall = shared.value
    return np.frombuffer(tall, dtype=np.uint8)[(keys >> np.uint64(54)).astype(np.int64) * (slice_bits // COUNTER_BITS) + _counters(keys, slice_bits)]
