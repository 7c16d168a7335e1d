"""A bitmap of fixed size that tells Python workers which keys may be in a table; an exact join has to follow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2 ** 27 bits are 16 MB, whatever the table's size; with more keys more rows pass that the join then drops.
BITS = 27
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def _places(keys: np.ndarray, factor: int) -> np.ndarray:
    return (keys * np.uint64(factor)) >> np.uint64(64 - BITS)


def bitmap(keys: DataFrame) -> np.ndarray:
    """The bitmap of the keys, a table of one long column. The driver gets its words, 2 ** 21 at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate([_places(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), f) for f in _FACTORS])
            bits = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array(bits)], names=["word", "bits"])

    found = keys.mapInArrow(work, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (BITS - 6), np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return words


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The places in `keys` (64 bits each) of those that may be in the table; none that is in it is left out."""
    keys = keys.view(np.uint64)
    kept = np.arange(len(keys))
    for f in _FACTORS:
        at = _places(keys[kept], f)
        kept = kept[(words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
    return kept
