"""Checksums and hashes that Spark does not have in this form."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CASTAGNOLI = 0x82F63B78


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(CASTAGNOLI), t >> 1).astype(np.uint32)
    return t


_TABLE = _crc_table().tolist()
CRC_BLOCK = 1024


@cache
def _crc_places() -> np.ndarray:
    """[i, b]: the checksum, from 0, of byte b at place i of a block and zeros up to the block's end."""
    t = _crc_table()
    out = np.empty((CRC_BLOCK, 256), np.uint32)
    out[-1] = t
    for i in range(CRC_BLOCK - 2, -1, -1):
        out[i] = out[i + 1] >> 8 ^ t[out[i + 1] & 0xFF]
    return out


def crc32c(data: bytes, crc: int = 0xFFFFFFFF) -> int:
    """CRC-32C from a start value, not inverted at the end.

    The checksum is linear: a block's is the XOR of what its bytes give at their places, and the value before the block counts
    as four more bytes in front, XORed into its first ones.
    """
    t, place, head = _crc_places(), np.arange(CRC_BLOCK), len(data) % CRC_BLOCK
    if head < 4:
        for b in data[:head]:
            crc = crc >> 8 ^ _TABLE[(crc ^ b) & 0xFF]
    else:
        x = np.frombuffer(data, np.uint8, head).copy()
        x[:4] ^= np.frombuffer(crc.to_bytes(4, "little"), np.uint8)
        crc = int(np.bitwise_xor.reduce(t[place[-head:], x]))
    first = t[:4].tolist()
    x = np.frombuffer(data, np.uint8)[head:].reshape(-1, CRC_BLOCK)
    for at in range(0, len(x), 1024):
        for own in np.bitwise_xor.reduce(t[place, x[at : at + 1024]], axis=1).tolist():
            crc = own ^ first[0][crc & 0xFF] ^ first[1][crc >> 8 & 0xFF] ^ first[2][crc >> 16 & 0xFF] ^ first[3][crc >> 24]
    return crc


def crc32c_column(c: Column) -> Column:
    @F.pandas_udf("long")
    def f(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else crc32c(bytes(x)))

    return f(c)


def xxh64_column(c: Column, seed: int = 0) -> Column:
    """XXH64 as a signed number (Spark's own uses seed 42)."""

    @F.pandas_udf("long")
    def f(v: pd.Series) -> pd.Series:
        import xxhash

        return v.map(lambda x: None if x is None else int.from_bytes(xxhash.xxh64(bytes(x), seed=seed).digest(), "big", signed=True))

    return f(c)


def xxh32(data: bytes, seed: int = 0) -> int:
    import xxhash

    return xxhash.xxh32(data, seed=seed).intdigest()


def bkdr(data: bytes, seed: int = 131313) -> int:
    """Multiply and add over signed bytes, modulo 2 ** 32."""
    h = 0
    for b in data:
        h = (h * seed + (b - 256 if b > 127 else b)) & 0xFFFFFFFF
    return h


def fnv1(data: bytes) -> int:
    """FNV-1, 32 bits."""
    h = 0x811C9DC5
    for b in data:
        h = (h * 0x01000193 & 0xFFFFFFFF) ^ b
    return h


def name_filter(names: list[tuple[int, bytes]], seed: int = 0x25BBE08F) -> int:
    """A 32-bit filter over (prefix index, rest of the name) in which a set bit means that no name has it."""
    bits = 0
    for index, rest in names:
        bits |= 1 << (xxh32(rest, (seed + index) & 0xFFFFFFFF) & 31)
    return ~bits & 0xFFFFFFFF
