"""Random access into gzip streams: a table of checkpoints, and ranges read from the one before."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN, WINDOW = 4 << 20, 32768
CHECKPOINT = "archive string, in_off long, out_off long, window binary"


def checkpoints(data: bytes, span: int = SPAN) -> list[tuple[int, int, bytes]]:
    """(compressed offset, output offset, window) at byte-aligned block ends, at least `span` output bytes apart.

    Byte-aligned ends are those of stored and flushed blocks; a stream without any has its start only, and is read from there.
    """
    d = zlib.decompressobj(31)
    out, at, found, tail = 0, 0, [(0, 0, b"")], b""
    marker = b"\x00\x00\xff\xff"
    places, k = [], data.find(marker)
    while k >= 0:
        places.append(k + 4)
        k = data.find(marker, k + 1)
    for end in [*places, len(data)]:
        part = d.decompress(data[at:end])
        out, at = out + len(part), end
        tail = (tail + part)[-WINDOW:]
        if end < len(data) and out - found[-1][1] >= span and _aligned(data, end, tail, out):
            found.append((end, out, tail))
    return found


def _aligned(data: bytes, at: int, window: bytes, out: int) -> bool:
    """Whether a block starts there: its first bytes decode from the window."""
    try:
        zlib.decompressobj(-15, zdict=window).decompress(data[at : at + 4096], 64)
    except zlib.error:
        return False
    return True


def read_range(data: bytes, off: int, n: int, points: list[tuple[int, int, bytes]]) -> bytes:
    """Output bytes [off, off + n), from the last checkpoint at or before off."""
    in_off, out_off, window = max((p for p in points if p[1] <= off), key=lambda p: p[1])
    d = zlib.decompressobj(-15, zdict=window) if in_off else zlib.decompressobj(31)
    left, out = off - out_off, b""
    for at in range(in_off, len(data), 65536):
        part = d.decompress(data[at : at + 65536])
        out += part[left:]
        left = max(0, left - len(part))
        if len(out) >= n:
            break
    return out[:n]


def export(points: list[tuple[int, int, bytes]]) -> bytes:
    """A 12-byte head (points, span) and a record of 17 bytes and the window for each point."""
    return struct.pack("<IQ", len(points), SPAN) + b"".join(struct.pack("<QQB", i, o, 0) + w.rjust(WINDOW, b"\0") for i, o, w in points)


def build(spark: SparkSession, path: str, span: int = SPAN) -> DataFrame:
    """Checkpoints of the gzip files at a path, a task a file."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                rows = checkpoints(bytes(c), span)
                yield pd.DataFrame({"archive": p, "in_off": [r[0] for r in rows], "out_off": [r[1] for r in rows], "window": [r[2] for r in rows]})

    return raw.mapInPandas(work, CHECKPOINT)


def start_points(requests: DataFrame, points: DataFrame) -> DataFrame:
    """request_id and the checkpoint to start from: as of, the greatest out_off at or before off. requests: request_id, archive, off."""
    j = requests.join(points, "archive").filter(F.col("out_off") <= F.col("off"))
    return j.groupBy("request_id").agg(F.max_by(F.struct("in_off", "out_off"), "out_off").alias("p")).select("request_id", "p.in_off", "p.out_off")
