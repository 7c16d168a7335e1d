"""Codecs: registry, sizes of files under a codec, clusters of fixed compressed size, raw layouts."""

from __future__ import annotations

import importlib.util
import lzma
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

LEVELS = {"deflate": (0, 9), "lzma": (0, 9), "zstd": (1, 22), "lz4": (0, 0), "lz4hc": (1, 12)}
#: Codecs whose data the same decoder reads.
FORMATS = {"lz4hc": "lz4", "libdeflate": "deflate"}


class UnknownCodec(ValueError):
    """No codec of that name, or one whose library is missing here."""


def parse(spec: str) -> list[dict]:
    """`alg,level=9,dictsize=65536:alg...`; a bare number after the name is the level."""
    out = []
    for part in spec.split(":"):
        name, *opts = part.split(",")
        base = "deflate" if name == "libdeflate" else name
        if base not in LEVELS:
            raise UnknownCodec(name)
        conf = {"alg": name, "level": None, "dict_size": None}
        for o in opts:
            k, _, v = o.rpartition("=")
            field = {"": "level", "level": "level", "dictsize": "dict_size"}.get(k)
            if field is None or not v.isdigit():
                raise UnknownCodec(f"option {o} of {name}")
            conf[field] = int(v)
        low, high = LEVELS[base]
        if conf["level"] is not None and not low <= conf["level"] <= high:
            raise UnknownCodec(f"level {conf['level']} of {name}")
        if conf["dict_size"] is not None and base not in ("lzma", "deflate", "zstd"):
            raise UnknownCodec(f"{name} has no dictionary")
        out.append(conf)
    return out


def compressor(name: str, level: int | None = None) -> Callable[[bytes], bytes]:
    name = "deflate" if name == "libdeflate" else name
    if name == "deflate":

        def deflate(data: bytes) -> bytes:
            c = zlib.compressobj(9 if level is None else level, zlib.DEFLATED, -15)
            return c.compress(data) + c.flush()

        return deflate
    if name == "lzma":
        return lambda data: lzma.compress(data, lzma.FORMAT_ALONE, preset=6 if level is None else level)
    if name == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=level or 3).compress
    if name in ("lz4", "lz4hc") and importlib.util.find_spec("lz4"):
        import lz4.block

        return lambda data: lz4.block.compress(data, mode="high_compression" if name == "lz4hc" else "default", store_size=False)
    raise UnknownCodec(name)


def decompress(name: str, data: bytes, size: int, padded: bool = False) -> bytes:
    """The first `size` bytes of what data decodes to; padded: zeros before the data are skipped."""
    data = data.lstrip(b"\0") if padded else data
    name = FORMATS.get(name, name)
    if name == "deflate":
        return zlib.decompressobj(-15).decompress(data, size)
    if name == "lzma":
        return lzma.LZMADecompressor(lzma.FORMAT_ALONE).decompress(data, size)
    if name == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)[:size]
    if name == "lz4" and importlib.util.find_spec("lz4"):
        import lz4.block

        return lz4.block.decompress(data, uncompressed_size=size)
    raise UnknownCodec(name)


def fill_cluster(data: bytes, size: int, compress: Callable[[bytes], bytes]) -> tuple[int, bytes]:
    """How much of data, from its start, compresses into `size` bytes, and those bytes: by bisection over the input's length."""
    low, best = 0, b""
    high = len(data)
    step = min(len(data), size)
    while low < high:
        mid = min(high, low + step) if step else (low + high + 1) // 2
        c = compress(data[:mid])
        if len(c) <= size:
            low, best = mid, c
            step = step * 2 if step else 0
        else:
            high, step = mid - 1, 0
    return low, best


def worth(raw: int, coded: int, threshold: int = 100, block: int = 4096) -> bool:
    """Whether a cluster's blocks, in per cent by the threshold, are fewer bytes than its input."""
    return -(-coded // block) * block * threshold // 100 < raw


def clusters(data: bytes, size: int, name: str, level: int | None = None) -> list[tuple[int, int, bytes, bool]]:
    """(offset, length, stored bytes, raw) of a file cut into clusters of at most `size` stored bytes."""
    c, at, out = compressor(name, level), 0, []
    while at < len(data):
        n, coded = fill_cluster(data[at:], size, c)
        if n and worth(n, len(coded), block=size):
            out.append((at, n, coded, False))
        else:
            n = min(size, len(data) - at)
            out.append((at, n, data[at : at + n], True))
        at += n
    return out


def rotated(data: bytes, shift: int) -> bytes:
    """Raw data stored from an offset within a block round to its start."""
    return data[-shift:] + data[:-shift] if shift else data


def sizes(files: DataFrame, name: str, level: int | None = None, segment: int = 1 << 20, key: str = "path", content: str = "content") -> DataFrame:
    """key, raw_size, coded_size: each file's bytes under a codec, segment by segment, raw where coding does not pay."""
    compressor(name, level)  # fails here rather than in tasks

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = compressor(name, level)
        for b in batches:
            raw, coded = [], []
            for v in b.column(1):
                data = v.as_py() or b""
                raw.append(len(data))
                coded.append(sum(min(len(c(data[i : i + segment])), len(data[i : i + segment])) for i in range(0, len(data), segment)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.int64()), pa.array(coded, pa.int64())], names=[key, "raw_size", "coded_size"])

    return files.select(key, content).mapInArrow(work, f"{key} {files.schema[key].dataType.simpleString()}, raw_size long, coded_size long")
