"""Scans of local or shared folders, rule files, ranged reads, records with a length before them, and option lists."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

STAT = "path string, mode int, uid long, gid long, nlink long, size long, mtime_s long, mtime_ns int, rdev long, dev long, ino long"


def _stat(root: str, path: str) -> list:
    s = os.lstat(os.path.join(root, path))
    rdev = s.st_rdev
    packed = (os.minor(rdev) & 0xFF) | os.major(rdev) << 8 | (os.minor(rdev) & ~0xFF) << 12
    return [path, s.st_mode, s.st_uid, s.st_gid, s.st_nlink, s.st_size if s.st_mode & 0xF000 in (0x8000, 0xA000) else 0, s.st_mtime_ns // 10**9, s.st_mtime_ns % 10**9, packed, s.st_dev, s.st_ino]


def scan(spark: SparkSession, root: str, skip: Callable[[str], bool] | None = None) -> DataFrame:
    """Stat rows of all that is below a folder which the executors see too; skip(path) hides an entry and what is below it.

    The folder's own entries are dealt out, and each task walks what it got.
    """
    skip = skip or (lambda p: False)
    top = [e for e in sorted(os.listdir(root)) if not skip(e)]
    names = [x.split()[0] for x in STAT.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in b["path"]:
                todo, rows = [start], []
                while todo:
                    p = todo.pop()
                    rows.append(_stat(root, p))
                    full = os.path.join(root, p)
                    if os.path.isdir(full) and not os.path.islink(full):
                        todo += [f"{p}/{e}" for e in sorted(os.listdir(full), reverse=True) if not skip(f"{p}/{e}")]
                    if len(rows) >= 1000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    if not top:
        return spark.createDataFrame([], STAT)
    return spark.createDataFrame([(t,) for t in top], "path string").repartition(min(len(top), 256)).mapInPandas(work, STAT)


def read_range(get: Callable[[int, int], tuple[int, bytes]], off: int, n: int, size: int, fill: bool = False) -> bytes:
    """[off, off + n) of an object of a size. get(start, count) returns a status and bytes: 206 is the range, 200 the whole object,
    which is cut here; others raise. fill: zeros beyond the end, else a short answer."""
    count = max(0, min(n, size - off))
    data = b""
    if count:
        status, data = get(off, count)
        if status == 200:
            data = data[off : off + count]
        elif status != 206:
            raise OSError(f"status {status}")
    return data + bytes(n - len(data)) if fill else data


def length_prefixed(data: bytes, at: int = 0, count: int | None = None) -> list[bytes]:
    """Records with a 16-bit length before them, each aligned to 4 bytes."""
    out = []
    while at + 2 <= len(data) and (count is None or len(out) < count):
        (n,) = struct.unpack_from("<H", data, at)
        if at + 2 + n > len(data):
            raise ValueError("a record runs beyond the end")
        out.append(data[at + 2 : at + 2 + n])
        at += 2 + n
        at += -at % 4
    return out


def options(text: str, known: set[str]) -> dict[str, str | bool]:
    """`name`, `^name` (off) and `name=value`, separated by commas."""
    out: dict[str, str | bool] = {}
    for part in filter(None, text.split(",")):
        m = re.fullmatch(r"(\^?)([^=^]+)(?:=(.+))?", part)
        if not m or m[2] not in known or (m[1] and m[3]):
            raise ValueError(f"option {part!r}")
        out[m[2]] = m[3] if m[3] is not None else not m[1]
    return out
