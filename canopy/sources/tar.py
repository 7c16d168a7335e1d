"""Tar archives (ustar, GNU, PAX; plain, gzip or xz) as entry rows."""

from __future__ import annotations

import base64
import gzip
import io
import lzma
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.schema import ENTRY

BLOCK = 512
#: Type flags and the mode bits they stand for.
FLAG_MODES = {"0": 0x8000, "7": 0x8000, "1": 0x8000, "2": 0xA000, "3": 0x2000, "4": 0x6000, "5": 0x4000, "6": 0x1000}


class BadArchive(ValueError):
    """The bytes are no archive."""


def precedence(headers: DataFrame) -> DataFrame:
    """Adds value: the local header's, else the latest global one's before or at it, else the field. archive, seq, local_value, global_value, field."""
    w = W.partitionBy("archive").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    return headers.withColumn("value", F.coalesce("local_value", F.last("global_value", ignorenulls=True).over(w), "field"))


def merge_xattrs(local, above):
    """Local attributes win, global ones fill gaps."""
    return F.map_concat(F.map_filter(above, lambda k, v: ~F.map_contains_key(local, k)), local)


def number(field: bytes) -> int:
    """Octal text, or base 256 (big-endian, after a byte 0x80 or 0xFF)."""
    if field[:1] in (b"\x80", b"\xff"):
        return int.from_bytes(field[1:], "big")
    m = re.match(rb"\s*([+-]?[0-7]+)(?:[ \0]|\Z)", field)
    if not m:
        raise BadArchive(f"no number: {field!r}")
    return int(m[1], 8)


def checksum_ok(header: bytes) -> bool:
    """The sum of all bytes, its own field as spaces, taken as unsigned or signed."""
    plain = header[:148] + b" " * 8 + header[156:]
    total = sum(plain)
    return number(header[148:156]) in (total, total - 256 * sum(b > 127 for b in plain))


def pax_records(data: bytes) -> dict[str, bytes]:
    """`LEN KEY=VALUE\\n` records; of repeated keys the last."""
    out, at = {}, 0
    while at < len(data):
        m = re.match(rb"(\d+) ([^=]+)=", data[at:])
        if not m:
            raise BadArchive("no extended header record")
        end = at + int(m[1])
        if end > len(data) or data[end - 1 : end] != b"\n":
            raise BadArchive("an extended header record has another length")
        out[m[2].decode("utf-8", "surrogateescape")] = data[at + m.end() : end - 1]
        at = end
    return out


def url_decode(text: str) -> str:
    """%XX decoded, anything else as it is."""
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode("utf-8", "surrogateescape")).decode("utf-8", "surrogateescape")


def pax_xattrs(records: dict[str, bytes]) -> dict[str, bytes]:
    out = {}
    for k, v in records.items():
        if k.startswith("SCHILY.xattr."):
            out[k[13:]] = v
        elif k.startswith("LIBARCHIVE.xattr."):
            out[url_decode(k[17:])] = base64.b64decode(v + b"=" * (-len(v) % 4))
    return out


def pax_time(text: str) -> tuple[int, int]:
    m = re.fullmatch(r"([+-]?\d+)(?:\.(\d+))?", text)
    if not m:
        raise BadArchive(f"no time: {text!r}")
    s, ns = int(m[1]), int(((m[2] or "") + "0" * 9)[:9])
    return (s - 1, 10**9 - ns) if ns and text.startswith("-") else (s, ns)


def decoded(data: bytes) -> bytes:
    if data[:2] == b"\x1f\x8b":
        return gzip.decompress(data)
    if data[:6] == b"\xfd7zXZ\0" or data[:3] == b"\x5d\0\0":
        return lzma.decompress(data)
    return data


def entries(data: bytes, source: str = "", layer: int = 0, keep: bool = True, headers_only: bool = False) -> Iterator[dict]:
    """The entries of one archive. headers_only: an archive of headers without the data between them."""
    text = lambda raw: raw.split(b"\0", 1)[0].decode("utf-8", "surrogateescape")
    view, at, seq = io.BytesIO(data), 0, 0
    shared: dict[str, bytes] = {}
    local: dict[str, bytes] = {}
    long_name = long_link = None
    while True:
        view.seek(at)
        h = view.read(BLOCK)
        if len(h) < BLOCK or not h.strip(b"\0"):
            return  # two empty blocks, or the end without them
        if not checksum_ok(h):
            raise BadArchive(f"checksum at {at}")
        flag = chr(h[156]) if h[156] else "0"
        size = number(h[124:136])
        said = {**{k: v for k, v in shared.items()}, **local}
        value = lambda k: said.get(k, b"") or None  # noqa: E731  an empty value unsets
        at += BLOCK
        if flag in "gxLK":
            view.seek(at)
            body = view.read(size)
            at += size + -size % BLOCK
            if flag == "g":
                shared = {**shared, **pax_records(body)}
            elif flag == "x":
                local = pax_records(body)
            elif flag == "L":
                long_name = text(body)
            else:
                long_link = text(body)
            continue
        if value("size"):
            size = int(value("size"))
        start, at = at, at + (0 if headers_only or flag in "123456" else size + -size % BLOCK)
        if flag in FLAG_MODES:
            prefix = text(h[345:500]) if h[257:263] == b"ustar\0" else ""
            name = text(h[:100])
            path = value("path").decode("utf-8", "surrogateescape") if value("path") else long_name or (f"{prefix}/{name}" if prefix else name)
            link = value("linkpath").decode("utf-8", "surrogateescape") if value("linkpath") else long_link or text(h[157:257])
            s, ns = pax_time(value("mtime").decode()) if value("mtime") else (number(h[136:148]), 0)
            major, minor = (number(h[329:337]), number(h[337:345])) if flag in "34" else (0, 0)
            yield {
                "source_id": source, "layer_no": layer, "seq": seq, "path": path.rstrip("/").removeprefix("./"), "linkpath": link if flag in "12" else None, "typeflag": flag,
                "mode": number(h[100:108]) & 0o7777 | FLAG_MODES[flag], "uid": int(value("uid") or number(h[108:116])), "gid": int(value("gid") or number(h[116:124])),
                "size": size if flag in "07" else len(link) if flag == "2" else 0, "mtime_s": s, "mtime_ns": ns, "rdev": (minor & 0xFF) | major << 8 | (minor & ~0xFF) << 12,
                "data_off": start, "xattrs": {**pax_xattrs(shared), **pax_xattrs(local)}, "data": data[start : start + size] if keep and flag in "07" and not headers_only else None,
            }
            seq += 1
        local, long_name, long_link = {}, None, None


def read(spark: SparkSession, path: str, data: bool = False, headers_only: bool = False) -> DataFrame:
    """Entry rows of the archives at a path; parallel across archives. data: with file bytes. An archive that is none raises."""
    schema = ENTRY + (", data binary" if data else "")
    names = [x.split()[0] for x in ENTRY.split(", ")] + (["data"] if data else [])
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for source, content in zip(b["path"], b["content"], strict=True):
                rows = []
                for e in entries(decoded(content), source, keep=data, headers_only=headers_only):
                    rows.append([e[n] for n in names])
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return raw.mapInPandas(work, schema)
