"""Motion-JPEG in AVI: frames of lossless JPEG, RIFF indexes, shots and timed clips.

Encoding stores bytes as 8-bit samples, 64 a line and `LINES` lines a frame, each frame a lossless JPEG (process 14: the
difference to the left neighbour, Huffman coded) whose lines are restart intervals. The lines of a batch are coded side by
side, sample by sample, so the work is numpy's. Decoding reads the AVI's idx1, each frame's DHT, SOF3 and DRI, and the
entropy-coded lines. Shots end where the difference of neighbouring histograms stands out against those of the shot so far.

Cases: null is the empty text, stored as one line of zeros; texts of any length are stored whole, in bounded batches; equal
texts give equal values; an empty table gives an empty result; further columns are not read. AVI's 32-bit sizes hold
payloads up to about 2 GB; larger ones raise. Frames in other JPEG processes than the lossless one raise.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.common import table, text_or_empty

WIDTH, LINES, FPS = 64, 16, 25
#: Fixed values of our files: code lengths of the difference categories, most frequent first.
CODE_SIZES = ((5, 2), (4, 2), (3, 3), (7, 3), (2, 4), (6, 4), (1, 5), (0, 5), (8, 6))
#: Payload bytes that are coded together, about.
AT_ONCE = 4 << 20
BINS = 32
MEMORY, SPREAD, LEAST = 8, 3.0, 0.25


def huffman_codes(sizes: tuple[tuple[int, int], ...]) -> dict[int, tuple[int, int]]:
    """category -> (code, length), canonical: lengths rise, codes count up."""
    codes, code, last = {}, 0, 0
    for cat, n in sizes:
        code <<= n - last
        codes[cat], last = (code, n), n
        code += 1
    return codes


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    codes = huffman_codes(CODE_SIZES)
    value, size = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        code, n = codes[cat]
        extra = d if d >= 0 else d + (1 << cat) - 1
        value[d + 255], size[d + 255] = code << cat | extra, n + cat
    return value, size


DIFF_CODE, DIFF_SIZE = _difference_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def frame_header(lines: int) -> bytes:
    counts = bytes(sum(1 for _, n in CODE_SIZES if n == k) for k in range(1, 17))
    return (
        b"\xff\xd8"
        + _segment(0xC4, b"\x00" + counts + bytes(c for c, _ in CODE_SIZES))
        + _segment(0xC3, struct.pack(">BHHB", 8, lines, WIDTH, 1) + b"\x01\x11\x00")
        + _segment(0xDD, struct.pack(">H", WIDTH))
        + _segment(0xDA, b"\x01\x01\x00\x01\x00\x00")
    )


HEADERS = {n: frame_header(n) for n in range(1, LINES + 1)}


def encode_lines(samples: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Entropy-coded lines of samples [n, WIDTH]; number: each line's number in its frame.

    Returns the bytes, where each line starts, and where it ends without the restart marker after it.
    """
    n = len(samples)
    diff = np.empty((n, WIDTH), np.int16)
    diff[:, 0] = samples[:, 0].astype(np.int16) - 128
    np.subtract(samples[:, 1:], samples[:, :-1], out=diff[:, 1:], dtype=np.int16)
    diff += 255
    sizes = DIFF_SIZE[diff]
    bits = sizes.sum(1)
    held = (bits + 7) >> 3
    start = np.cumsum(held) - held
    raw = np.zeros(int(held.sum()) + 4, np.uint8)
    at = start * 8
    for j in range(WIDTH):
        size = sizes[:, j]
        code = DIFF_CODE[diff[:, j]] << (24 - (at & 7) - size).astype(np.uint32)
        byte = at >> 3
        raw[byte] |= (code >> 16).astype(np.uint8)
        raw[byte + 1] |= (code >> 8 & 255).astype(np.uint8)
        raw[byte + 2] |= (code & 255).astype(np.uint8)
        at += size
    raw = raw[: int(held.sum())]
    raw[start + held - 1] |= ((1 << (-bits & 7)) - 1).astype(np.uint8)
    full = raw == 0xFF
    shift = np.cumsum(full) - full + 2 * np.repeat(np.arange(n), held)
    total = len(raw) + int(full.sum()) + 2 * n
    out = np.zeros(total, np.uint8)
    dest = np.arange(len(raw)) + shift
    out[dest] = raw
    first = dest[start]
    end = np.append(first[1:] - 2, total - 2)
    out[end] = 0xFF
    out[end + 1] = 0xD0 + (number & 7)
    return out.tobytes(), first, end


def build_avi(frames: list[bytes], lines: int) -> bytes:
    """An AVI with one MJPG stream and an idx1 index."""
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1000000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, WIDTH, lines, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, lines)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, lines, 1, 8, b"MJPG", WIDTH * lines, 0, 0, 0, 0)
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(chunk(b"00dc", f))
        at += len(movi[-1])
    body = b"AVI " + head + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """An AVI for each payload; payloads are multiples of WIDTH bytes."""
    lines = [len(p) // WIDTH for p in payloads]
    if not sum(lines):
        return [build_avi([], LINES) for _ in payloads]
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH)
    number = np.concatenate([np.arange(n) % LINES for n in lines])
    data, first, end = encode_lines(samples, number)
    first, end = first.tolist(), end.tolist()
    out, at = [], 0
    for n in lines:
        frames = []
        for k in range(at, at + n, LINES):
            m = min(LINES, at + n - k)
            frames.append(HEADERS[m] + data[first[k] : end[k + m - 1]] + b"\xff\xd9")
        out.append(build_avi(frames, min(n, LINES)))
        at += n
    return out


def riff_frames(media: bytes) -> tuple[list[tuple[int, int]], float]:
    """(offset, size) of the frames of stream 00 that idx1 lists, and seconds a frame."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("no AVI")
    at, movi, index, seconds = 12, None, None, 1.0 / FPS
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"LIST" and media[at + 8 : at + 12] == b"hdrl":
            seconds = struct.unpack_from("<I", media, at + 20)[0] / 1e6
        elif name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = (at + 8, size // 16)
        at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("no movi list or index")
    found = []
    for name, _, off, size in struct.iter_unpack("<4sIII", media[index[0] : index[0] + 16 * index[1]]):
        if name == b"00dc":
            found.append((movi + off + 8, size))
    return found, seconds


def frame_layout(media: bytes, at: int, end: int) -> tuple[bytes, int, int, int]:
    """(DHT body, lines, width, start of the entropy-coded data) of a lossless frame with a line a restart interval."""
    if media[at : at + 2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    at += 2
    dht, lines, width, interval = b"", 0, 0, 0
    while at < end:
        marker, size = media[at + 1], struct.unpack_from(">H", media, at + 2)[0]
        if marker == 0xC4:
            dht = media[at + 4 : at + 2 + size]
        elif marker == 0xC3:
            _, lines, width = struct.unpack_from(">BHH", media, at + 4)
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("only lossless frames are read")
        elif marker == 0xDD:
            interval = struct.unpack_from(">H", media, at + 4)[0]
        elif marker == 0xDA:
            if interval != width or not lines:
                raise ValueError("each line should be a restart interval")
            return dht, lines, width, at + 2 + size
        at += 2 + size
    raise ValueError("a frame without a scan")


_TABLES: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def decoding_table(dht: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits ahead: bits of the code with its extra bits, and the difference."""
    if dht not in _TABLES:
        counts, symbols = dht[1:17], dht[17:]
        size, diff = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        code, k = 0, 0
        for n in range(1, 17):
            for _ in range(counts[n - 1]):
                cat = symbols[k]
                if n + cat > 16:
                    raise ValueError("codes with their extra bits should fit 16 bits")
                extra = np.arange(1 << cat)
                value = np.where(extra < (1 << cat >> 1), extra - (1 << cat) + 1, extra) if cat else extra
                spare = 16 - n - cat
                rows = slice(code << (16 - n), (code + 1) << (16 - n))
                size[rows], diff[rows] = n + cat, np.repeat(value, 1 << spare)
                code, k = code + 1, k + 1
            code <<= 1
        _TABLES[dht] = size, diff
    return _TABLES[dht]


def decode_many(media: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], list[float]]:
    """Of each AVI: its samples, lines of all frames one below another; the lines of each frame; seconds a frame."""
    parts, lines, owner, tables, widths, seconds = [], [], [], set(), set(), []
    for i, m in enumerate(media):
        frames, s = riff_frames(m)
        seconds.append(s)
        for at, size in frames:
            dht, n, width, scan = frame_layout(m, at, at + size)
            parts.append(m[scan : at + size])
            lines.append(n)
            owner.append(i)
            tables.add(dht)
            widths.add(width)
    if not parts:
        return [np.zeros((0, WIDTH), np.uint8) for _ in media], [np.zeros(0, np.int64) for _ in media], seconds
    if len(tables) > 1 or len(widths) > 1:
        if len(media) == 1:
            raise ValueError("the frames of a file should share a table and a width")
        each = [decode_many([m]) for m in media]
        return [e[0][0] for e in each], [e[1][0] for e in each], seconds
    size, diff = decoding_table(tables.pop())
    width = widths.pop()
    data = np.frombuffer(b"".join(parts) + bytes(8), np.uint8)
    mark = np.flatnonzero(data[:-1] == 0xFF)
    after = data[mark + 1]
    keep = np.ones(len(data), bool)
    keep[mark[after == 0] + 1] = False
    markers = mark[after >= 0xD0]  # restart, and the end of the frame
    keep[markers] = keep[markers + 1] = False
    place = np.cumsum(keep) - keep
    frame_start = np.cumsum([0, *map(len, parts[:-1])])
    restarts = markers[data[markers + 1] <= 0xD7] + 2
    start = np.sort(np.concatenate([frame_start, restarts]))
    if len(start) != sum(lines):
        raise ValueError("a frame has not as many lines as it says")
    bare = data[keep]
    ahead = np.concatenate([bare, np.zeros(4, np.uint8)]).astype(np.uint32)
    ahead = ahead[:-3] << 24 | ahead[1:-2] << 16 | ahead[2:-1] << 8 | ahead[3:]
    at = place[start] * 8
    out = np.empty((len(start), width), np.uint8)
    value = np.full(len(start), 128, np.int32)
    for j in range(width):
        window = ahead[at >> 3] << (at & 7).astype(np.uint32) >> 16
        at += size[window]
        value = value + diff[window]
        out[:, j] = value & 255
    cuts = np.zeros(len(media), np.int64)
    np.add.at(cuts, owner, lines)
    ends = np.cumsum(cuts)
    of = np.asarray(lines)
    per = np.searchsorted(owner, np.arange(len(media) + 1))
    return [out[e - c : e] for e, c in zip(ends, cuts, strict=True)], [of[a:b] for a, b in zip(per[:-1], per[1:], strict=True)], seconds


def histograms(samples: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Shares of the sample values of each frame in BINS bins."""
    frame = np.repeat(np.arange(len(lines)), lines)
    counts = np.bincount((frame[:, None] * BINS + (samples >> 3)).reshape(-1), minlength=len(lines) * BINS).reshape(-1, BINS)
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


def clips(hists: np.ndarray, seconds: float) -> list[tuple[int, int, float, float]]:
    """(first frame, frames, start, end in seconds) of each shot.

    A frame starts a shot when its histogram differs from the one before by LEAST at least and by more than the mean of the
    shot's last MEMORY differences and SPREAD deviations.
    """
    n = len(hists)
    steps = (np.abs(np.diff(hists, axis=0)).sum(1) / 2).tolist() if n > 1 else []
    cuts, seen = [0], []
    for k, d in enumerate(steps, 1):
        recent = seen[-MEMORY:]
        mean = sum(recent) / len(recent) if recent else 0.0
        spread = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if d >= LEAST and d > mean + SPREAD * spread:
            cuts.append(k)
            seen = []
        else:
            seen.append(d)
    ends = [*cuts[1:], n]
    return [(a, b - a, round(a * seconds, 3), round(b * seconds, 3)) for a, b in zip(cuts, ends, strict=True) if b > a]


def as_payload(text: str) -> bytes:
    data = text.encode("utf-8")
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _batched(b: pa.RecordBatch, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """Slices of about AT_ONCE bytes."""
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > AT_ONCE:
            yield b.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < b.num_rows:
        yield b.slice(start)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the AVI that stores the text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _batched(b, [len(t.as_buffer()) if t.is_valid else 0 for t in b.column(1)]):
                texts = part.column(1).to_pylist()
                payloads = [as_payload(t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(encode_many(payloads), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(work, "doc_id long, n_bytes long, media binary")


#: What a stored AVI holds, and its shots: the operator's output, of which clip rows and the query's columns are made.
DECODED = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, "
    "clips array<struct<first_frame: long, n_frames: long, start_s: double, end_s: double>>"
)
_CLIPS = pa.list_(pa.struct([("first_frame", pa.int64()), ("n_frames", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())]))
_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "clips"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), _CLIPS]


def decoded(media: DataFrame) -> DataFrame:
    """DECODED of each AVI: sizes and digests of its samples and of the file, and the clips between its shots, in order."""
    clip = ("first_frame", "n_frames", "start_s", "end_s")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _batched(b, [len(m.as_buffer()) for m in b.column(2)]):
                stored = part.column(2).to_pylist()
                out = []
                for key, n_bytes, m, samples, lines, seconds in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), stored, *decode_many(stored), strict=True):
                    data = samples.tobytes()
                    shots = [dict(zip(clip, c, strict=True)) for c in clips(histograms(samples, lines), seconds)]
                    out.append((key, n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(m), hashlib.sha256(m).hexdigest(), len(lines), shots))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(work, DECODED)


def clip_rows(media: DataFrame) -> DataFrame:
    """doc_id, clip, first_frame, n_frames, start_s, end_s: a row for each shot of each AVI."""
    return decoded(media).select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", F.col("clip").cast("long").alias("clip"), "c.*")


def read_back(media: DataFrame) -> DataFrame:
    """The digests of what each AVI stores, the number of its clips, and their times as one string."""
    times = F.array_join(F.transform("clips", lambda c: F.format_string("%.2f-%.2f", c["start_s"], c["end_s"])), ",")
    feature = F.concat(F.col("n_frames").cast("string"), F.lit("f;"), times)
    return decoded(media).withColumns({"feature": feature, "n_clips": F.size("clips").cast("long")}).drop("clips")


def op1_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(to_media(table(spark, sf_dir, "documents")))
