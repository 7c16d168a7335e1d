"""Secret scans with structural confirmation.

Base findings are three patterns: values assigned to secret-like names, access key ids and long hex runs. Beyond these,
runs of base64 or hex characters are candidates only: each is decoded and reported when what it decodes to has the
structure of a key or a signed token - DER whose nested lengths add up to the last byte, an OpenSSH key whose
length-prefixed fields do, or a token whose header is a JSON object that names its algorithm. Candidates also start inside a run:
at any segment of a dotted run (tokens), after a sign of the alphabet (keys glued to a path or a name), and at any line of a
wrapped block. An armoured key with headers that name an encryption is confirmed by those and whole cipher blocks.

Spans are in code points, end exclusive. Findings of one kind never overlap; different kinds may. Cases: null is the
empty text, which has no findings; texts are scanned whole; equal texts have equal findings; an empty table gives an
empty result; further columns pass through `redacted` and are not read by `findings`.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.common import table, text_or_empty

KINDS = ("assign", "access", "hex", "jwt", "key")
ORDER = {k: i for i, k in enumerate(KINDS)}
NAMES = ("password", "passwd", "secret", "token", "api")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: Every access key id, hex run and encoded candidate lies in such a run.
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{20,}")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Candidates for keys: hex digits of either case.
HEX_DIGITS = re.compile(r"[0-9A-Fa-f]+")
DOTTED = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*)+")
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
#: Where a key may start inside a run, and how keys start there: a DER sequence, or an OpenSSH key.
GLUED = re.compile(r"(?<=[+/_-])(?=M[A-Za-z0-9+/_-]{3}|b3BlbnNzaC1rZXk|AAAA[A-Za-z0-9+/_-]{4})")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{32,}(?:\r?\n[ \t]*[A-Za-z0-9+/]+={0,2})+")
LINE = re.compile(r"[A-Za-z0-9+/]+={0,2}")
ARMOUR = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}KEY-----((?:\s*[A-Za-z][A-Za-z-]{1,40}: [^\n]*\n)*)([A-Za-z0-9+/=\s]*)-----END [A-Z0-9 ]{0,40}KEY-----")
LEAST_KEY_BYTES = 24


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """(content start, content length) of the DER value whose length field is at `at`."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return at + 1, first
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 1 + n > len(data) or data[at + 1] == 0:
        return None
    size = int.from_bytes(data[at + 1 : at + 1 + n], "big")
    return (at + 1 + n, size) if size >= 0x80 else None


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, content start, content end) of the values that fill data[start:end] exactly, else None."""
    items = []
    while start < end:
        head = der_length(data, start + 1)
        if head is None or head[0] + head[1] > end:
            return None
        items.append((data[start], head[0], head[0] + head[1]))
        start = head[0] + head[1]
    return items


def is_der_key(data: bytes) -> bool:
    """One sequence that fills all bytes and holds what a private or public key holds."""
    top = der_items(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = der_items(data, top[0][1], top[0][2])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _, _ in inner]
    if tags[0] == 0x02:  # a version or a modulus first
        if set(tags) == {0x02}:
            return len(tags) in (2, 6, 9)
        if tags[1] == 0x04:
            return True
        if tags[1] == 0x30 and len(tags) > 2 and tags[2] == 0x04:
            algorithm = der_items(data, inner[1][1], inner[1][2])
            return bool(algorithm) and algorithm[0][0] == 0x06
        return False
    if tags[:2] == [0x30, 0x03]:
        algorithm = der_items(data, inner[0][1], inner[0][2])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return False


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key, or a public key blob: length-prefixed fields that end with the last byte."""
    magic = b"openssh-key-v1\0"
    whole = not data.startswith(magic)
    at = 0 if whole else len(magic)
    fields: list[bytes] = []
    while at < len(data) and (whole or len(fields) < 3):
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    if not whole:
        return len(fields) == 3 and fields[0].isascii() and at + 4 <= len(data)
    return len(fields) >= 2 and re.match(rb"(ssh-|ecdsa-sha2-|sk-)[a-z0-9@.-]+\Z", fields[0]) is not None


def from_base64(text: str) -> bytes | None:
    bare = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(bare) % 4 == 1:
        return None
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_key(data: bytes | None) -> bool:
    return data is not None and len(data) >= LEAST_KEY_BYTES and (is_der_key(data) or is_ssh_key(data))


def is_hex_key(text: str) -> bool:
    return len(text) % 2 == 0 and is_key(bytes.fromhex(text))


def is_token_header(part: str) -> bool:
    data = from_base64(part)
    if not data or data[:1] != b"{":
        return False
    try:
        head = json.loads(data)
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def tokens_in(run: str) -> list[tuple[int, int]]:
    """Spans of signed tokens in a dotted run: a header, a payload of two letters or more, a signature that may be empty."""
    parts, out, at, i = run.split("."), [], 0, 0
    starts = []
    for p in parts:
        starts.append(at)
        at += len(p) + 1
    while i + 2 < len(parts):
        # a JSON object's first letter decides the first letter of its base64
        if parts[i][:1] == "e" and len(parts[i]) >= 8 and len(parts[i + 1]) >= 2 and is_token_header(parts[i]):
            out.append((starts[i], starts[i + 2] + len(parts[i + 2])))
            i += 3
        else:
            i += 1
    return out


def der_letters(run: str, at: int) -> int | None:
    """How many base64 letters (without padding) the DER sequence that starts at `at` needs; None where none starts there."""
    head = from_base64(run[at : at + 8])
    if not head or head[0] != 0x30:
        return None
    size = der_length(head + bytes(6), 1)
    return -(-(size[0] + size[1]) * 4 // 3) if size else None


def glued_key(run: str) -> tuple[int, int] | None:
    """A key that ends a run but starts after a sign inside it. Its own lengths say where, so few places are decoded."""
    bare = run.rstrip("=")
    for m in GLUED.finditer(run):
        at = m.start()
        if run[at] == "M" and der_letters(run, at) != len(bare) - at:
            continue
        if is_key(from_base64(run[at:])):
            return at, len(run)
    return None


def wrapped_keys(text: str) -> list[tuple[int, int]]:
    """Spans of keys in base64 over several lines without armour."""
    out = []
    for block in WRAPPED.finditer(text):
        lines, i = list(LINE.finditer(text, *block.span())), 0
        while i < len(lines):
            need, j, held = None, i, 0
            first = lines[i][0]
            if first[0] == "M":
                need = der_letters(first, 0)
            elif first.startswith(("b3BlbnNzaC1rZXk", "AAAA")):
                need = sum(len(m[0].rstrip("=")) for m in lines[i:])
            while need and j < len(lines) and held < need:
                held += len(lines[j][0].rstrip("="))
                j += 1
            if need and held == need and j > i + 1 and is_key(from_base64("".join(m[0] for m in lines[i:j]))):
                out.append((lines[i].start(), lines[j - 1].end()))
                i = j
            else:
                i += 1
    return out


def is_armoured_key(headers: str, body: str) -> bool:
    data = from_base64("".join(body.split()))
    if "ENCRYPTED" in headers:
        return data is not None and len(data) >= LEAST_KEY_BYTES and len(data) % 8 == 0
    return is_key(data)


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every finding, by start, then kind as listed."""
    out: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for run in RUN.finditer(text):
        at, s = run.start(), run[0]
        if "AKIA" in s:
            out += [(at + m.start(), at + m.end(), "access") for m in ACCESS.finditer(s) if len(m[0]) >= 20]
        for m in HEX.finditer(s):
            if len(m[0]) >= 24:
                out.append((at + m.start(), at + m.end(), "hex"))
        keys = []
        for m in HEX_DIGITS.finditer(s):
            if len(m[0]) >= 2 * LEAST_KEY_BYTES:
                keys += [m.span()] if is_hex_key(m[0]) else [n.span() for n in HEX.finditer(s, *m.span()) if is_hex_key(n[0])]
        if "." in s:
            out += [(at + m.start() + a, at + m.start() + b, "jwt") for m in DOTTED.finditer(s) for a, b in tokens_in(m[0])]
        for m in ENCODED.finditer(s):
            if HEX.fullmatch(m[0]) or any(a < m.end() and m.start() < b for a, b in keys):
                continue
            if is_key(from_base64(m[0])):
                keys.append(m.span())
            elif inside := glued_key(m[0]):
                keys.append((m.start() + inside[0], m.start() + inside[1]))
        out += [(at + a, at + b, "key") for a, b in keys]
    for a, b in wrapped_keys(text) if "\n" in text else []:
        out = [x for x in out if x[2] != "key" or x[1] <= a or b <= x[0]] + [(a, b, "key")]
    if "-----BEGIN " in text:
        for m in ARMOUR.finditer(text):
            if is_armoured_key(m[1], m[2]):
                inside = [x for x in out if x[2] == "key" and m.start() <= x[0] < m.end()]
                out = [x for x in out if x not in inside] + [(m.start(), m.end(), "key")]
    return sorted(out, key=lambda x: (x[0], ORDER[x[2]], x[1]))


def redact(text: str, found: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """The text with every stretch of touching findings replaced by a mark."""
    out, at = [], 0
    for start, end, _ in found:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def findings(docs: DataFrame) -> DataFrame:
    """doc_id and its findings as array<struct<start, end, kind>>, one row a document."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"start": s, "end": e, "kind": k} for s, e, k in scan(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["doc_id", "found"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(work, "doc_id long, found array<struct<start:long,end:long,kind:string>>")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns, with secrets in the text replaced; a null text stays null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(text)
            clean = [None if (s := t.as_py()) is None else redact(s, scan(s)) for t in b.column(i)]
            yield b.set_column(i, b.schema.field(i), pa.array(clean, b.schema.field(i).type))

    return docs.mapInArrow(work, docs.schema)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(table(spark, sf_dir, "documents"))
    joined = lambda part: F.concat_ws(",", F.transform(part, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS],
        F.sha2(joined(F.filter("found", lambda x: x["kind"].isin("assign", "access", "hex"))), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
