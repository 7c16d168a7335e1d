"""A writer of plain images (no compression) and an extractor: single-writer sinks for trees that one task can hold."""

from __future__ import annotations

import os
import struct
from pathlib import Path

from canopy.functions.hashes import crc32c
from canopy.sources.image import MAGIC, NO_BLOCK, SUPER, SUPER_AT, Image

BITS = 12
BS = 1 << BITS
KINDS = {0x8000: 1, 0x4000: 2, 0x2000: 3, 0x6000: 4, 0x1000: 5, 0xC000: 6, 0xA000: 7}


def directory_blocks(entries: list[tuple[bytes, int, int]]) -> bytes:
    """Sorted (name, nid, type) in blocks: records, then names; each block padded, the last cut after its names."""
    entries, blocks = sorted(entries), []
    while entries:
        n, used = 0, 0
        while n < len(entries) and used + 12 + len(entries[n][0]) <= BS:
            used += 12 + len(entries[n][0])
            n += 1
        at, heads, names = 12 * n, b"", b""
        for name, nid, kind in entries[:n]:
            heads += struct.pack("<QHBB", nid, at + len(names), kind, 0)
            names += name
        blocks.append(heads + names)
        entries = entries[n:]
    return b"".join(b.ljust(BS, b"\0") if k + 1 < len(blocks) else b for k, b in enumerate(blocks))


def build(entries: list[dict], epoch: int = 0, uuid: bytes = bytes(16), label: str = "") -> bytes:
    """An image of entries (path, mode, uid, gid, mtime_s, mtime_ns, rdev, data: bytes of files and targets of links).

    Inodes have 64 bytes; file data lie in whole blocks after the inodes; parents that no entry names are made (0755).
    """
    tree = {"": {"mode": 0x41ED}} | {e["path"].strip("/"): e for e in entries if e["path"].strip("/")}
    for path in list(tree):
        while "/" in path:
            path = path.rsplit("/", 1)[0]
            tree.setdefault(path, {"mode": 0x41ED})
    tree.setdefault("", {"mode": 0x41ED})
    paths = sorted(tree)
    nid = {p: 36 + 2 * k for k, p in enumerate(paths)}  # the superblock ends before slot 36
    below: dict[str, list[str]] = {p: [] for p in paths}
    for p in paths:
        if p:
            below[p.rsplit("/", 1)[0] if "/" in p else ""].append(p)
    bodies = {}
    for p in paths:
        e = tree[p]
        if e["mode"] & 0xF000 == 0x4000:
            up = p.rsplit("/", 1)[0] if "/" in p else ""
            own = [(b".", nid[p], 2), (b"..", nid[up], 2)]
            bodies[p] = directory_blocks(own + [(c.rsplit("/", 1)[-1].encode("utf-8", "surrogateescape"), nid[c], KINDS[tree[c]["mode"] & 0xF000]) for c in below[p]])
        else:
            bodies[p] = e.get("data") or b""
    end = (36 + 2 * len(paths)) * 32
    block = -(-end // BS)
    out = bytearray(block * BS)
    for k, p in enumerate(paths):
        e, body = tree[p], bodies[p]
        kind = e["mode"] & 0xF000
        special = kind in (0x2000, 0x6000, 0x1000, 0xC000)
        links = 2 + sum(tree[c]["mode"] & 0xF000 == 0x4000 for c in below[p]) if kind == 0x4000 else 1
        where = e.get("rdev", 0) if special else block if body else NO_BLOCK
        inode = struct.pack("<HHHHQIIIIQII16x", 1, 0, e["mode"] & 0xFFFF, 0, 0 if special else len(body), where, k + 1, e.get("uid", 0), e.get("gid", 0), e.get("mtime_s", epoch), e.get("mtime_ns", 0), links)
        out[nid[p] * 32 : nid[p] * 32 + 64] = inode
        if body and not special:
            out += body.ljust(-(-len(body) // BS) * BS, b"\0")
            block += -(-len(body) // BS)
    sb = bytearray(struct.pack(SUPER, MAGIC, 0, 1, BITS, 0, nid[""], len(paths), epoch, 0, block, 0, 0, uuid, label.encode()[:15], 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0))
    out[SUPER_AT : SUPER_AT + len(sb)] = sb
    crc = crc32c(bytes(out[SUPER_AT:BS]))
    out[SUPER_AT + 4 : SUPER_AT + 8] = struct.pack("<I", crc)
    return bytes(out)


def extract(data: bytes, to: str) -> int:
    """Write files, directories and links of an image below a folder; hard links are linked again. Returns the entries written."""
    image, written, seen = Image(data), 0, {}
    todo = [(image.root, Path(to))]
    while todo:
        nid, place = todo.pop()
        i = image.inode(nid)
        if i["ftype"] == 2:
            place.mkdir(parents=True, exist_ok=True)
            for e in image.dirents(i):
                if e["name"] in (b".", b".."):
                    continue
                if b"/" in e["name"] or not e["name"]:
                    raise ValueError(f"name {e['name']!r}")
                todo.append((e["nid"], place / e["name"].decode("utf-8", "surrogateescape")))
        elif nid in seen:
            os.link(seen[nid], place)
        elif i["ftype"] == 7:
            place.symlink_to(image.content(i).decode("utf-8", "surrogateescape"))
        elif i["ftype"] == 1:
            place.write_bytes(image.content(i))
            seen[nid] = place
        if i["ftype"] in (1, 2):
            os.chmod(place, i["mode"] & 0o7777 | (0o700 if i["ftype"] == 2 else 0))
        written += 1
    return written
