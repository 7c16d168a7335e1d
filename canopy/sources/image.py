"""Filesystem images: superblocks, devices, inodes, directory entries, attributes, extents and contents as tables.

An image is one row of a binary file scan; images are read side by side, each by one task, which yields bounded batches.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from canopy.functions.hashes import crc32c
from canopy.operators.xattrs import PREFIXES
from canopy.schema import ALGORITHMS, DEVICE, DIRENT, EXTENT, FEATURES, IMAGE, INODE, XATTR

#: Fixed values of the format.
MAGIC, SUPER_AT, SUPER_SIZE, SLOT = 0xE0F5E1E2, 1024, 128, 32
ALL_INCOMPAT = 0x1FF
NO_BLOCK = 0xFFFFFFFF
SUPER = "<IIIBBHQQIIII16s16sIHHHBBIQBB2xIQ8x"


class BadImage(ValueError):
    """The bytes are no image, or one of a kind that is not read."""


class Image:
    def __init__(self, data: bytes, image_id: str = "", layer_no: int = 0):
        self.data, self.image_id = data, image_id
        if len(data) < SUPER_AT + SUPER_SIZE:
            raise BadImage("too short")
        sb = struct.unpack_from(SUPER, data, SUPER_AT)
        (magic, checksum, compat, bits, slots, root, inos, epoch, nsec, blocks, meta, xattr, uid, name, incompat, algs, extra, devt, _, n_prefix, prefix_at, packed, _, _, build, root8) = sb
        metabox = struct.unpack_from("<Q", data, SUPER_AT + SUPER_SIZE)[0] if slots and len(data) >= SUPER_AT + SUPER_SIZE + 8 else None
        if magic != MAGIC:
            raise BadImage("magic")
        if not 9 <= bits <= 16:
            raise BadImage("block size")
        if incompat & ~ALL_INCOMPAT:
            raise BadImage("unknown features")
        wide = bool(incompat & 0x80)
        self.bits, self.bs, self.compat, self.incompat = bits, 1 << bits, compat, incompat
        self.root = root8 if wide else root
        self.epoch, self.nsec, self.meta, self.xattr_at = epoch, nsec, meta, xattr
        self.primary = blocks | (root << 32 if wide else 0)
        self.extra, self.devt = extra, devt
        end = SUPER_AT + SUPER_SIZE + slots * 16
        block = bytearray(data[SUPER_AT : max(end, self.bs)])
        block[4:8] = bytes(4)
        ok = crc32c(bytes(block)) == checksum if compat & 1 else None
        self.row = {
            "image_id": image_id, "layer_no": layer_no, "blksz": self.bs, "blkszbits": bits, "root_nid": self.root, "packed_nid": packed, "metabox_nid": metabox if incompat & 0x100 else None,
            "inos": inos, "epoch": epoch, "build_time": build, "fixed_nsec": nsec, "primary_blocks": self.primary, "total_blocks": self.primary + sum(d["blocks"] for d in self.devices()),
            "meta_blkaddr": meta, "xattr_blkaddr": xattr, "uuid": str(uuid.UUID(bytes=uid)), "volume_name": name.split(b"\0")[0].decode("utf-8", "replace"), "feature_compat": compat, "feature_incompat": incompat,
            "features": [n for c, _, b, n in FEATURES if (compat if c else incompat) & b], "compr_algs": [n for b, n, _ in ALGORITHMS if incompat & 2 and algs >> b & 1], "checksum": checksum, "checksum_ok": ok,
            "sb_size": SUPER_SIZE + slots * 16, "extra_devices": extra, "devt_slotoff": devt,
        }

    def devices(self) -> list[dict]:
        out = []
        for i in range(self.extra):
            tag, blocks, uni = struct.unpack_from("<64sII", self.data, (self.devt + i) * 128)
            out.append({"image_id": self.image_id, "device_id": i + 1, "tag": tag.split(b"\0")[0].decode("utf-8", "replace"), "blocks": blocks, "uniaddr": uni})
        return out

    def iloc(self, nid: int) -> int:
        return self.meta * self.bs + nid * SLOT

    def inode(self, nid: int) -> dict:
        at = self.iloc(nid)
        if at + 32 > len(self.data):
            raise BadImage(f"inode {nid} lies beyond the end")
        fmt, icount, mode, nb, size = struct.unpack_from("<HHHHI", self.data, at)
        if fmt & ~0x1F:
            raise BadImage(f"inode {nid}: format {fmt}")
        layout, extended = fmt >> 1 & 7, fmt & 1
        if layout > 4:
            raise BadImage(f"inode {nid}: layout {layout}")
        if extended:
            size, u, ino, uid, gid, mtime, ns, nlink = struct.unpack_from("<QIIIIQII", self.data, at + 8)
        else:
            _, mt, u, ino, uid, gid = struct.unpack_from("<IIIIHH", self.data, at + 8)
            mtime, ns = self.epoch + (mt if self.incompat & 0x80 else 0), self.nsec
            nlink = 1 if fmt & 16 and mode & 0xF000 != 0x4000 else nb
        kind = {0x8000: 1, 0x4000: 2, 0x2000: 3, 0x6000: 4, 0x1000: 5, 0xC000: 6, 0xA000: 7}.get(mode & 0xF000)
        if kind is None:
            raise BadImage(f"inode {nid}: mode {mode:o}")
        special = kind in (3, 4, 5, 6)
        return {
            "image_id": self.image_id, "nid": nid, "ino": ino, "mode": mode, "ftype": kind, "uid": uid, "gid": gid, "nlink": nlink, "size": size, "mtime_s": mtime, "mtime_ns": ns,
            "datalayout": layout, "inode_isize": 64 if extended else 32, "xattr_isize": 12 + 4 * (icount - 1) if icount else 0, "rdev": u if special else 0,
            "startblk": None if special or layout in (1, 3, 4) or u == NO_BLOCK else u, "chunkbits": self.bits + (u & 31) if layout == 4 else None, "iloc": at, "chunkformat": u & 0xFFFF if layout == 4 else None,
        }

    def extents(self, i: dict) -> list[dict]:
        """Logical to physical; holes have no pa. Compressed layouts are not mapped here."""
        body = i["iloc"] + i["inode_isize"] + i["xattr_isize"]
        out = []
        put = lambda la, n, pa, dev: out.append({"image_id": self.image_id, "nid": i["nid"], "ext_no": len(out), "la": la, "llen": n, "pa": pa, "plen": n, "device_id": dev, "mapped": pa is not None})
        size = i["size"]
        if i["datalayout"] in (0, 2):
            whole = size // self.bs * self.bs if i["datalayout"] == 2 else size
            if whole:
                put(0, whole, None if i["startblk"] is None else i["startblk"] * self.bs, 0)
            if size > whole:
                put(whole, size - whole, body, 0)
        elif i["datalayout"] == 4:
            chunk, indexes = 1 << i["chunkbits"], bool(i["chunkformat"] & 0x20)
            at = body + (-body % 8 if indexes else -body % 4)
            for k in range(-(-size // chunk)):
                if indexes:
                    hi, dev, lo = struct.unpack_from("<HHI", self.data, at + 8 * k)
                    block = lo | (hi << 32 if i["chunkformat"] & 0x40 else 0)
                    hole = lo == NO_BLOCK and (hi == 0xFFFF or not i["chunkformat"] & 0x40)
                else:
                    (block,), dev = struct.unpack_from("<I", self.data, at + 4 * k), 0
                    hole = block == NO_BLOCK
                put(k * chunk, min(chunk, -(-(size - k * chunk) // self.bs) * self.bs), None if hole else block * self.bs, dev)
        return out

    def content(self, i: dict) -> bytes:
        if i["datalayout"] in (1, 3):
            raise BadImage("compressed contents are not decoded here")
        return b"".join(self.data[e["pa"] : e["pa"] + e["llen"]] if e["mapped"] else bytes(e["llen"]) for e in self.extents(i))[: i["size"]]

    def dirents(self, i: dict) -> Iterator[dict]:
        data = self.content(i)
        for block in range(0, len(data), self.bs):
            b = data[block : block + self.bs]
            (first,) = struct.unpack_from("<H", b, 8)
            if not 12 <= first <= len(b) or first % 12:
                raise BadImage(f"directory {i['nid']}: names at {first}")
            heads = [struct.unpack_from("<QHB", b, k) for k in range(0, first, 12)]
            for k, (nid, at, kind) in enumerate(heads):
                end = heads[k + 1][1] if k + 1 < len(heads) else len(b)
                if not first <= at <= end <= len(b):
                    raise BadImage(f"directory {i['nid']}: a name at {at}")
                name = b[at:end] if k + 1 < len(heads) else b[at:].split(b"\0")[0]
                yield {"image_id": self.image_id, "dir_nid": i["nid"], "lblk": block >> self.bits, "idx": k, "name": name, "nid": nid & (1 << 63) - 1, "ftype": kind}

    def xattr_entry(self, at: int) -> tuple[int, str, bytes, int]:
        n, index, size = struct.unpack_from("<BBH", self.data, at)
        name = PREFIXES.get(index, "") + self.data[at + 4 : at + 4 + n].decode("utf-8", "replace")
        return index, name, self.data[at + 4 + n : at + 4 + n + size], 4 + n + size + -(n + size) % 4

    def xattrs(self, i: dict) -> Iterator[dict]:
        if not i["xattr_isize"]:
            return
        at, end = i["iloc"] + i["inode_isize"], i["iloc"] + i["inode_isize"] + i["xattr_isize"]
        shared = self.data[at + 4]
        row = lambda e, ref: {"image_id": self.image_id, "nid": i["nid"], "prefix_index": e[0], "name": e[1], "value": e[2], "shared_id": ref}
        for k in range(shared):
            (ref,) = struct.unpack_from("<I", self.data, at + 12 + 4 * k)
            yield row(self.xattr_entry(self.xattr_at * self.bs + ref * 4), ref)
        at += 12 + 4 * shared
        while at + 4 <= end:
            e = self.xattr_entry(at)
            yield row(e, None)
            at += e[3]

    def walk(self) -> Iterator[dict]:
        """All inodes from the root, each once."""
        seen, todo = {self.root}, [self.root]
        while todo:
            i = self.inode(todo.pop())
            yield i
            if i["ftype"] == 2:
                for e in self.dirents(i):
                    if e["name"] not in (b".", b"..") and e["nid"] not in seen:
                        seen.add(e["nid"])
                        todo.append(e["nid"])


TABLES: dict[str, tuple[str, Callable[[Image], Iterator[dict]]]] = {
    "image": (IMAGE, lambda m: iter([m.row])),
    "device": (DEVICE, lambda m: iter(m.devices())),
    "inode": (INODE, lambda m: m.walk()),
    "dirent": (DIRENT, lambda m: (e for i in m.walk() if i["ftype"] == 2 for e in m.dirents(i))),
    "xattr": (XATTR, lambda m: (x for i in m.walk() for x in m.xattrs(i))),
    "extent": (EXTENT, lambda m: (e for i in m.walk() for e in m.extents(i))),
    "content": ("image_id string, nid long, off long, data binary", lambda m: ({"image_id": m.image_id, "nid": i["nid"], "off": at, "data": c[at : at + (16 << 20)]} for i in m.walk() if i["ftype"] in (1, 7) for c in [m.content(i)] for at in range(0, len(c), 16 << 20))),
}


def read(spark: SparkSession, path: str, what: str) -> DataFrame:
    """One of TABLES of the images at a path; layer_no is 0 (assign layers by source)."""
    schema, rows = TABLES[what]
    names = [x.split()[0] for x in schema.split(", ")]
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for source, content in zip(b["path"], b["content"], strict=True):
                held = []
                for r in rows(Image(bytes(content), source)):
                    held.append([r[n] for n in names])
                    if len(held) == 2000:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names)

    return raw.mapInPandas(work, schema)
