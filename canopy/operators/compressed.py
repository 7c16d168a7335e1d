"""Maps of compressed files: index records decoded to rows, rows to extents; clusters estimated, placed and deduplicated."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.functions.codecs import clusters, compressor, worth

#: Types of index records, and the flag of a block count.
PLAIN, HEAD1, NONHEAD, HEAD2, COUNT_FLAG = 0, 1, 2, 3, 1 << 11


def index_records(raw: bytes) -> list[dict]:
    """Full records of 8 bytes: type, offset in the cluster, and a block address, or distances to the heads around it."""
    out = []
    for lcn in range(len(raw) // 8):
        advise, ofs, lo, hi = struct.unpack_from("<HHHH", raw, 8 * lcn)
        kind = advise & 3
        row = {"lcn": lcn, "kind": kind, "ofs": None, "blkaddr": None, "blocks": None, "back": None, "ahead": None, "partial": bool(advise >> 15) and kind != NONHEAD}
        if kind == NONHEAD:
            row |= {"back": 1 if lo & COUNT_FLAG else lo, "blocks": lo & ~COUNT_FLAG if lo & COUNT_FLAG else None, "ahead": hi}
        else:
            row |= {"ofs": ofs, "blkaddr": lo | hi << 16}
        out.append(row)
    return out


def pack_records(rows: list[dict]) -> bytes:
    """The inverse of index_records."""
    out = b""
    for r in rows:
        if r["kind"] == NONHEAD:
            out += struct.pack("<HHHH", NONHEAD, 0, r["blocks"] | COUNT_FLAG if r["blocks"] else r["back"], r["ahead"])
        else:
            out += struct.pack("<HHI", r["kind"] | (0x8000 if r["partial"] else 0), r["ofs"], r["blkaddr"])
    return out


def map_clusters(records: DataFrame, bits: int = 12) -> DataFrame:
    """nid, la, llen, pa, plen, encoded: an extent a head. records: nid, lcn, kind, ofs, blkaddr, blocks, size.

    A head's extent ends where the next begins, or with the file; its blocks are the count of the first record after it, if it
    has one, else one.
    """
    w = W.partitionBy("nid").orderBy("lcn")
    head = F.col("kind") != NONHEAD
    count = F.when((F.lead("kind").over(w) == NONHEAD) & (F.lead("lcn").over(w) == F.col("lcn") + 1), F.lead("blocks").over(w))
    la = F.shiftleft(F.col("lcn").cast("long"), bits) + F.col("ofs")
    heads = records.withColumn("n", count).filter(head).withColumn("la", la)
    end = F.coalesce(F.lead("la").over(W.partitionBy("nid").orderBy("la")), F.col("size"))
    return heads.withColumn("end", end).select("nid", "la", (F.col("end") - F.col("la")).alias("llen"), (F.col("blkaddr") * (1 << bits)).alias("pa"), (F.coalesce("n", F.lit(1)).cast("long") * (1 << bits)).alias("plen"), (F.col("kind") != PLAIN).alias("encoded")).filter("llen > 0")


def extent_records(raw: bytes, size: int, lcluster_bits: int, file_size: int) -> list[dict]:
    """Extent records of 4, 8, 16 or 32 bytes: la, llen, pa, plen. Those of 4 follow a base and each other; of 8, one a cluster."""
    mask, out = (2 << 20) - 1, []
    step = 1 << lcluster_bits
    if size == 4:
        (at,) = struct.unpack_from("<Q", raw)
        for k, (plen,) in enumerate(struct.iter_unpack("<I", raw[8:])):
            out.append({"la": k * step, "pa": at, "plen": plen & mask})
            at += plen & mask
    elif size == 8:
        out = [{"la": k * step, "pa": pa, "plen": plen & mask} for k, (plen, pa) in enumerate(struct.iter_unpack("<II", raw))]
    else:
        for k in range(len(raw) // size):
            plen, lo, hi, la = struct.unpack_from("<IIII", raw, k * size)
            top = struct.unpack_from("<I", raw, k * size + 16)[0] if size == 32 else 0
            out.append({"la": la | top << 32, "pa": lo | hi << 32, "plen": plen & mask})
    for a, b in zip(out, [*out[1:], {"la": file_size}], strict=True):
        a["llen"] = min(b["la"], file_size) - a["la"]
    return out


def fragment_map(files: DataFrame, tails: DataFrame) -> DataFrame:
    """nid, la, llen, packed_off: the last part of a file that is in the packed object. files: nid, size; tails: nid, tlen, off."""
    return files.join(tails, "nid").select("nid", (F.col("size") - F.col("tlen")).alias("la"), F.col("tlen").alias("llen"), F.col("off").alias("packed_off"))


def encoded_clusters(files: DataFrame, size: int = 4096, name: str = "deflate", level: int | None = None) -> DataFrame:
    """path, cluster_no, la, llen, plen, raw, digest of the stored bytes: files cut into clusters of a fixed stored size."""
    compressor(name, level)
    import hashlib

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = [(path, k, at, n, -(-len(c) // size) * size, raw, hashlib.sha256(c).hexdigest()) for k, (at, n, c, raw) in enumerate(clusters(data.as_py() or b"", size, name, level))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["path", "cluster_no", "la", "llen", "plen", "raw", "digest"])

    return files.select("path", "content").mapInArrow(work, "path string, cluster_no long, la long, llen long, plen long, raw boolean, digest string")


def keep_coded(coded: DataFrame, files: DataFrame) -> DataFrame:
    """Clusters of the files that coding makes smaller; the others fall back to raw data and are not here. files: path, size."""
    total = coded.groupBy("path").agg(F.sum("plen").alias("stored"))
    good = total.join(files.select("path", "size"), "path").filter("stored < size").select("path")
    return coded.join(good, "path", "left_semi")


def shared_clusters(coded: DataFrame) -> DataFrame:
    """digest, plen, raw, n, owner: stored clusters each once, with the least (path, offset) that has it."""
    return coded.groupBy("digest", "plen", "raw").agg(F.count("*").alias("n"), F.min(F.struct("path", "la")).alias("o")).select("digest", "plen", "raw", "n", F.col("o.path").alias("owner_path"), F.col("o.la").alias("owner_la"))


def inline_tail(inode_size: Column, xattr_size: Column, tail: Column, allowed: Column, block: int = 4096) -> Column:
    """Whether a tail lies beside its inode: it fits in a block with it, and nothing forbids it."""
    return allowed & (tail > 0) & (inode_size + xattr_size + tail <= block)


def wide_chunks(chunks: DataFrame) -> DataFrame:
    """nid, wide: files with a chunk beyond 32 bits of blocks. chunks: nid, startblk (null: a hole)."""
    return chunks.groupBy("nid").agg(F.coalesce(F.bool_or(F.col("startblk") > (1 << 32) - 1), F.lit(False)).alias("wide"))


def fold_extent(raw: int, coded: int, threshold: int = 100) -> bool:
    return worth(raw, coded, threshold)
