"""Address mapping: logical to physical, devices, range reads, islands of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.functions.columns import bit_length_of, lowbit


def flat_map(inodes: DataFrame, bits: int = 12) -> DataFrame:
    """nid, ext_no, la, llen, pa: whole blocks from startblk, then an inline tail (datalayout 2) after inode and attributes.

    inodes: nid, size, startblk (null: a hole), datalayout, iloc, inode_isize, xattr_isize.
    """
    bs = 1 << bits
    inline = F.col("datalayout") == 2
    head = F.when(inline, F.shiftleft(F.shiftright("size", bits), bits)).otherwise(F.col("size"))
    body = F.struct(F.lit(0).alias("ext_no"), F.lit(0).cast("long").alias("la"), head.alias("llen"), (F.col("startblk") * bs).alias("pa"))
    tail = F.struct(F.lit(1).alias("ext_no"), head.alias("la"), (F.col("size") - head).alias("llen"), (F.col("iloc") + F.col("inode_isize") + F.col("xattr_isize")).alias("pa"))
    return inodes.select("nid", F.inline(F.filter(F.array(body, tail), lambda e: e["llen"] > 0)))


def chunk_map(inodes: DataFrame, chunks: DataFrame, bits: int = 12) -> DataFrame:
    """nid, chunk_no, la, llen, pa, device_id: chunks: nid, chunk_no, startblk (null: a hole), device_id; inodes: nid, size, chunkbits."""
    j = chunks.join(inodes.select("nid", "size", "chunkbits"), "nid")
    la = F.expr("shiftleft(cast(chunk_no as bigint), chunkbits)")
    rest = F.shiftleft(F.shiftright(F.col("size") - la + ((1 << bits) - 1), bits), bits)
    return j.select("nid", "chunk_no", la.alias("la"), F.least(F.expr("shiftleft(1L, chunkbits)"), rest).alias("llen"), (F.col("startblk") * (1 << bits)).alias("pa"), "device_id").filter("llen > 0")


def map_offsets(requests: DataFrame, extents: DataFrame, key: str = "nid", span: int = 65536) -> DataFrame:
    """request_id, la, ext_no, pa of each offset: the extent with the greatest start at or before it (as of), null beyond its end.

    Requests and extents are dealt by file and by spans of offsets, extents into each span they touch, so the join is an
    equality on (file, span) whatever the size of a file.
    """
    e = extents.withColumn("span", F.explode(F.sequence(F.floor(F.col("la") / span), F.floor((F.col("la") + F.greatest(F.col("llen"), F.lit(1)) - 1) / span))))
    r = requests.withColumn("span", F.floor(F.col("off") / span))
    e = e.select(F.col(key).alias("e_key"), F.col("span").alias("e_span"), F.col("la").alias("e_la"), "llen", "ext_no", "pa", "plen")
    hit = (F.col("e_la") <= F.col("off")) & (F.col("off") < F.col("e_la") + F.col("llen"))
    met = r.join(e, (F.col(key) == F.col("e_key")) & (F.col("span") == F.col("e_span")) & hit, "left")  # extents do not overlap: a row a request
    pa = F.col("pa") + F.col("off") - F.col("e_la")
    return met.select("request_id", key, "off", "ext_no", F.when(F.col("off") - F.col("e_la") < F.col("plen"), pa).alias("pa"))


#: A device table has so many rows at most.
DEVICES = 65535


def device_table(devices: DataFrame) -> DataFrame:
    """Adds uniaddr, the running sum of blocks before each device. A device table has 65535 rows at most."""
    w = W.partitionBy(F.lit(0)).orderBy("device_id").rowsBetween(W.unboundedPreceding, -1)
    return devices.withColumn("uniaddr", F.coalesce(F.sum("blocks").over(w), F.lit(0)))


def map_devices(addresses: DataFrame, devices: DataFrame) -> DataFrame:
    """addresses: addr_id, pa (block), device_id (0: by address); devices: device_id, blocks, uniaddr, at most 65535 rows.

    Returns addr_id, device_id, pa on the device; an explicit device keeps its address; what no device holds has device 0.
    """
    # spans of equal length over all devices: each device is in those it touches, about twice DEVICES rows in all
    end = F.col("uniaddr") + F.col("blocks")
    length = F.broadcast(devices.agg(F.greatest(F.ceil(F.max(end) / DEVICES), F.lit(1)).cast("long").alias("length")))
    d = devices.filter("blocks > 0").crossJoin(length).withColumn("span", F.explode(F.sequence(F.expr("uniaddr div length"), F.expr("(uniaddr + blocks - 1) div length"))))
    d = F.broadcast(d.select("span", F.col("device_id").alias("dev"), "blocks", "uniaddr"))
    by_address = addresses.filter("device_id = 0").crossJoin(length).withColumn("at", F.expr("pa div length"))
    by_address = by_address.join(d, (F.col("at") == F.col("span")) & (F.col("pa") >= F.col("uniaddr")) & (F.col("pa") < end), "left")
    one = by_address.select("addr_id", F.coalesce("dev", F.lit(0)).alias("device_id"), (F.col("pa") - F.coalesce("uniaddr", F.lit(0))).alias("pa"))
    return one.unionByName(addresses.filter("device_id <> 0").select("addr_id", "device_id", "pa"))


def in_spans(rows: DataFrame, start: str, length: str, span: int) -> DataFrame:
    """Adds span, one row for each span of offsets that [start, start + length) touches (at least that of start), and first."""
    first = F.expr(f"{start} div {span}")
    last = F.expr(f"({start} + greatest({length}, 1) - 1) div {span}")
    return rows.withColumn("first", first).withColumn("span", F.explode(F.sequence(first, last)))


def overlapping(requests: DataFrame, pieces: DataFrame, key: str, span: int) -> DataFrame:
    """Each request beside each piece (p_off, p_len) of its file that it may overlap, once.

    Both are dealt by file and by spans of offsets, so a much read file is many keys; a pair that meets in several spans
    is kept in the first of them.
    """
    r = in_spans(requests.select("request_id", key, "off", "len"), "off", "len", span)
    p = in_spans(pieces, "p_off", "p_len", span).withColumnRenamed("first", "p_first")
    met = r.join(p, [key, "span"]).filter(F.col("span") == F.greatest("first", "p_first"))
    return met.filter("off < p_off + p_len and p_off < off + len").drop("span", "first", "p_first")


def range_parts(requests: DataFrame, extents: DataFrame, key: str = "nid", span: int = 65536) -> DataFrame:
    """request_id, part_no, off, n, pa: the parts of [off, off + len) in extents that it overlaps, trimmed, in order."""
    start = F.greatest("off", "la")
    end = F.least(F.col("off") + F.col("len"), F.col("la") + F.col("llen"))
    w = W.partitionBy("request_id").orderBy("part_off")
    j = overlapping(requests, extents.select(key, F.col("la").alias("p_off"), F.col("llen").alias("p_len"), "la", "llen", "pa"), key, span)
    p = j.select("request_id", start.alias("part_off"), (end - start).alias("n"), (F.col("pa") + start - F.col("la")).alias("pa"))
    return p.withColumn("part_no", F.row_number().over(w) - 1)


def read_ranges(requests: DataFrame, content: DataFrame, key: str = "nid", span: int = 65536) -> DataFrame:
    """request_id, data: bytes of [off, off + len), short at the end, empty beyond it. content: key, off (s_off), data segments."""
    segments = content.select(key, F.col("off").alias("p_off"), F.octet_length("data").cast("long").alias("p_len"), F.col("off").alias("s_off"), F.col("data").alias("seg"))
    j = overlapping(requests, segments, key, span)
    start = F.greatest(F.col("off") - F.col("s_off"), F.lit(0))
    end = F.least(F.col("off") + F.col("len") - F.col("s_off"), F.octet_length("seg").cast("long"))
    piece = j.withColumns({"a": start, "b": end}).withColumn("piece", F.when(F.col("b") > F.col("a"), F.expr("substring(seg, cast(a + 1 as int), cast(b - a as int))")))
    parts = F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("s_off", "piece"))))
    read = piece.groupBy("request_id").agg(F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["piece"])).alias("data"))
    return requests.select("request_id").join(read, "request_id", "left").select("request_id", F.coalesce("data", F.lit(b"")).alias("data"))


def next_starts(heads: DataFrame, size: str = "size") -> DataFrame:
    """Adds llen: up to the next head, or to the file's end. heads: nid, la, size."""
    return heads.withColumn("llen", F.lead("la").over(W.partitionBy("nid").orderBy("la")))\
        .withColumn("llen", F.coalesce("llen", F.col(size)) - F.col("la"))


def head_of(clusters: DataFrame) -> DataFrame:
    """Adds head: the last cluster at or before each that is a head. clusters: nid, lcn, is_head."""
    w = W.partitionBy("nid").orderBy("lcn").rowsBetween(W.unboundedPreceding, W.currentRow)
    return clusters.withColumn("head", F.last(F.when(F.col("is_head"), F.col("lcn")), ignorenulls=True).over(w))


def physical_starts(extents: DataFrame, base: Column | int = 0) -> DataFrame:
    """Adds pa: base and the running sum of plen before each extent of a file."""
    w = W.partitionBy("nid").orderBy("ext_no").rowsBetween(W.unboundedPreceding, -1)
    return extents.withColumn("pa", F.coalesce(F.sum("plen").over(w), F.lit(0)) + base)


def islands(chunks: DataFrame) -> DataFrame:
    """nid, island, first_chunk, startblk, n_blocks, device_id: runs of chunks whose blocks follow each other on one device.

    chunks: nid, chunk_no, startblk, n_blocks, device_id.
    """
    w = W.partitionBy("nid").orderBy("chunk_no")
    follows = (F.lag("startblk").over(w) + F.lag("n_blocks").over(w) == F.col("startblk")) & (F.lag("device_id").over(w) == F.col("device_id"))
    marked = chunks.withColumn("new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return marked.groupBy("nid", "island").agg(F.min("chunk_no").alias("first_chunk"), F.min_by("startblk", "chunk_no").alias("startblk"), F.sum("n_blocks").alias("n_blocks"), F.first("device_id").alias("device_id"))


def chunk_growth(isles: DataFrame) -> DataFrame:
    """nid, grow_bits: how far chunks of a file can double: the least lowest bit over its islands' lengths."""
    return isles.groupBy("nid").agg((bit_length_of(F.min(lowbit(F.col("n_blocks")))) - 1).cast("int").alias("grow_bits"))


def block_map_lines(isles: DataFrame) -> DataFrame:
    """line: `blkaddr nblocks srcoff`, hexadecimal."""
    return isles.select("nid", F.format_string("%08x %8x %08x", "startblk", "n_blocks", "srcoff").alias("line"))


def vmdk_extents(devices: DataFrame, bits: int = 12) -> DataFrame:
    """device_id, part, line: extents of a disk descriptor, split at 2 GiB. devices: device_id, blocks, tag."""
    most = 0x80000000 >> 9
    sectors = F.shiftleft("blocks", bits - 9)
    d = devices.withColumn("sectors", sectors).filter("sectors > 0")
    part = d.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("sectors") - 1) / most))))
    n = F.least(F.lit(most), F.col("sectors") - F.col("part") * most)
    return part.select("device_id", "part", F.format_string('RW %d FLAT "%s" %d', n, F.col("tag"), F.col("part") * most).alias("line"))


def vmdk_cylinders(devices: DataFrame, bits: int = 12) -> DataFrame:
    total = F.sum(F.shiftleft("blocks", bits - 9))
    return devices.agg(F.ceil(total / (63 * 16)).cast("long").alias("cylinders"))


def sparse_chunk_bits(size: Column, bits: int = 12) -> Column:
    """Of a fully sparse file's one chunk: bit length of size - 1, a block at least, 31 bits over it at most."""
    return F.least(F.greatest(bit_length_of(size - 1), F.lit(bits)), F.lit(bits + 31)).cast("int")
