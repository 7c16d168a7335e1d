"""Content-addressed deduplication. The first owner of equal content is the least (path, offset)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.operators.membership import bitmap, may_hold


def chunks(files: DataFrame, size: int, content: str = "content") -> DataFrame:
    """path, chunk_no, off, clen, digest of each chunk; the last is as long as it is. Empty files have none."""
    c = F.col(content)
    n = F.ceil(F.octet_length(c) / size).cast("int")
    at = files.filter(F.octet_length(c) > 0).select("path", c.alias("c"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    piece = at.withColumn("data", F.expr(f"substring(c, chunk_no * {size} + 1, {size})"))
    return piece.select("path", "chunk_no", (F.col("chunk_no").cast("long") * size).alias("off"), F.octet_length("data").cast("long").alias("clen"), F.sha2("data", 256).alias("digest"))


def unique_chunks(chunked: DataFrame, size: int | None = None) -> DataFrame:
    """digest, clen, n_refs, owner (least path and offset), hole: a full chunk of zeros when its size is given."""
    zero = F.lit(False) if size is None else F.col("digest") == F.sha2(F.lit(bytes(size)), 256)
    return chunked.groupBy("digest", "clen").agg(F.count("*").alias("n_refs"), F.min(F.struct("path", "off")).alias("owner")).select("digest", "clen", "n_refs", F.col("owner.path").alias("owner_path"), F.col("owner.off").alias("owner_off"), zero.alias("hole"))


def saved_bytes(chunked: DataFrame, size: int | None = None) -> DataFrame:
    """n_chunks, n_unique, total, stored and saved bytes; holes are not stored."""
    u = unique_chunks(chunked, size)
    kept = F.when(F.col("hole"), 0).otherwise(F.col("clen"))
    return u.agg(F.sum("n_refs").alias("n_chunks"), F.count("*").alias("n_unique"), F.sum(F.col("n_refs") * F.col("clen")).alias("total_bytes"), F.sum(kept).alias("stored_bytes"), (F.sum(F.col("n_refs") * F.col("clen")) - F.sum(kept)).alias("saved_bytes"))


def identical(files: DataFrame, content: str = "content") -> DataFrame:
    """digest, n_files, first_path of contents that several non-empty files have."""
    d = files.filter(F.octet_length(content) > 0).select("path", F.sha2(F.col(content).cast("binary"), 256).alias("digest"))
    return d.groupBy("digest").agg(F.count("*").alias("n_files"), F.min("path").alias("first_path")).filter("n_files > 1")


def fingerprints(files: DataFrame, content: str = "content") -> DataFrame:
    """path and the digest attribute's text, for files with bytes."""
    return files.filter(F.octet_length(content) > 0).select("path", F.concat(F.lit("sha256:"), F.sha2(F.col(content).cast("binary"), 256)).alias("digest"))


def tail_groups(files: DataFrame, content: str = "content", length: int = 64) -> DataFrame:
    """tail (hex of the last bytes), n_files, first_path: candidates for sharing tails; files of more than `length` bytes."""
    c = F.col(content).cast("binary")
    t = files.filter(F.octet_length(c) > length).select("path", F.lower(F.hex(F.expr(f"substring(cast({content} as binary), -{length}, {length})"))).alias("tail"))
    return t.groupBy("tail").agg(F.count("*").alias("n_files"), F.min("path").alias("first_path")).filter("n_files > 1")


def suffix_matches(files: DataFrame, content: str = "content", length: int = 64, whole_only: bool = False, settle: int = 4 << 20) -> DataFrame:
    """path, match_path, match_len: each file's longest common suffix with any file of smaller path, `length` bytes at least.

    Of several files with that suffix the least path is given; files are of more than `length` bytes. Of equal contents only the
    least path is compared: it finds what its copies find, and no file needs its copies. Suffixes meet by digest, never in pairs,
    first those of length, 2 length, 4 length and so on. A file matches at a length when the least path with its digest is smaller.
    Files that find none at the next length differ there from each other, so the lengths between are settled among them and the
    least path of the suffix they share: in one task where these bytes of a group are `settle` at most, else by digests of
    sixteenths of the range, again and again, until groups are small or ranges single bytes. Only bytes of such a range, and of
    the files that take part, are shuffled.
    """
    from canopy.plans.scratch import small_batches

    c = F.col(content).cast("binary")
    t = files.filter(F.octet_length(c) > length).select("path", c.alias("c"))
    with small_batches(files.sparkSession, 256):
        marks, found = _suffix_found(t, length, settle)
    own = found.filter("match_len = size" if whole_only else "match_len is not null").select("path", "match_path", "match_len")
    whole = found.filter("n > 1").select("whole", "n", "size", F.col("path").alias("first"), F.when(F.col("match_len") == F.col("size"), F.col("match_path")).otherwise(F.col("path")).alias("match_path"))
    copies_ = _meet(marks.select("path", "whole"), whole, "whole").filter("path <> first")
    return own.unionByName(copies_.select("path", "match_path", F.col("size").alias("match_len")))


def _suffix_found(t: DataFrame, length: int, settle: int) -> tuple[DataFrame, DataFrame]:
    """The marks of all files, and of each content whole, n, path (the least), size, match_path, match_len; both stored. t: path, c."""
    from canopy.plans.scratch import stored

    marks = stored(_suffix_marks(t, length), "suffix-marks")
    once = marks.groupBy("whole").agg(F.min(F.struct("path", "size", "keys")).alias("r"), F.count("*").alias("n"))
    once = stored(once.select("whole", "n", "r.path", "r.size", "r.keys"), "suffix-contents")
    levels = once.select("path", F.posexplode("keys").alias("k", "key")).select("path", "key", F.expr(f"shiftleft({length}L, k)").alias("lo"))
    open_ = stored(_longer_suffixes(levels.withColumn("width", F.col("lo"))), "suffixes")
    done = None
    while True:
        group = open_.groupBy("key").agg(((F.count("*") + 1) * F.max("width")).alias("bytes"))
        big = stored(group.filter(F.col("bytes") > settle).select("key"), "suffix-groups")
        # a big group's rows are not dealt by its key: there are few such groups for the rows
        large = F.broadcast(big.select("key", F.lit(True).alias("large")))
        now = open_.join(large, "key", "left").withColumn("large", F.coalesce("large", F.lit(False)))
        least = now.select(F.col("match_path").alias("path"), "key", "lo", "width", "large").distinct().withColumn("own", F.lit(False))
        members = stored(now.select("path", "key", "lo", "width", "large", F.lit(True).alias("own")).unionByName(least), "suffix-members")
        settled = _settled(_pieces(t, members.filter("not large"), length))
        done = settled if done is None else done.unionByName(settled)
        open_ = now.filter("large").select("path", "key", "lo", "width", "match_path")
        if not big.limit(1).count():
            break
        further = _longer_suffixes(stored(_range_digests(_pieces(t, members.filter("large"), length)), "suffix-digests"))
        step = F.greatest(F.floor(F.col("width") / 16), F.lit(1)).cast("long")
        moved = further.select("path", *[F.col(x).alias(f"_{x}") for x in ("key", "lo", "width", "match_path")])
        # who finds nothing stays with its match, and its range ends at the first step
        now = open_.withColumn("width", step).join(moved, "path", "left").select("path", *[F.coalesce(f"_{x}", x).alias(x) for x in ("key", "lo", "width", "match_path")])
        now = stored(now, "suffixes")
        done = done.unionByName(now.filter("width = 1").select("path", "match_path", F.col("lo").alias("match_len")))
        open_ = now.filter("width > 1")
    return marks, stored(once.drop("keys").join(done, "path", "left"), "suffix-found")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows one by one: no second copy of all contents of a batch."""
    for k in range(batch.num_rows):
        yield tuple(x[k].as_py() for x in batch.columns)


def _suffix_marks(files: DataFrame, length: int) -> DataFrame:
    """path, size, whole (the content's digest), keys: digests of its suffixes of length, 2 length, 4 length and so on. files: path, c."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            rows = []
            for path, c in _rows(b):
                h, at, keys = hashlib.blake2b(digest_size=16), 0, []
                for n in (length << k for k in range(len(c).bit_length())):
                    if n > len(c):
                        break
                    h.update(c[len(c) - n : len(c) - at])
                    at = n
                    keys.append(h.digest())
                rows.append((path, len(c), hashlib.blake2b(c, digest_size=16).digest(), keys))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.binary(), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "size", "whole", "keys"])

    return files.mapInArrow(work, "path string, size long, whole binary, keys array<binary>")


def _pieces(files: DataFrame, members: DataFrame, length: int) -> DataFrame:
    """key, path, lo, width, own, piece: of each member, the bytes before its suffix of length lo, less than width of them.

    files: path, c. A range lies between one of the first lengths and twice that. Python hands on just these bytes, and those of
    members only, by a bitmap of paths with the number k of the length; contents are not shuffled.
    """
    members = members.withColumn("k", (F.length(F.bin(F.expr(f"lo div {length}"))) - 1).cast("int"))
    keys = members.select(F.xxhash64("path").bitwiseXOR(F.shiftleft(F.col("k").cast("long"), 40)))
    words = files.sparkSession.sparkContext.broadcast(bitmap(keys))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, h, n = [], b.column(0).to_numpy(), b.column(3).to_numpy()
            for k in range(int(n.max(initial=0) // length).bit_length()):
                for at in may_hold(words.value, h ^ np.int64(k << 40)).tolist():
                    if n[at] >= length << k:
                        rows.append((b.column(1)[at].as_py(), k, b.column(2)[at].as_buffer()[max(0, int(n[at]) - (2 * length << k) + 1) : int(n[at]) - (length << k)].to_pybytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary()), strict=True)], names=["path", "k", "c"])

    part = files.select(F.xxhash64("path").alias("h"), "path", "c", F.octet_length("c").alias("n")).mapInArrow(some, "path string, k int, c binary")
    before = f"(octet_length(c) - (lo - shiftleft({length}L, k)))"
    piece = F.expr(f"substring(c, cast(greatest({before} - width + 2, 1) as int), cast(least({before}, width - 1) as int))")
    return members.join(part, ["path", "k"]).select("key", "path", "lo", "width", "own", piece.alias("piece"))


def _settled(pieces: DataFrame) -> DataFrame:
    """path, match_path, match_len of own members of groups that fit in one task.

    In the order of paths, each piece goes into a list sorted from its end: its neighbours there share most with it. The least path
    that shares as much is found along the matches of these, whose lengths fall.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_left

        group = None
        for b in batches:
            rows = []
            for key, path, lo, _, own, piece in _rows(b):
                if key != group:
                    group, ordered, names, found = key, [], [], {}
                turned = piece[::-1]
                at = bisect_left(ordered, turned)
                near = [(common_prefix(turned, ordered[k]), names[k]) for k in (at - 1, at) if 0 <= k < len(ordered)]
                n, match = max(near, default=(-1, None))
                while match is not None and found[match][1] >= n:
                    match = found[match][0]
                found[path] = match, n
                ordered.insert(at, turned)
                names.insert(at, path)
                if own:
                    rows.append((path, match, lo + n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["path", "match_path", "match_len"])

    return pieces.repartition("key").sortWithinPartitions("key", "path").mapInArrow(work, "path string, match_path string, match_len long")


def _range_digests(pieces: DataFrame) -> DataFrame:
    """path, key, lo, width: digests of each member's suffixes at sixteenths of its range, and the width of the range after each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            rows = []
            for key, path, lo, width, _, piece in _rows(b):
                step = max(1, width // 16)
                h = hashlib.blake2b(key, digest_size=16)
                for n in range(step, len(piece) + 1, step):
                    h.update(piece[len(piece) - n : len(piece) - n + step])
                    rows.append((path, h.digest(), lo + n, step))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["path", "key", "lo", "width"])

    return pieces.mapInArrow(work, "path string, key binary, lo long, width long")


def _longer_suffixes(digests: DataFrame) -> DataFrame:
    """path, key, lo, width, match_path: of each path, its longest suffix that a smaller path has, and the least path that has it."""
    from canopy.plans.scratch import stored

    least = digests.groupBy("key").agg(F.min("path").alias("match_path"), F.max("path").alias("last"), F.count("*").alias("n")).filter("match_path < last").drop("last")
    met = _meet(digests, stored(least, "suffix-least"), "key").filter("match_path < path")
    best = met.groupBy("path").agg(F.max_by(F.struct("key", "lo", "width", "match_path"), "lo").alias("b"))
    return best.select("path", "b.*")


def _meet(rows: DataFrame, groups: DataFrame, key: str, many: int = 20000) -> DataFrame:
    """rows with the columns of their group (unique keys, n rows each), inner. Groups of more than `many` rows come to the rows:

    no task has all rows of one key, and there are few such groups for the rows.
    """
    large = groups.filter(F.col("n") > many)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(groups.filter(F.col("n") <= many), key)
    return rest.unionByName(rows.join(F.broadcast(large), key))


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8)[:n] != np.frombuffer(b, np.uint8)[:n])
    return int(differ[0]) if len(differ) else n


def common_suffix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8)[len(a) - n :], np.frombuffer(b, np.uint8)[len(b) - n :]
    differ = np.flatnonzero(x != y)
    return n - 1 - int(differ[-1]) if len(differ) else n


def pack_tails(tails: DataFrame, buckets: int = 256) -> DataFrame:
    """path, off: places of tails in one packed object, ordered by bucket and path; tails: path, tlen.

    Running sums are kept within hash buckets; the buckets' totals, a fixed number, give each bucket's start.
    """
    b = tails.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)))
    start = b.groupBy("bucket").agg(F.sum("tlen").alias("total")).withColumn("start", F.coalesce(F.sum("total").over(W.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    w = W.partitionBy("bucket").orderBy("path").rowsBetween(W.unboundedPreceding, -1)
    return b.withColumn("before", F.coalesce(F.sum("tlen").over(w), F.lit(0))).join(F.broadcast(start.select("bucket", "start")), "bucket").select("path", "tlen", (F.col("start") + F.col("before")).alias("off"))


def window_sums(data: bytes, window: int) -> np.ndarray:
    """A weak hash of every window of the data: sum of byte[i] * 256 ** (i mod 4) modulo 2 ** 32 - 1, i from the window's start.

    256 ** 4 is 1 in that ring, so one running sum gives all windows at once, each turned to its start.
    """
    x = np.frombuffer(data, np.uint8)
    n = len(x) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    ring = np.uint64((1 << 32) - 1)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x.astype(np.uint64) << (np.arange(len(x), dtype=np.uint64) % 4 * 8), out=total[1:])
    part = (total[window:] - total[:n]) % ring
    return (part << ((4 - np.arange(n, dtype=np.uint64) % 4) % 4 * 8)) % ring


def sums_by_block(data: bytes, window: int, block: int = 1 << 16) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, window_sums from there) of `block` windows at a time: memory does not grow with the data."""
    view = memoryview(data)
    for at in range(0, len(data) - window + 1, block):
        yield at, window_sums(view[at : at + block + window - 1], window)


def _windows(files: DataFrame, window: int, words=None) -> DataFrame:
    """path, off, weak, digest of each file's aligned windows, or of those at any offset whose weak hash the bitmap may hold.

    files: path, c. A worker has one file at a time beside its batch, and hands on 1,024 rows at once.
    """
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        def rows() -> Iterator[tuple]:
            for b in batches:
                for path, c in _rows(b):
                    for start, sums in sums_by_block(c, window):
                        kept = np.arange(-start % window, len(sums), window) if words is None else may_hold(words.value, sums)
                        for k, weak in zip(kept.tolist(), sums[kept].tolist(), strict=True):
                            yield path, start + k, weak, hashlib.sha256(memoryview(c)[start + k : start + k + window]).digest()

        found = rows()
        while part := list(islice(found, 1024)):
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*part, strict=True), kinds, strict=True)], names=["path", "off", "weak", "digest"])

    return files.mapInArrow(work, "path string, off long, weak long, digest binary")


def rolling_dedupe(files: DataFrame, window: int = 4096, content: str = "content") -> DataFrame:
    """path, off, match_path, match_off, match_len: stretches equal to an aligned window of a file with a smaller path.

    Aligned windows of all files are the index (first owner of a digest: least path and offset). A file's windows at any offset
    whose weak hash may be in the index, by a bitmap of fixed size, are digested where they are found and joined by hash and
    digest, which drops what is not; matches grow forward in whole windows of the owner by joining consecutive windows (gaps and
    islands). Contents go to Python a few files at a time and are not shuffled.
    """
    from canopy.plans.scratch import small_batches, stored

    f = files.select("path", F.col(content).cast("binary").alias("c")).filter(F.octet_length("c") >= window)
    with small_batches(files.sparkSession, 64):
        index = stored(_windows(f, window).groupBy("weak", "digest").agg(F.min(F.struct("path", "off")).alias("owner")), "windows")
        words = files.sparkSession.sparkContext.broadcast(bitmap(index.select("weak")))
        hits = stored(_windows(f, window, words), "window-hits")
    met = hits.join(index, ["weak", "digest"]).filter((F.col("owner.path") < F.col("path")) | ((F.col("owner.path") == F.col("path")) & (F.col("owner.off") + window <= F.col("off"))))
    m = met.select("path", "off", F.col("owner.path").alias("match_path"), F.col("owner.off").alias("match_off"), F.pmod("off", F.lit(window)).alias("phase"))
    w = W.partitionBy("path", "match_path", "phase").orderBy("off")
    joined = (F.lag("off").over(w) + window == F.col("off")) & (F.lag("match_off").over(w) + window == F.col("match_off"))
    island = m.withColumn("new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return island.groupBy("path", "match_path", "phase", "island").agg(F.min("off").alias("off"), F.min("match_off").alias("match_off"), (F.count("*") * window).alias("match_len")).select("path", "off", "match_path", "match_off", "match_len")


def intern(xattrs: DataFrame) -> DataFrame:
    """name, value, n: each attribute once."""
    return xattrs.groupBy("name", "value").agg(F.count("*").alias("n"))


def suffix_length(a: Column, b: Column) -> Column:
    @F.pandas_udf("long")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([common_suffix(bytes(p), bytes(q)) for p, q in zip(x, y, strict=True)])

    return f(a, b)


def copies(files: DataFrame) -> DataFrame:
    """path, owner of files that repeat the contents of a file of smaller path; empty files have no owner. files: path, content.

    Equal means equal SHA-256 and length: no contents meet, and only digests are shuffled.
    """
    f = files.filter(F.octet_length("content") > 0).select("path", F.sha2("content", 256).alias("digest"), F.octet_length("content").alias("size"))
    owner = f.groupBy("digest", "size").agg(F.min("path").alias("owner"), F.count("*").alias("n")).filter("n > 1")
    return f.join(owner, ["digest", "size"]).filter("path <> owner").select("path", "owner")
