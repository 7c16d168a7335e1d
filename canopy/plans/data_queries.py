"""Queries on extents, devices, deduplication, extended attributes and integrity, bound to the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.functions import columns as C
from canopy.operators import dedupe, extents, integrity, xattrs
from canopy.operators.order import running
from canopy.operators.paths import tree
from canopy.plans.registry import query
from canopy.sources import vfs
from canopy.sources.vfs import DEVICES, EXTENTS, FILES, INODES, REQUESTS, XATTRS, table

CH = 512
CHUNKS = f"""{FILES}, pages0 AS (SELECT path, encode(text) AS c, size FROM files WHERE size > 0),
chunks AS (SELECT path, CAST(i AS INTEGER) AS chunk_no, CAST(i * {CH} AS BIGINT) AS off, CAST(least({CH}, size - i * {CH}) AS BIGINT) AS clen, sha256(c[i * {CH} + 1 : i * {CH} + {CH}]) AS digest
 FROM pages0, LATERAL (SELECT unnest(range((size + {CH} - 1) // {CH})) AS i))"""


def _files(s, d):
    return vfs.files(s, d).withColumn("content", F.encode("text", "UTF-8"))


def _chunks(s, d):
    return dedupe.chunks(_files(s, d), CH)


query("d1_chunks", f"WITH {CHUNKS} SELECT path, chunk_no, off, clen, digest FROM chunks")(_chunks)
query("d1_unique_chunks", f"""WITH {CHUNKS} SELECT digest, clen, count(*) AS n_refs, min({{'p': path, 'o': off}}).p AS owner_path, min({{'p': path, 'o': off}}).o AS owner_off, false AS hole FROM chunks GROUP BY 1, 2""")(
    lambda s, d: dedupe.unique_chunks(_chunks(s, d), CH))
query("a14_d2_saved_bytes", f"""WITH {CHUNKS}, u AS (SELECT digest, clen, count(*) AS n FROM chunks GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS n_chunks, count(*) AS n_unique, CAST(sum(n * clen) AS BIGINT) AS total_bytes, CAST(sum(clen) AS BIGINT) AS stored_bytes, CAST(sum(n * clen) - sum(clen) AS BIGINT) AS saved_bytes FROM u""")(
    lambda s, d: dedupe.saved_bytes(_chunks(s, d), CH))
query("d8_tail_groups", f"""WITH {FILES}, t AS (SELECT path, lower(hex(encode(text)[size - 63 : size])) AS tail FROM files WHERE size > 64)
SELECT tail, count(*) AS n_files, min(path) AS first_path FROM t GROUP BY 1 HAVING count(*) > 1""")(lambda s, d: dedupe.tail_groups(_files(s, d)))
query("d8_suffix_matches", None)(lambda s, d: dedupe.suffix_matches(_files(s, d)))
query("d9_whole_file_matches", None)(lambda s, d: dedupe.suffix_matches(_files(s, d), whole_only=True))
query("d10_packed_tails", None)(lambda s, d: dedupe.pack_tails(vfs.files(s, d).select("path", F.least("size", F.lit(4096)).cast("long").alias("tlen"))))
query("d5_rolling_dedupe", None)(lambda s, d: dedupe.rolling_dedupe(_files(s, d), 4096))
query("d11_identical_files", f"""WITH {FILES} SELECT sha256(text) AS digest, count(*) AS n_files, min(path) AS first_path FROM files WHERE size > 0 GROUP BY 1 HAVING count(*) > 1""")(lambda s, d: dedupe.identical(_files(s, d)))
query("d11_fingerprints", f"WITH {FILES} SELECT path, 'sha256:' || sha256(text) AS digest FROM files WHERE size > 0")(lambda s, d: dedupe.fingerprints(_files(s, d)))
query("d12_interned", f"WITH {XATTRS} SELECT name, value, count(*) AS n FROM xattrs GROUP BY 1, 2")(lambda s, d: dedupe.intern(vfs.xattrs(s, d)))

SHARED = f"{XATTRS}, shared AS (SELECT name, value, count(*) AS n FROM xattrs GROUP BY 1, 2 HAVING count(*) > 2), sized AS (SELECT name, value, (4 + strlen(name) - 5 + strlen(value) + 3) & -4 AS bytes FROM shared)"
query("a11_shared_xattrs", f"WITH {SHARED} SELECT * FROM shared")(lambda s, d: xattrs.shared(vfs.xattrs(s, d)))
query("a12_shared_ids", f"WITH {SHARED} SELECT name, value, CAST((sum(bytes) OVER (ORDER BY name, value ROWS UNBOUNDED PRECEDING) - bytes) // 4 AS BIGINT) AS shared_id FROM sized")(lambda s, d: xattrs.shared_ids(vfs.xattrs(s, d)))
query("a13_inline_sizes", f"""WITH {SHARED}, x AS (SELECT x.nid, s.n IS NOT NULL AS sh, (4 + strlen(x.name) - 5 + strlen(x.value) + 3) & -4 AS bytes FROM xattrs x LEFT JOIN shared s ON s.name = x.name AND s.value IS NOT DISTINCT FROM x.value)
SELECT nid, count(*) FILTER (WHERE sh) AS n_shared, CAST(sum(CASE WHEN sh THEN 4 ELSE bytes END) + 12 AS BIGINT) AS body_size FROM x GROUP BY 1""")(lambda s, d: xattrs.inline_sizes(vfs.xattrs(s, d)))
query("p14_long_prefixes", f"""WITH {XATTRS} SELECT nid, name, CASE WHEN starts_with(name, 'user.so') THEN 0 WHEN starts_with(name, 'user.') THEN 1 END AS prefix, CASE WHEN starts_with(name, 'user.so') THEN substr(name, 8) ELSE substr(name, 6) END AS rest FROM xattrs""")(
    lambda s, d: vfs.xattrs(s, d).select("nid", "name", (x := xattrs.long_prefix(F.col("name"), ["user.so", "user.", "user.sour"]))[0].alias("prefix"), x[1].alias("rest")))
query("s11_xattr_names", f"WITH {XATTRS} SELECT nid, name AS full_name, 1 AS prefix_index FROM xattrs")(
    lambda s, d: vfs.xattrs(s, d).select("nid", xattrs.full_name((x := xattrs.split_name(F.col("name")))[0], F.lit(None).cast("string"), x[1]).alias("full_name"), x[0].alias("prefix_index")))
query("j11_j12_xattr_lookup", f"""WITH {SHARED}, w AS (SELECT doc_id AS nid, 'user.source' AS name FROM documents UNION ALL SELECT doc_id, 'user.none' FROM documents)
SELECT w.nid, w.name, x.value FROM w LEFT JOIN xattrs x ON x.nid = w.nid AND x.name = w.name""")(lambda s, d: _xattr_lookup(s, d))


def _xattr_lookup(s, d):
    x = vfs.xattrs(s, d)
    ids = xattrs.shared_ids(x)
    marked = x.join(ids, ["name", "value"], "left")
    inline, refs = marked.filter("shared_id is null").select("nid", "name", "value"), marked.filter("shared_id is not null").select("nid", "shared_id")
    docs = table(s, d, "documents").select(F.col("doc_id").alias("nid"))
    wanted = docs.withColumn("name", F.lit("user.source")).unionByName(docs.withColumn("name", F.lit("user.none")))
    return xattrs.lookup(inline, refs, ids, wanted)


query("w4_physical_starts", f"WITH {EXTENTS} SELECT nid, ext_no, CAST(sum(plen) OVER (PARTITION BY nid ORDER BY ext_no ROWS UNBOUNDED PRECEDING) - plen AS BIGINT) AS pa FROM extents")(
    lambda s, d: extents.physical_starts(vfs.extents(s, d).drop("pa")).select("nid", "ext_no", "pa"))
query("w2_next_starts", f"WITH {EXTENTS} SELECT nid, la, llen FROM extents")(
    lambda s, d: extents.next_starts((e := vfs.extents(s, d)).select("nid", "la").join(e.groupBy("nid").agg(F.sum("llen").alias("size")), "nid")).select("nid", "la", "llen"))
query("w3_heads", """WITH c AS (SELECT user_id AS nid, event_id AS lcn, event_id % 4 = 0 AS h FROM events) SELECT nid, lcn, max(CASE WHEN h THEN lcn END) OVER (PARTITION BY nid ORDER BY lcn ROWS UNBOUNDED PRECEDING) AS head FROM c""")(
    lambda s, d: extents.head_of(table(s, d, "events").select(F.col("user_id").alias("nid"), F.col("event_id").alias("lcn"), (F.col("event_id") % 4 == 0).alias("is_head"))).select("nid", "lcn", "head"))
query("j7_offsets", f"""WITH {EXTENTS}, {REQUESTS} SELECT r.request_id, r.nid, r.off, e.ext_no, CASE WHEN r.off - e.la < e.plen THEN e.pa + r.off - e.la END AS pa FROM requests r LEFT JOIN extents e ON e.nid = r.nid AND e.la <= r.off AND r.off < e.la + e.llen""")(
    lambda s, d: extents.map_offsets(vfs.requests(s, d), vfs.extents(s, d)))
query("w7_k6_device_table", f"WITH {DEVICES} SELECT device_id, blocks, tag, CAST(sum(blocks) OVER (ORDER BY device_id ROWS UNBOUNDED PRECEDING) - blocks AS BIGINT) AS uniaddr FROM devices")(lambda s, d: extents.device_table(vfs.devices(s, d)))
query("j8_map_devices", f"""WITH {DEVICES}, t AS (SELECT *, CAST(sum(blocks) OVER (ORDER BY device_id ROWS UNBOUNDED PRECEDING) - blocks AS BIGINT) AS uniaddr FROM devices),
a AS (SELECT event_id AS addr_id, event_id * 104729 % 900000000 AS pa, CAST(CASE WHEN event_id % 5 = 0 THEN event_id % 50 + 1 ELSE 0 END AS INTEGER) AS device_id FROM events)
SELECT addr_id, CASE WHEN a.device_id <> 0 THEN a.device_id ELSE coalesce(t.device_id, 0) END AS device_id, CASE WHEN a.device_id <> 0 THEN pa ELSE pa - coalesce(uniaddr, 0) END AS pa FROM a LEFT JOIN t ON pa >= uniaddr AND pa < uniaddr + blocks""")(
    lambda s, d: extents.map_devices(table(s, d, "events").select(F.col("event_id").alias("addr_id"), (F.col("event_id") * 104729 % 900000000).alias("pa"), F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 50 + 1).otherwise(0).cast("int").alias("device_id")), extents.device_table(vfs.devices(s, d))))

RUNS = """c0 AS (SELECT user_id AS nid, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS chunk_no, event_id FROM events),
c AS (SELECT nid, chunk_no, CASE WHEN chunk_no % 5 = 0 THEN 1000 + chunk_no * 100 ELSE chunk_no * 2 END AS startblk, CAST(2 AS BIGINT) AS n_blocks, CAST(chunk_no // 7 % 2 AS INTEGER) AS device_id FROM c0),
m AS (SELECT *, CASE WHEN lag(startblk) OVER w + lag(n_blocks) OVER w = startblk AND lag(device_id) OVER w = device_id THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY nid ORDER BY chunk_no)),
i AS (SELECT *, sum(new) OVER (PARTITION BY nid ORDER BY chunk_no ROWS UNBOUNDED PRECEDING) AS island FROM m),
isles AS (SELECT nid, CAST(island AS BIGINT) AS island, min(chunk_no) AS first_chunk, CAST(arg_min(startblk, chunk_no) AS BIGINT) AS startblk, CAST(sum(n_blocks) AS BIGINT) AS n_blocks, any_value(device_id) AS device_id FROM i GROUP BY nid, island)"""


def _isles(s, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("event_id")
    n = F.col("chunk_no")
    c = table(s, d, "events").select(F.col("user_id").alias("nid"), F.row_number().over(w).cast("long").alias("chunk_no"))
    c = c.select("nid", "chunk_no", F.when(n % 5 == 0, 1000 + n * 100).otherwise(n * 2).alias("startblk"), F.lit(2).cast("long").alias("n_blocks"), (F.expr("chunk_no div 7") % 2).cast("int").alias("device_id"))
    return extents.islands(c)


query("w5_islands", f"WITH {RUNS} SELECT * FROM isles")(_isles)
query("w6_chunk_growth", f"WITH {RUNS} SELECT nid, CAST(log2(min(n_blocks & -n_blocks)) AS INTEGER) AS grow_bits FROM isles GROUP BY 1")(lambda s, d: extents.chunk_growth(_isles(s, d)))
query("k3_block_map", f"WITH {RUNS} SELECT nid, printf('%08x %8x %08x', startblk, n_blocks, first_chunk * 4096) AS line FROM isles")(lambda s, d: extents.block_map_lines(_isles(s, d).withColumn("srcoff", F.col("first_chunk") * 4096)))
query("k4_vmdk_extents", f"""WITH {DEVICES}, x AS (SELECT device_id, tag, blocks * 8 AS sectors FROM devices)
SELECT device_id, p AS part, 'RW ' || least(4194304, sectors - p * 4194304) || ' FLAT "' || tag || '" ' || p * 4194304 AS line FROM x, LATERAL (SELECT unnest(range((sectors - 1) // 4194304 + 1)) AS p)""")(lambda s, d: extents.vmdk_extents(vfs.devices(s, d)))
query("k4_vmdk_cylinders", f"WITH {DEVICES} SELECT CAST((sum(blocks * 8) + 1007) // 1008 AS BIGINT) AS cylinders FROM devices")(lambda s, d: extents.vmdk_cylinders(vfs.devices(s, d)))
query("x1_flat_map", f"""WITH {INODES}, f AS (SELECT nid, size, datalayout, nid * 8 AS startblk, nid * 32 AS iloc, CASE WHEN datalayout = 2 THEN size // 4096 * 4096 ELSE size END AS head FROM inodes)
SELECT nid, 0 AS ext_no, CAST(0 AS BIGINT) AS la, head AS llen, startblk * 4096 AS pa FROM f WHERE head > 0 UNION ALL SELECT nid, 1, head, size - head, iloc + 64 + 12 FROM f WHERE size > head""")(
    lambda s, d: extents.flat_map(vfs.inodes(s, d).select("nid", "size", "datalayout", (F.col("nid") * 8).alias("startblk"), (F.col("nid") * 32).alias("iloc"), F.lit(64).alias("inode_isize"), F.lit(12).alias("xattr_isize"))))
query("x2_chunk_map", f"""WITH {INODES}, f AS (SELECT nid, size FROM inodes WHERE size > 0), c AS (SELECT nid, size, CAST(i AS BIGINT) AS chunk_no FROM f, LATERAL (SELECT unnest(range((size + 65535) // 65536)) AS i))
SELECT nid, chunk_no, chunk_no * 65536 AS la, least(65536, (size - chunk_no * 65536 + 4095) // 4096 * 4096) AS llen, CASE WHEN (nid + chunk_no) % 7 <> 0 THEN (nid + chunk_no) * 4096 END AS pa, 0 AS device_id FROM c""")(
    lambda s, d: extents.chunk_map(i := vfs.inodes(s, d).filter("size > 0").select("nid", "size", F.lit(16).alias("chunkbits")),
        i.select("nid", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("size") + 65535, 16) - 1)).alias("chunk_no")).withColumn("startblk", F.when((F.col("nid") + F.col("chunk_no")) % 7 != 0, F.col("nid") + F.col("chunk_no"))).withColumn("device_id", F.lit(0))))
query("x7_range_parts", f"""WITH {EXTENTS}, {REQUESTS}, p AS (SELECT request_id, greatest(off, la) AS part_off, least(off + len, la + llen) - greatest(off, la) AS n, pa + greatest(off, la) - la AS pa FROM requests JOIN extents USING (nid) WHERE off < la + llen AND la < off + len)
SELECT request_id, part_off, n, pa, CAST(row_number() OVER (PARTITION BY request_id ORDER BY part_off) - 1 AS INTEGER) AS part_no FROM p""")(lambda s, d: extents.range_parts(vfs.requests(s, d), vfs.extents(s, d)))

DOCREQ = "dr AS (SELECT event_id AS request_id, event_id * 31 % (SELECT max(doc_id) + 1 FROM documents) AS nid, event_id * 7919 % 6000 AS off, event_id % 9 * 300 AS len FROM events)"


def _doc_requests(s, d):
    e = F.col("event_id")
    many = table(s, d, "documents").agg((F.max("doc_id") + 1).alias("many"))  # one row
    return table(s, d, "events").crossJoin(F.broadcast(many)).select(e.alias("request_id"), (e * 31 % F.col("many")).alias("nid"), (e * 7919 % 6000).alias("off"), (e % 9 * 300).alias("len"))


def _segments(s, d, size=1024):
    c = _files(s, d).select("nid", F.col("content").alias("c"), "size").filter("size > 0")
    at = c.select("nid", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {size}"))).alias("seg_no"))
    return at.select("nid", (F.col("seg_no") * size).alias("off"), F.expr(f"substring(c, cast(seg_no * {size} + 1 as int), {size})").alias("data"))


query("x6_x7_s10_read_ranges", f"""WITH {FILES}, {DOCREQ} SELECT request_id, sha256(CASE WHEN text IS NULL OR off >= size OR len = 0 THEN ''::BLOB ELSE encode(text)[off + 1 : least(off + len, size)] END) AS digest FROM dr LEFT JOIN files USING (nid)""")(
    lambda s, d: extents.read_ranges(_doc_requests(s, d), _segments(s, d)).select("request_id", F.sha2("data", 256).alias("digest")))
query("i13_differential_reads", f"""WITH {FILES}, {DOCREQ} SELECT request_id, sha256(CASE WHEN text IS NULL OR off >= size OR len = 0 THEN ''::BLOB ELSE encode(text)[off + 1 : least(off + len, size)] END) AS digest, true AS same FROM dr LEFT JOIN files USING (nid)""")(lambda s, d: _differential(s, d))


def _differential(s, d):
    r = _doc_requests(s, d)
    a = extents.read_ranges(r, _segments(s, d, 1024)).select("request_id", F.col("data").alias("a"))
    b = extents.read_ranges(r, _segments(s, d, 777)).select("request_id", F.col("data").alias("b"))
    return a.join(b, "request_id").select("request_id", F.sha2("a", 256).alias("digest"), (F.col("a") == F.col("b")).alias("same"))


query("j10_verified_copies", f"""WITH {FILES}, o AS (SELECT text, min(path) AS owner FROM files WHERE size > 0 GROUP BY 1) SELECT path, owner FROM files JOIN o USING (text) WHERE path <> owner""")(lambda s, d: _verified(s, d))


def _verified(s, d):
    return dedupe.copies(_files(s, d))


query("j13_compare_trees", f"""WITH {CHUNKS}, b AS (SELECT path, chunk_no, CASE WHEN chunk_no % 3 = 0 THEN 'x' ELSE digest END AS digest FROM chunks WHERE NOT contains(path, '/src3/')
UNION ALL SELECT path || '.new', chunk_no, digest FROM chunks WHERE contains(path, '/src4/'))
SELECT coalesce(a.path, b.path) AS path, coalesce(a.chunk_no, b.chunk_no) AS chunk_no, CASE WHEN b.path IS NULL THEN 'only_a' WHEN a.path IS NULL THEN 'only_b' ELSE 'differs' END AS status
FROM (SELECT path, chunk_no, digest FROM chunks) a FULL JOIN b ON a.path = b.path AND a.chunk_no = b.chunk_no WHERE a.digest IS DISTINCT FROM b.digest""")(lambda s, d: _compare(s, d))


def _compare(s, d):
    a = _chunks(s, d).select("path", "chunk_no", "digest")
    b = a.filter(~F.contains("path", F.lit("/src3/"))).withColumn("digest", F.when(F.col("chunk_no") % 3 == 0, "x").otherwise(F.col("digest")))
    b = b.unionByName(a.filter(F.contains("path", F.lit("/src4/"))).withColumn("path", F.concat("path", F.lit(".new"))))
    return integrity.compare_trees(a, b)


DIRENTS = """dirents AS (SELECT user_id AS dir_nid, event_id // 8 AS lblk, CAST(event_id % 8 AS INTEGER) AS idx, CASE event_id % 97 WHEN 1 THEN '' WHEN 2 THEN 'a/b' WHEN 3 THEN repeat('n', 256) ELSE 'f' || lpad(CAST(event_id - event_id % 5 * 20 AS VARCHAR), 8, '0') END AS name,
 event_id AS nid, CAST(event_id % 9 AS INTEGER) AS ftype FROM events)"""


def _dirents(s, d):
    e = F.col("event_id")
    name = F.when(e % 97 == 1, "").when(e % 97 == 2, "a/b").when(e % 97 == 3, F.expr("repeat('n', 256)")).otherwise(F.concat(F.lit("f"), F.lpad((e - e % 5 * 20).cast("string"), 8, "0")))
    return table(s, d, "events").select(F.col("user_id").alias("dir_nid"), F.expr("event_id div 8").alias("lblk"), (e % 8).cast("int").alias("idx"), name.alias("name"), e.alias("nid"), (e % 9).cast("int").alias("ftype"))


query("i3_w1_name_order", f"""WITH {DIRENTS}, o AS (SELECT *, lag(name) OVER (PARTITION BY dir_nid ORDER BY lblk, idx) AS prev FROM dirents) SELECT dir_nid, lblk, idx, name, nid, ftype FROM o WHERE prev IS NOT NULL AND name <= prev""")(lambda s, d: integrity.name_order(_dirents(s, d)))
query("i3_bad_names", f"WITH {DIRENTS} SELECT * FROM dirents WHERE strlen(name) NOT BETWEEN 1 AND 255 OR contains(name, '/') OR ftype > 7")(lambda s, d: integrity.bad_names(_dirents(s, d)))
SPECIAL = """sp AS (SELECT c_custkey AS dir_nid, '.' AS name, c_custkey + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS nid FROM customer WHERE c_custkey % 13 <> 0
UNION ALL SELECT c_custkey, '..', c_custkey // 10 FROM customer WHERE c_custkey % 17 <> 0 UNION ALL SELECT c_custkey, '..', c_custkey // 10 FROM customer WHERE c_custkey % 19 = 0 UNION ALL SELECT c_custkey, 'x', 5 FROM customer)"""
query("i4_w8_special_entries", f"""WITH {SPECIAL}, g AS (SELECT dir_nid, count(*) FILTER (WHERE name = '.') AS a, count(*) FILTER (WHERE name = '..') AS b, max(nid) FILTER (WHERE name = '.') AS dot, max(nid) FILTER (WHERE name = '..') AS up FROM sp GROUP BY 1),
r AS (SELECT dir_nid, CASE WHEN a > 1 THEN 'repeated .' WHEN b > 1 THEN 'repeated ..' WHEN a = 0 THEN 'missing .' WHEN b = 0 THEN 'missing ..' WHEN dot <> dir_nid THEN 'wrong .' WHEN up <> CASE WHEN dir_nid % 23 = 0 THEN 3 ELSE dir_nid // 10 END THEN 'wrong ..' END AS problem FROM g)
SELECT * FROM r WHERE problem IS NOT NULL""")(lambda s, d: _special(s, d))


def _special(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("dir_nid"))
    k = F.col("dir_nid")
    up = F.expr("dir_nid div 10")
    row = lambda df, name, nid: df.select("dir_nid", F.lit(name).alias("name"), nid.cast("long").alias("nid"))
    e = row(c.filter(k % 13 != 0), ".", k + F.when(k % 11 == 0, 1).otherwise(0)).unionByName(row(c.filter(k % 17 != 0), "..", up)).unionByName(row(c.filter(k % 19 == 0), "..", up)).unionByName(row(c, "x", F.lit(5)))
    return integrity.special_entries(e, c.select("dir_nid", F.when(k % 23 == 0, 3).otherwise(up).cast("long").alias("parent_nid")))


query("i9_bad_inodes", f"WITH {INODES}, i AS (SELECT nid, mode & 61440 AS m, nid % 6 AS datalayout, nid % 40 AS chunkbits FROM inodes) SELECT nid FROM i WHERE datalayout > 4 OR datalayout = 4 AND chunkbits > 31")(
    lambda s, d: integrity.bad_inodes(vfs.inodes(s, d).select("nid", "mode", (F.col("nid") % 6).alias("datalayout"), (F.col("nid") % 40).alias("chunkbits"))).select("nid"))
query("i10_type_mismatch", f"""WITH {INODES}, e AS (SELECT nid, CAST(nid % 8 AS INTEGER) AS ftype, 'n' || nid AS name FROM inodes) SELECT e.nid, e.ftype, e.name FROM e JOIN inodes i USING (nid)
WHERE e.ftype <> CASE i.mode & 61440 WHEN 32768 THEN 1 WHEN 16384 THEN 2 WHEN 8192 THEN 3 WHEN 24576 THEN 4 WHEN 4096 THEN 5 WHEN 49152 THEN 6 WHEN 40960 THEN 7 ELSE 0 END""")(
    lambda s, d: integrity.type_mismatch((i := vfs.inodes(s, d)).select("nid", (F.col("nid") % 8).cast("int").alias("ftype"), F.concat(F.lit("n"), "nid").alias("name")), i))
query("i7_x8_bad_extents", f"""WITH {EXTENTS}, x AS (SELECT nid, ext_no, llen * 700 AS llen, plen * 300 AS plen, nid % 2 = 0 AS encoded, nid % 5 = 0 AS fragment, CAST(ext_no % 5 AS INTEGER) AS alg FROM extents)
SELECT nid, ext_no FROM x WHERE NOT encoded AND llen <> plen OR encoded AND NOT fragment AND (plen > 1048576 OR llen > 12582912 OR alg > 3)""")(
    lambda s, d: integrity.bad_extents(vfs.extents(s, d).select("nid", "ext_no", (F.col("llen") * 700).alias("llen"), (F.col("plen") * 300).alias("plen"), (F.col("nid") % 2 == 0).alias("encoded"), (F.col("nid") % 5 == 0).alias("fragment"), (F.col("ext_no") % 5).cast("int").alias("alg"))).select("nid", "ext_no"))
query("i8_digest_status", f"""WITH {FILES}, v AS (SELECT path, nid, 'sha256:' || sha256(text) AS actual FROM files WHERE size > 0)
SELECT path, CASE nid % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'corrupt' WHEN 2 THEN 'mismatch' ELSE 'ok' END AS status FROM v""")(lambda s, d: _digests(s, d))


def _digests(s, d):
    f = _files(s, d)
    good = F.concat(F.lit("sha256:"), F.sha2("content", 256))
    v = f.filter("nid % 4 <> 0").select("path", F.when(F.col("nid") % 4 == 1, "md5:xyz").when(F.col("nid") % 4 == 2, F.concat(F.lit("sha256:"), F.sha2(F.encode("path", "UTF-8"), 256))).otherwise(good).alias("value"))
    return integrity.digest_status(f, v)


query("i12_tails_across_blocks", f"WITH {INODES} SELECT nid FROM inodes WHERE datalayout = 2 AND (nid * 32 + 76) % 4096 + size % 4096 > 4096")(
    lambda s, d: integrity.tails_across_blocks(vfs.inodes(s, d).withColumns({"iloc": F.col("nid") * 32, "inode_isize": F.lit(64), "xattr_isize": F.lit(12)})).select("nid"))
query("i6_xattr_bodies", """SELECT c_custkey AS nid, CASE WHEN c_custkey % 60 = 12 THEN 'reserved size' WHEN c_custkey % 60 BETWEEN 1 AND 11 THEN 'too small' ELSE 'entries do not fit' END AS problem FROM customer
WHERE c_custkey % 60 BETWEEN 1 AND 12 OR c_custkey % 60 > 12 AND 12 + 4 * (c_custkey % 3) + c_custkey % 7 * 4 > c_custkey % 60""")(
    lambda s, d: integrity.xattr_bodies(table(s, d, "customer").select((k := F.col("c_custkey")).alias("nid"), (k % 60).alias("body_size"), (k % 3).alias("n_shared"), (k % 7 * 4).alias("entry_bytes"))))
query("i11_verdict", f"""WITH {DIRENTS}, o AS (SELECT *, lag(name) OVER (PARTITION BY dir_nid ORDER BY lblk, idx) AS prev FROM dirents) SELECT 'names' AS "check", (SELECT count(*) FROM dirents WHERE strlen(name) NOT BETWEEN 1 AND 255 OR contains(name, '/') OR ftype > 7) AS n, true AS corrupted
UNION ALL SELECT 'order', (SELECT count(*) FROM o WHERE prev IS NOT NULL AND name <= prev), true""")(lambda s, d: integrity.verdict(names=integrity.bad_names(e := _dirents(s, d)), order=integrity.name_order(e)))
query("i5_directory_loops", f"""WITH {FILES}, dirs AS (SELECT DISTINCT dir, lang FROM files) SELECT dir || '/self' AS path FROM dirs UNION ALL SELECT dir || '/up' FROM dirs UNION ALL SELECT dir || '/root' FROM dirs""")(lambda s, d: _loops(s, d))


def _loops(s, d):
    """The tree of all files, with three loops planted in each directory of files: to itself, to the one above and to the root."""
    from canopy.operators.paths import walk
    from canopy.plans.tree_queries import _nid_dirents

    e = _nid_dirents(s, d)
    up = e.filter("ftype = 2").select(F.col("nid").alias("own"), F.col("dir_nid").alias("above"))
    holds = e.filter("ftype = 1").select(F.col("dir_nid").alias("own")).distinct().join(up, "own")
    planted = lambda name, to: holds.select(F.col("own").alias("dir_nid"), F.lit(name).alias("name"), to.cast("long").alias("nid"), F.lit(2).alias("ftype"))
    return walk(e.unionByName(planted("self", F.col("own"))).unionByName(planted("up", F.col("above"))).unionByName(planted("root", F.lit(1))), 1).filter("loop").select("path")


query("j4_hard_link_groups", f"""WITH {INODES} SELECT uid AS dev, size % 1000 AS ino, count(*) AS n_names, min(nid) AS first_nid FROM inodes WHERE mode & 61440 <> 16384 GROUP BY 1, 2 HAVING count(*) > 1""")(
    lambda s, d: vfs.inodes(s, d).filter(C.ftype_of(F.col("mode")) != 2).groupBy(F.col("uid").alias("dev"), (F.col("size") % 1000).alias("ino")).agg(F.count("*").alias("n_names"), F.min("nid").alias("first_nid")).filter("n_names > 1"))
query("j1_list_directory", f"""WITH {FILES}, dirs AS (SELECT DISTINCT dir AS path, lang AS parent FROM files UNION SELECT DISTINCT lang, '' FROM files) SELECT dir, name, 1 AS ftype, size FROM files UNION ALL SELECT parent, regexp_replace(path, '^.*/', ''), 2, NULL FROM dirs""")(
    lambda s, d: tree(f := vfs.files(s, d)).join(f.select("path", "size"), "path", "left").select("dir", "name", "ftype", "size"))
query("s15_list_from_offset", f"WITH {FILES}, o AS (SELECT dir, name, row_number() OVER (PARTITION BY dir ORDER BY name) AS n FROM files) SELECT dir, name FROM o WHERE n > 3")(lambda s, d: _page(s, d))


def _page(s, d):
    from pyspark.sql import Window as W

    return vfs.files(s, d).withColumn("n", F.row_number().over(W.partitionBy("dir").orderBy("name"))).filter("n > 3").select("dir", "name")


query("s13_tar_data_index", f"""WITH {FILES} SELECT path, CAST(sum((size + 511) // 512 * 512) OVER (PARTITION BY lang ORDER BY nid ROWS UNBOUNDED PRECEDING) - (size + 511) // 512 * 512 AS BIGINT) AS off FROM files""")(lambda s, d: _tar_index(s, d))


def _tar_index(s, d):
    return running(vfs.files(s, d).select("lang", "nid", "path", "size"), ["lang"], F.col("nid"), C.round_up(F.col("size"), 512), "off").select("path", "off")


query("s2d_pax_times", """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 1 THEN -event_id - 1 ELSE event_id END AS s, CAST(CASE event_id % 4 WHEN 0 THEN 500000000 WHEN 1 THEN 750000000 WHEN 2 THEN 123456789 END AS INTEGER) AS ns FROM events""")(
    lambda s, d: table(s, d, "events").withColumn("t", F.element_at(F.array(F.concat("event_id", F.lit(".5")), F.concat(F.lit("-"), "event_id", F.lit(".25")), F.concat("event_id", F.lit(".1234567899")), F.concat("event_id", F.lit("."))), (F.col("event_id") % 4 + 1).cast("int")))
    .select("event_id", (x := C.pax_time(F.col("t")))[0].alias("s"), x[1].alias("ns")))
query("s2e_octal_fields", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey END AS v FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", C.octal(F.when(F.col("o_orderkey") % 9 == 0, F.lit(" ")).otherwise(C.octal_field(F.col("o_orderkey")))).alias("v")))
query("s2c_header_precedence", """WITH h AS (SELECT event_id AS seq, user_id % 5 AS archive, CASE WHEN event_id % 10 = 0 THEN 'g' || event_id END AS g, CASE WHEN event_id % 3 = 0 THEN 'x' || event_id END AS x, 'u' || event_id AS u FROM events)
SELECT seq, coalesce(x, last_value(g IGNORE NULLS) OVER (PARTITION BY archive ORDER BY seq ROWS UNBOUNDED PRECEDING), u) AS path FROM h""")(lambda s, d: _precedence(s, d))


def _precedence(s, d):
    from canopy.sources.tar import precedence

    e = F.col("event_id")
    h = table(s, d, "events").select(e.alias("seq"), (F.col("user_id") % 5).alias("archive"), F.when(e % 10 == 0, F.concat(F.lit("g"), "event_id")).alias("global_value"), F.when(e % 3 == 0, F.concat(F.lit("x"), "event_id")).alias("local_value"), F.concat(F.lit("u"), "event_id").alias("field"))
    return precedence(h).select("seq", F.col("value").alias("path"))


query("k10_data_layout", f"WITH {INODES} SELECT nid, size // 4096 AS whole_blocks, size % 4096 AS tail FROM inodes WHERE mode & 61440 = 32768")(
    lambda s, d: vfs.inodes(s, d).filter(C.ftype_of(F.col("mode")) == 1).select("nid", F.shiftright("size", 12).alias("whole_blocks"), F.col("size").bitwiseAND(4095).alias("tail")))
query("k11_build_summary", f"""WITH {CHUNKS}, u AS (SELECT digest, clen, count(*) AS n FROM chunks GROUP BY 1, 2) SELECT (SELECT count(*) FROM files) AS inodes, CAST((SELECT sum((clen + 511) // 512) FROM u) AS BIGINT) AS blocks, CAST((SELECT sum((n - 1) * clen) FROM u) AS BIGINT) AS deduplicated_bytes""")(
    lambda s, d: dedupe.unique_chunks(_chunks(s, d)).agg(F.sum(C.blocks_of(F.col("clen"), 9)).alias("blocks"), F.sum((F.col("n_refs") - 1) * F.col("clen")).alias("deduplicated_bytes")).crossJoin(vfs.files(s, d).agg(F.count("*").alias("inodes"))))
query("o5_longest_match", f"""WITH {FILES} SELECT dir, arg_max(name, {{'s': size, 'n': -nid}}) AS name FROM files GROUP BY 1""")(lambda s, d: vfs.files(s, d).groupBy("dir").agg(F.max_by("name", F.struct("size", -F.col("nid"))).alias("name")))
query("o1_name_ranks", f"WITH {FILES} SELECT path, CAST(row_number() OVER (PARTITION BY dir ORDER BY name) AS INTEGER) AS pos FROM files")(lambda s, d: _ranks(s, d))
query("w10_inode_numbers", f"""WITH {FILES} SELECT path, CAST((sum(32 + size % 5 * 4 + (32 - (32 + size % 5 * 4) % 32) % 32) OVER (PARTITION BY lang ORDER BY nid ROWS UNBOUNDED PRECEDING) - (32 + size % 5 * 4 + (32 - (32 + size % 5 * 4) % 32) % 32)) // 32 AS BIGINT) AS slot FROM files""")(lambda s, d: _slots(s, d))


def _ranks(s, d):
    from pyspark.sql import Window as W

    return vfs.files(s, d).select("path", F.row_number().over(W.partitionBy("dir").orderBy(F.col("name").cast("binary"))).alias("pos"))


def _slots(s, d):
    rows = running(vfs.files(s, d).select("lang", "nid", "path", "size"), ["lang"], F.col("nid"), C.round_up(32 + F.col("size") % 5 * 4, 32), "at")
    return rows.select("path", F.shiftright("at", 5).alias("slot"))
