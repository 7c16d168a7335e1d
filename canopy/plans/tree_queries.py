"""Queries on statistics, attributes, filters, paths and layers, bound to the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.functions import columns as C
from canopy.operators import attrs, filters, layers, paths, stats
from canopy.plans.registry import query
from canopy.sources import vfs
from canopy.sources.vfs import FILES, INODES, table

KNOWN = "['.txt','.so','.xml','.apk','.odex','.vdex','.oat','.rc','.otf']"
BITLEN = lambda x: f"CASE WHEN {x} > 0 THEN length(bin({x})) ELSE 0 END"

query("a3_size_histogram", f"""WITH {FILES}, b AS (SELECT least(16, {BITLEN('size // 1024')}) AS bucket FROM files)
SELECT CAST(r.i AS INTEGER) AS bucket, CAST(count(b.bucket) AS BIGINT) AS n_files FROM range(17) r(i) LEFT JOIN b ON b.bucket = r.i GROUP BY 1""")(
    lambda s, d: stats.size_histogram(vfs.files(s, d)))

query("a5_size_ratio", f"""WITH {FILES}, b AS (SELECT least(16, {BITLEN('size // 1024')}) AS bucket, count(*) AS n FROM files GROUP BY 1), t AS (SELECT count(*) AS total FROM files)
SELECT CAST(bucket AS INTEGER) AS bucket, n, n * 100.0::DOUBLE / total AS ratio, repeat('#', CAST(floor(n * 100.0::DOUBLE / total / 2) AS BIGINT)) AS bar FROM b, t""")(
    lambda s, d: stats.with_ratio((f := vfs.files(s, d)).groupBy(C.size_bucket(F.col("size")).alias("bucket")).agg(F.count("*").alias("n"))
                                  .join(F.broadcast(f.agg(F.count("*").alias("total")))), F.col("total")).drop("total"))


def _tree(s, d):
    return paths.tree(vfs.files(s, d))


TREE = f"""{FILES}, dirs AS (SELECT DISTINCT dir AS path, lang AS parent FROM files UNION SELECT DISTINCT lang, '' FROM files),
tree AS (SELECT dir, name, path, 1 AS ftype FROM files UNION ALL SELECT parent, regexp_replace(path, '^.*/', ''), path, 2 FROM dirs)"""

query("a1_type_counts", f"""WITH {TREE} SELECT ftype, count(*) AS n, CASE ftype WHEN 1 THEN 'regular file' ELSE 'directory' END AS type_name FROM tree GROUP BY 1""")(lambda s, d: stats.type_counts(_tree(s, d)))

query("a2_compression_counts", f"""WITH {INODES} SELECT count(*) FILTER (WHERE datalayout IN (1, 3)) AS n_compressed, count(*) FILTER (WHERE datalayout NOT IN (1, 3)) AS n_uncompressed FROM inodes""")(
    lambda s, d: stats.compression_counts(vfs.inodes(s, d)))

NAMES = "names AS (SELECT p_partkey || '.' || ['so','s','txt','tx','xml','h','html','r','rc','pyc','otf','zip'][p_partkey % 12 + 1] AS name FROM part UNION ALL SELECT p_brand FROM part)"


def _names(s, d):
    p = table(s, d, "part")
    ext = F.element_at(F.array(*[F.lit(e) for e in ("so", "s", "txt", "tx", "xml", "h", "html", "r", "rc", "pyc", "otf", "zip")]), (F.col("p_partkey") % 12 + 1).cast("int"))
    return p.select(F.concat_ws(".", F.col("p_partkey").cast("string"), ext).alias("name")).unionByName(p.select(F.col("p_brand").alias("name")))


query("a4_extension_histogram", f"""WITH {NAMES}, e AS (SELECT CASE WHEN contains(name, '.') THEN regexp_extract(name, '(\\.[^.]*)$', 1) END AS ext FROM names)
SELECT coalesce(list_filter({KNOWN}, lambda k: starts_with(k, e.ext))[1], 'others') AS ext, count(*) AS n_files FROM e GROUP BY 1""")(lambda s, d: stats.extension_histogram(_names(s, d)))

query("a6_size_totals", f"""WITH {INODES}, f AS (SELECT size, CASE WHEN datalayout IN (1, 3) THEN ((size // 3 + 4095) // 4096) * 4096 ELSE size END AS occupied FROM inodes WHERE mode & 61440 = 32768)
SELECT count(*) AS n_files, CAST(sum(size) AS BIGINT) AS original_bytes, CAST(sum(occupied) AS BIGINT) AS disk_bytes, CAST(sum(occupied) AS BIGINT) * 100.0::DOUBLE / CAST(sum(size) AS BIGINT) AS rate FROM f""")(
    lambda s, d: stats.size_totals(vfs.inodes(s, d).filter(F.col("mode").bitwiseAND(0xF000) == 0x8000)
                                   .withColumn("occupied", stats.occupied(F.col("size"), F.col("datalayout"), C.blocks_of(F.expr("size div 3"), 12), 12))))

query("a7_block_ratio", f"""WITH {vfs.EXTENTS}, s AS (SELECT nid, sum(llen) AS size FROM extents GROUP BY 1),
p AS (SELECT CAST(sum((plen + 4095) // 4096) AS BIGINT) AS physical_blocks FROM extents), l AS (SELECT CAST(sum((size + 4095) // 4096) AS BIGINT) AS logical_blocks FROM s)
SELECT physical_blocks, logical_blocks, physical_blocks * 100.0::DOUBLE / logical_blocks AS ratio FROM p, l""")(
    lambda s, d: stats.block_ratio(e := vfs.extents(s, d), e.groupBy("nid").agg(F.sum("llen").alias("size"))))

query("a8_directory_links", f"""WITH {TREE} SELECT dir, count(*) FILTER (WHERE ftype = 2) + 2 AS nlink FROM tree GROUP BY 1""")(lambda s, d: stats.directory_links(_tree(s, d)))

query("a9_hard_links", "SELECT l_partkey AS nid, count(*) AS nlink FROM lineitem GROUP BY 1")(lambda s, d: stats.hard_links(table(s, d, "lineitem").select(F.col("l_partkey").alias("nid"))))

query("a10_directory_sizes", None)(lambda s, d: stats.directory_sizes(_tree(s, d)))

query("a15_algorithms", "SELECT bit_or(CAST(1 << (c_nationkey % 4) AS INTEGER)) AS available, max(CAST(c_custkey * 4096 AS BIGINT)) AS max_dict FROM customer")(
    lambda s, d: stats.algorithms(table(s, d, "customer").select((F.col("c_nationkey") % 4).alias("alg"), (F.col("c_custkey") * 4096).alias("dict_size"))))

query("a16_extent_summary", f"""WITH {vfs.EXTENTS} SELECT nid, count(*) AS n_extents, CAST(sum(llen) AS BIGINT) AS logical_bytes, CAST(sum(plen) AS BIGINT) AS physical_bytes FROM extents GROUP BY 1""")(
    lambda s, d: stats.extent_summary(vfs.extents(s, d)))

query("a17_total_blocks", """SELECT n_name AS image_id, CAST(n_nationkey * 1000 + coalesce(x.extra, 0) AS BIGINT) AS total_blocks FROM nation
LEFT JOIN (SELECT s_nationkey, sum(s_suppkey % 97 + 1) AS extra FROM supplier GROUP BY 1) x ON x.s_nationkey = n_nationkey""")(
    lambda s, d: stats.total_blocks(table(s, d, "nation").select(F.col("n_name").alias("image_id"), (F.col("n_nationkey").cast("long") * 1000).alias("primary_blocks")),
                                    table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("image_id"), (F.col("s_suppkey") % 97 + 1).alias("blocks"))))

query("p1_owners", f"WITH {INODES} SELECT nid, (uid + 4294960000) % 4294967296 AS uid, CAST(1000 AS BIGINT) AS gid FROM inodes")(
    lambda s, d: vfs.inodes(s, d).select("nid", attrs.mapped_id(F.col("uid"), None, 4294960000).alias("uid"), attrs.mapped_id(F.col("gid"), 1000, 0).alias("gid")))

CLAMP = 757382400


def _times(s, d):
    a, b = attrs.time_policy(F.col("mtime_s"), F.col("mtime_ns"), "clamp", CLAMP, 5)
    return vfs.inodes(s, d).select("nid", a.alias("mtime_s"), b.alias("mtime_ns"))


query("p2_times", f"WITH {INODES} SELECT nid, least(mtime_s, {CLAMP}) AS mtime_s, CAST(CASE WHEN mtime_s >= {CLAMP} THEN 5 ELSE mtime_ns END AS INTEGER) AS mtime_ns FROM inodes")(_times)

query("p3_inode_forms", f"""WITH {INODES} SELECT nid, CASE WHEN size > 4294967295 OR uid > 65535 OR gid > 65535 OR nlink > 65535 OR mtime_s <> {CLAMP} AND nid % 2 = 0 THEN 64 ELSE 32 END AS form FROM inodes""")(
    lambda s, d: vfs.inodes(s, d).select("nid", F.when(F.col("nid") % 2 == 0, attrs.inode_form(F.col("size"), F.col("uid"), F.col("gid"), F.col("nlink"), F.col("mtime_s"), CLAMP))
        .otherwise(attrs.inode_form(F.col("size"), F.col("uid"), F.col("gid"), F.col("nlink"), F.col("mtime_s"), CLAMP, wide=True)).alias("form")))

query("p4_build_epoch", f"WITH {INODES}, t AS (SELECT nid, mtime_s * 5 AS t FROM inodes) SELECT nid, greatest(0, t - 4294967295) AS epoch, t - greatest(0, t - 4294967295) AS build_time FROM t")(
    lambda s, d: vfs.inodes(s, d).select("nid", (e := attrs.build_epoch(F.col("mtime_s") * 5))[0].alias("epoch"), e[1].alias("build_time")))

query("p5_modes", f"""WITH {INODES} SELECT nid, CASE mode & 61440 WHEN 32768 THEN 1 WHEN 16384 THEN 2 WHEN 8192 THEN 3 WHEN 24576 THEN 4 WHEN 4096 THEN 5 WHEN 49152 THEN 6 WHEN 40960 THEN 7 ELSE 0 END AS ftype,
array_to_string(list_transform(range(9), lambda i: CASE WHEN (mode >> CAST(8 - i AS INTEGER)) & 1 = 1 THEN ['r','w','x'][i % 3 + 1] ELSE '-' END), '') AS access,
(rdev >> 8) & 4095 AS major, (rdev & 255) | ((rdev >> 12) & 1048320) AS minor FROM inodes""")(
    lambda s, d: vfs.inodes(s, d).select("nid", C.ftype_of(F.col("mode")).alias("ftype"), C.access_string(F.col("mode")).alias("access"),
                                         (m := C.decode_rdev(F.col("rdev")))[0].alias("major"), m[1].alias("minor")))

query("p5_rdev_round_trip", "SELECT e.event_id, e.event_id % 4096 AS major, e.event_id * 37 % 1048576 AS minor FROM events e")(
    lambda s, d: table(s, d, "events").withColumn("dev", C.encode_rdev(F.col("event_id") % 4096, F.col("event_id") * 37 % 1048576))
    .select("event_id", (m := C.decode_rdev(F.col("dev")))[0].alias("major"), m[1].alias("minor")))

query("p6_normal_paths", """SELECT event_id, ['a' || event_id % 7, 'b/x', 'c' || event_id % 3 || '/' || user_id % 11, '', 'y'][event_id % 5 + 1] AS path FROM events""")(
    lambda s, d: table(s, d, "events").select("event_id", C.normal_path(F.element_at(F.array(
        F.concat(F.lit("//a"), F.col("event_id") % 7, F.lit("/./")), F.lit("./b//q/../x"), F.concat(F.lit("z/../c"), F.col("event_id") % 3, F.lit("//"), F.col("user_id") % 11),
        F.lit("./../.."), F.lit("x/../../y/")), (F.col("event_id") % 5 + 1).cast("int"))).alias("path")))

query("p10_sparse_chunk_bits", f"WITH {INODES} SELECT nid, CAST(least(greatest({BITLEN('(size * 4099 - 1)')}, 12), 43) AS INTEGER) AS chunk_bits FROM inodes")(
    lambda s, d: vfs.inodes(s, d).select("nid", __import__("canopy.operators.extents", fromlist=["x"]).sparse_chunk_bits(F.col("size") * 4099, 12).alias("chunk_bits")))

query("p12_size_suffixes", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size::BIGINT WHEN 1 THEN p_size::BIGINT * 1024 WHEN 2 THEN p_size::BIGINT * 1048576 WHEN 3 THEN p_size::BIGINT * 1073741824 END::BIGINT AS bytes FROM part""")(
    lambda s, d: table(s, d, "part").select("p_partkey", C.size_suffix(F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*[F.lit(x) for x in ("", "k", "M", "g", "x")]), (F.col("p_partkey") % 5 + 1).cast("int")))).alias("bytes")))


def _images(s, d):
    c = F.col("c_custkey")
    return table(s, d, "customer").select(c.alias("image_id"), (c % 64).alias("feature_compat"), (c * 7 % 512).alias("feature_incompat"), (c % 16).cast("int").alias("algs"))


KERNELS = "[(1,504),(2,513),(4,515),(8,516),(16,517),(32,601),(64,604),(128,615),(256,617)]"
query("p13_least_kernels", """SELECT c_custkey AS image_id, CAST(greatest(CASE WHEN c_custkey % 16 & 2 > 0 THEN 516 ELSE 0 END, CASE WHEN c_custkey % 16 & 4 > 0 THEN 606 ELSE 0 END, CASE WHEN c_custkey % 16 & 8 > 0 THEN 610 ELSE 0 END,
list_max([CASE WHEN (c_custkey * 7 % 512) & b > 0 THEN k ELSE 0 END FOR b, k IN [0]] || [0])) AS INTEGER) AS kernel FROM customer""".replace("list_max([CASE WHEN (c_custkey * 7 % 512) & b > 0 THEN k ELSE 0 END FOR b, k IN [0]] || [0])", ", ".join(f"CASE WHEN (c_custkey * 7 % 512) & {b} > 0 THEN {k} ELSE 0 END" for b, k in ((1, 504), (2, 513), (4, 515), (8, 516), (16, 517), (32, 601), (64, 604), (128, 615), (256, 617)))))(
    lambda s, d: attrs.least_kernel(_images(s, d)))
query("p13_features", "WITH f(word, bit, feature) AS (VALUES " + ", ".join(f"('{'c' if c else 'i'}', {b}, '{n}')" for c, _, b, n in __import__("canopy.schema", fromlist=["x"]).FEATURES) + """)
SELECT c_custkey AS image_id, feature FROM customer, f WHERE CASE word WHEN 'c' THEN c_custkey % 64 ELSE c_custkey * 7 % 512 END & bit <> 0""")(lambda s, d: attrs.features(_images(s, d)).select("image_id", "feature"))

query("p18_initial_stat", f"WITH {INODES} SELECT nid, CASE WHEN mode & 61440 IN (32768, 40960) THEN size ELSE 0 END AS size, 1 AS nlink FROM inodes")(
    lambda s, d: vfs.inodes(s, d).select("nid", (x := attrs.initial_stat(F.col("mode"), F.col("size")))[0].alias("size"), x[1].alias("nlink")))

query("f1_f2_exclude", f"""WITH {FILES} SELECT path FROM files WHERE dir <> 'en/src1' AND NOT regexp_matches(path, '[0-9]7\\.txt$') AND path <> 'en/src2/2.txt' AND lang <> 'fr'""")(
    lambda s, d: filters.exclude(vfs.files(s, d), ["/en/src1", "en/src2/2.txt"], ["[[:digit:]]7\\.txt$", "^fr$"]).select("path"))

query("f3_first_match", f"""WITH {FILES} SELECT path, CAST(CASE WHEN regexp_matches(path, 'src1') THEN 16384 WHEN regexp_matches(path, '^(de|fr)/') THEN 0 WHEN regexp_matches(path, '1\\.txt$') THEN 65536 ELSE 4096 END AS INTEGER) AS cluster_size FROM files""")(
    lambda s, d: vfs.files(s, d).select("path", filters.first_match(F.col("path"), [("src1", 16384), ("^(de|fr)/", 0), ("1\\.txt$", 65536)], 4096).alias("cluster_size")))

query("f4_whiteouts", f"WITH {INODES} SELECT nid FROM inodes WHERE mode & 61440 = 8192 AND rdev = 0")(lambda s, d: vfs.inodes(s, d).filter(filters.is_whiteout(F.col("mode"), F.col("rdev"))).select("nid"))
query("f6_strip_overlay", f"WITH {INODES} SELECT nid FROM inodes WHERE NOT (mode & 61440 = 8192 AND rdev = 0)")(lambda s, d: filters.strip_overlay(vfs.inodes(s, d)).select("nid"))
query("f5_aufs_names", """SELECT event_id, ['d' || event_id % 9, 'd/f' || event_id % 4, 'd/e' || event_id % 3, 'g'][event_id % 4 + 1] AS target, event_id % 4 IN (1, 3) AS whiteout, event_id % 4 = 0 AS opaque FROM events""")(
    lambda s, d: table(s, d, "events").withColumn("path", F.element_at(F.array(F.concat(F.lit("d"), F.col("event_id") % 9, F.lit("/.wh..wh..opq")), F.concat(F.lit("d/.wh.f"), F.col("event_id") % 4),
        F.concat(F.lit("d/e"), F.col("event_id") % 3), F.lit(".wh.g")), (F.col("event_id") % 4 + 1).cast("int")))
    .select("event_id", (a := filters.aufs(F.col("path")))[0].alias("target"), a[1].alias("whiteout"), a[2].alias("opaque")))
query("f8_compressible", f"WITH {FILES} SELECT path FROM files WHERE size > 0 AND NOT regexp_matches(path, '^fr/')")(
    lambda s, d: vfs.files(s, d).filter(filters.compressible(F.col("size"), filters.first_match(F.col("path"), [("^fr/", 0)], 4096))).select("path"))

query("j2_path_lookup", f"""WITH {FILES} SELECT '//' || lang || '//' || source || '/./' || nid || '.txt' AS want, nid FROM files UNION ALL SELECT '/no/such/' || nid, NULL FROM files""")(
    lambda s, d: paths.lookup(f := vfs.files(s, d), f.select(F.concat(F.lit("//"), "lang", F.lit("//"), "source", F.lit("/./"), "name").alias("want")).unionByName(f.select(F.concat(F.lit("/no/such/"), F.col("nid")).alias("want")))))


def _nid_dirents(s, d):
    f = vfs.files(s, d)
    number = lambda c: F.crc32(c) + 10000000000
    dirs = paths.directories(f)
    up = lambda c: F.when(c == "", F.lit(1)).otherwise(number(c)).cast("long")
    last = F.substring_index("path", "/", -1).alias("name")
    return f.select(up(F.col("dir")).alias("dir_nid"), "name", "nid", F.lit(1).alias("ftype")).unionByName(dirs.select(up(F.col("parent")).alias("dir_nid"), last, up(F.col("path")).alias("nid"), F.lit(2).alias("ftype")))


query("j3_walk", f"WITH {TREE} SELECT path, ftype, false AS loop FROM tree")(lambda s, d: paths.walk(_nid_dirents(s, d), 1).select("path", "ftype", "loop"))
query("j3_first_paths", f"""WITH x AS (SELECT doc_id % 100 AS nid, lang || '/' || source || '/' || doc_id AS path FROM documents) SELECT nid, arg_min(path, string_split(path, '/')) AS path FROM x GROUP BY 1""")(
    lambda s, d: paths.first_paths(table(s, d, "documents").select((F.col("doc_id") % 100).alias("nid"), F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"))))

query("s4a_key_tree", f"WITH {TREE} SELECT path, ftype FROM tree")(lambda s, d: _tree(s, d).select("path", "ftype"))
query("m6_missing_parents", f"""WITH {FILES} SELECT dir AS path, CAST(16877 | CASE lang WHEN 'en' THEN 16 ELSE 0 END AS INTEGER) AS mode, CAST(CASE lang WHEN 'en' THEN 7 ELSE 0 END AS BIGINT) AS uid, CAST(CASE lang WHEN 'en' THEN 8 ELSE 0 END AS BIGINT) AS gid FROM files GROUP BY ALL
UNION ALL SELECT DISTINCT lang, 16877, 0, 0 FROM files WHERE lang <> 'en'""")(
    lambda s, d: paths.missing_parents((f := vfs.files(s, d)).select("path", F.lit(0x81A4).alias("mode"), F.lit(1).cast("long").alias("uid"), F.lit(1).cast("long").alias("gid"))
        .unionByName(s.createDataFrame([("en", 0x4000 | 0o775, 7, 8)], "path string, mode int, uid long, gid long"))))


def _layered(s, d):
    f = vfs.files(s, d)
    l = table(s, d, "labels")  # noqa: E741
    row = lambda df, path, no, mode, opaque: df.select(path.alias("path"), F.lit(no).alias("layer_no"), mode.cast("int").alias("mode"), F.lit(0).cast("long").alias("rdev"), opaque.alias("opaque"))
    no = F.lit(False)
    base = row(f, F.col("path"), 0, F.lit(0x81A4), no)
    dirs = paths.directories(f)
    upper_dirs = row(dirs.filter(F.col("path").isin("en/src3", "de")), F.col("path"), 1, F.lit(0x41ED), F.col("path") == "en/src3")
    white = row(f.join(l.filter("toxic = 1"), F.col("nid") == F.col("doc_id")), F.col("path"), 1, F.lit(0x2000), no)
    top = row(f.filter("nid % 10 = 0"), F.col("path"), 2, F.lit(0x81A4), no)
    return base.unionByName(row(dirs, F.col("path"), 0, F.lit(0x41ED), no)).unionByName(upper_dirs).unionByName(white).unionByName(top)


query("m1_m2_layer_merge", f"""WITH {TREE}, f AS (SELECT files.*, coalesce(toxic, 0) AS toxic FROM files LEFT JOIN labels ON nid = doc_id)
SELECT path, CASE WHEN nid % 10 = 0 THEN 2 WHEN toxic = 1 THEN 1 ELSE 0 END AS layer_no FROM f WHERE dir <> 'en/src3' OR nid % 10 = 0 OR toxic = 1
UNION ALL SELECT path, CASE WHEN path IN ('en/src3', 'de') THEN 1 ELSE 0 END FROM dirs""")(lambda s, d: layers.merge(_layered(s, d)).select("path", "layer_no"))
query("m3_merge_stripped", f"""WITH {TREE}, f AS (SELECT files.*, coalesce(toxic, 0) AS toxic FROM files LEFT JOIN labels ON nid = doc_id)
SELECT path FROM f WHERE nid % 10 = 0 OR toxic = 0 AND dir <> 'en/src3' UNION ALL SELECT path FROM dirs""")(lambda s, d: filters.strip_overlay(layers.merge(_layered(s, d))).select("path"))
query("m5_overlay_attributes", f"""WITH {FILES} SELECT 'en/src3' AS path, 'trusted.overlay.opaque' AS name, 'y' AS value UNION ALL
SELECT DISTINCT dir, 'trusted.overlay.origin', '' FROM files JOIN labels ON nid = doc_id WHERE toxic = 1""")(lambda s, d: layers.overlay_attributes(_layered(s, d)))


def _sequence(s, d):
    e = table(s, d, "events")
    p = F.concat(F.lit("d"), F.col("user_id") % 50)
    path = F.when(F.col("event_id") % 11 == 0, p).otherwise(F.concat(p, F.lit("/f"), F.col("event_id") % 400))
    mode = F.when(F.col("event_id") % 11 > 0, 0x81A4).when(F.col("event_id") % 3 == 0, 0x81A4).otherwise(0x41ED)
    link = F.when(F.col("event_id") % 13 == 0, F.concat(p, F.lit("/f"), F.col("event_id") * 3 % 400))
    return e.select(F.col("event_id").alias("seq"), path.alias("path"), mode.cast("int").alias("mode"), F.when(F.col("event_id") % 11 > 0, link).alias("linkpath"))


SEQUENCE = """q AS (SELECT event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 'd' || user_id % 50 ELSE 'd' || user_id % 50 || '/f' || event_id % 400 END AS path,
CASE WHEN event_id % 11 = 0 AND event_id % 3 <> 0 THEN 16877 ELSE 33188 END AS mode, CASE WHEN event_id % 11 > 0 AND event_id % 13 = 0 THEN 'd' || user_id % 50 || '/f' || event_id * 3 % 400 END AS linkpath FROM events)"""
query("m4_archive_override", f"""WITH {SEQUENCE}, l AS (SELECT path, max(seq) AS seq, arg_max(mode, seq) AS mode FROM q GROUP BY 1), k AS (SELECT path, max(seq) AS cut FROM q WHERE mode = 33188 GROUP BY 1)
SELECT l.path, l.seq, l.mode FROM l LEFT JOIN k ON contains(l.path, '/') AND k.path = split_part(l.path, '/', 1) WHERE k.cut IS NULL OR l.seq >= k.cut""")(lambda s, d: layers.override(_sequence(s, d)).select("path", "seq", "mode"))
query("j5_link_targets", f"""WITH {SEQUENCE}, t AS (SELECT a.seq, a.path, max(b.seq) AS target_seq, any_value(a.linkpath) AS linkpath FROM q a LEFT JOIN q b ON b.path = a.linkpath AND b.seq < a.seq WHERE a.linkpath IS NOT NULL GROUP BY 1, 2)
SELECT t.seq, CASE WHEN q.mode = 33188 AND t.path <> t.linkpath THEN t.target_seq END AS target_seq FROM t LEFT JOIN q ON q.seq = t.target_seq""")(lambda s, d: layers.link_targets(_sequence(s, d)))
query("m7_incremental", f"""WITH {FILES} SELECT path FROM files WHERE dir <> 'en/src5' AND nid % 4 <> 1 UNION SELECT path FROM files WHERE nid % 4 = 1 UNION SELECT 'en/src5'""")(
    lambda s, d: layers.incremental((b := vfs.files(s, d).select("path", F.lit(0x81A4).alias("mode"), F.lit(False).alias("opaque"), "nid")).filter("nid % 4 <> 1").drop("nid"),
        b.filter("nid % 4 = 1").drop("nid").unionByName(s.createDataFrame([("en/src5", 0x41ED, True)], "path string, mode int, opaque boolean"))).select("path"))
