"""The supplied tables read as a virtual file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nid, path, dir, name, lang, source, text, size: a file a document, lang/source/doc_id.txt."""
    d = table(spark, sf_dir, "documents")
    directory = F.concat_ws("/", "lang", "source")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(
        F.col("doc_id").alias("nid"), F.concat_ws("/", directory, name).alias("path"), directory.alias("dir"), name.alias("name"),
        "lang", "source", "text", F.octet_length("text").cast("long").alias("size"),
    )


FILES = """files AS (SELECT doc_id AS nid, lang || '/' || source || '/' || doc_id || '.txt' AS path, lang || '/' || source AS dir,
 doc_id || '.txt' AS name, lang, source, text, CAST(strlen(text) AS BIGINT) AS size FROM documents)"""


def inodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nid, uid, gid, nlink, size, mtime_s, mtime_ns, mode, ftype, rdev, datalayout from orders."""
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(m) for m in (0x8000, 0x4000, 0xA000, 0x2000, 0x6000, 0x1000, 0xC000, 0x8000, 0x8000, 0x8000)]), (k % 10 + 1).cast("int"))
    mode = (kind.bitwiseOR((k % 512).cast("int"))).cast("int")
    return table(spark, sf_dir, "orders").select(
        k.alias("nid"), F.col("o_custkey").alias("uid"), (k % 70000).alias("gid"),
        F.when(k % 50 == 0, 70000).otherwise(k % 4 + 1).cast("long").alias("nlink"),
        F.floor("o_totalprice").cast("long").alias("size"),
        F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)").alias("mtime_s"),
        (k % 1000 * 1000).cast("int").alias("mtime_ns"), mode.alias("mode"),
        (k % 5).cast("int").alias("datalayout"),
        F.when(kind.isin(0x2000, 0x6000), k % 3 * (k % 100000)).otherwise(0).cast("long").alias("rdev"),
    )


INODES = """inodes AS (SELECT o_orderkey AS nid, o_custkey AS uid, o_orderkey % 70000 AS gid,
 CAST(CASE WHEN o_orderkey % 50 = 0 THEN 70000 ELSE o_orderkey % 4 + 1 END AS BIGINT) AS nlink,
 CAST(floor(o_totalprice) AS BIGINT) AS size, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS mtime_s,
 CAST(o_orderkey % 1000 * 1000 AS INTEGER) AS mtime_ns,
 CAST([32768,16384,40960,8192,24576,4096,49152,32768,32768,32768][o_orderkey % 10 + 1] + o_orderkey % 512 AS INTEGER) AS mode,
 CAST(o_orderkey % 5 AS INTEGER) AS datalayout,
 CAST(CASE WHEN o_orderkey % 10 IN (3, 4) THEN (o_orderkey % 3) * (o_orderkey % 100000) ELSE 0 END AS BIGINT) AS rdev FROM orders)"""

EXTENT_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nid, ext_no, la, llen, pa, plen, device_id: an extent a line item, in 512-byte units, running sums within a file."""
    w = W.partitionBy("l_orderkey").orderBy(*EXTENT_ORDER)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    llen = (F.col("l_quantity").cast("long") * 512).alias("llen")
    rows = table(spark, sf_dir, "lineitem").withColumn("llen", llen).withColumn("plen", F.least("llen", (F.col("l_partkey") % 8 + 1) * 512))
    return rows.select(
        F.col("l_orderkey").alias("nid"), (F.row_number().over(w) - 1).alias("ext_no"),
        F.coalesce(F.sum("llen").over(before), F.lit(0)).alias("la"), "llen",
        (F.col("l_orderkey") * 1048576 + F.coalesce(F.sum("plen").over(before), F.lit(0))).alias("pa"), "plen",
        (F.col("l_suppkey") % 3).cast("int").alias("device_id"),
    )


EXTENTS = """extents0 AS (SELECT *, CAST(l_quantity AS BIGINT) * 512 AS llen, least(CAST(l_quantity AS BIGINT) * 512, (l_partkey % 8 + 1) * 512) AS plen FROM lineitem),
extents AS (SELECT l_orderkey AS nid, CAST(row_number() OVER w - 1 AS INTEGER) AS ext_no,
 CAST(sum(llen) OVER w - llen AS BIGINT) AS la, llen, CAST(l_orderkey * 1048576 + sum(plen) OVER w - plen AS BIGINT) AS pa, plen, CAST(l_suppkey % 3 AS INTEGER) AS device_id
 FROM extents0 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate ROWS UNBOUNDED PRECEDING))"""


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """device_id, blocks, tag: a device a supplier. A device table has at most 65535 rows."""
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(s.cast("int").alias("device_id"), (s % 97 + 1 + s % 5 * 4194304).alias("blocks"), F.col("s_name").alias("tag"))


DEVICES = "devices AS (SELECT CAST(s_suppkey AS INTEGER) AS device_id, s_suppkey % 97 + 1 + s_suppkey % 5 * 4194304 AS blocks, s_name AS tag FROM supplier)"


def xattrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nid, name, value: lang and source of documents, quality of labels."""
    d = table(spark, sf_dir, "documents")
    q = table(spark, sf_dir, "labels")
    row = lambda df, name, value: df.select(F.col("doc_id").alias("nid"), F.lit(name).alias("name"), value.cast("string").alias("value"))
    return row(d, "user.lang", F.col("lang")).unionByName(row(d, "user.source", F.col("source"))).unionByName(row(q, "user.quality", F.col("quality")))


XATTRS = """xattrs AS (SELECT doc_id AS nid, 'user.lang' AS name, lang AS value FROM documents UNION ALL SELECT doc_id, 'user.source', source FROM documents
 UNION ALL SELECT doc_id, 'user.quality', CAST(quality AS VARCHAR) FROM labels)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, nid, off, len from events: reads of files of `extents`."""
    e = F.col("event_id")
    many = table(spark, sf_dir, "orders").agg((F.max("o_orderkey") + 1).alias("many"))  # one row
    return table(spark, sf_dir, "events").crossJoin(F.broadcast(many)).select(e.alias("request_id"), (e * 31 % F.col("many")).alias("nid"), (e * 7919 % 120000).alias("off"), (e % 5 * 4096 + 1).alias("len"), "ts")


REQUESTS = "requests AS (SELECT event_id AS request_id, event_id * 31 % (SELECT max(o_orderkey) + 1 FROM orders) AS nid, event_id * 7919 % 120000 AS off, event_id % 5 * 4096 + 1 AS len, ts FROM events)"
