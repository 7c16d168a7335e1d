"""Queries on compressed maps and codecs, bound to the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.functions import codecs, hashes
from canopy.operators import compressed, filters
from canopy.operators.order import running
from canopy.operators.paths import name_order
from canopy.plans.data_queries import _files
from canopy.plans.registry import query
from canopy.sources import vfs
from canopy.sources.vfs import INODES, table

RECORDS = """r AS (SELECT user_id AS nid, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS lcn, event_id FROM events),
rec AS (SELECT nid, lcn, CASE WHEN lcn % 5 IN (1, 2) THEN 2 WHEN lcn % 5 = 3 THEN 0 ELSE 1 END AS kind, CASE WHEN lcn % 5 IN (0, 4) THEN event_id % 4000 WHEN lcn % 5 = 3 THEN 0 END AS ofs, event_id * 3 AS blkaddr, CASE WHEN lcn % 5 = 1 AND event_id % 2 = 0 THEN event_id % 7 + 1 END AS blocks FROM r),
sz AS (SELECT nid, (max(lcn) + 1) * 4096 - 7 AS size FROM rec GROUP BY 1)"""


def _records(s, d):
    from pyspark.sql import Window as W

    e, n = F.col("event_id"), F.col("lcn")
    r = table(s, d, "events").select(F.col("user_id").alias("nid"), (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("lcn"), e)
    kind = F.when((n % 5).isin(1, 2), 2).when(n % 5 == 3, 0).otherwise(1)
    ofs = F.when((n % 5).isin(0, 4), e % 4000).when(n % 5 == 3, 0)
    rec = r.select("nid", "lcn", kind.alias("kind"), ofs.alias("ofs"), (e * 3).alias("blkaddr"), F.when((n % 5 == 1) & (e % 2 == 0), e % 7 + 1).alias("blocks"))
    return rec.join(rec.groupBy("nid").agg(((F.max("lcn") + 1) * 4096 - 7).alias("size")), "nid")


query("x3_x10_cluster_map", f"""WITH {RECORDS}, n AS (SELECT *, CASE WHEN lead(kind) OVER w = 2 THEN lead(blocks) OVER w END AS cnt FROM rec WINDOW w AS (PARTITION BY nid ORDER BY lcn)),
h AS (SELECT *, lcn * 4096 + ofs AS la FROM n WHERE kind <> 2), e AS (SELECT h.*, coalesce(lead(la) OVER (PARTITION BY h.nid ORDER BY la), size) AS nxt FROM h JOIN sz ON sz.nid = h.nid)
SELECT nid, la, nxt - la AS llen, blkaddr * 4096 AS pa, coalesce(cnt, 1) * 4096 AS plen, kind <> 0 AS encoded FROM e WHERE nxt > la""")(lambda s, d: compressed.map_clusters(_records(s, d)))
query("x5_fragment_map", f"""WITH {INODES} SELECT nid, size - least(size, 4096) AS la, least(size, 4096) AS llen, nid * 4096 AS packed_off FROM inodes""")(
    lambda s, d: compressed.fragment_map(i := vfs.inodes(s, d), i.select("nid", F.least("size", F.lit(4096)).cast("long").alias("tlen"), (F.col("nid") * 4096).alias("off"))))
query("p15_inline_tails", f"WITH {INODES} SELECT nid, datalayout <> 0 AND size % 4096 > 0 AND 64 + nid % 100 + size % 4096 <= 4096 AS inline_tail FROM inodes")(
    lambda s, d: vfs.inodes(s, d).select("nid", compressed.inline_tail(F.lit(64), F.col("nid") % 100, F.col("size") % 4096, F.col("datalayout") != 0).alias("inline_tail")))
query("p9_wide_chunks", "SELECT user_id AS nid, bool_or(event_id * 1000003 > 4294967295) AS wide FROM events GROUP BY 1")(
    lambda s, d: compressed.wide_chunks(table(s, d, "events").select(F.col("user_id").alias("nid"), (F.col("event_id") * 1000003).alias("startblk"))))
query("p11_label_overrides", f"""WITH {vfs.FILES} SELECT path, CASE WHEN regexp_matches(path, '^en/.*1\\.txt$') THEN 'label:one' WHEN starts_with(path, 'en/') THEN 'label:en' ELSE 'label:any' END AS label FROM files""")(
    lambda s, d: vfs.files(s, d).select("path", filters.first_match(F.col("path"), [("^en/.*1\\.txt$", "label:one"), ("^en/", "label:en")], "label:any").alias("label")))
query("o3_emission_order", f"""WITH {vfs.FILES} SELECT path, CAST(row_number() OVER (PARTITION BY lang ORDER BY string_split(path, '/')) AS BIGINT) AS pos FROM files""")(lambda s, d: _order(s, d))
query("s8_layer_numbers", f"""WITH {vfs.FILES} SELECT path, CAST(max(CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END) AS INTEGER) AS layer_no FROM files GROUP BY 1""")(
    lambda s, d: _stacked(s, d).groupBy("path").agg(F.max("layer_no").alias("layer_no")))
query("c6_coded_sizes", None)(lambda s, d: codecs.sizes(_files(s, d), "deflate", 6))
query("c2_c3_clusters", None)(lambda s, d: compressed.keep_coded(compressed.encoded_clusters(_files(s, d), 4096, "zstd"), vfs.files(s, d)))
query("d4_shared_clusters", None)(lambda s, d: compressed.shared_clusters(compressed.encoded_clusters(_files(s, d), 4096, "zstd")))
query("h_crc32c", None)(lambda s, d: _files(s, d).select("path", hashes.crc32c_column(F.col("content")).alias("crc32c")))
query("h_xxh64", None)(lambda s, d: _files(s, d).select("path", hashes.xxh64_column(F.col("content")).alias("xxh64")))


def _order(s, d):
    rows = vfs.files(s, d).select("lang", "path")
    return running(rows, ["lang"], name_order(F.col("path")), F.lit(1), "n").select("path", (F.col("n") + 1).alias("pos"))


def _stacked(s, d):
    from canopy.operators.layers import stack

    f = vfs.files(s, d)
    return stack([f.filter("lang = 'en'").select("path"), f.filter("lang = 'de'").select("path"), f.filter("lang not in ('en', 'de')").select("path")])
