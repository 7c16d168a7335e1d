"""Integrity checks: queries that return violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.functions.columns import ftype_of


def name_order(dirents: DataFrame) -> DataFrame:
    """Entries whose name does not come after the one before in its directory (byte order). dirents: dir_nid, lblk, idx, name."""
    w = W.partitionBy("dir_nid").orderBy("lblk", "idx")
    return dirents.withColumn("prev", F.lag("name").over(w)).filter(F.col("prev").isNotNull() & (F.col("name") <= F.col("prev"))).drop("prev")


def bad_names(dirents: DataFrame) -> DataFrame:
    """Entries with names of a length other than 1 to 255 bytes, with a slash or NUL, or of an unknown type."""
    n = F.octet_length("name")
    return dirents.filter((n < 1) | (n > 255) | (F.instr("name", "/") > 0) | (F.instr("name", "\0") > 0) | ~F.col("ftype").between(0, 7))


def special_entries(dirents: DataFrame, parents: DataFrame, dot_omitted: bool = False) -> DataFrame:
    """dir_nid, problem: . or .. missing, repeated or leading elsewhere. parents: dir_nid, parent_nid."""
    dot, up = F.col("name") == ".", F.col("name") == ".."
    n = dirents.groupBy("dir_nid").agg(F.count_if(dot).alias("dots"), F.count_if(up).alias("ups"), F.max(F.when(dot, F.col("nid"))).alias("dot"), F.max(F.when(up, F.col("nid"))).alias("up"))
    j = n.join(parents, "dir_nid", "left")
    problem = (
        F.when(F.col("dots") > 1, "repeated .").when(F.col("ups") > 1, "repeated ..").when((F.col("dots") == 0) & F.lit(not dot_omitted), "missing .").when(F.col("ups") == 0, "missing ..")
        .when(F.col("dot") != F.col("dir_nid"), "wrong .").when(F.col("up") != F.coalesce("parent_nid", "dir_nid"), "wrong ..")
    )
    return j.select("dir_nid", problem.alias("problem")).filter("problem is not null")


def type_mismatch(dirents: DataFrame, inodes: DataFrame) -> DataFrame:
    """Entries whose type is not their inode's. inodes: nid, mode."""
    return dirents.join(inodes.select("nid", "mode"), "nid").filter(F.col("ftype") != ftype_of(F.col("mode"))).drop("mode")


def bad_inodes(inodes: DataFrame) -> DataFrame:
    """Inodes of an unknown layout, mode or chunk format. inodes: nid, mode, datalayout, chunkbits (null: none)."""
    return inodes.filter((F.col("datalayout") > 4) | (ftype_of(F.col("mode")) == 0) | ((F.col("datalayout") == 4) & (F.col("chunkbits") > 31)))


def bad_extents(extents: DataFrame, most_physical: int = 1 << 20, most_logical: int = 12 << 20) -> DataFrame:
    """Plain extents whose lengths differ; encoded ones beyond the limits or with an unknown algorithm. extents: encoded, fragment, alg, llen, plen."""
    plain = ~F.col("encoded") & (F.col("llen") != F.col("plen"))
    coded = F.col("encoded") & ~F.col("fragment") & ((F.col("plen") > most_physical) | (F.col("llen") > most_logical) | ~F.col("alg").between(0, 3))
    return extents.filter(plain | coded)


def digest_status(files: DataFrame, stored: DataFrame) -> DataFrame:
    """path, status: ok, missing, corrupt (a value that is no digest) or mismatch. files: path, content; stored: path, value."""
    have = files.filter(F.octet_length("content") > 0).select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("actual"))
    j = have.join(stored.select("path", "value"), "path", "left")
    wrong = ~F.col("value").startswith("sha256:") | (F.length("value") != 71)
    return j.select("path", F.when(F.col("value").isNull(), "missing").when(wrong, "corrupt").when(F.col("value") != F.col("actual"), "mismatch").otherwise("ok").alias("status"))


def tails_across_blocks(inodes: DataFrame, bits: int = 12) -> DataFrame:
    """Inodes whose inline tail would cross a block. inodes: nid, iloc, inode_isize, xattr_isize, size, datalayout."""
    bs = 1 << bits
    at = F.col("iloc") + F.col("inode_isize") + F.col("xattr_isize")
    return inodes.filter((F.col("datalayout") == 2) & (F.pmod(at, F.lit(bs)) + F.pmod("size", F.lit(bs)) > bs))


def xattr_bodies(bodies: DataFrame) -> DataFrame:
    """nid, problem. bodies: nid, body_size, n_shared, entry_bytes."""
    p = F.when(F.col("body_size") == 12, "reserved size").when((F.col("body_size") > 0) & (F.col("body_size") < 12), "too small").when((F.col("body_size") > 12) & (12 + 4 * F.col("n_shared") + F.col("entry_bytes") > F.col("body_size")), "entries do not fit")
    return bodies.select("nid", p.alias("problem")).filter("problem is not null")


def verdict(**violations: DataFrame) -> DataFrame:
    """check, n, corrupted: how many violations each query found, and whether any did."""
    out = None
    for name, df in violations.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("corrupted", F.max(F.col("n") > 0).over(W.partitionBy(F.lit(0))))


def compare_trees(a: DataFrame, b: DataFrame) -> DataFrame:
    """path, chunk_no, status of chunks that differ: only_a, only_b or differs. a, b: path, chunk_no, digest."""
    j = a.select("path", "chunk_no", F.col("digest").alias("da")).join(b.select("path", "chunk_no", F.col("digest").alias("db")), ["path", "chunk_no"], "full_outer")
    s: Column = F.when(F.col("db").isNull(), "only_a").when(F.col("da").isNull(), "only_b").when(F.col("da") != F.col("db"), "differs")
    return j.select("path", "chunk_no", s.alias("status")).filter("status is not null")
