"""Extended attributes: sharing, layout, lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Short prefixes by index.
PREFIXES = {1: "user.", 2: "system.posix_acl_access", 3: "system.posix_acl_default", 4: "trusted.", 5: "lustre.", 6: "security."}


def split_name(name: Column) -> tuple[Column, Column]:
    """(prefix index, rest); index 0 keeps the whole name."""
    index, rest = F.lit(0), name
    for i, p in PREFIXES.items():
        hit = name.startswith(p)
        index = F.when(hit, i).otherwise(index)
        rest = F.when(hit, F.substring(name, len(p) + 1, 1 << 20)).otherwise(rest)
    return index.cast("int"), rest


def full_name(index: Column, infix: Column, suffix: Column) -> Column:
    """The name from prefix, long prefix's infix and the rest."""
    prefix = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in PREFIXES.items() for v in kv]), index), F.lit(""))
    return F.concat(prefix, F.coalesce(infix, F.lit("")), suffix)


def long_prefix(name: Column, prefixes: list[str]) -> tuple[Column, Column]:
    """(prefix number from 0 or null, rest of the name): the first listed prefix that the name starts with."""
    number, rest = F.lit(None).cast("int"), name
    for i, p in reversed(list(enumerate(prefixes))):
        hit = name.startswith(p)
        number, rest = F.when(hit, i).otherwise(number), F.when(hit, F.substring(name, len(p) + 1, 1 << 20)).otherwise(rest)
    return number, rest


def shared(xattrs: DataFrame, tolerance: int = 2) -> DataFrame:
    """name, value, n of attributes that more than `tolerance` inodes have; none when it is negative."""
    counted = xattrs.groupBy("name", "value").agg(F.count("*").alias("n"))
    return counted.filter(F.lit(tolerance >= 0) & (F.col("n") > tolerance))


def entry_size(name: Column, value: Column) -> Column:
    """4 bytes, the name without its short prefix and the value, rounded up to 4."""
    return (4 + F.octet_length(split_name(name)[1]) + F.octet_length(value) + 3).bitwiseAND(-4)


def shared_ids(xattrs: DataFrame, tolerance: int = 2) -> DataFrame:
    """name, value, shared_id: the offset in the shared area, in units of 4, sorted by key bytes.

    Every row of the window is a distinct shared attribute; what an image shares fits its shared area, whose ids have 32 bits.
    """
    w = W.partitionBy(F.lit(0)).orderBy("name", "value").rowsBetween(W.unboundedPreceding, -1)
    s = shared(xattrs, tolerance).withColumn("bytes", entry_size(F.col("name"), F.col("value")))
    return s.withColumn("shared_id", F.shiftright(F.coalesce(F.sum("bytes").over(w), F.lit(0)), 2)).select("name", "value", "shared_id")


def inline_sizes(xattrs: DataFrame, tolerance: int = 2, most_shared: int = 255) -> DataFrame:
    """nid, n_shared, body_size: 12 bytes, 4 for each shared attribute (255 at most), the others in full."""
    s = shared(xattrs, tolerance).select("name", "value", F.lit(True).alias("is_shared"))
    w = W.partitionBy("nid", "is_shared").orderBy("name", "value")
    rows = xattrs.join(s, ["name", "value"], "left").withColumn("nth", F.row_number().over(w))
    out = F.coalesce("is_shared", F.lit(False)) & (F.col("nth") <= most_shared)
    size = F.when(out, 4).otherwise(entry_size(F.col("name"), F.col("value")))
    return rows.groupBy("nid").agg(F.count_if(out).alias("n_shared"), (F.sum(size) + 12).alias("body_size"))


def lookup(inline: DataFrame, refs: DataFrame, shared_table: DataFrame, wanted: DataFrame) -> DataFrame:
    """nid, name, value of wanted (nid, name): inline entries first, then shared ones (refs: nid, shared_id); null: none."""
    own = wanted.join(inline, ["nid", "name"], "left").select("nid", "name", F.col("value").alias("own"))
    far = refs.join(shared_table, "shared_id").select("nid", "name", F.col("value").alias("far"))
    return own.join(far, ["nid", "name"], "left").select("nid", "name", F.coalesce("own", "far").alias("value"))


def digest_name(xattrs: DataFrame, name: str = "user.canopy.digest") -> DataFrame:
    return xattrs.filter(F.col("name") == name)
