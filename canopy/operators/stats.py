"""Statistics over a tree: counts by type, sizes, extensions, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions.columns import blocks_of, extension_of, size_bucket
from canopy.schema import FILE_TYPES, KNOWN_EXTENSIONS


def with_ratio(counts: DataFrame, total: Column, n: str = "n") -> DataFrame:
    """Adds ratio, in per cent of `total` (0 where that is 0), and bar, a # for every two per cent."""
    ratio = F.when(total > 0, F.col(n) * 100.0 / total).otherwise(0.0)
    return counts.withColumn("ratio", ratio).withColumn("bar", F.expr("repeat('#', cast(floor(ratio / 2) as int))"))


def type_counts(dirents: DataFrame) -> DataFrame:
    """Entries by file type; hard links count once an entry."""
    name = F.element_at(F.create_map(*[F.lit(v) for kv in FILE_TYPES.items() for v in kv]), F.col("ftype"))
    return dirents.groupBy("ftype").agg(F.count("*").alias("n")).withColumn("type_name", name)


def occupied(size: Column, datalayout: Column, i_blocks: Column, bits: int) -> Column:
    """Bytes on disk: compressed layouts (1 and 3) take their blocks, others their size."""
    return F.when(datalayout.isin(1, 3), F.shiftleft(i_blocks, bits)).otherwise(size)


def compression_counts(inodes: DataFrame) -> DataFrame:
    compressed = F.col("datalayout").isin(1, 3)
    return inodes.agg(F.count_if(compressed).alias("n_compressed"), F.count_if(~compressed).alias("n_uncompressed"))


def size_histogram(files: DataFrame, size: str = "size") -> DataFrame:
    """bucket, files: bucket b holds sizes of b bits in KiB; all 17 are listed."""
    spark = files.sparkSession
    counts = files.groupBy(size_bucket(F.col(size)).alias("bucket")).agg(F.count("*").alias("n_files"))
    return spark.range(17).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(counts), "bucket", "left").select("bucket", F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"))


def extension_class(name: Column) -> Column:
    """The first known extension that begins with the name's; "others" for the rest."""
    ext = extension_of(name)
    out = F.when(ext.isNull(), "others")
    for known in KNOWN_EXTENSIONS:
        out = out.when(F.startswith(F.lit(known), ext), known)
    return out.otherwise("others")


def extension_histogram(files: DataFrame, name: str = "name") -> DataFrame:
    return files.groupBy(extension_class(F.col(name)).alias("ext")).agg(F.count("*").alias("n_files"))


def size_totals(files: DataFrame) -> DataFrame:
    """n_files, original and on-disk bytes (columns size, occupied), and the rate between them (null without bytes)."""
    t = files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("original_bytes"), F.coalesce(F.sum("occupied"), F.lit(0)).alias("disk_bytes"))
    return t.withColumn("rate", F.when(F.col("original_bytes") > 0, F.col("disk_bytes") * 100.0 / F.col("original_bytes")))


def block_ratio(extents: DataFrame, files: DataFrame, bits: int = 12) -> DataFrame:
    """Physical blocks of all extents in per cent of the blocks of all files."""
    p = extents.agg(F.sum(blocks_of(F.col("plen"), bits)).alias("physical_blocks"))
    q = files.agg(F.sum(blocks_of(F.col("size"), bits)).alias("logical_blocks"))
    return p.crossJoin(q).withColumn("ratio", F.when(F.col("logical_blocks") > 0, F.col("physical_blocks") * 100.0 / F.col("logical_blocks")))  # one row each


def directory_links(dirents: DataFrame) -> DataFrame:
    """dir, nlink: 2 and the subdirectories; 1 where that is over 65535. dirents: dir, ftype."""
    n = F.count_if(F.col("ftype") == 2) + 2
    return dirents.groupBy("dir").agg(n.alias("n")).select("dir", F.when(F.col("n") > 65535, 1).otherwise(F.col("n")).alias("nlink"))


def hard_links(dirents: DataFrame) -> DataFrame:
    """nid, nlink: entries that name each inode."""
    return dirents.groupBy("nid").agg(F.count("*").alias("nlink"))


def directory_sizes(dirents: DataFrame, block: int = 4096) -> DataFrame:
    """dir, dir_size: records of 12 bytes and a name, in byte order; one that does not fit starts a block."""
    sized = dirents.groupBy("dir").agg(F.sort_array(F.collect_list(F.col("name").cast("binary"))).alias("names"))
    step = lambda acc, n: F.when(F.shiftright(acc, 12) == F.shiftright(acc + 11 + F.octet_length(n), 12), acc + 12 + F.octet_length(n)).otherwise(F.shiftleft(F.shiftright(acc, 12) + 1, 12) + 12 + F.octet_length(n))
    if block != 4096:
        raise ValueError("directory blocks have 4096 bytes")
    return sized.select("dir", F.aggregate("names", F.lit(0), step).alias("dir_size"))


def algorithms(rows: DataFrame) -> DataFrame:
    """The set of algorithms as bits, and the largest dictionary; rows: alg (bit number), dict_size."""
    return rows.agg(F.bit_or(F.expr("shiftleft(1, alg)")).alias("available"), F.max("dict_size").alias("max_dict"))


def extent_summary(extents: DataFrame) -> DataFrame:
    return extents.groupBy("nid").agg(F.count("*").alias("n_extents"), F.sum("llen").alias("logical_bytes"), F.sum("plen").alias("physical_bytes"))


def total_blocks(images: DataFrame, devices: DataFrame) -> DataFrame:
    """image_id, total_blocks: primary blocks and those of the devices."""
    extra = devices.groupBy("image_id").agg(F.sum("blocks").alias("extra"))
    return images.join(extra, "image_id", "left").select("image_id", (F.col("primary_blocks") + F.coalesce("extra", F.lit(0))).alias("total_blocks"))
