"""Object listings (XML) and image manifests (JSON) as entry rows, from saved responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions.columns import ancestors

LISTING = "Name string, IsTruncated boolean, NextMarker string, Contents array<struct<Key: string, LastModified: string, Size: bigint>>"
INDEX = "manifests array<struct<digest: string, mediaType: string, size: bigint, platform: struct<os: string, architecture: string, variant: string>>>"
MANIFEST = "layers array<struct<digest: string, mediaType: string, size: bigint>>"


def objects(pages: DataFrame) -> DataFrame:
    """page, key, size, mtime_s, mtime_ns. pages: page, xml."""
    c = pages.select("page", F.from_xml("xml", LISTING).alias("x")).select("page", F.explode("x.Contents").alias("c"))
    frac = F.rpad(F.substring(F.regexp_extract("c.LastModified", r"\.(\d+)", 1), 1, 9), 9, "0").cast("int")
    at = F.unix_timestamp(F.to_timestamp(F.concat(F.substring("c.LastModified", 1, 19), F.lit("Z")), "yyyy-MM-dd'T'HH:mm:ssX"))
    return c.select("page", F.col("c.Key").alias("key"), F.col("c.Size").alias("size"), at.alias("mtime_s"), F.coalesce(frac, F.lit(0)).alias("mtime_ns"))


def next_marker(pages: DataFrame) -> DataFrame:
    """page, marker: where the next page starts; null after the last. NextMarker, or the last key of a truncated page."""
    x = pages.select("page", F.from_xml("xml", LISTING).alias("x"))
    last = F.element_at("x.Contents.Key", -1)
    return x.select("page", F.when(F.col("x.IsTruncated"), F.coalesce("x.NextMarker", last)).alias("marker"))


def entries(objs: DataFrame) -> DataFrame:
    """path, mode, size: files 0644, directories 0755, those that keys only imply made once; a key that ends in a slash is a directory."""
    key = F.regexp_replace("key", "/+$", "")
    own = objs.filter(key != "").select(key.alias("path"), F.when(F.endswith("key", F.lit("/")), 0x41ED).otherwise(0x81A4).alias("mode"), F.when(F.endswith("key", F.lit("/")), 0).otherwise(F.col("size")).alias("size"))
    up = own.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().select("path", F.lit(0x41ED).alias("mode"), F.lit(0).cast("long").alias("size"))
    dirs = up.unionByName(own.filter(F.col("mode") == 0x41ED)).distinct()
    return dirs.unionByName(own.filter(F.col("mode") != 0x41ED).join(dirs.select("path"), "path", "left_anti"))


def pick_manifest(indexes: DataFrame, platform: str) -> DataFrame:
    """image, digest of the first manifest for os/arch[/variant]. indexes: image, json."""
    os_, arch, *variant = platform.split("/")
    m = indexes.select("image", F.posexplode(F.from_json("json", INDEX)["manifests"]).alias("pos", "m"))
    fits = (F.col("m.platform.os") == os_) & (F.col("m.platform.architecture") == arch)
    if variant:
        fits = fits & (F.col("m.platform.variant") == variant[0])
    return m.filter(fits).groupBy("image").agg(F.min_by("m.digest", "pos").alias("digest"))


def layers(manifests: DataFrame, index: int | None = None, digest: str | None = None) -> DataFrame:
    """image, layer_no, digest, media_type, size in order; one layer by index or digest. manifests: image, json."""
    out = manifests.select("image", F.posexplode(F.from_json("json", MANIFEST)["layers"]).alias("layer_no", "l"))
    out = out.select("image", "layer_no", F.col("l.digest").alias("digest"), F.col("l.mediaType").alias("media_type"), F.col("l.size").alias("size"))
    if index is not None:
        out = out.filter(F.col("layer_no") == index)
    return out.filter(F.col("digest") == digest) if digest is not None else out
