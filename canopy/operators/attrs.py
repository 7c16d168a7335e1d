"""Attribute rewriting: owners, times, inode forms, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.schema import ALGORITHMS, FEATURES

U32 = (1 << 32) - 1


def mapped_id(value: Column, fixed: int | None = None, offset: int = 0) -> Column:
    """An owner: fixed or its own, and an offset, modulo 2 ** 32."""
    return F.pmod((F.lit(fixed) if fixed is not None else value) + offset, F.lit(1 << 32)).cast("long")


def time_policy(s: Column, ns: Column, policy: str = "none", at: int = 0, at_ns: int = 0) -> tuple[Column, Column]:
    """none keeps times; fixed sets all; clamp sets those at or after `at`."""
    if policy == "none":
        return s, ns
    late = F.lit(True) if policy == "fixed" else s >= at
    return F.when(late, F.lit(at).cast("long")).otherwise(s), F.when(late, F.lit(at_ns)).otherwise(ns)


def inode_form(size: Column, uid: Column, gid: Column, nlink: Column, mtime_s: Column, epoch: int, forced: int = 0, wide: bool = False, ignore_mtime: bool = False) -> Column:
    """64 or 32: bytes of the inode."""
    out = F.when(F.lit(forced == 64), 64).when((size > U32) | (uid > 65535) | (gid > 65535) | (nlink > 65535), 64)
    if not (wide or ignore_mtime):
        out = out.when(mtime_s != epoch, 64)
    return out.otherwise(32)


def build_epoch(t: Column) -> tuple[Column, Column]:
    """(epoch, build time) of an image with 32-bit offsets from the epoch."""
    epoch = F.greatest(F.lit(0), t - U32)
    return epoch, t - epoch


def initial_stat(mode: Column, size: Column) -> tuple[Column, Column]:
    """(size, nlink) of a new inode: regular files and links keep sizes."""
    return F.when(mode.bitwiseAND(0xF000).isin(0x8000, 0xA000), size).otherwise(0).cast("long"), F.lit(1)


def feature_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, k, b, n, i) for i, (c, k, b, n) in enumerate(FEATURES)], "compat boolean, kernel int, bit long, feature string, ord int")


def features(images: DataFrame) -> DataFrame:
    """image_id, feature: a row a feature that is set."""
    t = feature_table(images.sparkSession)
    word = F.when(F.col("compat"), F.col("feature_compat")).otherwise(F.col("feature_incompat"))
    return images.join(F.broadcast(t), word.bitwiseAND(F.col("bit")) != 0).select("image_id", "feature", "kernel")


def least_kernel(images: DataFrame) -> DataFrame:
    """image_id, kernel: major * 100 + minor, 0 where any will do. images: image_id, feature_compat, feature_incompat, algs."""
    rules = [F.when(F.shiftright("algs", bit).bitwiseAND(1) == 1, kernel).otherwise(0) for bit, _, kernel in ALGORITHMS]
    for compat, kernel, bit, _ in FEATURES:
        rules.append(F.when(F.col("feature_compat" if compat else "feature_incompat").bitwiseAND(bit) != 0, kernel).otherwise(0))
    return images.select("image_id", F.greatest(*rules).cast("int").alias("kernel"))
