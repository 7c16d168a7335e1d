"""Rules over paths: excludes, first-match hints, whiteouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions.columns import ancestors, java_pattern


def excluded(path: Column, exact: list[str] = (), patterns: list[str] = ()) -> Column:
    """Exact paths (without a leading slash), or a POSIX pattern found anywhere in the path."""
    out = F.lit(False)
    if exact:
        out = out | path.isin([e.lstrip("/") for e in exact])
    for p in patterns:
        out = out | path.rlike(java_pattern(p))
    return out


def exclude(entries: DataFrame, exact: list[str] = (), patterns: list[str] = ()) -> DataFrame:
    """Entries that no rule excludes, nor any directory above them."""
    chain = F.concat(ancestors(F.col("path")), F.array("path"))
    return entries.filter(~F.exists(chain, lambda p: excluded(p, exact, patterns)))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """rule_no, cluster_size, alg, pattern of a rule file: `size [alg] pattern`.

    A # starts a comment at the start of a line or after white space; inside a pattern it stands for itself. Rules whose size
    is no multiple of the block size are left out.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("rule_no", "line"))
    return parse_rules(lines)


def parse_rules(lines: DataFrame, block_size: int = 4096) -> DataFrame:
    bare = lines.select("rule_no", F.trim(F.regexp_replace("line", r"(^|\s)#.*$", "")).alias("line")).filter("line <> ''")
    size, alg = F.regexp_extract("line", r"^(\d+)", 1), F.regexp_extract("line", r"^\d+\s+(\d+)\s+\S", 1)
    return bare.filter(F.col("line").rlike(r"^\d+\s+\S") & (size.cast("long") % block_size == 0)).select(
        F.col("rule_no").cast("int"), size.cast("long").alias("cluster_size"),
        F.when(alg != "", alg.cast("int")).alias("alg"), F.regexp_extract("line", r"^\d+\s+(?:\d+\s+(?=\S))?(.*)$", 1).alias("pattern"),
    )


def first_match(path: Column, rules: list[tuple[str, object]], default: object) -> Column:
    """The value of the first rule, in order, whose pattern is found in the path: one pass, no join."""
    out = None
    for pattern, value in rules:
        found = path.rlike(java_pattern(pattern))
        out = F.when(found, F.lit(value)) if out is None else out.when(found, F.lit(value))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def is_whiteout(mode: Column, rdev: Column) -> Column:
    return (mode.bitwiseAND(0xF000) == 0x2000) & (rdev == 0)


def aufs(path: Column) -> tuple[Column, Column, Column]:
    """(path it stands for, whiteout, opaque marker) of names that start with .wh."""
    name = F.substring_index(path, "/", -1)
    opaque = name == ".wh..wh..opq"
    white = name.startswith(".wh.") & ~opaque
    parent = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")
    target = F.when(opaque, parent).when(white, F.concat(F.when(parent != "", F.concat(parent, F.lit("/"))).otherwise(""), F.expr("substring(substring_index(path, '/', -1), 5)"))).otherwise(path)
    return target, white, opaque


def strip_overlay(entries: DataFrame) -> DataFrame:
    """Entries without whiteouts."""
    return entries.filter(~is_whiteout(F.col("mode"), F.col("rdev")))


def compressible(size: Column, cluster_size: Column, has_algorithm: bool = True) -> Column:
    """Files that a hint does not exempt (cluster size 0) and that have bytes."""
    return F.lit(has_algorithm) & (cluster_size > 0) & (size > 0)
