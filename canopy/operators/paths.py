"""Trees: directories of paths, path lookup, walking directory entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions.columns import ancestors, parent_of


#: Levels of a walk whose union is written as one table.
FOLD = 32


def name_order(path: Column) -> Column:
    """Sorts paths as a walk meets them, by the names of their parts: a/z before a-b/z, which whole paths would turn round."""
    return F.split(path, "/")


def directories(files: DataFrame) -> DataFrame:
    """path, parent, depth of all directories above the files; not the root."""
    d = files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return d.select("path", parent_of(F.col("path")).alias("parent"), F.size(F.split("path", "/")).alias("depth"))


def tree(files: DataFrame) -> DataFrame:
    """dir, name, path, ftype: all entries of a tree given by its files."""
    last = F.substring_index("path", "/", -1).alias("name")
    f = files.select(parent_of(F.col("path")).alias("dir"), last, "path", F.lit(1).alias("ftype"))
    return f.unionByName(directories(files).select(F.col("parent").alias("dir"), last, "path", F.lit(2).alias("ftype")))


def missing_parents(entries: DataFrame) -> DataFrame:
    """path, mode, uid, gid: directories that no entry names; 0755 and the group's and others' write bits of the nearest named
    directory above, its owner too (root's where there is none: 0, mode 0755)."""
    need = entries.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().join(entries.select("path"), "path", "left_anti")
    dirs = entries.filter(F.col("mode").bitwiseAND(0xF000) == 0x4000).select(F.col("path").alias("above"), "mode", "uid", "gid")
    chain = need.select("path", F.explode_outer(ancestors(F.col("path"))).alias("above")).join(dirs, "above", "left")
    best = F.max_by(F.struct("mode", "uid", "gid"), F.when(F.col("mode").isNotNull(), F.length("above")))
    found = chain.groupBy("path").agg(best.alias("p"))
    write = F.coalesce(F.col("p.mode"), F.lit(0)).bitwiseAND(0o022)
    return found.select("path", F.lit(0x4000 | 0o755).bitwiseOR(write).alias("mode"), F.coalesce("p.uid", F.lit(0)).cast("long").alias("uid"), F.coalesce("p.gid", F.lit(0)).cast("long").alias("gid"))


def walk(dirents: DataFrame, root_nid: int) -> DataFrame:
    """path, nid, ftype of all entries below a root; dirents: dir_nid, name (string), nid, ftype.

    One join a level, on the directory: a level's directories and the entries meet by hash; levels are walked until one has no
    directory left, however deep the tree is. A directory that is its own ancestor is reported with loop = true and not entered,
    so the walk ends.
    """
    from canopy.plans.scratch import stored

    names = dirents.filter(~F.col("name").isin(".", "..")).select("dir_nid", "name", F.col("nid").alias("to"), "ftype")
    level = names.sparkSession.createDataFrame([("", root_nid, [root_nid])], "at string, dir_nid long, above array<long>")
    levels = []
    while True:
        now = level.join(names, "dir_nid").select(
            F.when(F.col("at") == "", F.col("name")).otherwise(F.concat_ws("/", "at", "name")).alias("path"), "to", "ftype", "above",
            ((F.col("ftype") == 2) & F.array_contains("above", F.col("to"))).alias("loop"),
        )
        now = stored(now, "walk")
        levels.append(now.select("path", F.col("to").alias("nid"), "ftype", "loop"))
        if len(levels) == FOLD:  # a deep tree's union stays small
            levels = [stored(reduce(DataFrame.unionByName, levels), "walked")]
        level = now.filter("ftype = 2 and not loop").select(F.col("path").alias("at"), F.col("to").alias("dir_nid"), F.concat("above", F.array("to")).alias("above"))
        if not level.limit(1).count():
            return reduce(DataFrame.unionByName, levels)


def lookup(paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """nid of each wanted path (column want), null where a part is missing; extra slashes are ignored."""
    from canopy.functions.columns import normal_path

    return wanted.withColumn("path", normal_path(F.col("want"))).join(paths.select("path", "nid"), "path", "left").select("want", "nid")


def first_paths(walked: DataFrame) -> DataFrame:
    """nid, path: for inodes with several names, the first in directory order: names are compared part by part, byte by byte."""
    return walked.groupBy("nid").agg(F.min_by("path", name_order(F.col("path"))).alias("path"))
