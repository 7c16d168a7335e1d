"""Layers: merging trees with whiteouts and opaque directories, and archives that override themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.functions.columns import ancestors
from canopy.operators.filters import is_whiteout

DIRECTORY = 0x4000


def _is_dir(mode):
    return mode.bitwiseAND(0xF000) == DIRECTORY


def merge(entries: DataFrame) -> DataFrame:
    """The merged tree of layers; the higher layer_no is the upper one. entries: layer_no, path, mode, rdev, opaque (boolean), ...

    A path's entry is the uppermost, and what it hides goes by cut-offs: an entry at layer L hides everything below its path
    in layers under L if it is no directory (a whiteout included) and is the uppermost there or lies under upper directories
    as a whiteout, or if it is an opaque directory (which hides layers under L, not L). A plain file under an upper directory
    is ignored and hides nothing. Whiteouts that are uppermost stay.
    """
    top = W.partitionBy("path").orderBy(F.desc("layer_no"))
    ranked = entries.withColumn("nth", F.row_number().over(top))
    white = is_whiteout(F.col("mode"), F.col("rdev"))
    hides = F.when(~_is_dir(F.col("mode")) & ((F.col("nth") == 1) | white), F.col("layer_no")).when(_is_dir(F.col("mode")) & F.col("opaque"), F.col("layer_no"))
    cuts = ranked.groupBy("path").agg(F.max(hides).alias("cut")).filter("cut is not null")
    best = ranked.filter("nth = 1").drop("nth")
    chain = best.select("path", F.col("layer_no").alias("l"), F.explode(ancestors(F.col("path"))).alias("above"))
    hidden = chain.join(cuts.select(F.col("path").alias("above"), "cut"), "above").filter("l < cut").select("path").distinct()
    return best.join(hidden, "path", "left_anti")


def override(entries: DataFrame) -> DataFrame:
    """The tree an archive leaves behind: the last entry of a path wins (seq); an entry that is no directory, replacing or
    becoming one, drops what was below the path before it."""
    w = W.partitionBy("path").orderBy(F.desc("seq"))
    ranked = entries.withColumn("nth", F.row_number().over(w))
    last = ranked.filter("nth = 1").drop("nth")
    drops = entries.filter(~_is_dir(F.col("mode"))).groupBy("path").agg(F.max("seq").alias("dropped"))
    chain = last.select("path", F.col("seq").alias("s"), F.explode(ancestors(F.col("path"))).alias("above"))
    gone = chain.join(drops.select(F.col("path").alias("above"), "dropped"), "above").filter("s < dropped").select("path").distinct()
    return last.join(gone, "path", "left_anti")


def incremental(base: DataFrame, new: DataFrame) -> DataFrame:
    """New entries over a base: a base entry stays where the path is not new and no new directory above it is opaque or no directory."""
    block = new.filter(F.col("opaque") | ~_is_dir(F.col("mode"))).select(F.col("path").alias("above"))
    chain = base.select("path", F.explode(ancestors(F.col("path"))).alias("above")).join(block, "above", "left_semi").select("path").distinct()
    kept = base.join(new.select("path"), "path", "left_anti").join(chain, "path", "left_anti")
    return kept.unionByName(new)


def link_targets(entries: DataFrame) -> DataFrame:
    """seq, target_seq of hard links: the latest earlier entry of the target path; null where there is none, it is a directory,
    or the link names itself. entries: seq, path, linkpath (null: no link), mode."""
    links = entries.filter("linkpath is not null").select(F.col("seq").alias("link_seq"), F.col("path").alias("own"), F.col("linkpath").alias("path"))
    met = links.join(entries.select("path", "seq", "mode"), "path", "left").filter("seq is null or seq < link_seq or own = path")
    best = F.max_by(F.struct("seq", "mode", "own", "path"), F.when(F.col("seq") < F.col("link_seq"), F.col("seq")))
    found = met.groupBy("link_seq").agg(best.alias("t"))
    good = F.col("t.seq").isNotNull() & ~_is_dir(F.col("t.mode")) & (F.col("t.own") != F.col("t.path"))
    return links.select("link_seq").join(found, "link_seq", "left").select(F.col("link_seq").alias("seq"), F.when(good, F.col("t.seq")).alias("target_seq"))


def overlay_attributes(entries: DataFrame) -> DataFrame:
    """path, name, value: trusted.overlay.opaque = y on opaque directories, an origin marker on directories that hold whiteouts."""
    opaque = entries.filter(F.col("opaque") & _is_dir(F.col("mode"))).select("path", F.lit("trusted.overlay.opaque").alias("name"), F.lit("y").alias("value"))
    from canopy.functions.columns import parent_of

    origin = entries.filter(is_whiteout(F.col("mode"), F.col("rdev"))).select(parent_of(F.col("path")).alias("path")).distinct()
    return opaque.unionByName(origin.select("path", F.lit("trusted.overlay.origin").alias("name"), F.lit("").alias("value")))


def stack(sources: list[DataFrame]) -> DataFrame:
    """Sources as layers: a later one is above an earlier one (layer_no is its position)."""
    out = None
    for no, s in enumerate(sources):
        s = s.withColumn("layer_no", F.lit(no))
        out = s if out is None else out.unionByName(s)
    return out


def data_mode(merged: DataFrame, mode: str) -> DataFrame:
    """What a merge does with data: `index` refers to the source image, `full` copies (and refuses chunked and compressed inputs),
    `reserve` only keeps room. merged: datalayout, size, layer_no."""
    if mode == "index":
        return merged.withColumn("device_id", F.col("layer_no") + 1)
    if mode == "reserve":
        return merged.withColumn("reserved", F.col("size"))
    if mode != "full":
        raise ValueError(mode)
    return merged.withColumn("copied", F.when(F.col("datalayout").isin(0, 2), F.col("size")).otherwise(F.raise_error(F.lit("full copies are of plain inputs"))))
