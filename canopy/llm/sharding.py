"""Sharding by fixed virtual slots, in DataFrame operations only.

Records hash into a fixed number of virtual slots (thousands, far more than shards). Bytes and rows are aggregated per
slot, and a versioned slot-to-shard map is stored. Rebalancing edits the map: each shard keeps its slots, largest first,
while they fit its fair share of the bytes; only the slots beyond it move, one by one, to the shard that is lightest at
that moment. Records never move one by one, so the control data is bounded by the number of slots whatever the table's size.

A slot is hashed from id, checksum and size, so a null or much repeated id is spread over the slots like any other. Places are
counted in parts of slots, PART_ROWS rows each, about: no task sorts a whole slot.

Cases: a null text counts no bytes; repeated rows get places of their own (`slot`), ties are
broken by id, checksum and size; an empty table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.llm.common import partitions_for, stored, table

VIRTUAL_SLOTS = 4096
ROW_OVERHEAD = 16
PART_ROWS = 50_000


def virtual_slot(*key: Column | str, n_slots: int = VIRTUAL_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n_slots)).cast("int")


def sized(docs: DataFrame, n_slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of each record: the only pass over the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return rows.withColumn("vslot", virtual_slot("doc_id", "text_crc32", "size", n_slots=n_slots))


def slot_totals(rows: DataFrame) -> DataFrame:
    """Bytes and rows per virtual slot; partial sums leave each task, so a hot slot costs one row a task."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def initial_map(totals: DataFrame, n_shards: int) -> DataFrame:
    """Version 1: slots dealt round the shards, by number."""
    return totals.select(F.lit(1).alias("version"), "vslot", F.pmod("vslot", F.lit(n_shards)).cast("int").alias("shard"), "bytes", "n_rows")


def rebalanced_map(current: DataFrame, n_shards: int) -> DataFrame:
    """The next version of a map (version, vslot, shard, bytes, n_rows), at most `VIRTUAL_SLOTS` rows.

    Shards numbered n_shards or more are emptied; new shards start empty. A slot stays where its shard's running sum of
    bytes, largest slot first, is within the mean of all shards; the others go, largest first, to the lightest shard.
    """
    everything = W.partitionBy(F.lit(0))
    mine = W.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = (
        current.withColumn("fair", F.sum("bytes").over(everything) / n_shards)
        .withColumn("running", F.sum("bytes").over(mine))
        .withColumn("stays", (F.col("running") <= F.col("fair")) & (F.col("shard") < n_shards))
    )
    slot = F.struct(F.col("bytes"), (-F.col("vslot")).alias("order"), F.col("vslot"))
    parts = marked.groupBy().agg(
        F.sort_array(F.collect_list(F.when(~F.col("stays"), slot)), asc=False).alias("pool"),
        *[F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == s), F.col("bytes"))), F.lit(0)).alias(f"load_{s}") for s in range(n_shards)],
    ).select("pool", F.array(*[f"load_{s}" for s in range(n_shards)]).alias("loads"))
    placed = parts.select(
        F.expr(
            """inline(aggregate(
                 pool,
                 named_struct('loads', loads, 'moves', cast(array() as array<struct<vslot:int,target:int>>)),
                 (acc, x) -> named_struct(
                   'loads', transform(acc.loads, (v, i) -> if(i = array_position(acc.loads, array_min(acc.loads)) - 1, v + x.bytes, v)),
                   'moves', concat(acc.moves, array(named_struct('vslot', x.vslot, 'target', cast(array_position(acc.loads, array_min(acc.loads)) - 1 as int))))),
                 acc -> acc.moves))"""
        )
    )
    return (
        marked.join(F.broadcast(placed), "vslot", "left")
        .select((F.col("version") + 1).alias("version"), "vslot", F.coalesce("target", "shard").cast("int").alias("shard"), "bytes", "n_rows")
    )


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Each record's shard and its place there, counted from 0 without gaps, shard by shard.

    The place is the slot's offset in its shard, the part's offset in the slot and the record's number in the part.
    """
    n_parts = partitions_for(rows.count(), slot_map.count() * PART_ROWS or 1)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("size", "text_crc32", "doc_id"), F.lit(n_parts)))
    before = lambda key, order: W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    total_before = lambda n, key, order: F.coalesce(F.sum(n).over(before(key, order)), F.lit(0))
    slots = slot_map.select("vslot", "shard", total_before("n_rows", "shard", "vslot").alias("slot_at"))
    parts = rows.groupBy("vslot", "part").agg(F.count("*").alias("n")).select("vslot", "part", total_before("n", "vslot", "part").alias("part_at"))
    in_part = W.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("nth", F.row_number().over(in_part))
        .join(parts, ["vslot", "part"])
        .join(F.broadcast(slots), "vslot")
        .withColumn("slot", (F.col("slot_at") + F.col("part_at") + F.col("nth") - 1).cast("long"))
    )


def shard(docs: DataFrame, n_shards: int = 40, n_slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, slot and map version of every record, sizes near equal between shards."""
    rows = stored(sized(docs, n_slots), "shard-rows")
    v1 = initial_map(slot_totals(rows), n_shards)
    versions = stored(v1, "slot-map-v1")
    v2 = stored(rebalanced_map(versions, n_shards).coalesce(1), "slot-map-v2")
    return place(rows, v2).withColumn("map_version", F.lit(2))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), 40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version",
    )
