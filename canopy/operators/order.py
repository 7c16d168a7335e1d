"""Numbers and running sums over long orders, without a window over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.plans.scratch import stored


def running(rows: DataFrame, group: list[str], order: Column, value: Column, name: str) -> DataFrame:
    """rows and `name`: the sum of value over the rows before each in its group's order (0 for the first).

    Rows are dealt by ranges of (group, order), summed range by range, and each range starts where those before it end: a group
    of any size is spread over many tasks. Ties in the order must not matter, or the order must have none.
    """
    ranged = rows.withColumns({"__order": order, "__value": value}).repartitionByRange(*group, "__order").withColumn("__range", F.spark_partition_id())
    kept = stored(ranged, "ranges")  # bounds are sampled anew each time they are worked out
    totals = kept.groupBy(*group, "__range").agg(F.sum("__value").alias("__total"))
    before = W.partitionBy(*group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*group, "__range", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__start"))
    inside = W.partitionBy(*group, "__range").orderBy("__order").rowsBetween(W.unboundedPreceding, -1)
    summed = kept.withColumn("__before", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    return summed.join(starts, [*group, "__range"]).select(*rows.columns, (F.col("__start") + F.col("__before")).alias(name))
