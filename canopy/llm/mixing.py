"""Mixing sources to target weights: temperature, budget and block permutations.

A source's weight is its share of all tokens to the power of an exponent between 0 and 1, normalised: 1 keeps the shares, 0
makes all sources equal. The exponent is bisected to meet a target entropy (a part of the way from the entropy of the shares to
that of equal weights) or a limit on repetition (how often the most repeated source is seen for each time the least repeated one
is). The budget, in tokens, is given, or is the least that shows every document once.

Each source is dealt into blocks by hash, BLOCKS at least and more as the table grows (BLOCK_ROWS rows a block of all sources, about).
Its quota of the budget is whole epochs over all its blocks and a part of
another; each epoch has its own permutation of the blocks. The last block of the part is filled document by document. `at`
places a block in the mixture between 0 and 1, so readers that sort by it see all sources at their weights all along.

Cases: a null source is a source of its own; null and empty texts have no tokens, are part of whole epochs, and come along in
a partial one as long as its quota lasts; repeated rows are rows each; ties are broken by id and tokens; an empty table, or one
without tokens, gives every row once; further columns pass through, whatever their names, but for `__tokens`, `__block`, `__epoch` and
`__at`, which are ours in the result.
The totals per source (one row a source) are collected; nothing else is.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.llm.common import partitions_for, stored, table, text_or_empty

BLOCKS, BLOCK_ROWS = 1024, 20_000
MAX_REPEATS = 1.25


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(shares: list[float], exponent: float) -> list[float]:
    raw = [s**exponent if s > 0 else 0.0 for s in shares]
    total = math.fsum(raw)
    return [r / total for r in raw]


def repetition(shares: list[float], weights: list[float]) -> float:
    rates = [w / s for s, w in zip(shares, weights, strict=True) if s > 0]
    return max(rates) / min(rates)


def bisect_exponent(shares: list[float], max_repeats: float | None = None, target_entropy: float | None = None) -> float:
    """The least exponent that keeps the repetition limit, or the greatest that reaches the target entropy (0 to 1 of the way)."""
    if max_repeats is not None:
        good = lambda e: repetition(shares, tempered(shares, e)) <= max_repeats
        if good(0.0):
            return 0.0
        low, high = 0.0, 1.0  # high is good
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if good(mid) else (mid, high)
        return high
    n = sum(s > 0 for s in shares)
    want = entropy(shares) + (target_entropy or 0.0) * (math.log(n) - entropy(shares))
    low, high = 0.0, 1.0  # low reaches it
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(tempered(shares, mid)) >= want else (low, mid)
    return low


def quotas(totals: list[int], max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None) -> list[int]:
    """Tokens of each source."""
    if target_entropy is not None:
        max_repeats = None
    total = sum(totals)
    if not total:
        return [0] * len(totals)
    shares = [t / total for t in totals]
    weights = tempered(shares, bisect_exponent(shares, max_repeats, target_entropy))
    if budget is not None:
        return [int(w * budget) for w in weights]
    scale = max(t / w for t, w in zip(totals, weights, strict=True) if w > 0)
    return [max(t, int(w * scale + 1e-6)) for t, w in zip(totals, weights, strict=True)]


OURS = ("__tokens", "__block", "__epoch", "__at")


def with_tokens(docs: DataFrame, seed: int, blocks: int) -> DataFrame:
    """row (all columns of docs) with tokens (stretches without white space), source (never null), block and a key for its order."""
    text = text_or_empty()
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source"),
        # by id and text: an id that many rows share, or null, does not make a large block
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", text), F.lit(blocks)).cast("int").alias("block"),
        F.struct(F.xxhash64(F.lit(seed + 1), "doc_id", text), "doc_id").alias("order"),
    )


def schedule(totals: DataFrame, quota: DataFrame, seed: int) -> DataFrame:
    """For each (source, block): whole epochs, the place of the block in the partial one, and how many tokens it may give there."""
    w = W.partitionBy("source").orderBy("order", "block")
    joined = totals.join(quota, "source").withColumn("order", F.xxhash64(F.lit(seed), "source", "whole", "block"))
    before = F.coalesce(F.sum("tokens").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return joined.withColumn("before", before).select("source", "block", "whole", "quota", "total", F.col("tokens").alias("block_tokens"), (F.col("left") - F.col("before")).alias("room"))


def mixed(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None, seed: int = 17, blocks: int | None = None) -> DataFrame:
    """The rows of the mixture: all columns, and __tokens, __block, __epoch and __at. A row comes once for each epoch it is in."""
    spark = docs.sparkSession
    rows = with_tokens(docs, seed, blocks or partitions_for(docs.count(), BLOCK_ROWS, BLOCKS))
    totals = stored(rows.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "mix-blocks")
    by_source = sorted(totals.groupBy("source").agg(F.sum("tokens").alias("n")).collect())
    want = quotas([r["n"] for r in by_source], max_repeats, target_entropy, budget)
    plan = [(r["source"], r["n"], q, q // r["n"] if r["n"] else 1, q % r["n"] if r["n"] else 0) for r, q in zip(by_source, want, strict=True)]
    quota = spark.createDataFrame(plan, "source string, total long, quota long, whole long, left long")
    dealt = rows.join(schedule(totals, quota, seed), ["source", "block"])
    inside = dealt.filter(F.col("room") >= F.col("block_tokens")).withColumn("partial", F.col("room") > 0)
    outside = dealt.filter(F.col("room") <= 0).filter(F.col("room") < F.col("block_tokens")).withColumn("partial", F.lit(False))
    w = W.partitionBy("source", "block").orderBy("order", "tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    across = dealt.filter((F.col("room") > 0) & (F.col("room") < F.col("block_tokens"))).withColumn("partial", F.sum("tokens").over(w) <= F.col("room"))
    together = inside.unionByName(outside).unionByName(across)
    last = F.when(F.col("partial"), F.col("whole")).otherwise(F.col("whole") - 1)
    epochs = together.filter(last >= 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    share = F.pmod(F.xxhash64(F.lit(seed), "source", "epoch", "block"), F.lit(1 << 20)) / float(1 << 20)
    whole_at = (F.col("epoch") + share) * F.col("total") / F.col("quota")
    at = F.when(F.col("quota") > 0, F.when(F.col("epoch") < F.col("whole"), whole_at).otherwise(1 - F.col("room") / F.col("quota"))).otherwise(F.lit(0.0))
    return epochs.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in OURS], F.col("tokens").alias("__tokens"), F.col("block").alias("__block"), F.col("epoch").alias("__epoch"), at.alias("__at"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "source", F.col("__tokens").alias("n_tokens"), F.col("__block").alias("block"), F.col("__epoch").alias("epoch"), F.col("__at").alias("at"))
