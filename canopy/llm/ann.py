"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample of vectors (FIT_ROWS, chosen by hash of the id) and broadcast; its size does not grow
with the table. Every vector goes down the tree to one leaf. A query walks the tree with a priority queue: the branch whose
centre promises most is opened next, leaves come out in that order. How many leaf rows a query looks at is calibrated on
sample queries: the visits widen until recall against brute force over the sample reaches TARGET (in shares of the sample's
distinct vectors, so that a much repeated vector does not use up a query's visits), and never stop below k candidates. Leaves are joined with the
queries that visit them, leaf by leaf; a leaf with many rows is salted into bounded blocks, each searched by a task of its own.

Nearness is the inner product in double precision. Cases: vectors that are null, zero or have null or non-finite components,
or another length than most of the sample, take no part; with fewer candidates than k all are returned; ties go to the
smaller id; repeated rows are candidates each, but a query's own id never is;
equal query rows are one query, and each vector of an id with several is a query of its own with its own ranks; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.llm.common import partitions_for, stored, table

FIT_ROWS = 20_000
#: Rows of the sample that go with the tree.
FLOOR_ROWS = 8192
LEAF_ROWS = 40
BRANCHES = 8
ROUNDS = 8
TARGET = 0.94
CALIBRATION_QUERIES = 200
#: Rows of one block of a leaf; rows of leaves that share a part.
BLOCK, PART_ROWS = 2048, 1024


@dataclass
class Tree:
    """Nodes in arrays: centres, children as ranges (first, count; count 0: a leaf), leaf numbers."""

    centre: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray
    share: np.ndarray  # of the sample's distinct vectors, by leaf
    budget: float = 0.1  # share of these that a query looks at, at least
    floor_ids: np.ndarray | None = None  # some rows of the table,
    floor_rows: np.ndarray | None = None  # and their leaves: the k-th nearest of those that a query
    floor_leaf: np.ndarray | None = None  # looks at is a floor for the k nearest that it finds

    def floor(self, query_id: int, q: np.ndarray, k: int, leaves: list[int]) -> float:
        """What the k-th nearest score in these leaves is at least."""
        looked = np.zeros(len(self.share), bool)
        looked[leaves] = True
        score = self.floor_rows[looked[self.floor_leaf] & (self.floor_ids != query_id)] @ q
        return float(np.partition(score, -k)[-k]) - 1e-9 * (1 + float(np.abs(score).max())) if len(score) >= k else -np.inf

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child at every node."""
        at = np.zeros(len(x), np.int64)
        moving = np.flatnonzero(self.count[at] > 0)
        while len(moving):
            node = at[moving]
            for n in np.unique(node):
                rows = moving[node == n]
                c = self.centre[self.first[n] : self.first[n] + self.count[n]]
                at[rows] = self.first[n] + np.argmin((c**2).sum(1)[None, :] - 2 * (x[rows] @ c.T), axis=1)
            moving = moving[self.count[at[moving]] > 0]
        return self.leaf[at]

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, the most promising first: a priority queue over branches, by inner product with their centres."""
        score = self.centre @ q
        queue = [(0.0, 0)]
        while queue:
            _, n = heapq.heappop(queue)
            if self.count[n] == 0:
                yield int(self.leaf[n])
            for c in range(self.first[n], self.first[n] + self.count[n]):
                heapq.heappush(queue, (-score[c], c))

    def visits(self, q: np.ndarray, size: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The leaves a query looks at: as calibrated, and until they hold `least` rows by their sizes."""
        out, held, rows = [], 0.0, 0
        for leaf in self.walk(q):
            out.append(leaf)
            held += self.share[leaf]
            rows += size.get(leaf, 0) if size else 0
            if held >= self.budget and rows >= least:
                break
        return out


def k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = np.argmin((centre**2).sum(1)[None, :] - 2 * (x @ centre.T), axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
    return centre


def fit(x: np.ndarray, seed: int = 7) -> Tree:
    """The tree over the distinct vectors of a sample: nodes of more than LEAF_ROWS rows are divided."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centre, first, count, rows = [distinct.mean(0)], [0], [0], [np.arange(len(distinct))]
    i = 0
    while i < len(centre):
        own = rows[i]
        if len(own) > LEAF_ROWS:
            c = k_means(distinct[own], min(BRANCHES, len(own)), rng)
            near = np.argmin((c**2).sum(1)[None, :] - 2 * (distinct[own] @ c.T), axis=1)
            groups = [own[near == j] for j in range(len(c))]
            groups = [g for g in groups if len(g)]
            if len(groups) > 1:
                first[i], count[i] = len(centre), len(groups)
                for g in groups:
                    centre.append(distinct[g].mean(0))
                    first.append(0)
                    count.append(0)
                    rows.append(g)
        rows[i] = own if count[i] == 0 else None
        i += 1
    leaf, share, todo = np.full(len(centre), -1), [], [0]
    while todo:  # numbered depth first, so leaves near each other have near numbers
        i = todo.pop()
        if count[i] == 0:
            leaf[i] = len(share)
            share.append(len(rows[i]) / len(distinct))
        todo += range(first[i] + count[i] - 1, first[i] - 1, -1)
    return Tree(np.array(centre), np.array(first), np.array(count), leaf, np.array(share))


def calibrate(tree: Tree, x: np.ndarray, k: int, seed: int = 11) -> Tree:
    """Widen the visits until mean recall at k over sample queries is TARGET."""
    rng = np.random.default_rng(seed)
    queries = rng.choice(len(x), min(CALIBRATION_QUERIES, len(x)), replace=False)
    leaf = tree.assign(x)
    score = x[queries] @ x.T
    score[np.arange(len(queries)), queries] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return tree
    worst = -np.partition(-score, k - 1, axis=1)[:, k - 1]
    # the k nearest of the whole table lie nearer than those of a sample, so calibration on a sample errs on the safe side
    held = []
    for q, row, w in zip(queries, score, worst, strict=True):
        want = leaf[np.argsort(-row, kind="stable")[:k]]
        place, share = {}, 0.0
        for v in tree.walk(x[q]):
            place[v] = share
            share += tree.share[v]
        held.append(np.sort([place[v] for v in want]))
    held = np.array(held)
    for budget in np.concatenate([np.arange(0.01, 0.3, 0.01), np.arange(0.3, 1.01, 0.05)]):
        if (held < budget).mean() >= TARGET:
            break
    tree.budget = float(budget)
    return tree


def sound(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """id and vector of the rows that take part; floats stay floats until they are multiplied."""
    kind = vectors.schema[column].dataType.elementType.simpleString()
    v = F.col(column) if kind in ("float", "double") else F.col(column).cast("array<double>")
    ok = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.col("vec_id").isNotNull()).filter(ok)


def build_tree(rows: DataFrame, k: int, fit_rows: int = FIT_ROWS) -> Tree | None:
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).toPandas()
    if sample.empty:
        return None
    sizes = sample["v"].map(len)
    size = sizes.mode().iloc[0]
    sample = sample[sizes == size]
    x = np.stack(sample["v"].to_numpy()).astype(np.float64)
    tree = calibrate(fit(x), x, k)
    tree.floor_ids, tree.floor_rows = sample["vec_id"].to_numpy()[:FLOOR_ROWS], x[:FLOOR_ROWS]
    tree.floor_leaf = tree.assign(tree.floor_rows)
    return tree


def with_leaf(rows: DataFrame, tree: Tree) -> DataFrame:
    size = tree.centre.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            b = b.filter(pa.compute.equal(pa.compute.list_value_length(v), size))
            if b.num_rows:
                leaf = tree.assign(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf, pa.int32())], names=["vec_id", "v", "leaf"])

    return rows.mapInArrow(work, f"vec_id long, v {rows.schema['v'].dataType.simpleString()}, leaf int")


@dataclass
class Layout:
    """Where the rows of each leaf are: leaves beside each other share a part; a leaf of several blocks is a part of its own."""

    part: dict[int, int]
    blocks: dict[int, int]
    size: dict[int, int]

    @staticmethod
    def of(size: dict[int, int], rows: int = PART_ROWS) -> Layout:
        part, held, now = {}, 0, 0
        for leaf in sorted(size):
            if size[leaf] <= BLOCK and held and held + size[leaf] > rows:
                now, held = now + 1, 0
            part[leaf] = now if size[leaf] <= BLOCK else -leaf - 1
            held += size[leaf] if size[leaf] <= BLOCK else 0
        return Layout(part, {leaf: -(-n // BLOCK) for leaf, n in size.items()}, size)


def with_visits(queries: DataFrame, tree: Tree, layout: Layout, k: int, own: int = 1) -> DataFrame:
    """part, block, query_id, q, least, leaves: a row for each block that holds leaves a query looks at.

    least: no row that scores less is among the k nearest, so blocks need not return any. own: how many rows a query's id has
    at most; these are no candidates of it.
    """
    size = tree.centre.shape[1]
    kind = queries.schema["v"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows = []
                for i, (key, q) in enumerate(zip(part.column(0).to_pylist(), part.column(1), strict=True)):
                    by: dict[tuple[int, int], list[int]] = {}
                    q = np.array(q.as_py(), np.float64)
                    leaves = tree.visits(q, layout.size, k + own)
                    least = tree.floor(key, q, k, leaves)
                    for leaf in leaves:
                        for block in range(layout.blocks.get(leaf, 0)):
                            by.setdefault((layout.part[leaf], block), []).append(leaf)
                    rows += [(p, n, i, least, leaves) for (p, n), leaves in by.items()]
                if rows:
                    p, n, i, least, leaves = zip(*rows, strict=True)
                    take = pa.array(i)
                    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(n, pa.int32()), part.column(0).take(take), part.column(1).take(take), pa.array(least, pa.float64()), pa.array(leaves, pa.list_(pa.int32()))], names=["part", "block", "query_id", "q", "least", "leaves"])

    return queries.filter(F.size("v") == size).mapInArrow(work, f"part int, block int, query_id long, q {kind}, least double, leaves array<int>")


def best(ids: np.ndarray, x: np.ndarray, leaf: np.ndarray, query_ids: np.ndarray, q: np.ndarray, least: np.ndarray, leaves: list[np.ndarray], k: int) -> pd.DataFrame:
    """The k nearest rows of a block to each query among the leaves that it looks at, ties to the smaller id."""
    order = np.lexsort((ids, leaf))
    ids, x, leaf = ids[order], x[order], leaf[order]
    asker = np.repeat(np.arange(len(q)), [len(v) for v in leaves])
    asked = np.concatenate(leaves)
    by = np.argsort(asked, kind="stable")
    asker, asked = asker[by], asked[by]
    who, near, got = [], [], []
    for v in np.unique(leaf):
        a, b = np.searchsorted(leaf, [v, v + 1])
        c, d = np.searchsorted(asked, [v, v + 1])
        for at in range(c, d, 256):
            some = asker[at : min(at + 256, d)]
            score = np.einsum("qd,nd->qn", q[some], x[a:b])
            score[query_ids[some, None] == ids[None, a:b]] = -np.inf
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            value = np.take_along_axis(score, top, 1)
            ok = (value > -np.inf) & (value >= least[some, None])
            who.append(np.repeat(some, top.shape[1])[ok.ravel()])
            near.append(ids[a + top][ok])
            got.append(value[ok])
    if not who:
        return pd.DataFrame({"asker": [], "query_id": [], "vec_id": [], "score": []}).astype({"asker": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})
    who, near, got = np.concatenate(who), np.concatenate(near), np.concatenate(got)
    order = np.lexsort((near, -got, who))
    who, near, got = who[order], near[order], got[order]
    start = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)
    nth = np.arange(len(who)) - np.repeat(start, np.diff(np.append(start, len(who))))
    keep = nth < k
    return pd.DataFrame({"asker": who[keep], "query_id": query_ids[who[keep]], "vec_id": near[keep], "score": got[keep]})


RESULT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", column: str = "embedding", fit_rows: int = FIT_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found rows of `vectors` to each row of `queries`."""
    spark = vectors.sparkSession
    rows = sound(vectors, key, column)
    tree = build_tree(rows, k, fit_rows)
    if tree is None:
        return spark.createDataFrame([], RESULT)
    placed = stored(with_leaf(rows, tree), "ann-rows")
    size = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row a leaf: bounded by the tree
    if not size:
        return spark.createDataFrame([], RESULT)
    layout = Layout.of(size)
    where = spark.createDataFrame([(leaf, layout.part[leaf], layout.blocks[leaf]) for leaf in size], "leaf int, part int, blocks int")
    dealt = placed.join(F.broadcast(where), "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).select("part", "block", "leaf", "vec_id", "v")
    own = placed.groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    n_parts = partitions_for(sum(size.values()), 2 * PART_ROWS, 32)
    asked = with_visits(sound(queries, key, column).repartition(n_parts, "vec_id").dropDuplicates(["vec_id", "v"]), tree, layout, k, own)

    def meet(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            matrix = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1)
            leaves = [np.array(v) for v in right["leaves"].to_pylist()]
            q = matrix(right["q"])
            found = best(left["vec_id"].to_numpy(), matrix(left["v"]), left["leaf"].to_numpy(), right["query_id"].to_numpy(), q, right["least"].to_numpy(), leaves, k)
            mark = np.array([int.from_bytes(hashlib.blake2b(v.tobytes(), digest_size=8).digest(), "little", signed=True) for v in q], np.int64)
            found["vector"] = mark[found["asker"].to_numpy()]
            found = found[["query_id", "vector", "vec_id", "score"]]
            return pa.Table.from_pandas(found, pa.schema([("query_id", pa.int64()), ("vector", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]), preserve_index=False)
        return pa.table({"query_id": pa.array([], pa.int64()), "vector": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    found = dealt.repartition(n_parts, "part", "block").groupBy("part", "block").cogroup(asked.repartition(n_parts, "part", "block").groupBy("part", "block")).applyInArrow(meet, "query_id long, vector long, vec_id long, score double")
    w = W.partitionBy("query_id", "vector").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)
