"""N-gram Jaccard join under several global token orders, without all-pairs work inside groups of copies.

A text's set is its distinct 5-word shingles. Texts with equal sets are one node (`sig`, a 64-bit digest of the set). Two
nodes link when 100 * intersection >= 75 * union; the result is each document's connected component. Linked sets of n and m
tokens differ in (n + m) / 7 tokens at most. Every candidate pair shares prefix tokens under three orders, and these filters are
intersected before any set is fetched for verification. Steps:

1. First order (by token value). Of each set its first q = floor(n/4) + ceil(n/12) tokens are indexed. A set with a partner
   shares at least ceil(n/12) of these with some other set; sets that do not are done. Tokens settled inside a batch leave it
   once, so a token of a third of all texts costs one entry a batch. Each remaining set is a candidate with one pivot, the
   smaller set it met most often; links to pivots form a forest, jumping pointers gives first components.
2. Rarity order (a token's frequency counted in components). Tokens of one component only cannot link it to another, so they fill
   the prefix first; sets with more than floor(n/4) of them are done. Each token left in prefixes has a reference: of its sets
   the one that meets most others. Sets are candidates with the references of their tokens, one a foreign component: a group of n
   copies costs n candidates a reference, not n * n.
3. The order again, with the components so far. All sets that share a prefix token belong to the family of its reference p. Near
   members are compared by what they do not share with p: A and B link only if the differences A ^ p and B ^ p share
   (|A ^ p| + |B ^ p| - (n + m) / 7) / 2 tokens, and at least one unless both link to p. In a group of near copies nearly all
   tokens are common but differences are rare, so prefixes of differences, rarest first, name few pairs. Members far from p that
   may link to none of the near ones meet on the token itself.

Orders two and three of every step are rarity classes (step 1: none), then hashes of the token. Verification is exact on whole
sets. No link between different texts is lost: a linked pair in different components passes every filter. Digests: shingles have
64 bits (48 in the filters and in verification), sets 64, so results are exact but for collisions of those digests.

Cases: null and empty texts have the empty set and link with nothing; texts of under five words have one shingle; equal and
repeated rows are one node; a row whose id is null takes part, and its component is the smallest id that is not null (null if
there is none); an empty table gives an empty result; further columns are not read. Limits: none on partners or candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.llm.common import give_back, partitions_for, small_batches, stored, table, text_or_empty

WORDS = 5
#: Bytes of text that are shingled together, about.
AT_ONCE = 1 << 19
#: Index entries of one partition; tokens a batch holds before it sends them.
ENTRIES, HELD = 1_200_000, 500_000
#: Tokens of one bucket of sets; rows that go to Python at once.
BUCKET, BATCH_ROWS = 400_000, 256
#: Bits of the filter that says which sets are needed again: fixed, so it is broadcast whatever the table's size.
FILTER_BITS = 24

_rng = np.random.default_rng(20)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
PLACE = _rng.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, for i < n."""
    if len(_POWERS["up"]) < n:
        for k, b in (("up", BASE), ("down", BASE_INVERSE)):
            row = np.full(n, b, np.uint64)
            row[0] = 1
            _POWERS[k] = np.cumprod(row, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingles of each text."""
    data = LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)] if texts else np.zeros(0, np.uint8)
    up, down = powers(len(data) + 1)
    gap = SEPARATOR[data]
    word = ~gap
    starts = np.flatnonzero(word & np.append(True, gap[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(gap & np.append(False, word[:-1])) if len(data) else starts
    running = np.append(np.uint64(0), np.cumsum(BYTE[data] * up[: len(data)], dtype=np.uint64))
    words = mix((running[ends] - running[starts]) * down[starts])
    first = np.cumsum([0, *[len(t) + 1 for t in texts]])
    cut = np.searchsorted(starts, first)
    if len(words) >= WORDS:
        m = len(words) - WORDS + 1
        grams = words[:m] * PLACE[0]
        for k in range(1, WORDS):
            grams = grams + words[k : k + m] * PLACE[k]
        grams = mix(grams)
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= WORDS:
            g = np.sort(grams[a : b - WORDS + 1])
            out.append(g[np.append(True, g[1:] != g[:-1])])
        elif b > a:
            out.append(mix((words[a:b] * PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + PLACE[WORDS] * np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> int:
    """A set's 64-bit digest as a signed integer."""
    return int(mix(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(shingles))).view(np.int64)[0])


def tokens_of(shingles: np.ndarray) -> np.ndarray:
    """48-bit tokens, sorted and distinct."""
    return np.unique(shingles >> np.uint64(16))


def pack(tokens: np.ndarray) -> bytes:
    return tokens.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(">u8").astype(np.uint64)


def spare(n):
    """Tokens of a set of n that a partner may lack: floor(n / 4)."""
    return n // 4


def extra(n):
    """How many shared tokens the longer prefix of the first order must have."""
    return -(-n // 12)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """(ids, sets) of slices of (id, binary text) batches."""
    for b in batches:
        ids, column = b.column(0), b.column(1)
        size = pa.compute.binary_length(column).to_pylist()
        start = held = 0
        for i, n in enumerate([*size, AT_ONCE]):
            if held and held + n > AT_ONCE or i == len(size) and i > start:
                yield ids.slice(start, i - start), shingle_sets(column.slice(start, i - start).to_pylist())
                start, held = i, 0
            held += n


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))
    return start, np.diff(np.append(start, len(sorted_values)))


MET = "x long, n long, pivot long, met long, shared long"
MET_NAMES = ["x", "n", "pivot", "met", "shared"]


def met_rows(x: np.ndarray, n: np.ndarray, pivot: np.ndarray, shared: np.ndarray) -> pd.DataFrame:
    """Sums over equal (x, pivot)."""
    df = pd.DataFrame({"x": x, "n": n, "pivot": pivot, "met": 1, "shared": shared.astype(np.int64)})
    return df.groupby(["x", "n", "pivot"], as_index=False, sort=False).sum()[MET_NAMES]


def index_first_order(docs: DataFrame, n_parts: int) -> DataFrame:
    """Blocks of index entries, and the meetings settled inside batches (part -1).

    A block: tokens, sorted; for each the set's number in `sigs`/`sizes`; and whether the entry was counted as shared already.
    """
    schema = "part int, tokens binary, number binary, counted binary, sigs binary, sizes binary"
    names = ["part", "tokens", "number", "counted", "sigs", "sizes"]

    def flush(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        sigs, sizes = np.array(list(held), np.int64), np.array([int(s[0]) for s in held.values()], np.int64)
        prefix = [s[1:] for s in held.values()]
        token = np.concatenate(prefix)
        owner = np.repeat(np.arange(len(prefix)), [len(p) for p in prefix])
        order = np.lexsort((sigs[owner], token))
        token, owner = token[order], owner[order]
        start, length = runs(token)
        least = np.repeat(owner[start], length)  # the smallest sig that has the token
        several = np.repeat(length > 1, length)
        met = met_rows(sigs[owner[several]], sizes[owner[several]], sigs[least[several]], np.ones(int(several.sum())))
        token, owner, counted = token[start], owner[start], length > 1
        part = (token % np.uint64(n_parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        token, owner, counted, part = token[order], owner[order], counted[order], part[order]
        start, length = runs(part)
        rows = []
        for a, m in zip(start.tolist(), length.tolist(), strict=True):
            some, number = np.unique(owner[a : a + m], return_inverse=True)
            rows.append((int(part[a]), pack(token[a : a + m]), number.astype(np.uint32).tobytes() if len(some) > 65535 else number.astype(np.uint16).tobytes(), np.packbits(counted[a : a + m]).tobytes(), sigs[some].tobytes(), sizes[some].astype(np.int32).tobytes()))
        if len(met):
            rows.append((-1, met["x"].to_numpy().tobytes(), met["n"].to_numpy().tobytes(), met["met"].to_numpy().tobytes(), met["pivot"].to_numpy().tobytes(), met["shared"].to_numpy().tobytes()))
        types = [pa.int32(), *[pa.binary()] * 5]
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64], strict=True), types, strict=True)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        n_held = 0
        for _, sets in _texts(batches):
            for s in sets:
                if len(s) and (sig := signature(s)) not in held:
                    t = tokens_of(s)
                    n = len(t)
                    held[sig] = np.append(np.uint64(n), t[: spare(n) + extra(n)])
                    n_held += len(held[sig])
            if n_held > HELD:
                yield from flush(held)
                held, n_held = {}, 0
                give_back()
        if held:
            yield from flush(held)
        del held
        give_back()

    return docs.mapInArrow(work, schema)


def meet_first_order(blocks: DataFrame, n_parts: int) -> DataFrame:
    """MET rows: x shares `met` prefix tokens with the smaller set pivot; shared counts each shared token of x once."""

    def settle(df: pd.DataFrame) -> pd.DataFrame:
        token, sig, size, counted = [], [], [], []
        for t, number, c, s, z in zip(df["tokens"], df["number"], df["counted"], df["sigs"], df["sizes"], strict=True):
            t, s, z = unpack(t), np.frombuffer(s, np.int64), np.frombuffer(z, np.int32)
            number = np.frombuffer(number, np.uint32 if len(s) > 65535 else np.uint16)
            token.append(t)
            sig.append(s[number])
            size.append(z[number])
            counted.append(np.unpackbits(np.frombuffer(c, np.uint8), count=len(t)).astype(bool))
        token, sig, size, counted = (np.concatenate(v) for v in (token, sig, size, counted))
        order = np.lexsort((sig, token))
        token, sig, size, counted = token[order], sig[order], size[order], counted[order]
        start, length = runs(token)
        different = sig[start] != sig[start + length - 1]
        pick = np.repeat(different, length)
        give_back()
        return met_rows(sig[pick], size[pick].astype(np.int64), np.repeat(sig[start], length)[pick], ~counted[pick])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*[b.column(i) for i in (1, 2, 4, 3, 5)], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(v.as_py(), np.int64)) for v in row], names=MET_NAMES)

    across = blocks.filter("part >= 0").repartition(n_parts, "part").groupBy("part").applyInPandas(lambda df: settle(df), MET)
    return across.unionByName(blocks.filter("part < 0").mapInArrow(local, MET))


def choose(met: DataFrame) -> DataFrame:
    """x, n, pivot: the sets that pass the first order, each with the smaller set it met most often (null: none)."""
    pairs = met.groupBy("x", "pivot").agg(F.max("n").alias("n"), F.sum("met").alias("met"), F.sum("shared").alias("shared"))
    best = F.max_by("pivot", F.when(F.col("pivot") != F.col("x"), F.struct("met", -F.col("pivot").cast("decimal(20,0)"))))
    each = pairs.groupBy("x").agg(F.max("n").alias("n"), F.sum("shared").alias("shared"), best.alias("pivot"))
    return each.filter(F.col("shared") >= F.ceil(F.col("n") / 12)).select("x", "n", F.when(F.col("pivot") != F.col("x"), F.col("pivot")).alias("pivot"))


def needed_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size over hashes of ids: no false negatives."""
    low = F.col(column).bitwiseAND((1 << FILTER_BITS) - 1)
    words = ids.select(F.shiftright(low, 5).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 31 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    bits = np.zeros(1 << (FILTER_BITS - 5), np.int64)
    for w, b in words:  # 2 ** 19 rows at most
        bits[w] = b
    return np.unpackbits(bits.astype("<u4").view(np.uint8), bitorder="little").astype(bool)


SEEDS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def further_prefixes(tokens: np.ndarray, k: int, count: np.ndarray | None = None) -> list[np.ndarray]:
    """The first k tokens under each further order: by rarity class (log2 of count), then by hash; signed, for Spark."""
    rank = np.zeros(len(tokens)) if count is None else np.floor(np.log2(count))
    return [tokens[np.lexsort((mix(tokens ^ seed), rank))[:k]].astype(np.int64) for seed in SEEDS]


def sets_of(docs: DataFrame, needed: np.ndarray, n_parts: int) -> DataFrame:
    """sig, n, tokens, second, third of the sets that the filter lets through, one row a set."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(needed))
    mask = (1 << FILTER_BITS) - 1
    types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        seen: set[int] = set()
        for _, sets in _texts(batches):
            out = []
            for s in sets:
                if len(s) and bits[(sig := signature(s)) & mask] and sig not in seen:
                    seen.add(sig)
                    t = tokens_of(s)
                    out.append((sig, len(t), pack(t), *further_prefixes(t, spare(len(t)) + 1)))
            if len(seen) > 200_000:
                seen.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["sig", "n", "tokens", "second", "third"])

    schema = "sig long, n long, tokens binary, second array<long>, third array<long>"
    return docs.mapInArrow(work, schema).repartition(n_parts, "sig").dropDuplicates(["sig"])


def common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on whole sets (sorted, distinct)."""
    n, m = len(a), len(b)
    if 4 * min(n, m) < 3 * max(n, m):
        return False
    same = common(a, b)
    return 100 * same >= 75 * (n + m - same)


def intersected(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The pairs (family, a, b), found under one order, that also share a prefix token under both further orders.

    prefixes: family, sig, second, third.
    """
    side = lambda c: prefixes.select("family", F.col("sig").alias(c), F.col("second").alias(f"{c}2"), F.col("third").alias(f"{c}3"))
    both = pairs.join(side("a"), ["family", "a"]).join(side("b"), ["family", "b"])
    return both.filter(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3")).select("a", "b").distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. Rows stream through; a set that many pairs name is split by the join, not gathered."""
    left = pairs.join(sets.select(F.col("sig").alias("a"), F.col("tokens").alias("ta")), "a")
    both = left.join(sets.select(F.col("sig").alias("b"), F.col("tokens").alias("tb")), "b").select("a", "b", "ta", "tb")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(unpack(x.as_py()), unpack(y.as_py())) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(work, "a long, b long")


def roots(links: DataFrame) -> DataFrame:
    """node, root of a forest of links node -> parent, one row a node that has a parent: pointers jump until none moves."""
    now = stored(links, "forest")
    while True:
        up = now.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        after = stored(now.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "forest")
        if not after.filter("moved").limit(1).count():
            return after.select("node", F.col("parent").alias("root"))
        now = after.drop("moved")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each component of a graph (a, b), by alternating large and small stars."""
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        small = stored(small, "stars")
        if not small.exceptAll(now).limit(1).count() and not now.exceptAll(small).limit(1).count():
            return small.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now = small


def buckets_for(sets: DataFrame) -> tuple[DataFrame, int]:
    """The sets dealt to buckets of about BUCKET tokens by their id, and how many buckets there are."""
    total = sets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n = partitions_for(total, BUCKET, 12)
    return sets.withColumn("bucket", F.pmod(F.xxhash64("family", "sig"), F.lit(n)).cast("int")), n


def whole_sets(sets: DataFrame, root: DataFrame) -> DataFrame:
    """Sets with their component so far, as members of no family: a partner must share ceil(3n/4) tokens."""
    of = root.select(F.col("node").alias("sig"), F.col("root").alias("g"))
    return sets.join(of, "sig", "left").select(F.lit(0).cast("long").alias("family"), "sig", F.coalesce("g", "sig").alias("g"), "n", F.col("n").alias("size"), F.expr("n - n div 4").alias("need"), "tokens")


def across_components(sets: DataFrame, n_parts: int, n_buckets: int) -> DataFrame:
    """bucket, tokens, often: of each bucket the tokens that occur in two components or more, and in how many (at least)."""

    def index(df: pd.DataFrame) -> pd.DataFrame:
        token = np.concatenate([unpack(t) for t in df["tokens"]])
        g = np.repeat(df["g"].to_numpy(), df["size"].to_numpy())
        order = np.lexsort((g, token))
        token, g = token[order], g[order]
        new = np.append(True, (token[1:] != token[:-1]) | (g[1:] != g[:-1]))
        token, g = token[new], g[new]
        # of a token with several components here, two entries say so; its count goes with the first
        start, length = runs(token)
        keep = np.zeros(len(token), bool)
        keep[start] = keep[start[length > 1] + 1] = True
        often = np.repeat(length, length)[keep].astype(np.int32)
        token, g = token[keep], g[keep]
        part = (token % np.uint64(n_parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        token, g, often, part = token[order], g[order], often[order], part[order]
        give_back()
        rows = [(int(df["bucket"].iloc[0]), int(part[a]), pack(token[a : a + m]), g[a : a + m].tobytes(), often[a : a + m].tobytes()) for a, m in zip(*[v.tolist() for v in runs(part)], strict=True)]
        return pd.DataFrame(rows, columns=["bucket", "part", "tokens", "g", "often"])

    def settle(df: pd.DataFrame) -> pd.DataFrame:
        token = [unpack(t) for t in df["tokens"]]
        bucket = np.repeat(df["bucket"].to_numpy(), [len(t) for t in token])
        token, g, often = np.concatenate(token), np.concatenate([np.frombuffer(x, np.int64) for x in df["g"]]), np.concatenate([np.frombuffer(x, np.int32) for x in df["often"]])
        order = np.lexsort((g, token))
        token, g, often, bucket = token[order], g[order], often[order], bucket[order]
        start, length = runs(token)
        several = g[start] != g[start + length - 1]
        pick = np.repeat(several, length)
        total = np.repeat(np.add.reduceat(often, start), length)[pick] if len(start) else often
        token, bucket = token[pick], bucket[pick]
        order = np.lexsort((token, bucket))
        token, bucket, total = token[order], bucket[order], total[order]
        new = np.append(True, (token[1:] != token[:-1]) | (bucket[1:] != bucket[:-1])) if len(token) else np.zeros(0, bool)
        token, bucket, total = token[new], bucket[new], total[new]
        give_back()
        rows = [(int(bucket[a]), pack(token[a : a + m]), total[a : a + m].astype(np.int64).tobytes()) for a, m in zip(*[v.tolist() for v in runs(bucket)], strict=True)]
        return pd.DataFrame(rows, columns=["bucket", "tokens", "often"])

    blocks = sets.repartition(n_buckets, "bucket").groupBy("bucket").applyInPandas(lambda df: index(df), "bucket int, part int, tokens binary, g binary, often binary")
    return blocks.repartition(n_parts, "part").groupBy("part").applyInPandas(lambda df: settle(df), "bucket int, tokens binary, often binary")


PREFIXES = "family long, sig long, g long, n long, size long, shared long, first array<long>, second array<long>, third array<long>"


def rare_prefixes(sets: DataFrame, often: DataFrame, n_buckets: int) -> DataFrame:
    """The prefixes under three orders of the sets that may link to another component, one row a set.

    shared: how many of its tokens occur in other components. A partner must share `need` tokens, all of them among these.
    """
    names = [f.split()[0] for f in PREFIXES.split(", ")]

    def work(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            token, count = np.concatenate([unpack(t) for t in right["tokens"]]), np.concatenate([np.frombuffer(x, np.int64) for x in right["often"]])
            order = np.argsort(token)
            token, count = token[order], count[order]
            for family, sig, g, n, size, need, own in zip(*[left[c] for c in ("family", "sig", "g", "n", "size", "need", "tokens")], strict=True):
                own = unpack(own)
                at = np.minimum(np.searchsorted(token, own), len(token) - 1)
                there = token[at] == own
                shared = int(there.sum())
                take = shared - need + 1
                if take > 0:
                    own, c = own[there], count[at[there]]
                    out.append((family, sig, g, n, size, shared, own[np.lexsort((own, c))[:take]].astype(np.int64), *further_prefixes(own, take, c)))
        give_back()
        return pd.DataFrame(out, columns=names)

    return sets.repartition(n_buckets, "bucket").groupBy("bucket").cogroup(often.repartition(n_buckets, "bucket").groupBy("bucket")).applyInPandas(work, PREFIXES)


def open_prefixes(sets: DataFrame, name: str) -> DataFrame:
    """PREFIXES rows of sets (family, sig, g, n, size, need, tokens), stored."""
    dealt, n = buckets_for(sets)
    dealt = stored(dealt, f"{name}-dealt")
    tokens = dealt.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return stored(rare_prefixes(dealt, across_components(dealt, partitions_for(tokens, ENTRIES, 12), n), n), name)


#: What linked whole sets satisfy: sizes within 3/4, and enough tokens that occur in other components.
BOUNDS = "4 * least(n, nb) >= 3 * greatest(n, nb) and 7 * least(shared, sb) >= 3 * (n + nb)"


def members(prefixes: DataFrame) -> DataFrame:
    """token, sig, g, n, shared, family: each prefix token of each set, with the token's reference.

    A token's reference is that of its sets that meets most others, for its size; a large group mostly has one.
    """
    rows = prefixes.select(F.explode("first").alias("token"), "sig", "g", "n", "shared")
    several = rows.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1")
    weight = rows.join(several, "token").groupBy("sig").agg((F.sum("k") / F.first("n")).alias("w"))
    reference = rows.join(several.select("token"), "token").join(weight, "sig").groupBy("token").agg(F.max_by("sig", F.struct("w", "sig")).alias("family"))
    return rows.join(reference, "token")


def tries_of(member: DataFrame) -> DataFrame:
    """Pairs (a, b): a set and the reference of one of its tokens; of each foreign component the one it met most often."""
    of = member.filter("sig = family").select("family", F.col("g").alias("gb"), F.col("n").alias("nb"), F.col("shared").alias("sb")).distinct()
    met = member.groupBy("family", "sig").agg(F.first("g").alias("g"), F.first("n").alias("n"), F.first("shared").alias("shared"), F.count("*").alias("met"))
    other = met.join(of, "family").filter("g <> gb").filter(BOUNDS)
    return other.groupBy(F.col("sig").alias("a"), "gb").agg(F.max_by("family", F.struct("met", "family")).alias("b")).select(F.lit(0).cast("long").alias("family"), "a", "b")


DIFFERENCES = "family long, sig long, g long, n long, shared long, size long, need long, near boolean, beside boolean, link boolean, tokens binary"


def differences(member: DataFrame, sets: DataFrame) -> DataFrame:
    """Each member of a family of several components, with what it does not share with the reference.

    near: at a Jaccard similarity of 5/9 at least. beside: not near, but may link to a near set. link: links to the reference.
    Tokens are hashed with the family. need: how many of them a partner in another component shares at least.
    """
    each = member.groupBy("family", "sig").agg(F.first("g").alias("g"), F.first("n").alias("n"), F.first("shared").alias("shared"))
    mixed = each.groupBy("family").agg(F.min("g").alias("low"), F.max("g").alias("high")).filter("low <> high").select("family")
    rows = each.filter("sig <> family").join(mixed, "family").join(sets.select("sig", "tokens"), "sig")
    both = rows.join(sets.select(F.col("sig").alias("family"), F.col("tokens").alias("reference")), "family").select("family", "sig", "g", "n", "shared", "tokens", "reference")
    names = [f.split()[0] for f in DIFFERENCES.split(", ")]
    types = [*[pa.int64()] * 7, *[pa.bool_()] * 3, pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for family, sig, g, n, shared, tokens, reference in zip(*[c.to_pylist() for c in batch.columns[:5]], batch.column(5), batch.column(6), strict=True):
                p = unpack(reference.as_py())
                x = np.setxor1d(unpack(tokens.as_py()), p, assume_unique=True)
                size, m = len(x), len(p)
                near = 7 * size <= 2 * (n + m)
                beside = not near and 7 * size <= 5 * n + 2 * m
                hashed = np.sort(mix(x ^ np.uint64(family & (2**64 - 1))) >> np.uint64(16)) if near or beside else x[:0]
                out.append((family, sig, g, n, shared, size, max(1, -((n + m - 7 * size) // 14)), near, beside, 7 * size <= n + m, pack(hashed)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return both.mapInArrow(work, DIFFERENCES)


def pairs_of(rows: DataFrame) -> DataFrame:
    """Distinct pairs (family, a, b) of different components that share a prefix token and that the bounds allow.

    rows: family, token, sig, g, n, shared (of the whole set), size, own (shared tokens of the difference), near. Whole sets are
    differences to nothing: their family is 0, and all are near.
    """
    right = rows.select("family", "token", *[F.col(c).alias(f"{c}_b") for c in ("sig", "g", "n", "shared", "size", "own", "near")])
    bounds = "sig < sig_b and g <> g_b and (near or near_b) and 4 * least(n, n_b) >= 3 * greatest(n, n_b) and 7 * least(shared, shared_b) >= 3 * (n + n_b) and 14 * least(own, own_b) >= 7 * (size + size_b) - n - n_b"
    return rows.join(right, ["family", "token"]).filter(bounds).select("family", F.col("sig").alias("a"), F.col("sig_b").alias("b")).distinct()


def nodes_of(docs: DataFrame) -> DataFrame:
    """id, n_shingles, sig of every row (sig null for the empty set)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _texts(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "n_shingles", "sig"])

    return docs.mapInArrow(work, "doc_id long, n_shingles long, sig long")


def link_roots(docs: DataFrame, total: int) -> DataFrame:
    """node, root over sigs: each set that links to another, and its component."""
    n_parts = partitions_for(total // 3, ENTRIES, 12)
    blocks = index_first_order(docs, n_parts)
    chosen = stored(choose(meet_first_order(blocks, n_parts)), "pivots")
    tokens = chosen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    needed = needed_filter(chosen.select("x").union(chosen.filter("pivot is not null").select("pivot")), "x")
    sets = stored(sets_of(docs, needed, partitions_for(tokens, BUCKET, 12)), "sets")
    tries = chosen.filter("pivot is not null").select(F.lit(0).cast("long").alias("family"), F.col("x").alias("a"), F.col("pivot").alias("b"))
    passed = intersected(tries, sets.select(F.lit(0).cast("long").alias("family"), "sig", "second", "third"))
    first = stored(verified(passed, sets), "links")
    root = stored(roots(first.select(F.col("a").alias("node"), F.col("b").alias("parent"))), "roots")
    prefixes = open_prefixes(whole_sets(sets, root), "open")
    # a set that passes no filter here cannot pass later: components only grow, so tokens only get rarer
    left = stored(sets.join(prefixes.select("sig"), "sig", "left_semi"), "sets")
    more = stored(verified(intersected(tries_of(members(prefixes)), prefixes), left), "links")
    root = stored(joined_roots(root, more), "roots")
    prefixes = open_prefixes(whole_sets(left, root), "open")
    return joined_roots(root, stored(links_in_families(prefixes, left), "links"))


def links_in_families(prefixes: DataFrame, sets: DataFrame) -> DataFrame:
    """All links (a, b) between components so far, but for those that links to references imply."""
    member = stored(members(prefixes), "members")
    away = stored(differences(member, sets), "differences")
    apart = stored(open_prefixes(away.filter("near or beside").select("family", "sig", "g", "n", "size", "need", "tokens"), "apart").join(away.select("family", "sig", F.col("shared").alias("whole"), "near"), ["family", "sig"]), "apart")
    close = apart.select("family", F.explode("first").alias("token"), "sig", "g", "n", F.col("whole").alias("shared"), "size", F.col("shared").alias("own"), "near")
    far = member.join(away.filter("not near").select("family", "sig"), ["family", "sig"]).select(F.lit(0).cast("long").alias("family"), "token", "sig", "g", "n", "shared", F.col("n").alias("size"), F.col("shared").alias("own"), F.lit(True).alias("near"))
    pairs = pairs_of(close.unionByName(far))
    orders = apart.select("family", "sig", "second", "third").unionByName(prefixes.select("family", "sig", "second", "third"))
    direct = away.filter("link").select(F.col("sig").alias("a"), F.col("family").alias("b"))
    return verified(intersected(pairs, orders), sets).unionByName(direct)


def joined_roots(root: DataFrame, links: DataFrame) -> DataFrame:
    """node, root after further links (a, b)."""
    of = root.select(F.col("node").alias("sig"), "root")
    end = lambda c: F.coalesce(F.col(f"r{c}"), F.col(c))
    joined = links.join(of.select(F.col("sig").alias("a"), F.col("root").alias("ra")), "a", "left").join(of.select(F.col("sig").alias("b"), F.col("root").alias("rb")), "b", "left")
    higher = components(joined.select(end("a").alias("a"), end("b").alias("b")))
    top = higher.select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = root.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(higher.join(root.select("node"), "node", "left_anti"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return classes_and_roots(docs, key, text)[0]


def with_root(docs: DataFrame, root: DataFrame, text: str = "text", name: str = "root") -> DataFrame:
    """docs and `name`, the component of each row's set by the roots of classes_and_roots; null for the empty set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.RecordBatch.from_arrays([pa.array(range(b.num_rows), pa.int64()), b.columns[-1]], names=["at", "text"])
            sig = [signature(s) if len(s) else None for _, sets in _texts(iter([texts])) for s in sets]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sig, pa.int64())], names=[*b.schema.names[:-1], name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    whole = [F.col(f"`{c}`") for c in docs.columns]
    with small_batches(docs.sparkSession, BATCH_ROWS):
        # the last column replaces no column of docs: it goes to Python by position
        rows = stored(docs.select(*whole, F.encode(text_or_empty(text), "UTF-8").alias(name)).mapInArrow(work, schema), "signed")
    of = root.select(F.col("node").alias(name), F.col("root").alias(f"{name}_of"))
    both = rows.join(of, name, "left")
    return both.select(*[rows[f"`{c}`"] for c in docs.columns], F.coalesce(of[f"{name}_of"], rows[name]).alias(name))


def classes_and_roots(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, n_shingles, component_id of every row; node, root of the sets that link to others; root, component_id."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.encode(text_or_empty(text), "UTF-8").alias("text"))
    with small_batches(docs.sparkSession, BATCH_ROWS):
        nodes = stored(nodes_of(rows), "nodes")
        total = nodes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
        root = stored(link_roots(rows, total), "roots")
    by_sig = nodes.filter("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    top = by_sig.join(root.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    # only sets with copies or links differ from their own id: the rest need no second look
    least = top.groupBy("root").agg(F.min("least").alias("component_id"))
    where = stored(top.filter(F.col("root").isNotNull()).join(least, "root").filter((F.col("copies") > 1) | (F.col("component_id") != F.col("least"))).select("sig", "component_id"), "classes")
    return nodes.join(where, "sig", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), root, least


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
