"""On-demand range requests as a keyed stream: fetch what is not there yet."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DEFAULT_COUNT = 4 << 20
FETCHED = "nid long, off long, len long"


def missing(covered: list[tuple[int, int]], a: int, b: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(parts of [a, b) that are not covered, the cover with [a, b)): sorted disjoint intervals."""
    gaps, at, out = [], a, []
    low, high = a, b
    for s, e in covered:
        if e < a or s > b:
            out.append((s, e))
            continue
        if s > at:
            gaps.append((at, min(s, b)))
        at = max(at, e)
        low, high = min(low, s), max(high, e)
    if at < b:
        gaps.append((at, b))
    return gaps, sorted([*out, (low, high)])


def clip(off: int, count: int, size: int) -> tuple[int, int]:
    """The range a request means: no count is 4 MiB or the rest; nothing beyond the end."""
    return off, min(size, off + (count or DEFAULT_COUNT))


def serve(requests: DataFrame) -> DataFrame:
    """Streaming requests (nid, off, count, size) -> the ranges to fetch; each byte of a file is fetched once.

    The state of a file is its covered ranges, which merge as they touch.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        covered = [tuple(x) for x in zip(*state.get, strict=True)] if state.exists else []
        out = []
        for b in batches:
            for off, count, size in zip(b["off"], b["count"], b["size"], strict=True):
                a, e = clip(int(off), int(count), int(size))
                if a < e:
                    gaps, covered = missing(covered, a, e)
                    out += [(key[0], s, t - s) for s, t in gaps]
        state.update(([s for s, _ in covered], [e for _, e in covered]))
        yield pd.DataFrame(out, columns=["nid", "off", "len"])

    return requests.groupBy("nid").applyInPandasWithState(step, FETCHED, "starts array<long>, ends array<long>", "append", GroupStateTimeout.NoTimeout)


def split_device(off: int, count: int, index_size: int) -> list[tuple[str, int, int]]:
    """A read of a device whose first index_size bytes are local and whose rest is remote."""
    out = []
    if off < index_size:
        out.append(("index", off, min(count, index_size - off)))
    if off + count > index_size:
        start = max(off, index_size)
        out.append(("remote", start - index_size, off + count - start))
    return out


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str):
    """Archives that arrive in a folder become entry rows in a Parquet table, each archive once."""
    import uuid

    from canopy.sources.tar import read

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.tar*").load(folder).select("path")

    def each(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.select("path").collect()]  # names of the archives of one trigger
        if paths:
            session = batch.sparkSession
            out = read(session, paths[0]) if len(paths) == 1 else read(session, paths)
            out.write.mode("overwrite").parquet(f"{target}/batch={number}-{uuid.uuid5(uuid.NAMESPACE_URL, target)}")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
