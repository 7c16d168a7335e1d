"""Chunk rows with running digests, and clip rows of stored AVIs."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from canopy.llm import avi, warc


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.fixture(scope="module")
def pages():
    return [(0, "u", ""), (1, "u", None), (2, None, "a" * 2500), (3, "u", "a" * 2500), (4, "u", "é" * 512), (5, "u", "b" * 1024), (6, "u", "b" * 1025)]


@pytest.fixture(scope="module")
def archive(spark, pages):
    return warc.archive(spark.createDataFrame(pages, "page_id long, url string, html string"), chunk=1024)


def test_running_digests(archive, pages):
    got = {(int(r["record_id"]), r["chunk_no"]): (r["n_chunks"], r["running_digest"]) for r in warc.chunk_table(archive).collect()}
    want = {}
    for page, _, html in pages:
        body = b"" if page in (1, 3) else (html or "").encode()  # revisits hold no payload
        n = max(1, -(-len(body) // 1024))
        want.update({(page, k): (n, sha1(body[: (k + 1) * 1024])) for k in range(n)})
    assert got == want


def test_bytes_of_chunks(archive):
    sizes = {(r["record_id"], r["chunk_no"]): r["bytes"] for r in warc.chunk_table(archive).collect()}
    assert sizes == {(r["record_id"], r["chunk_no"]): len(r["data"]) for r in archive.collect()}


@pytest.mark.parametrize("damage", ["byte", "missing", "repeated"])
def test_damage_raises(archive, damage):
    at = "record_id = '2' and chunk_no = 1"
    bad = {
        "byte": lambda: archive.withColumn("data", F.when(F.expr(at), F.concat(F.lit(b"x"), F.expr("substring(data, 2)"))).otherwise(F.col("data"))),
        "missing": lambda: archive.filter(f"not ({at})"),
        "repeated": lambda: archive.unionByName(archive.filter(at)),
    }[damage]()
    with pytest.raises(Exception, match="chunk [12]"):
        warc.read_records(bad).collect()


def test_clip_rows(spark):
    rng = random.Random(3)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789~{}|") for _ in range(64 * 16 * 9))
    texts = ["", None, "short", "a" * 64 * 16 * 8 + noise, "a" * 64 * 16 * 8 + noise]
    df = spark.createDataFrame([(i if i != 4 else None, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, clips double")
    media = avi.to_media(df)
    got = sorted(((r["doc_id"], r["clip"], r["first_frame"], r["n_frames"], r["start_s"], r["end_s"]) for r in avi.clip_rows(media).collect()), key=repr)
    want = []
    for i, t in enumerate(texts):
        samples, lines, seconds = avi.decode_many(avi.encode_many([avi.as_payload(t or "")]))
        want += [(i if i != 4 else None, k, *c) for k, c in enumerate(avi.clips(avi.histograms(samples[0], lines[0]), seconds[0]))]
    assert got == sorted(want, key=repr) and any(k == 1 for _, k, *_ in got)
    back = {r["doc_id"]: r for r in avi.read_back(media).collect()}
    for key in back:
        own = [c for c in want if c[0] == key]
        assert back[key]["n_clips"] == len(own)
        assert back[key]["feature"].split(";")[1] == ",".join(f"{s:.2f}-{e:.2f}" for *_, s, e in own)
    assert avi.clip_rows(avi.to_media(df.limit(0))).count() == 0
