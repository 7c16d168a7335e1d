import hashlib
import io
import tarfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canopy.functions import addresses, codecs, columns, hashes
from canopy.operators.dedupe import common_suffix, window_sums
from canopy.sources import gzip_index, tar
from canopy.streaming.ranges import clip, missing, split_device


def test_crc32c_known_answer():
    assert hashes.crc32c(b"123456789") ^ 0xFFFFFFFF == 0xE3069283


def test_small_hashes():
    assert hashes.fnv1(b"") == 0x811C9DC5 and hashes.fnv1(b"a") == 0x050C5D7E
    assert hashes.bkdr(b"a") == 97 and hashes.bkdr(b"\xff") == 2**32 - 1
    assert hashes.xxh32(b"") == 0x02CC5D05
    assert hashes.name_filter([]) == 0xFFFFFFFF and bin(hashes.name_filter([(1, b"a")])).count("1") == 31


@given(st.binary(max_size=300), st.integers(1, 40))
def test_window_sums(data, w):
    want = [sum(b * 256 ** (i % 4) for i, b in enumerate(data[k : k + w])) % (2**32 - 1) for k in range(max(0, len(data) - w + 1))]
    assert window_sums(data, w).tolist() == want


@given(st.binary(max_size=50), st.binary(max_size=50), st.binary(max_size=80))
def test_common_suffix(a, b, tail):
    x, y = a + tail, b + tail
    n = common_suffix(x, y)
    assert n >= len(tail) and x[len(x) - n :] == y[len(y) - n :]
    assert n == min(len(x), len(y)) or x[len(x) - n - 1] != y[len(y) - n - 1]


@pytest.mark.parametrize(
    "args, url, v2, v4",
    [
        (("s3.amazonaws.com", "my-bucket", "path/to/object.txt", True), "https://my-bucket.s3.amazonaws.com/path/to/object.txt", "/my-bucket/path/to/object.txt", "/path/to/object.txt"),
        (("s3.amazonaws.com", "my-bucket", "path/to/object.txt", False), "https://s3.amazonaws.com/my-bucket/path/to/object.txt", "/my-bucket/path/to/object.txt", "/my-bucket/path/to/object.txt"),
        (("http://localhost:9000", "local-bucket", "data/file.dat/", True), "http://local-bucket.localhost:9000/data/file.dat/", "/local-bucket/data/file.dat/", "/data/file.dat/"),
        (("s3.amazonaws.com", "my-bucket", None, True), "https://my-bucket.s3.amazonaws.com/", "/my-bucket/", "/"),
        (("s3.amazonaws.com", "my-bucket", None, False), "https://s3.amazonaws.com/my-bucket", "/my-bucket", "/my-bucket"),
        (("s3.amazonaws.com", "bucket/", None, False), "https://s3.amazonaws.com/bucket/", "/bucket/", "/bucket/"),
        (("s3.amazonaws.com", "bucket/", "a/b/c/object.txt", True), "https://bucket.s3.amazonaws.com/a/b/c/object.txt", "/bucket/a/b/c/object.txt", "/a/b/c/object.txt"),
        (("bucket.s3.amazonaws.com", "/", "object.txt", True), "https://bucket.s3.amazonaws.com/object.txt", "/bucket/object.txt", "/object.txt"),
        (("bucket.s3.amazonaws.com", None, "object.txt", True), "https://bucket.s3.amazonaws.com/object.txt", "/bucket/object.txt", "/object.txt"),
        (("s3.amazonaws.com", "bucket", "file&name$test@sign=value.txt", False), "https://s3.amazonaws.com/bucket/file%26name%24test%40sign%3Dvalue.txt", "/bucket/file%26name%24test%40sign%3Dvalue.txt", "/bucket/file%26name%24test%40sign%3Dvalue.txt"),
        (("s3.amazonaws.com", "bucket", "my folder/my file.txt", True), "https://bucket.s3.amazonaws.com/my%20folder/my%20file.txt", "/bucket/my%20folder/my%20file.txt", "/my%20folder/my%20file.txt"),
    ],
)
def test_object_urls(args, url, v2, v4):
    assert addresses.object_url(*args, signature=2) == (url, v2)
    assert addresses.object_url(*args, signature=4) == (url, v4)


def test_object_url_errors():
    for bad in ((None, "b", "k", False), ("s3.amazonaws.com", None, "k", False)):
        with pytest.raises(ValueError):
            addresses.object_url(*bad)
    assert addresses.canonical_query({"b": "1 2", "a": "~x"}) == "a=~x&b=1%202"


@pytest.mark.parametrize(
    "ref, want",
    [
        ("nginx", ("registry-1.docker.io", "library/nginx", "latest")),
        ("nginx:1.21", ("registry-1.docker.io", "library/nginx", "1.21")),
        ("user/myapp:v2.0", ("registry-1.docker.io", "user/myapp", "v2.0")),
        ("registry.example.com/myapp", ("registry.example.com", "myapp", "latest")),
        ("localhost:5000/myapp:latest", ("localhost:5000", "myapp", "latest")),
        ("127.0.0.1:5000/myapp:latest", ("127.0.0.1:5000", "myapp", "latest")),
        ("registry.example.com/org/project/app:dev", ("registry.example.com", "org/project/app", "dev")),
        ("myapp:sha256-abc123", ("registry-1.docker.io", "library/myapp", "sha256-abc123")),
        ("org/team/app:v1", ("registry-1.docker.io", "org/team/app", "v1")),
    ],
)
def test_image_references(ref, want):
    assert addresses.image_reference(ref) == want


def test_tar_numbers_and_times():
    assert tar.number(b"0000755 ") == 0o755 and tar.number(b"\x80\0\0\0\0\0\x01\0") == 256
    assert tar.pax_time("1.5") == (1, 500000000) and tar.pax_time("-1.25") == (-2, 750000000) and tar.pax_time("1.1234567899") == (1, 123456789)
    for bad in ("1.", "x", ""):
        with pytest.raises(tar.BadArchive):
            tar.pax_time(bad)
    with pytest.raises(tar.BadArchive):
        tar.number(b"        ")
    assert tar.url_decode("a%41+%zz") == "aA+%zz"


def test_octal_fields_of_any_number(spark, tmp_path):
    from canopy.plans.catalog import QUERIES

    keys = [1, 7, 9, 2097151, 2097152, 8999999, 1 << 33, (1 << 63) - 1, -1, -2097153, -(1 << 63), 0, None]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    found = {r["o_orderkey"]: r["v"] for r in QUERIES["s2e_octal_fields"](spark, str(tmp_path)).collect()}
    assert found == {k: None if k is None or k % 9 == 0 else k for k in keys}
    texts = ["0000755 ", " 17 x", "+5", "-0000005 ", "+-5", "8", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(columns.octal(F.col("t"))).collect()] == [0o755, 15, 5, -5, None, None, None, None]


def archive(fmt=tarfile.PAX_FORMAT, **files):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w", format=fmt) as t:
        for name, data in files.items():
            i = tarfile.TarInfo(name)
            i.size, i.mode, i.mtime, i.uid = len(data), 0o640, 7, 5
            t.addfile(i, io.BytesIO(data))
    return buf.getvalue()


def test_tar_entries():
    long = "d/" * 80 + "f"
    for fmt in (tarfile.PAX_FORMAT, tarfile.GNU_FORMAT):
        got = list(tar.entries(archive(fmt, a=b"hello", **{long: b"x" * 600})))
        assert [(e["path"], e["size"], e["data"], e["mode"]) for e in got] == [("a", 5, b"hello", 0x8000 | 0o640), (long, 600, b"x" * 600, 0x8000 | 0o640)]
    bad = bytearray(archive(a=b"1"))
    bad[0] ^= 1
    with pytest.raises(tar.BadArchive):
        list(tar.entries(bytes(bad)))
    assert list(tar.entries(b"")) == []


def test_tar_pax_xattrs_links():
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w", format=tarfile.PAX_FORMAT, pax_headers={"SCHILY.xattr.user.g": "1", "SCHILY.xattr.user.b": "g"}) as t:
        i = tarfile.TarInfo("f")
        i.pax_headers = {"SCHILY.xattr.user.b": "l", "mtime": "-1.25", "LIBARCHIVE.xattr.user%2Ec": "aGk"}
        t.addfile(i)
        j = tarfile.TarInfo("l")
        j.type, j.linkname = tarfile.SYMTYPE, "f"
        t.addfile(j)
    f, l = tar.entries(buf.getvalue())  # noqa: E741
    assert f["xattrs"] == {"user.g": b"1", "user.b": b"l", "user.c": b"hi"} and (f["mtime_s"], f["mtime_ns"]) == (-2, 750000000)
    assert l["linkpath"] == "f" and l["mode"] & 0xF000 == 0xA000 and l["xattrs"] == {"user.g": b"1", "user.b": b"g"}


def test_gzip_ranges():
    rng = np.random.default_rng(1)
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    parts = [rng.integers(97, 110, 50000, dtype=np.uint8).tobytes() for _ in range(6)]
    data = b"".join(c.compress(p) + c.flush(zlib.Z_FULL_FLUSH) for p in parts) + c.flush()
    plain = b"".join(parts)
    points = gzip_index.checkpoints(data, 60000)
    assert len(points) >= 3
    for off, n in ((0, 10), (123456, 70000), (299990, 100), (300000, 5)):
        assert gzip_index.read_range(data, off, n, points) == plain[off : off + n]
    assert len(gzip_index.export(points)) == 12 + len(points) * (17 + 32768)


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=6000), st.sampled_from(["deflate", "zstd"]))
def test_clusters_round_trip(data, name):
    out = b""
    for at, n, coded, raw in codecs.clusters(data, 512, name):
        assert at == len(out) and len(coded) <= 512
        out += coded if raw else codecs.decompress(name, coded, n)
    assert out == data


def test_codec_rules():
    assert codecs.parse("zstd,level=5:lzma,9,dictsize=65536")[1] == {"alg": "lzma", "level": 9, "dict_size": 65536}
    for bad in ("nope", "zstd,level=99", "lz4,dictsize=1", "deflate,foo=1"):
        with pytest.raises(codecs.UnknownCodec):
            codecs.parse(bad)
    assert codecs.worth(8192, 4096) and not codecs.worth(4096, 100)
    assert codecs.rotated(b"abcdef", 2) == b"efabcd"


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 20)), max_size=12))
def test_missing_ranges(asks):
    cover, seen = [], set()
    for off, n in asks:
        gaps, cover = missing(cover, off, off + n)
        new = {x for a, b in gaps for x in range(a, b)}
        assert new == set(range(off, off + n)) - seen
        seen |= new
        assert {x for a, b in cover for x in range(a, b)} == seen
        assert all(a[1] < b[0] for a, b in zip(cover, cover[1:], strict=False))


def test_requests_and_devices():
    assert clip(0, 0, 10 << 20) == (0, 4 << 20) and clip(5, 100, 50) == (5, 50)
    assert split_device(90, 20, 100) == [("index", 90, 10), ("remote", 0, 10)] and split_device(0, 5, 100) == [("index", 0, 5)]


def test_patterns():
    assert columns.java_pattern("[[:digit:]]+a\\.b") == r"[\p{Digit}]+a\.b"
    assert columns.java_pattern("[^]a\\]x") == r"[^\]a\\]x"


def test_column_functions(spark):
    df = spark.createDataFrame([("a.s",), ("a.",), ("noext",), ("x.txtx",), (".rc",)], "name string")
    from canopy.operators.stats import extension_class

    assert [r[0] for r in df.select(extension_class(F.col("name"))).collect()] == [".so", ".txt", "others", "others", ".rc"]
    sizes = spark.createDataFrame([(0, 0), (1023, 0), (1024, 1), (2047, 1), (2048, 2), ((32 << 20) - 1, 15), (32 << 20, 16), (1 << 40, 16)], "s long, b int")
    assert sizes.filter(columns.size_bucket(F.col("s")) != F.col("b")).count() == 0
    p = spark.createDataFrame([("/a//b", "a/b"), ("./a", "a"), ("a/../b", "b"), ("a/", "a"), ("", ""), ("../..", "")], "p string, w string")
    assert p.filter(columns.normal_path(F.col("p")) != F.col("w")).count() == 0
    t = spark.createDataFrame([("1.5",), ("-1.25",), ("1.1234567899",), ("1.",), ("",)], "t string").select(*columns.pax_time(F.col("t"))).collect()
    assert [tuple(r) for r in t] == [(1, 500000000), (-2, 750000000), (1, 123456789), (None, None), (None, None)]
    assert spark.range(1).select(hashes.crc32c_column(F.lit(b"123456789")).alias("c")).first()[0] == 0xE3069283 ^ 0xFFFFFFFF
    digest = spark.range(1).select(columns.uuid_text(F.unhex(F.lit("00112233445566778899aabbccddeeff")))).first()[0]
    assert digest == "00112233-4455-6677-8899-aabbccddeeff"


def test_sha256_known_answers(spark):
    for text in ("", "abc", "abcdbcdecdefdefgefghfghighijhijkijkljklmklmnlmnomnopnopq"):
        assert spark.range(1).select(F.sha2(F.lit(text), 256)).first()[0] == hashlib.sha256(text.encode()).hexdigest()
