"""Layers, trees, images, archives and streams on hand-made inputs."""

import io
import os
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from canopy.operators import dedupe, filters, layers, paths, stats, xattrs
from canopy.sources import image, image_writer, remote, tar

REG, DIR, CHR = 0x81A4, 0x41ED, 0x2000


def merged(spark, rows):
    df = spark.createDataFrame([(no, p, m, 0, o) for no, p, m, o in rows], "layer_no int, path string, mode int, rdev long, opaque boolean")
    return {r["path"]: r["layer_no"] for r in layers.merge(df).collect()}


def test_whiteout_hides_lower_file_and_tree(spark):
    got = merged(spark, [(0, "d", DIR, False), (0, "d/f", REG, False), (0, "g", REG, False), (1, "g", CHR, False), (1, "d", CHR, False), (2, "d", DIR, False), (2, "d/n", REG, False)])
    assert got == {"d": 2, "d/n": 2, "g": 1}


def test_opaque_in_the_middle(spark):
    got = merged(spark, [(0, "d", DIR, False), (0, "d/a", REG, False), (1, "d", DIR, True), (1, "d/b", REG, False), (2, "d", DIR, False), (2, "d/c", REG, False)])
    assert got == {"d": 2, "d/b": 1, "d/c": 2}


def test_lower_file_under_upper_directory_does_not_block(spark):
    got = merged(spark, [(0, "d", DIR, False), (0, "d/a", REG, False), (1, "d", REG, False), (2, "d", DIR, False)])
    assert got == {"d": 2, "d/a": 0}


def test_archive_override(spark):
    rows = [(0, "d", DIR), (1, "d/f", REG), (2, "d", DIR), (3, "e", DIR), (4, "e/f", REG), (5, "e", REG), (6, "e", DIR), (7, "e/g", REG)]
    df = spark.createDataFrame(rows, "seq long, path string, mode int")
    assert {(r["path"], r["seq"]) for r in layers.override(df).collect()} == {("d", 2), ("d/f", 1), ("e", 6), ("e/g", 7)}


def test_link_targets(spark):
    rows = [(0, "a", None, REG), (1, "l", "a", REG), (2, "m", "none", REG), (3, "s", "s", REG), (4, "d", None, DIR), (5, "x", "d", REG)]
    df = spark.createDataFrame(rows, "seq long, path string, linkpath string, mode int")
    assert {(r[0], r[1]) for r in layers.link_targets(df).collect()} == {(1, 0), (2, None), (3, None), (5, None)}


def test_shared_tolerance(spark):
    rows = [(n, "user.a", "v") for n in range(2)] + [(n, "user.b", "w") for n in range(3)]
    df = spark.createDataFrame(rows, "nid long, name string, value string")
    assert [(r["name"], r["n"]) for r in xattrs.shared(df).collect()] == [("user.b", 3)]
    assert xattrs.shared(df, -1).count() == 0
    many = spark.createDataFrame([(n, f"user.{k:03}", "v") for n in range(3) for k in range(256)], "nid long, name string, value string")
    assert {r["n_shared"] for r in xattrs.inline_sizes(many).collect()} == {255}


def test_chunks_and_holes(spark):
    files = [("z", bytes(1024)), ("t", bytes(512) + bytes(100)), ("e", b""), ("x", b"a" * 1024)]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    u = {(r["clen"], r["hole"]): r["n_refs"] for r in dedupe.unique_chunks(dedupe.chunks(df, 512), 512).collect()}
    assert u == {(512, True): 3, (100, False): 1, (512, False): 2}


def test_tails(spark):
    tail = os.urandom(300 << 10)
    df = spark.createDataFrame([("a", bytearray(b"1" + tail)), ("b", bytearray(b"22" + tail)), ("c", bytearray(64)), ("d", bytearray(65)), ("e", bytearray(65))], "path string, content binary")
    assert {(r["path"], r["match_path"], r["match_len"]) for r in dedupe.suffix_matches(df).collect()} == {("b", "a", len(tail)), ("e", "d", 65)}
    assert [r["path"] for r in dedupe.suffix_matches(df, whole_only=True).collect()] == ["e"]


def test_rolling_matches(spark):
    rng = random.Random(3)
    a = rng.randbytes(40960)
    df = spark.createDataFrame([("a", bytearray(a)), ("b", bytearray(b"xyz" + a[4096:20480] + b"end"))], "path string, content binary")
    assert [tuple(r) for r in dedupe.rolling_dedupe(df, 4096).collect()] == [("b", 3, "a", 4096, 16384)]


def test_packed_tails_do_not_overlap(spark):
    df = spark.createDataFrame([(f"p{i}", i % 7) for i in range(500)], "path string, tlen long")
    rows = sorted((r["off"], r["tlen"]) for r in dedupe.pack_tails(df).collect() if r["tlen"])
    assert rows[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:], strict=False))


def test_directory_sizes(spark):
    names = [f"{i:0200}" for i in range(40)]
    df = spark.createDataFrame([("d", n) for n in names], "dir string, name string")
    want, at = 0, 0
    for n in names:
        size = 12 + len(n)
        if at // 4096 != (at + size - 1) // 4096:
            at = (at // 4096 + 1) * 4096
        at += size
        want = at
    assert stats.directory_sizes(df).first()["dir_size"] == want


def test_rules(spark):
    text = "# comment\n16384 1 \\.so$\n0 ^boot/ # none\n\nbad line\n4096 [0-9]+\n"
    df = spark.createDataFrame(list(enumerate(text.split("\n"))), "rule_no int, line string")
    assert [tuple(r) for r in filters.parse_rules(df).orderBy("rule_no").collect()] == [(1, 16384, 1, "\\.so$"), (2, 0, None, "^boot/"), (5, 4096, None, "[0-9]+")]


def test_excluded_directories_hide_what_is_below(spark):
    df = spark.createDataFrame([("a",), ("a/b",), ("a/b/c",), ("x/y1",), ("x/z",)], "path string")
    assert {r[0] for r in filters.exclude(df, ["/a/b"], ["y[[:digit:]]"]).collect()} == {"a", "x/z"}


ENTRIES = [
    {"path": "dir/hello", "mode": REG, "uid": 70000, "gid": 2, "mtime_s": 11, "data": b"hello" * 2000},
    {"path": "dir/empty", "mode": REG, "data": b""},
    {"path": "link", "mode": 0xA1FF, "data": b"dir/hello"},
    {"path": "null", "mode": CHR | 0o666, "rdev": 0x103},
] + [{"path": f"many/{i:04}", "mode": REG, "data": str(i).encode()} for i in range(400)]


@pytest.fixture(scope="module")
def img(tmp_path_factory):
    p = tmp_path_factory.mktemp("img") / "a.img"
    p.write_bytes(image_writer.build(ENTRIES, label="test"))
    return str(p)


def test_image_tables(spark, img):
    sb = image.read(spark, img, "image").first()
    assert sb["checksum_ok"] and sb["volume_name"] == "test" and sb["features"] == ["sb_csum"] and sb["blksz"] == 4096
    d = image.read(spark, img, "dirent").withColumn("name", F.col("name").cast("string"))
    walked = paths.walk(d, sb["root_nid"])
    i = image.read(spark, img, "inode").select("nid", "mode", "size", "uid", "rdev")
    got = {r["path"]: r for r in walked.join(i, "nid").collect()}
    assert {p: (got[p]["mode"], got[p]["size"]) for p in ("dir/hello", "link", "null", "dir")} == {"dir/hello": (REG, 10000), "link": (0xA1FF, 9), "null": (CHR | 0o666, 0), "dir": (DIR, got["dir"]["size"])}
    assert got["dir/hello"]["uid"] == 70000 and got["null"]["rdev"] == 0x103 and len(got) == len(ENTRIES) + 2
    from canopy.operators import integrity

    assert integrity.name_order(image.read(spark, img, "dirent")).count() == 0
    c = image.read(spark, img, "content").join(walked, "nid").filter("path = 'dir/hello'").first()
    assert bytes(c["data"]) == b"hello" * 2000
    assert image.read(spark, img, "extent").filter("not mapped").count() == 0
    assert image.read(spark, img, "xattr").count() == 0 and image.read(spark, img, "device").count() == 0


def test_extraction(img, tmp_path):
    with open(img, "rb") as f:
        image_writer.extract(f.read(), str(tmp_path / "out"))
    assert (tmp_path / "out/dir/hello").read_bytes() == b"hello" * 2000
    assert os.readlink(tmp_path / "out/link") == "dir/hello" and len(os.listdir(tmp_path / "out/many")) == 400


def test_bad_images_raise(img):
    with open(img, "rb") as f:
        data = bytearray(f.read())
    for at, value in ((1024, 0), (1024 + 12, 40), (1024 + 80, 0xFF), (1024 + 81, 0xFF)):
        bad = bytearray(data)
        bad[at] = value
        with pytest.raises(image.BadImage):
            list(image.Image(bytes(bad)).walk())
    data[2000] ^= 1
    assert image.Image(bytes(data)).row["checksum_ok"] is False
    rng = random.Random(1)
    for _ in range(200):
        bad = bytearray(data)
        for _ in range(5):
            bad[rng.randrange(1024, 8192)] = rng.randrange(256)
        try:
            for i in image.Image(bytes(bad)).walk():
                image.Image(bytes(bad)).extents(i)
        except (image.BadImage, Exception) as e:  # noqa: BLE001
            assert not isinstance(e, (MemoryError, RecursionError))


def test_read_archives(spark, tmp_path):
    for k, mode in enumerate(("w", "w:gz", "w:xz")):
        with tarfile.open(tmp_path / f"{k}.tar", mode) as t:
            i = tarfile.TarInfo("f")
            i.size = 3
            t.addfile(i, io.BytesIO(b"abc"))
    rows = tar.read(spark, str(tmp_path), data=True).collect()
    assert [(r["path"], bytes(r["data"])) for r in rows] == [("f", b"abc")] * 3


def test_listing_and_manifests(spark):
    xml = "<ListBucketResult><Name>b</Name><IsTruncated>true</IsTruncated><Contents><Key>a/b/c.txt</Key><LastModified>2024-01-02T03:04:05.678Z</LastModified><Size>7</Size></Contents><Contents><Key>d/</Key><LastModified>2024-01-02T03:04:05Z</LastModified><Size>0</Size></Contents></ListBucketResult>"
    pages = spark.createDataFrame([(0, xml)], "page int, xml string")
    o = remote.objects(pages)
    assert [tuple(r) for r in o.select("key", "size", "mtime_s", "mtime_ns").collect()] == [("a/b/c.txt", 7, 1704164645, 678000000), ("d/", 0, 1704164645, 0)]
    assert remote.next_marker(pages).first()["marker"] == "d/"
    assert {(r["path"], r["mode"]) for r in remote.entries(o).collect()} == {("a", DIR), ("a/b", DIR), ("a/b/c.txt", REG), ("d", DIR)}
    idx = spark.createDataFrame([("i", '{"manifests":[{"digest":"x","platform":{"os":"linux","architecture":"arm64","variant":"v8"}},{"digest":"y","platform":{"os":"linux","architecture":"amd64"}}]}')], "image string, json string")
    assert remote.pick_manifest(idx, "linux/amd64").first()["digest"] == "y" and remote.pick_manifest(idx, "linux/arm64/v8").first()["digest"] == "x"
    man = spark.createDataFrame([("i", '{"layers":[{"digest":"l0","size":1},{"digest":"l1","size":2}]}')], "image string, json string")
    assert [r["digest"] for r in remote.layers(man).orderBy("layer_no").collect()] == ["l0", "l1"] and remote.layers(man, index=1).first()["digest"] == "l1"


def test_range_stream(spark, tmp_path):
    from canopy.streaming.ranges import serve

    rows = [(1, 0, 100, 1000), (1, 50, 100, 1000), (1, 0, 150, 1000), (2, 990, 0, 1000), (1, 400, 10, 1000)]
    spark.createDataFrame(rows, "nid long, off long, count long, size long").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("nid long, off long, count long, size long").parquet(str(tmp_path / "in"))
    q = serve(s).writeStream.format("memory").queryName("fetched").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("fetched").groupBy("nid").agg(F.sum("len")).collect()
    assert {tuple(r) for r in got} == {(1, 160), (2, 10)}


def test_archive_stream(spark, tmp_path):
    from canopy.streaming.ranges import ingest

    (tmp_path / "in").mkdir()
    with tarfile.open(tmp_path / "in" / "a.tar", "w") as t:
        t.addfile(tarfile.TarInfo("f"))
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_index_records():
    from canopy.operators import compressed

    rows = compressed.index_records(b"".join([b"\x01\x00\x10\x00\x05\x00\x00\x00", b"\x02\x00\x00\x00\x03\x08\x02\x00", b"\x02\x00\x00\x00\x02\x00\x01\x00", b"\x00\x80\x20\x00\x08\x00\x01\x00"]))
    assert [(r["kind"], r["ofs"], r["blkaddr"], r["blocks"], r["back"], r["partial"]) for r in rows] == [(1, 16, 5, None, None, False), (2, None, None, 3, 1, False), (2, None, None, None, 2, False), (0, 32, 65544, None, None, True)]
    assert compressed.index_records(compressed.pack_records(rows)) == rows


def test_extent_records():
    import struct

    from canopy.operators.compressed import extent_records

    four = struct.pack("<QIII", 4096, 4096, 8192, 100)
    assert [(e["la"], e["llen"], e["pa"], e["plen"]) for e in extent_records(four, 4, 12, 10000)] == [(0, 4096, 4096, 4096), (4096, 4096, 8192, 8192), (8192, 1808, 16384, 100)]
    big = struct.pack("<IIII", 10, 1, 1, 0) + struct.pack("<IIII", 20, 2, 0, 5000)
    assert [(e["la"], e["llen"], e["pa"], e["plen"]) for e in extent_records(big, 16, 12, 9000)] == [(0, 5000, (1 << 32) + 1, 10), (5000, 4000, 2, 20)]


def test_local_scan_and_helpers(spark, tmp_path):
    from canopy.sources import local

    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/f").write_bytes(b"123")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip/x").write_bytes(b"")
    os.symlink("b/f", tmp_path / "a/l")
    got = {r["path"]: r["size"] for r in local.scan(spark, str(tmp_path), lambda p: p == "skip").collect()}
    assert got == {"a": 0, "a/b": 0, "a/b/f": 3, "a/l": 3}
    data = bytes(range(100))
    assert local.read_range(lambda o, n: (206, data[o : o + n]), 90, 20, 100) == data[90:]
    assert local.read_range(lambda o, n: (200, data), 5, 3, 100) == data[5:8]
    assert local.read_range(lambda o, n: (206, data[o : o + n]), 99, 4, 100, fill=True) == b"c\0\0\0"
    with pytest.raises(OSError):
        local.read_range(lambda o, n: (404, b""), 0, 1, 100)
    assert local.length_prefixed(b"\x03\x00abc\0\0\0\x01\x00z") == [b"abc", b"z"]
    assert local.options("a,^b,c=1", {"a", "b", "c"}) == {"a": True, "b": False, "c": "1"}
    with pytest.raises(ValueError):
        local.options("nope", {"a"})
