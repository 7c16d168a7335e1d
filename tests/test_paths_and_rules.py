"""Deep trees, directory order, rule files, and range reads against plain loops."""

import random

from canopy.operators import extents, filters, order, paths
from pyspark.sql import functions as F


def test_walk_of_seventy_levels(spark):
    rows = [(i, f"d{i}", i + 1, 2) for i in range(1, 71)] + [(71, "file", 1000, 1), (71, "back", 40, 2)]
    out = paths.walk(spark.createDataFrame(rows, "dir_nid long, name string, nid long, ftype int"), 1).collect()
    deep = "/".join(f"d{i}" for i in range(1, 71))
    assert len(out) == 72
    assert {r["path"] for r in out if r["ftype"] == 1} == {f"{deep}/file"}
    assert [r["path"] for r in out if r["loop"]] == [f"{deep}/back"]


def test_first_path_is_in_directory_order(spark):
    df = spark.createDataFrame([(1, "a-b/z"), (1, "a/z"), (2, "b"), (2, "a.c/x"), (2, "a/x/y")], "nid long, path string")
    assert {r["nid"]: r["path"] for r in paths.first_paths(df).collect()} == {1: "a/z", 2: "a/x/y"}


def test_rules_keep_signs_and_leave_out_odd_sizes(spark):
    lines = ["# all", "4096 a#b", "5000 x$", "8192 2 c#d  # why", "  # more", "0 ^e"]
    got = filters.parse_rules(spark.createDataFrame(list(enumerate(lines)), "rule_no int, line string")).orderBy("rule_no").collect()
    assert [tuple(r) for r in got] == [(1, 4096, None, "a#b"), (3, 8192, 2, "c#d"), (5, 0, None, "^e")]


def test_ranges_against_a_loop(spark):
    rng = random.Random(3)
    content = {n: rng.randbytes(rng.randint(0, 900)) for n in range(6)}
    segments = [(n, at, c[at : at + step]) for n, c in content.items() for step in [rng.choice([7, 50, 300])] for at in range(0, len(c), step)]
    asked = [(i, rng.randrange(8), rng.randrange(1000), rng.choice([0, 1, 64, 500, 2000])) for i in range(300)]
    data = spark.createDataFrame([(n, a, bytearray(b)) for n, a, b in segments], "nid long, off long, data binary")
    requests = spark.createDataFrame(asked, "request_id long, nid long, off long, len long")
    got = {r["request_id"]: bytes(r["data"]) for r in extents.read_ranges(requests, data, span=64).collect()}
    assert got == {i: content.get(n, b"")[off : off + length] for i, n, off, length in asked}
    maps = spark.createDataFrame([(n, a, len(b), 10000 * n + a) for n, a, b in segments], "nid long, la long, llen long, pa long")
    parts = extents.range_parts(requests.filter("len > 0"), maps, span=64).collect()
    want = {(i, max(off, a), min(off + length, a + len(b)) - max(off, a)) for i, n, off, length in asked if length for m, a, b in segments if m == n and off < a + len(b) and a < off + length}
    assert len(parts) == len(want) and {(r["request_id"], r["part_off"], r["n"]) for r in parts} == want


def test_devices_against_a_loop(spark):
    rng = random.Random(5)
    blocks = [rng.choice([0, 1, 3, 1000, 10**9]) for _ in range(40)]
    table = extents.device_table(spark.createDataFrame(list(enumerate(blocks, 1)), "device_id int, blocks long"))
    starts = {r["device_id"]: r["uniaddr"] for r in table.collect()}
    asked = [(i, a) for i, a in enumerate({*(s + d for s in starts.values() for d in (-1, 0, 1) if s + d >= 0), sum(blocks) - 1, sum(blocks), sum(blocks) + 10**12})]
    df = spark.createDataFrame(asked, "addr_id long, pa long").withColumn("device_id", F.lit(0))
    got = {r["addr_id"]: (r["device_id"], r["pa"]) for r in extents.map_devices(df, table).collect()}
    for i, a in asked:
        dev = next((d for d, s in starts.items() if s <= a < s + blocks[d - 1]), 0)
        assert got[i] == (dev, a - starts.get(dev, 0))


def test_running_sums(spark):
    rng = random.Random(6)
    rows = [(rng.choice("aaab"), i, rng.randint(0, 9)) for i in range(500)]
    got = order.running(spark.createDataFrame(rows, "g string, k long, v long").repartition(7), ["g"], F.col("k"), F.col("v"), "before").collect()
    total = {}
    for g, k, v in rows:
        assert next(r["before"] for r in got if r["k"] == k) == total.get(g, 0)
        total[g] = total.get(g, 0) + v
    assert len(got) == 500
