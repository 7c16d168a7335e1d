"""Queries without SQL against brute force over whole small tables."""

import random

import pytest

from canopy.functions import codecs, hashes
from canopy.operators import dedupe
from canopy.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents, and the bytes of each path. Copies have ids of all remainders."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    long, short = prose(5000), prose(900)
    texts = [long, prose(30), short, "", None, prose(4000), "x" * 20000, long, short, "é" * 3000, prose(1200), long, short + " more", "123456789"]
    rows = [(i, t, "en" if i % 3 else "de", "web", len(t or "")) for i, t in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder, {f"{lang}/web/{i}.txt": None if t is None else t.encode() for i, t, lang, _, _ in rows}


def test_clusters_of_all_files(spark, corpus):
    import hashlib

    folder, files = corpus
    all_of = {p: codecs.clusters(c or b"", 4096, "zstd") for p, c in files.items()}
    stored = {p: sum(-(-len(c) // 4096) * 4096 for _, _, c, _ in v) for p, v in all_of.items()}
    kept = {(p, k, at, n) for p, v in all_of.items() if files[p] and stored[p] < len(files[p]) for k, (at, n, _, _) in enumerate(v)}
    assert {(r["path"], r["cluster_no"], r["la"], r["llen"]) for r in QUERIES["c2_c3_clusters"](spark, folder).collect()} == kept
    shared = {}
    for p, v in all_of.items():
        for at, _, c, raw in v:
            shared.setdefault((hashlib.sha256(c).hexdigest(), -(-len(c) // 4096) * 4096, raw), []).append((p, at))
    found = {(r["digest"], r["plen"], r["raw"]): (r["n"], r["owner_path"], r["owner_la"]) for r in QUERIES["d4_shared_clusters"](spark, folder).collect()}
    assert found == {k: (len(v), *min(v)) for k, v in shared.items()}
    assert max(n for n, _, _ in found.values()) >= 3


def brute_crc(data, crc=0xFFFFFFFF):
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ 0x82F63B78 * (crc & 1)
    return crc


def test_checksum_of_any_length():
    rng = random.Random(7)
    for n in (0, 1, 4, 255, 1023, 1024, 1025, 2047, 2048, 5000):
        data = rng.randbytes(n)
        assert hashes.crc32c(data) == brute_crc(data) and hashes.crc32c(data, 0x1234) == brute_crc(data, 0x1234)
    data = bytes(1100 << 10)
    assert hashes.crc32c(data + b"1") == hashes.crc32c(b"1", hashes.crc32c(data))
    assert hashes.crc32c(data[: 1 << 20]) == hashes.crc32c(data[: 1 << 19], hashes.crc32c(data[: 1 << 19]))


def test_checksum_of_whole_files(spark, corpus):
    folder, files = corpus
    found = {r["path"]: r["crc32c"] for r in QUERIES["h_crc32c"](spark, folder).collect()}
    assert found == {p: None if c is None else brute_crc(c) for p, c in files.items()}
    assert found["de/web/12.txt"] != found["en/web/8.txt"]  # they differ in their last bytes


def brute_suffixes(files):
    """path: (match_path, match_len), the longest common suffix with a smaller path, of these the least path."""
    out = {}
    for p, c in files.items():
        for q, d in sorted(files.items()):
            if q < p and min(len(c), len(d)) > 64 and (n := dedupe.common_suffix(c, d)) >= 64 and n > out.get(p, ("", 0))[1]:
                out[p] = (q, n)
    return out


def test_longest_suffix_of_any_file(spark):
    rng = random.Random(11)
    foot, files = rng.randbytes(70), {"A": b"a" * 300, "B": b"b" * 500, "C": b"b" * 500}
    files = {p: c + foot for p, c in files.items()}
    ends = [foot]
    for _ in range(70):  # each file grows from the end of an earlier one
        base = rng.choice(ends)
        ends.append(rng.randbytes(rng.choice([0, 1, 3, 64, 130, 900])) + base[-rng.choice([64, 65, 70, 127, 128, 129, 300, 3000]) :])
        if rng.random() < 0.2:
            ends.append(ends[-1])
    names = [f"f{i}" for i in range(len(ends))]
    rng.shuffle(names)
    files |= dict(zip(names, ends, strict=True))
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files.items()], "path string, content binary")
    true = brute_suffixes(files)
    found = {r["path"]: (r["match_path"], r["match_len"]) for r in dedupe.suffix_matches(df).collect()}
    assert found["C"] == ("B", 570) and found == true
    whole = {r["path"]: (r["match_path"], r["match_len"]) for r in dedupe.suffix_matches(df, whole_only=True).collect()}
    assert "C" in whole and whole == {p: v for p, v in true.items() if v[1] == len(files[p])}


def shuffled(spark, job):
    """The result of the job and the bytes that its stages shuffled, spilled and wrote."""
    sc = spark.sparkContext
    jvm, store = sc._gateway.jvm, sc._jsc.sc().statusStore()

    def stages():
        every = store.stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(x := every.apply(k)).stageId(): x.shuffleWriteBytes() + x.diskBytesSpilled() + x.outputBytes() for k in range(every.size())}

    before = stages()
    out = job()
    return out, sum(v for k, v in stages().items() if k not in before)


@pytest.mark.parametrize("whole_only", [True, False])
def test_contents_of_copies_are_not_shuffled(spark, whole_only):
    rng = random.Random(13)
    text = rng.randbytes(100000)
    files = {f"c{i:02}": text for i in range(40)} | {f"l{i}": rng.randbytes(100000) for i in range(10)} | {"a": b"more" + text, "m": text[5:], "z": b"x" + text[-300:]}
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files.items()], "path string, content binary")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as with tables that are no longer small
    try:
        rows, moved = shuffled(spark, lambda: dedupe.suffix_matches(df, whole_only=whole_only).collect())
    finally:
        spark.conf.set(key, before)
    assert {r["path"]: (r["match_path"], r["match_len"]) for r in rows} == {f"c{i:02}": ("a", 100000) for i in range(40)} | {"m": ("a", 99995)} | ({} if whole_only else {"z": ("a", 300)})
    assert moved < sum(map(len, files.values())) / 2, moved


@pytest.mark.parametrize("settle", [0, 1000, 20000])
def test_suffixes_of_large_groups(spark, settle, monkeypatch):
    """Groups that no task may hold whole, and keys that are too frequent to be dealt by."""
    rng = random.Random(17)
    foot, files = rng.randbytes(200), {}
    for i in range(60):
        files[f"f{rng.randrange(10**6):06}"] = rng.randbytes(rng.choice([1, 3, 5, 200])) + rng.choice([b"", b"ab" * rng.randrange(40), b"b" * rng.randrange(90)]) + foot[rng.choice([0, 0, 100]) :]
    meet = dedupe._meet
    monkeypatch.setattr(dedupe, "_meet", lambda rows, groups, key: meet(rows, groups, key, many=5))
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files.items()], "path string, content binary")
    assert {r["path"]: (r["match_path"], r["match_len"]) for r in dedupe.suffix_matches(df, settle=settle).collect()} == brute_suffixes(files)


def brute_windows(files, window):
    """The matched windows of each file as (path, off, match_path, match_off)."""
    index, out = {}, set()
    for p, c in sorted(files.items()):
        for k in range(0, len(c) - window + 1, window):
            index.setdefault(c[k : k + window], (p, k))
    for p, c in files.items():
        for k in range(len(c) - window + 1):
            q, at = index.get(c[k : k + window], (None, 0))
            if q is not None and (q < p or q == p and at + window <= k):
                out.add((p, k, q, at))
    return out


def test_rolling_windows_of_whole_files(spark):
    rng = random.Random(19)
    base = rng.randbytes(3000)
    files = {"a": base, "b": b"xyz" + base[64:1500] + b"end", "c": b"p" * 500, "d": rng.randbytes(70000) + base[128:900] + rng.randbytes(70000), "e": base, "s": b"t" * 63, "z": b""}
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files.items()], "path string, content binary")
    rows = dedupe.rolling_dedupe(df, 64).collect()
    assert {(r["path"], r["off"] + k, r["match_path"], r["match_off"] + k) for r in rows for k in range(0, r["match_len"], 64)} == brute_windows(files, 64)


def test_rolling_windows_in_little_memory(spark):
    """A worker's memory follows neither the size of a file nor the number of files in a batch."""
    import os

    import psutil

    rng = random.Random(23)
    content = rng.randbytes(1 << 20)
    files = [(f"f{i:02}", bytearray(content[i:])) for i in range(6)] + [("long", bytearray(rng.randbytes(24 << 20)))]
    df = spark.createDataFrame(files, "path string, content binary").coalesce(1)

    def run():
        return {r["path"] for r in dedupe.rolling_dedupe(df, 4096).collect()}

    def workers():
        return [p for p in psutil.Process().children(recursive=True) if "java" not in p.name() and p.ppid() != os.getpid()]

    def peak(p):
        try:
            with open(f"/proc/{p.pid}/status") as f:
                return next((int(x.split()[1]) for x in f if x.startswith("VmHWM")), 0)
        except (FileNotFoundError, ProcessLookupError):
            return 0

    for p in workers():
        try:
            with open(f"/proc/{p.pid}/clear_refs", "w") as f:
                f.write("5")  # the peak starts anew
        except (FileNotFoundError, ProcessLookupError):
            pass
    assert run() == {f"f{i:02}" for i in range(1, 6)}
    assert 0 < max(map(peak, workers())) < 600 << 10
