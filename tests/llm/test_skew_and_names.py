"""Clashing column names, repeated and null ids, and plain-loop versions of scores, slots and schedules."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from canopy.llm import mixing, sharding, toxicity
from tests.llm.test_llm import ODD, docs_of, toxic_corpus

NAMES = ["total", "quota", "whole", "left", "room", "partial", "order", "block", "tokens", "row", "score", "root", "key", "own", "part", "size"]


def with_names(df):
    return df.select("doc_id", "text", "source", *[F.lit(i).alias(c) for i, c in enumerate(NAMES)])


def test_mixing_keeps_clashing_columns(spark):
    df = with_names(docs_of(spark, ODD * 3))
    rows = mixing.mixed(df).collect()
    assert {r["doc_id"] for r in rows} == set(range(3 * len(ODD)))
    assert all([r[c] for c in NAMES] == list(range(len(NAMES))) for r in rows)


def test_mixing_equals_a_plain_schedule(spark):
    """Epochs, blocks and the cut of the last block, from the same hashes, in a loop."""
    df = docs_of(spark, [" ".join(["w"] * (1 + i % 7)) for i in range(400)])
    hashed = mixing.with_tokens(df, 17, 8).select("row.doc_id", "tokens", "source", "block", "order", F.xxhash64(F.lit(17), "source", F.lit(1).cast("long"), "block").alias("place")).collect()
    totals = {}
    for r in hashed:
        totals[r["source"]] = totals.get(r["source"], 0) + r["tokens"]
    names = sorted(totals)
    quota = dict(zip(names, mixing.quotas([totals[s] for s in names]), strict=True))
    want = set()
    for s in names:
        whole, room = quota[s] // totals[s], quota[s] % totals[s]
        assert whole == 1
        rows = [r for r in hashed if r["source"] == s]
        want |= {(r["doc_id"], 0) for r in rows}
        for block in sorted({r["block"] for r in rows}, key=lambda b: next((r["place"], b) for r in rows if r["block"] == b)):
            own = sorted((r for r in rows if r["block"] == block), key=lambda r: (tuple(r["order"]), r["tokens"]))
            for r, total in zip(own, np.cumsum([r["tokens"] for r in own]), strict=True):
                if total <= room:
                    want.add((r["doc_id"], 1))
            room = max(0, room - sum(r["tokens"] for r in own))
    assert {(r["doc_id"], r["__epoch"]) for r in mixing.mixed(df, blocks=8).collect()} == want


def test_shards_of_null_and_repeated_ids(spark):
    texts = [f"text {i} " + "x" * (i % 50) for i in range(4000)]
    out = sharding.shard(docs_of(spark, texts, [None if i % 2 else 7 if i % 4 else i for i in range(4000)]), 8).collect()
    load = np.bincount([r["shard"] for r in out], weights=[r["size"] for r in out], minlength=8)
    assert load.max() - load.min() < 0.02 * load.mean()
    for s in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))


def test_parts_of_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 10)
    out = sharding.shard(docs_of(spark, [f"t {i}" for i in range(1000)]), 4, 16).collect()
    for s in range(4):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))


def test_map_equals_a_plain_one(spark):
    """Version 2 of the map against a loop over slots."""
    v1 = sharding.initial_map(sharding.slot_totals(sharding.sized(docs_of(spark, [("y" * (i * i % 300)) for i in range(500)]), 64)), 5)
    rows = {r["vslot"]: (r["shard"], r["bytes"]) for r in v1.collect()}
    fair = sum(b for _, b in rows.values()) / 5
    load, pool, want = [0] * 5, [], {}
    for s in range(5):
        running = 0
        for slot in sorted((k for k, v in rows.items() if v[0] == s), key=lambda k: (-rows[k][1], k)):
            running += rows[slot][1]
            if running <= fair:
                want[slot] = s
                load[s] += rows[slot][1]
            else:
                pool.append(slot)
    for slot in sorted(pool, key=lambda k: (-rows[k][1], k)):
        want[slot] = int(np.argmin(load))
        load[want[slot]] += rows[slot][1]
    assert {r["vslot"]: r["shard"] for r in sharding.rebalanced_map(v1, 5).collect()} == want


def test_scores_equal_one_window_at_a_time():
    texts, labels = toxic_corpus(120, 3)
    net = toxicity.fit(texts, labels)
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))

    def plain(text):
        words = toxicity.words_of(text)
        best = -np.inf
        for s in toxicity.window_starts(len(words)):
            xs = []
            for w in words[s : s + toxicity.WINDOW]:
                own, grams, _ = toxicity.features([w])
                xs.append(np.concatenate([p["word"][own[0]], p["gram"][grams].sum(0) / np.sqrt(len(grams))]))
            there = len(xs)
            xs += [np.zeros(toxicity.WORD_DIM + toxicity.GRAM_DIM)] * (toxicity.WINDOW - there)
            states = {}
            for side, seq in (("f", xs), ("b", xs[::-1])):
                h, out = np.zeros(toxicity.HIDDEN), []
                for x in seq:
                    a, g = x @ p[f"w{side}"] + p[f"b{side}"], h @ p[f"u{side}"]
                    z, r = sig(a + g)[: toxicity.HIDDEN], sig(a + g)[toxicity.HIDDEN : 2 * toxicity.HIDDEN]
                    n = np.tanh(a[2 * toxicity.HIDDEN :] + r * g[2 * toxicity.HIDDEN :])
                    h = (1 - z) * n + z * h
                    out.append(h)
                states[side] = out if side == "f" else out[::-1]
            st = np.array([np.concatenate(v) for v in zip(states["f"], states["b"], strict=True)])
            e = np.tanh(st @ p["att"] + p["att_b"]) @ p["att_v"]
            a = np.exp(e[: max(there, 0)]) if there else np.ones(len(e))
            a = a / a.sum()
            best = max(best, (a[:, None] * st[: len(a)]).sum(0) @ p["out"] + p["out_b"][0])
        return sig(best)

    some = [*texts[:25], "", "one", " ".join(texts[:6])]
    assert np.allclose(toxicity.Scorer(net).scores(some), [plain(t) for t in some], atol=1e-5)


def test_segments_are_drawn_over_the_whole_text():
    words = [f"w{i}" for i in range(20_000)]
    assert toxicity.segments("a b") == ["a b"] and toxicity.segments("") == [""]
    got = toxicity.segments(" ".join(words), 50)
    assert len(got) == 50 and int(got[0].split()[0][1:]) < 500 and int(got[-1].split()[-1][1:]) > 19_500
    assert all(len(s.split()) == toxicity.WINDOW for s in got)


def test_training_leaves_out_held_out_rows(spark):
    """Held-out, null and odd labels do not change what is learnt; repeated ones count once."""
    texts, labels = toxic_corpus(80, 9)
    docs = docs_of(spark, texts)
    kept = [(i, y) for i, y in enumerate(labels) if zlib.crc32(str(i).encode()) % 4 != 2]
    flipped = [(i, 1 - y) for i, y in enumerate(labels) if zlib.crc32(str(i).encode()) % 4 == 2]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    a = toxicity.train(docs, frame(kept))
    b = toxicity.train(docs, frame([*kept, *kept[:5], *flipped, (None, 1), (3, None), (4, 9)]))
    c = toxicity.fit([texts[i] for i, _ in kept], [y for _, y in kept])
    assert all((a.p[k] == b.p[k]).all() and (a.p[k] == c.p[k]).all() for k in a.p)


def test_copies_are_judged_row_by_row(spark):
    import corpus_pipeline as P

    base = " ".join(f"w{i}" for i in range(60))
    df = docs_of(spark, [base, base + " more", "other text of five words here", "other text of five words here", None, None], [3, 5, 5, 5, 5, 6])
    kept = P.drop_near_copies(spark, with_names(df), "")
    assert kept.columns == ["doc_id", "text", "source", *NAMES]
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == [(3, base), (5, ""), (5, "other text of five words here"), (6, "")]
    assert all([r[c] for c in NAMES] == list(range(len(NAMES))) for r in kept.collect())
