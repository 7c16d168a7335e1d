"""The n-gram Jaccard join on large groups: near copies about the threshold, one token of a third of all texts, far members."""

import random

import numpy as np

from canopy.llm import jaccard
from tests.llm.test_llm import brute_classes, docs_of


def grouped_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7)))
    base, passage = [word() for _ in range(140)], [word() for _ in range(40)]
    texts = []
    for _ in range(300):  # one to seven edits of 136 shingles: pairs lie on both sides of 75 %
        w = list(base)
        for _ in range(rng.randint(1, 7)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    for _ in range(150):  # a third of the others share a passage, few of them much more
        texts.append(" ".join([*passage, *[word() for _ in range(rng.randint(0, 30))]]))
    texts += [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(100)]
    return texts


def test_near_copies_about_the_threshold(spark):
    texts = grouped_texts(7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == dict(enumerate(brute_classes(texts)))
    sizes = np.bincount([c for _, c in got.values()])
    assert sizes.max() > 100 and (sizes[:300] == 1).sum() > 10


def test_links_in_families_without_earlier_links(spark):
    """The last step alone finds every component, whatever the steps before have joined."""
    texts = grouped_texts(8)
    sets = {}
    for s in jaccard.shingle_sets([t.encode() for t in texts]):
        sets.setdefault(jaccard.signature(s), jaccard.tokens_of(s))
    rows = [(sig, len(t), bytearray(jaccard.pack(t))) for sig, t in sets.items()]
    df = spark.createDataFrame(rows, "sig long, n long, tokens binary")
    none = spark.createDataFrame([], "node long, root long")
    links = jaccard.links_in_families(jaccard.open_prefixes(jaccard.whole_sets(df, none), "t"), df)
    got = {r["node"]: r["root"] for r in jaccard.components(links).collect()}
    ids = list(sets)
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if jaccard.linked(sets[a], sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in ids if find(i) != i}
