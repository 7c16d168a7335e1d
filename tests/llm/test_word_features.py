"""Word and n-gram rows, computed for many words side by side, against a plain loop."""

from canopy.llm import toxicity as tx

M = 1 << 64


def scattered(x):
    x = (x ^ x >> 31) * 0x9E3779B97F4A7C15 % M
    return x ^ x >> 29


def plain(word):
    places = [int(p) for p in tx.PLACES]
    s = f"<{word.strip(tx.EDGES) or word}>"
    total = lambda part: sum(ord(c) * places[i] for i, c in enumerate(part))
    grams = [scattered((total(s[i : i + n]) + places[-n]) % M) % tx.GRAM_ROWS for i in range(len(s)) for n in tx.GRAMS if i + n <= len(s)]
    return scattered(total(s) % M) % tx.WORD_ROWS, grams


def test_features_of_many_words():
    words = ["a", "ab", "(word)", "...", "é", "漢字", "😀x", "x" * tx.LONGEST, "zum", "12", "w1n"] + [f"k{i}z" for i in range(tx.WORDS_AT_ONCE)]
    own, grams, counts = tx.features(words)
    expected = [plain(w) for w in words]
    assert own.tolist() == [e[0] for e in expected]
    assert counts.tolist() == [len(e[1]) for e in expected] and grams.tolist() == [g for e in expected for g in e[1]]
    assert [len(c) for c in tx.features([])] == [0, 0, 0]
