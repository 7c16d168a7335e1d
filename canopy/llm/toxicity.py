"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is cut into words, overlapping windows of WINDOW words, STEP apart. Each word is the sum of what its letters say (its
character n-grams, with word edges) beside an embedding of the word itself. Two gated recurrent layers read a window, one from
each end; attention weighs their states, and a logistic unit scores the weighted mean. A text's score is that of its
highest-scoring window, so every window of every text counts.

The network is fitted on the driver, on at most FIT_DOCS labelled rows (chosen by hash of the id) whose crc32(doc_id) mod 4 is not
2; the rest is held out. Of a text with more than FIT_WINDOWS windows so many are drawn, evenly over the whole text; tasks draw
them, so what the driver gets has a bound. Ids, languages, sources and labels are no inputs of a score.

Cases: a null text is an empty one, and an empty text is a window without words, which has a score; words of more than
LONGEST letters count as several; equal texts get equal scores but for rounding (about 1e-8: products of single precision depend on
which words share a batch); labels that are null or neither 0 nor 1 are passed over; repeated labels of a document count once (the
largest), and of rows that repeat an id the least text is learnt; without labels of both kinds every score is the share of toxic labels (0 without
any); an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.common import give_back, table, text_or_empty

FIT_DOCS, FIT_WINDOWS = 5000, 192
WINDOW, STEP, LONGEST = 32, 16, 24
WORD_ROWS, WORD_DIM, GRAM_ROWS, GRAM_DIM = 1 << 14, 6, 1 << 14, 10
HIDDEN, ATTENTION = 8, 8
GRAMS = (3, 4, 5)
STEPS, BATCH, RATE = 500, 160, 0.015
THRESHOLD = 0.3
#: Words whose inputs a Python worker keeps; the table is emptied when full.
KEPT = 200_000
WINDOWS_AT_ONCE, WORDS_AT_ONCE = 2048, 8192
#: An odd number a place in a word with its edges, and one a length of n-grams.
PLACES = np.random.default_rng(11).integers(1, 1 << 63, LONGEST + 2 + max(GRAMS), dtype=np.uint64) | np.uint64(1)
EDGES = ".,;:!?\"'()[]{}<>*$%&#|-_/\\=+~^@`0123456789"


def words_of(text: str) -> list[str]:
    words = text.lower().split()
    if words and max(map(len, words)) > LONGEST:
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def scattered(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word's embedding; rows of the n-grams of all words, and how many each word has.

    Hashes are sums of code points times odd numbers by place, over all words side by side.
    """
    if len(words) > WORDS_AT_ONCE:  # bounds the arrays of places
        parts = [features(words[i : i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)]
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)
    bare = [w.strip(EDGES) or w for w in words]
    code = np.frombuffer(f"<{'><'.join(bare)}>".encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, bare), np.int64, len(bare)) + 2
    start = np.cumsum(length) - length
    place = np.arange(len(code)) - np.repeat(start, length)
    own = scattered(np.add.reduceat(code * PLACES[place], start)) % np.uint64(WORD_ROWS)
    left = np.repeat(length, length) - place  # letters from here to the end of the word
    grams = np.zeros((len(code), len(GRAMS)), np.uint64)
    for k, n in enumerate(GRAMS):
        m = max(len(code) - n + 1, 0)
        for i in range(n):
            grams[:m, k] += code[i : i + m] * PLACES[i]
        grams[:m, k] += PLACES[-n]
    there = left[:, None] >= np.array(GRAMS)
    rows = scattered(grams[there]) % np.uint64(GRAM_ROWS)
    return own.astype(np.int32), rows.astype(np.int32), np.add.reduceat(there.sum(1), start)


def window_starts(n: int) -> list[int]:
    """Starts of overlapping windows that cover n words; the last ends with the last word."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STEP), n - WINDOW]


def segments(text: str, n: int = FIT_WINDOWS, chance: float = 0.5) -> list[str]:
    """The text if it has n windows at most; else n of its windows, one from each n-th of them."""
    words = words_of(text)
    starts = window_starts(len(words))
    if len(starts) <= n:
        return [text]
    return [" ".join(words[s : s + WINDOW]) for s in (starts[int((i + chance) * len(starts) / n)] for i in range(n))]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    p: dict[str, np.ndarray]
    prior: float | None = None  # set: no network, this score for all

    @staticmethod
    def fresh(seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        d = WORD_DIM + GRAM_DIM
        p = {
            "word": rng.normal(0, 0.1, (WORD_ROWS, WORD_DIM)), "gram": rng.normal(0, 0.1, (GRAM_ROWS, GRAM_DIM)),
            "att": rng.normal(0, 0.3, (2 * HIDDEN, ATTENTION)), "att_b": np.zeros(ATTENTION), "att_v": rng.normal(0, 0.3, ATTENTION),
            "out": rng.normal(0, 0.3, 2 * HIDDEN), "out_b": np.array([-1.0]),
        }
        for side in "fb":
            p |= {f"w{side}": rng.normal(0, d**-0.5, (d, 3 * HIDDEN)), f"u{side}": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)), f"b{side}": np.zeros(3 * HIDDEN)}
        return Network({k: v.astype(np.float32) for k, v in p.items()})

    def inputs(self, own: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        start = np.cumsum(counts) - counts
        letters = np.add.reduceat(self.p["gram"][grams], start, axis=0) / np.sqrt(counts)[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][own], letters], axis=1)

    def word_inputs(self, own: np.ndarray, grams: np.ndarray, counts: np.ndarray, at_once: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """The words' inputs to either layer, and those of no word after them; some words at a time."""
        left, right = (np.tile(self.p[f"b{s}"], (len(own) + 1, 1)) for s in "fb")
        ends = np.cumsum(counts)
        for i in range(0, len(own), at_once):
            j = min(i + at_once, len(own))
            x = self.inputs(own[i:j], grams[ends[i] - counts[i] : ends[j - 1]], counts[i:j])
            left[i:j] += x @ self.p["wf"]
            right[i:j] += x @ self.p["wb"]
        return left, right

    def layer(self, side: str, steps: list[np.ndarray], keep: list | None = None) -> list[np.ndarray]:
        """States after each step; steps: the inputs times w plus b. keep gets what the way back needs."""
        u = self.p[f"u{side}"]
        h = np.zeros((len(steps[0]), HIDDEN), np.float32)
        out = []
        for x in steps:
            g = h @ u
            zr = sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if keep is not None:
                keep.append((h, z, r, n, g[:, 2 * HIDDEN :]))
            h = new
            out.append(h)
        return out

    def pool(self, states: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, ...]:
        """states [T, B, 2H], there [T, B] -> logits, and what the way back needs."""
        e = np.tanh(states @ self.p["att"] + self.p["att_b"])
        a = np.where(there, e @ self.p["att_v"], np.float32(-30))
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        mean = (a[:, :, None] * states).sum(0)
        return mean @ self.p["out"] + self.p["out_b"][0], mean, a, e

    def sweep(self, side: str, table: np.ndarray, windows: np.ndarray, states: np.ndarray) -> None:
        """layer() without the way back: states [T, H, B] are filled with one row a unit, so that each step works on whole rows."""
        u = np.ascontiguousarray(self.p[f"u{side}"].T)
        h = np.zeros((HIDDEN, len(windows)), np.float32)
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            x, g = np.ascontiguousarray(table[windows[:, t]].T), u @ h
            zr = x[: 2 * HIDDEN]
            zr += g[: 2 * HIDDEN]
            np.exp(np.negative(zr, out=zr), out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            n = x[2 * HIDDEN :]
            n += zr[HIDDEN:] * g[2 * HIDDEN :]
            np.tanh(n, out=n)
            h -= n
            h *= zr[:HIDDEN]
            h += n
            states[t] = h

    def score(self, left: np.ndarray, right: np.ndarray, windows: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Logits of windows [B, T] of word numbers; left, right: the words' inputs to either layer."""
        states = np.empty((WINDOW, 2 * HIDDEN, len(windows)), np.float32)
        with np.errstate(over="ignore"):  # exp of a large number: the gate is shut
            self.sweep("f", left, windows, states[:, :HIDDEN])
            self.sweep("b", right, windows, states[:, HIDDEN:])
        e = self.p["att"].T @ states
        e += self.p["att_b"][:, None]
        a = np.where(there.T, (self.p["att_v"] @ np.tanh(e, out=e)), np.float32(-30))
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        mean = np.einsum("tb,thb->hb", a, states)
        return self.p["out"] @ mean + self.p["out_b"][0]

    def gradients(self, x: np.ndarray, there: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the weighted log loss over windows with inputs x [T, B, D]; also with regard to x."""
        p, n_steps = self.p, len(x)
        keep: dict[str, list] = {"f": [], "b": []}
        f = self.layer("f", [x[t] @ p["wf"] + p["bf"] for t in range(n_steps)], keep["f"])
        b = self.layer("b", [x[t] @ p["wb"] + p["bb"] for t in range(n_steps - 1, -1, -1)], keep["b"])[::-1]
        states = np.concatenate([np.stack(f), np.stack(b)], axis=2)
        logit, mean, a, e = self.pool(states, there.T)
        d_logit = ((sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
        g = {"out": mean.T @ d_logit, "out_b": np.array([d_logit.sum()])}
        d_mean = d_logit[:, None] * p["out"]
        d_states = a[:, :, None] * d_mean
        d_a = (states * d_mean).sum(2)
        d_s = a * (d_a - (a * d_a).sum(0))
        g["att_v"] = np.einsum("tb,tbk->k", d_s, e)
        d_e = d_s[:, :, None] * p["att_v"] * (1 - e**2)
        g["att"], g["att_b"] = np.einsum("tbh,tbk->hk", states, d_e), d_e.sum((0, 1))
        d_states = d_states + d_e @ p["att"].T
        d_x = np.zeros_like(x)
        for side, cols, order in (("f", slice(0, HIDDEN), range(n_steps)), ("b", slice(HIDDEN, None), range(n_steps - 1, -1, -1))):
            w, u = p[f"w{side}"], p[f"u{side}"]
            g[f"w{side}"], g[f"u{side}"], g[f"b{side}"] = np.zeros_like(w), np.zeros_like(u), np.zeros(3 * HIDDEN, np.float32)
            d_h = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, (h, z, r, n, gn) in zip(reversed(order), reversed(keep[side]), strict=True):
                d_h = d_h + d_states[t][:, cols]
                d_n = d_h * (1 - z) * (1 - n**2)
                d_z = d_h * (h - n) * z * (1 - z)
                d_r = d_n * gn * r * (1 - r)
                d_in = np.concatenate([d_z, d_r, d_n], axis=1)
                d_g = np.concatenate([d_z, d_r, d_n * r], axis=1)
                g[f"w{side}"] += x[t].T @ d_in
                g[f"b{side}"] += d_in.sum(0)
                g[f"u{side}"] += h.T @ d_g
                d_x[t] += d_in @ w.T
                d_h = d_h * z + d_g @ u.T
        return g, d_x


def fit(texts: list[str | list[str]], labels: list[int], seed: int = 5) -> Network:
    """Windows stand for their text: at first any, later the one that scores highest, and another by chance.

    A text may come as a list of segments of it.
    """
    y = np.array(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        return Network({}, float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    rows, owner = [], []
    for i, text in enumerate(texts):
        for part in [text] if isinstance(text, str) else text:
            ids = np.array([vocab.setdefault(w, len(vocab)) for w in words_of(part)], np.int32)
            starts = np.array(window_starts(len(ids)))
            rows.append(np.append(ids, np.full(WINDOW, -1, np.int32))[starts[:, None] + np.arange(WINDOW)])
            owner.append(np.full(len(starts), i, np.int32))
    windows, owner = np.concatenate(rows), np.concatenate(owner)
    del rows
    there = windows >= 0
    windows[~there] = len(vocab)
    first = np.searchsorted(owner, np.arange(len(texts)))
    n_windows = np.append(first[1:], len(owner)) - first
    own, grams, counts = features(list(vocab))
    n_words = len(vocab)
    del vocab
    start = np.cumsum(counts) - counts
    net = Network.fresh()
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    positive, negative = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    top = first + (rng.random(len(texts)) * n_windows).astype(np.int64)
    n_pos = BATCH // 3
    weight = np.ones(BATCH, np.float32)
    for step in range(STEPS):
        if step >= STEPS // 5 and step % (STEPS // 10) == 0:  # find each text's highest window anew
            left, right = net.word_inputs(own, grams, counts)
            logit = np.concatenate([net.score(left, right, windows[i : i + WINDOWS_AT_ONCE], there[i : i + WINDOWS_AT_ONCE]) for i in range(0, len(windows), WINDOWS_AT_ONCE)])
            order = np.lexsort((logit, owner))
            top = order[np.append(first[1:], len(owner)) - 1]
        docs = np.concatenate([rng.choice(positive, n_pos), rng.choice(negative, BATCH - n_pos)])
        any_one = first[docs] + (rng.random(BATCH) * n_windows[docs]).astype(np.int64)
        by_chance = (rng.random(BATCH) < 0.5) & ((y[docs] == 0) | (step < STEPS // 5))
        pick = np.where(by_chance, any_one, top[docs])
        part, inverse = np.unique(windows[pick].T, return_inverse=True)
        real = part < n_words
        x = np.zeros((len(part), WORD_DIM + GRAM_DIM), np.float32)
        used = part[real]
        flat = np.concatenate([grams[start[w] : start[w] + counts[w]] for w in used]) if len(used) else np.zeros(0, np.int64)
        if len(used):
            x[real] = net.inputs(own[used], flat, counts[used])
        g, d_x = net.gradients(x[inverse.reshape(WINDOW, BATCH)], there[pick], y[docs], weight)
        d_part = np.zeros_like(x)
        np.add.at(d_part, inverse.reshape(-1), d_x.reshape(-1, x.shape[1]))
        d_part = d_part[real]
        g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
        np.add.at(g["word"], own[used], d_part[:, :WORD_DIM])
        np.add.at(g["gram"], flat, np.repeat(d_part[:, WORD_DIM:] / np.sqrt(counts[used])[:, None].astype(np.float32), counts[used], axis=0))
        rate = RATE * (1 if step < STEPS * 0.7 else 0.3)
        for k, v in net.p.items():
            m, s = moment[k]
            m += 0.1 * (g[k] - m)
            s += 0.01 * (g[k] ** 2 - s)
            v -= (rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(s / (1 - 0.99 ** (step + 1))) + 1e-6)).astype(np.float32)
            if k in ("word", "gram"):
                v *= np.float32(1 - 1e-4)
    return net


class Scorer:
    """Scores texts with a network; keeps the inputs of words it has met."""

    def __init__(self, net: Network):
        self.net = net
        self.forget()

    def forget(self) -> None:
        blank = np.zeros((1, WORD_DIM + GRAM_DIM), np.float32)
        self.known: dict[str, int] = {}
        self.left, self.right = (np.concatenate([blank @ self.net.p[f"w{s}"] + self.net.p[f"b{s}"], np.zeros((KEPT, 3 * HIDDEN), np.float32)]) for s in "fb")

    def learn(self, new: list[str]) -> None:
        at = len(self.known) + 1
        if at + len(new) > len(self.left):
            more = np.zeros((len(new) + KEPT, 3 * HIDDEN), np.float32)
            self.left, self.right = np.concatenate([self.left, more]), np.concatenate([self.right, more])
        x = self.net.inputs(*features(new))
        self.left[at : at + len(new)] = x @ self.net.p["wf"] + self.net.p["bf"]
        self.right[at : at + len(new)] = x @ self.net.p["wb"] + self.net.p["bb"]
        self.known.update(zip(new, range(at, at + len(new)), strict=True))

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.net.prior is not None:
            return np.full(len(texts), self.net.prior)
        words = [words_of(t) for t in texts]
        new = set().union(*words).difference(self.known)
        if len(self.known) + len(new) > KEPT and self.known:
            self.forget()
            new = set().union(*words)
        if new:
            self.learn(list(new))
        known = self.known
        ids = np.array([known[w] for own in words for w in own], np.int64)
        length = np.array([len(w) for w in words])
        start = np.cumsum(length) - length
        begins = [window_starts(n) for n in length.tolist()]
        owner = np.repeat(np.arange(len(texts)), [len(b) for b in begins])
        inside = np.concatenate([np.array(b, np.int64) for b in begins])
        ids = np.append(ids, np.zeros(WINDOW, np.int64))
        best = np.full(len(texts), -np.inf)
        step = np.arange(WINDOW)
        for i in range(0, len(owner), WINDOWS_AT_ONCE):
            o, s = owner[i : i + WINDOWS_AT_ONCE], inside[i : i + WINDOWS_AT_ONCE]
            there = s[:, None] + step < length[o][:, None]
            windows = np.where(there, ids[(start[o] + s)[:, None] + step], 0)
            np.maximum.at(best, o, self.net.score(self.left, self.right, windows, there).astype(np.float64))
        return sigmoid(best)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_windows: int = FIT_WINDOWS) -> Network:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    sample = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chance = [zlib.crc32(str(i).encode()) / 2**32 for i in b.column(0).to_pylist()]
            drawn = [segments(t.as_py(), fit_windows, c) for t, c in zip(b.column(1), chance, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(drawn, pa.list_(pa.string()))], names=["doc_id", "toxic", "segments"])

    got = rows.mapInArrow(draw, "doc_id long, toxic int, segments array<string>").toArrow().sort_by("doc_id")
    texts, toxic = got["segments"].to_pylist(), got["toxic"].to_pylist()
    del got
    net = fit(texts, toxic)
    del texts
    give_back()
    return net


def with_score(docs: DataFrame, net: Network, text: str = "text", score: str = "score") -> DataFrame:
    """All columns and the score of each row's text."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(net)  # bounded by its layout
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                scorer = scorer or Scorer(shared.value)
                i = part.schema.get_field_index(text)
                got = scorer.scores([t or "" for t in part.column(i).to_pylist()])
                yield part.append_column(score, pa.array(got, pa.float64()))
        del scorer
        give_back()

    return docs.mapInArrow(work, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs, table(spark, sf_dir, "labels"))
    out = with_score(docs.select("doc_id", text_or_empty().alias("text")), net)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
