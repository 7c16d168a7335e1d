"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. Each node has a failure link and the number of tokens that greedy longest-match pops on
the way to it, so a word's count is one walk over its bytes: no piece is built, no byte is read twice. A word is a stretch
between white space with one space before it, as byte-level vocabularies write word starts; the space belongs to the word.

Cases: null and empty texts have no words; words of any length take linear time; equal texts have equal counts; a byte that
no token covers counts as a token of its own; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from canopy.llm.bpe import byte_alphabet, default_vocabulary
from canopy.llm.common import table, text_or_empty

#: Words whose counts a Python worker keeps; the table is emptied when full.
KEPT = 500_000


class Automaton:
    """step: node * 256 + byte -> node; fail: where to go on when there is no step; popped: tokens that leaving a node so yields."""

    def __init__(self, tokens: list[bytes]):
        whole = {bytes([b]) for b in range(256)} | {t for t in tokens if t}
        self.step: dict[int, int] = {}
        ends = [False]
        for t in whole:
            at = 0
            for b in t:
                key = at * 256 + b
                if key not in self.step:
                    self.step[key] = len(ends)
                    ends.append(False)
                at = self.step[key]
            ends[at] = True
        below: list[list[tuple[int, int]]] = [[] for _ in ends]
        for key, to in self.step.items():
            below[key >> 8].append((key & 255, to))
        self.fail, self.popped = [0] * len(ends), [0] * len(ends)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for b, v in below[u]:
                queue.append(v)
                if ends[v]:
                    self.fail[v], self.popped[v] = 0, 1
                    continue
                # u was left with popped[u] tokens and stands at fail[u]; go on until b can be read there
                z, n = self.fail[u], self.popped[u]
                while z * 256 + b not in self.step:
                    n += self.popped[z]
                    z = self.fail[z]
                self.fail[v], self.popped[v] = self.step[z * 256 + b], n

    def count(self, data: bytes) -> int:
        step, fail, popped = self.step, self.fail, self.popped
        u = n = 0
        for b in data:
            to = step.get(u * 256 + b)
            while to is None:
                n += popped[u]
                u = fail[u]
                to = step.get(u * 256 + b)
            u = to
        while u:
            n += popped[u]
            u = fail[u]
        return n


class Counter(dict):
    """Counts by word."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(b" " + word.encode("utf-8"))
        if len(word) <= 64:
            if len(self) >= KEPT:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=2)
def load(path: str) -> Counter:
    alphabet = byte_alphabet()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return Counter(Automaton([bytes(alphabet[c] for c in t) for t in vocab]))


def token_counts(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_words and n_tokens of every row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(vocabulary or default_vocabulary())
        for b in batches:
            words, tokens = [], []
            for t in b.column(1):
                own = t.as_py().split()
                words.append(len(own))
                tokens.append(sum(map(counter.__getitem__, own)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[key, "n_words", "n_tokens"])

    return docs.select(key, text_or_empty(text).alias("text")).mapInArrow(work, f"{key} {docs.schema[key].dataType.simpleString()}, n_words long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
