"""Byte-level BPE: encoding through a segment tree over adjacent pair ranks, and decoding.

A pre-token starts as its bytes. The leaves of a segment tree hold the merge rank of each symbol with its right
neighbour; each inner node holds the least rank below it, the left one on ties, so the root names the leftmost
lowest-rank merge. A merge changes three leaves, each a logarithmic update, until the root has no mergeable pair.
A pre-token of n bytes costs O(n log n), however long it is.

Pieces of text between single spaces recur, so their ids are kept in a table of bounded size; a piece whose edges touch
further white space is encoded with its surroundings, because white space runs are split by what follows them.

Cases: null is the empty text, which has no tokens; texts of any length are encoded whole; equal texts give equal ids;
an empty table gives an empty result; further columns are not read, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from canopy.llm.common import give_back, table, text_or_empty

#: The pre-token pattern of the public byte-level vocabularies.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces and pre-tokens whose ids a Python worker keeps; the table is emptied when full.
KEPT = 80_000
#: Texts that are encoded together.
TEXTS_AT_ONCE = 128
NO_MERGE = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTree:
    """Least rank over adjacent pairs, leftmost on ties."""

    __slots__ = ("size", "node")

    def __init__(self, ranks: list[int]):
        self.size = 1
        while self.size < len(ranks):
            self.size *= 2
        self.node = [NO_MERGE] * self.size + ranks + [NO_MERGE] * (self.size - len(ranks))
        node = self.node
        for i in range(self.size - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a <= b else b

    def put(self, at: int, rank: int) -> None:
        node, i = self.node, self.size + at
        node[i] = rank
        i >>= 1
        while i:
            a, b = node[2 * i], node[2 * i + 1]
            least = a if a <= b else b
            if node[i] == least:
                break
            node[i] = least
            i >>= 1

    def leftmost(self) -> int:
        """The first leaf that holds the root's rank."""
        node, i = self.node, 1
        least = node[1]
        while i < self.size:
            i = 2 * i if node[2 * i] == least else 2 * i + 1
        return i - self.size


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        raw = {token: bytes(alphabet[c] for c in token) for token in vocab}
        self.bytes_of: dict[int, bytes] = {i: raw[token] for token, i in vocab.items()}
        self.of_byte = [0] * 256
        for token, i in vocab.items():
            if len(raw[token]) == 1:
                self.of_byte[raw[token][0]] = i
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.at_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pre = regex.compile(PRE_TOKEN)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self._tables()

    def _tables(self) -> None:
        """The merges as an open-addressed table, and the tokens' bytes end to end."""
        self.n_ids = max(self.bytes_of) + 1
        self.byte_ids = np.array(self.of_byte, np.int64)
        self.mask = (1 << (8 * len(self.merges)).bit_length()) - 1
        self.slot_key, self.slot_rank = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int64)
        self.merged_id = np.zeros(max((r for r, _ in self.merges.values()), default=0) + 1, np.int64)
        for (a, b), (rank, i) in self.merges.items():
            key = a * self.n_ids + b
            slot = (key * 0x9E3779B1 >> 7) & self.mask
            while self.slot_key[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.slot_key[slot], self.slot_rank[slot], self.merged_id[rank] = key, rank, i
        parts = [self.bytes_of.get(i, b"") for i in range(self.n_ids)]
        self.token_size = np.fromiter(map(len, parts), np.int64, self.n_ids)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(parts), np.uint8)

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        ids = [self.of_byte[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        tree = PairTree([merges.get(pair, (NO_MERGE,))[0] for pair in zip(ids, ids[1:], strict=False)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while tree.node[1] < NO_MERGE:
            i = tree.leftmost()
            j = after[i]
            ids[i] = merges[ids[i], ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                tree.put(j, NO_MERGE)
            if k < n:
                before[k] = i
                tree.put(i, merges.get((ids[i], ids[k]), (NO_MERGE,))[0])
            else:
                tree.put(i, NO_MERGE)
            h = before[i]
            if h >= 0:
                tree.put(h, merges.get((ids[h], ids[i]), (NO_MERGE,))[0])
        return [i for i in ids if i >= 0]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        Python's cycle collector rests meanwhile: nothing made here holds cycles, and it would scan the tables again and again.
        """
        resting = gc.isenabled()
        gc.disable()
        try:
            if not self.special:
                return self._encode_plain(texts)
            parts: list[list] = []
            for text in texts:
                own, at = [], 0
                if any(s in text for s in self.special):
                    for m in self.at_special.finditer(text):
                        own += [text[at : m.start()], self.special[m[0]]]
                        at = m.end()
                parts.append([*own, text[at:] if at else text])
            ids = iter(self._encode_plain([p for own in parts for p in own if isinstance(p, str)]))
            return [b"".join([next(ids) if isinstance(p, str) else p.to_bytes(4, "little") for p in own]) for own in parts]
        finally:
            if resting:
                gc.enable()

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without special tokens.

        No pre-token crosses the place before a single space between visible characters, so texts are cut there. A piece that
        begins or ends with white space, or is empty, shows that a space stood beside more white space: its text is cut by the pattern.
        """
        known, words = self.pieces, self.words
        first, rest, unknown = [], [], set()
        for text in texts:
            head, *tail = text.split(" ")
            first.append(head)
            rest.append(tail)
            unknown.update(tail)
        unknown.difference_update(known)
        odd = {p for p in unknown if not p or p[0].isspace() or p[-1].isspace()}
        unknown -= odd
        slow = [bool(r) and (not h or h[-1].isspace() or not odd.isdisjoint(r)) for h, r in zip(first, rest, strict=True)] if odd else [bool(r) and (not h or h[-1].isspace()) for h, r in zip(first, rest, strict=True)]
        find = self.pre.findall
        heads = [find(t if s else h) for t, h, s in zip(texts, first, slow, strict=True)]
        split = {p: find(" " + p) for p in unknown}
        new = {w for some in (split.values(), heads) for parts in some for w in parts}
        new.difference_update(words)
        self._learn(new)
        for p, parts in split.items():
            known[p] = words[parts[0]] if len(parts) == 1 else b"".join([words[w] for w in parts])
        get, word = known.__getitem__, words.__getitem__
        out = [b"".join(map(word, h)) + (b"" if s else b"".join(map(get, r))) for h, r, s in zip(heads, rest, slow, strict=True)]
        if len(known) > KEPT:
            known.clear()
        if len(words) > KEPT:
            words.clear()
        return out

    def _learn(self, new: set[str]) -> None:
        """Fill the table of pre-tokens."""
        words = self.words
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in new:
            data = w.encode("utf-8")
            size = max(8, 1 << (len(data) - 1).bit_length())
            if size > 64 or len(new) < 100:
                words[w] = b"".join([i.to_bytes(4, "little") for i in self.merge(data)])
            else:
                by_size.setdefault(size, []).append((w, data))
        for size, some in by_size.items():
            for at in range(0, len(some), 4096):
                part = some[at : at + 4096]
                words.update(zip([w for w, _ in part], self.merge_many([d for _, d in part], size), strict=True))

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids, NO_MERGE where there is none."""
        key = a.astype(np.int64) * self.n_ids + b
        slot = (key * 0x9E3779B1 >> 7) & self.mask
        rank = np.full(len(key), NO_MERGE, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            there = self.slot_key[slot]
            hit = there == key
            rank[todo[hit]] = self.slot_rank[slot[hit]]
            go = ~hit & (there >= 0)
            todo, key, slot = todo[go], key[go], (slot[go] + 1) & self.mask
        return rank

    def merge_many(self, words: list[bytes], size: int) -> list[bytes]:
        """The ids of many pre-tokens of at most `size` bytes: one segment tree a row, all rows merging side by side."""
        n_words = len(words)
        length = np.fromiter(map(len, words), np.int64, n_words)
        filled = np.arange(size)[None, :] < length[:, None]
        ids = np.full((n_words, size), -1, np.int64)
        ids[filled] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        node = np.full((n_words, 2 * size), NO_MERGE, np.int64)
        pair = filled[:, 1:]
        leaves = node[:, size:-1]
        leaves[pair] = self.rank_of(ids[:, :-1][pair], ids[:, 1:][pair])
        width = size
        while width > 1:
            half = width // 2
            node[:, half:width] = np.minimum(node[:, width : 2 * width : 2], node[:, width + 1 : 2 * width : 2])
            width = half
        after = np.tile(np.arange(1, size + 1), (n_words, 1))
        before = np.tile(np.arange(-1, size), (n_words, 1))
        flat_node, flat_ids, flat_after, flat_before = node.reshape(-1), ids.reshape(-1), after.reshape(-1), before.reshape(-1)
        levels = size.bit_length() - 1
        rows = np.flatnonzero(node[:, 1] < NO_MERGE)
        while len(rows):
            base = rows * 2 * size
            least = flat_node[base + 1]
            i = np.ones(len(rows), np.int64)
            for _ in range(levels):
                i *= 2
                i += flat_node[base + i] != least
            i -= size
            at = rows * size
            j = flat_after[at + i]
            merged = self.merged_id[least]
            flat_ids[at + i] = merged
            flat_ids[at + j] = -1
            k = flat_after[at + j]
            flat_after[at + i] = k
            flat_before[rows * (size + 1) + k] = i
            h = flat_before[rows * (size + 1) + i]
            flat_node[base + size + j] = NO_MERGE
            right = k < length[rows]
            rank = np.full(len(rows), NO_MERGE, np.int64)
            rank[right] = self.rank_of(merged[right], flat_ids[(at + k)[right]])
            flat_node[base + size + i] = rank
            left = h >= 0
            flat_node[(base + size + h)[left]] = self.rank_of(flat_ids[(at + h)[left]], merged[left])
            h = np.where(left, h, i)
            for level in range(1, levels + 1):
                for leaf in (i, j, h):
                    up = (leaf + size) >> level
                    flat_node[base + up] = np.minimum(flat_node[base + 2 * up], flat_node[base + 2 * up + 1])
            rows = rows[flat_node[base + 1] < NO_MERGE]
        kept = ids >= 0
        flat = ids[kept].astype("<u4").tobytes()
        ends = (np.cumsum(kept.sum(1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def decode_batch(self, many: list[bytes]) -> list[str]:
        """The texts of id sequences; bytes that are no UTF-8 become U+FFFD."""
        ids = np.frombuffer(b"".join(many), "<u4").astype(np.int64)
        size = self.token_size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        data = self.token_bytes[np.repeat(self.token_start[ids] - (ends - size), size) + np.arange(total)].tobytes()
        cuts = np.cumsum([len(m) // 4 for m in many])
        to = np.concatenate([[0], ends])[cuts].tolist() if many else []
        return [data[a:b].decode("utf-8", "replace") for a, b in zip([0, *to[:-1]], to, strict=True)]

    def decode(self, ids: bytes) -> str:
        return self.decode_batch([ids])[0]


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(docs: DataFrame, vocabulary: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key`, ids (binary, little-endian unsigned 32-bit) and the decoded text of every row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary or default_vocabulary())
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                ids = bpe.encode_batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(bpe.decode_batch(ids), pa.string())], names=[key, "ids", "decoded"])
            give_back()

    return docs.select(key, text_or_empty(text).alias("text")).mapInArrow(work, f"{key} {docs.schema[key].dataType.simpleString()}, ids binary, decoded string")


def token_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text; ids and texts stay in the task that made them."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary or default_vocabulary())
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                ids = bpe.encode_batch(part.column(1).to_pylist())
                of_ids = [hashlib.sha256(i).hexdigest() for i in ids]
                of_text = [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in bpe.decode_batch(ids)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            give_back()

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))
