"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols are the leaves' left neighbours: leaf i of the tree holds (rank, i) of the pair that starts at symbol
i, each inner node the least of its children. The root is therefore the leftmost pair of the lowest rank. A merge
replaces symbol i, unlinks its right neighbour and updates three leaves with the nodes above them, until the root
holds no mergeable pair.

Words of a batch that have about the same length are merged together, a tree in each row of an array; each step takes
one merge in every word that still has one. Longer words use the same tree one by one. Worker processes remember the
words and stretches between spaces that they have seen, up to CACHE_WORDS of either or what one slice of rows holds.

``encode`` equals the tokenizers library on vocabularies with a word-end suffix, NFC and lower case; special tokens in
a text keep their ids. ``decode`` is its decode without a decoder: tokens joined by one space. Null texts count as
empty and have no ids. Repeated rows, null ids and other columns need no care: rows are independent of each other.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 500_000
SLICE_ROWS = 512
LONG_WORD = 63

# The vocabulary's split pattern, and Unicode white space as its normaliser takes it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_NOT_SPACE = re.compile(f"[^{SPACE}]+")
_SEPARATOR = re.compile("[\\x1c-\\x1f]")

NONE = np.int64(1) << 40


class SegmentTree:
    """Least values over a fixed number of leaves; point updates and the root's value."""

    def __init__(self, leaves: list[int], none: int):
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.node = [none] * self.size + leaves + [none] * (self.size - len(leaves))
        for i in range(self.size - 1, 0, -1):
            self.node[i] = min(self.node[2 * i], self.node[2 * i + 1])

    def root(self) -> int:
        return self.node[1]

    def set(self, leaf: int, value: int) -> None:
        i, node = leaf + self.size, self.node
        node[i] = value
        while i > 1:
            i >>= 1
            least = min(node[2 * i], node[2 * i + 1])
            if node[i] == least:
                break
            node[i] = least


class Bpe:
    def __init__(self, vocabulary: str):
        import regex

        with open(vocabulary, encoding="utf-8") as file:
            model = json.load(file)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        self.suffix = model["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.tokens = [""] * (1 + max(max(vocab.values()), *self.special.values()))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.vocab = vocab
        pairs = sorted((vocab[a] << 32 | vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(merges))
        self.pairs = {key: (rank, merged) for key, rank, merged in pairs}
        self.keys = np.array([p[0] for p in pairs], np.int64)
        self.ranks = np.array([p[1] for p in pairs], np.int64)
        self.merged = np.zeros(len(pairs), np.int64)
        self.merged[self.ranks] = [p[2] for p in pairs]
        # A hash table of the pairs: two places a pair, so that a look-up takes no search.
        self.bits = 18
        self.table = self._hash_table()
        self.split = regex.compile(SPLIT)
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in set(own)]
        self.letters = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.inner = {b: vocab.get(c) for b, c in self.letters.items()}
        self.last = {b: vocab.get(c + self.suffix) for b, c in self.letters.items()}
        if None in [*self.inner.values(), *self.last.values()]:
            raise ValueError("the vocabulary lacks a byte")
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, str] = {}
        self.words: dict[str, tuple[str, str]] = {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _hash_table(self) -> np.ndarray:
        """Open addressing: each key's place in ``keys`` at its slot or the next free ones; -1 is free."""
        table = np.full((1 << self.bits) + 64, -1, np.int64)
        for place, slot in enumerate(self._slot(self.keys).tolist()):
            while table[slot] >= 0:
                slot += 1
            table[slot] = place
        return table

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; NONE for pairs that don't merge and for missing symbols (-1)."""
        key = np.where((left >= 0) & (right >= 0), left << 32 | right, np.int64(-1))
        slot, out = self._slot(key), np.full(len(key), NONE)
        todo = np.arange(len(key))
        while len(todo):
            place = self.table[slot[todo]]
            hit = (place >= 0) & (self.keys[place] == key[todo])
            out[todo[hit]] = self.ranks[place[hit]]
            todo = todo[(place >= 0) & ~hit]
            slot[todo] += 1
        return out

    def symbols(self, word: str) -> list[int]:
        """A word's first symbols: its bytes, the last one with the word-end suffix."""
        data = word.encode()
        return [*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]]

    def merge_one(self, symbols: list[int]) -> list[int]:
        n, none = len(symbols), 1 << 62
        if n < 2:
            return symbols
        width = max(1, (n - 1).bit_length())
        pairs = self.pairs

        def leaf(i: int, j: int) -> int:
            found = pairs.get(symbols[i] << 32 | symbols[j]) if 0 <= i and j < n else None
            return none if found is None else found[0] << width | i

        tree = SegmentTree([leaf(i, i + 1) for i in range(n - 1)], none)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := tree.root()) != none:
            i = root & ((1 << width) - 1)
            j = after[i]
            symbols[i] = pairs[symbols[i] << 32 | symbols[j]][1]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            if j < n - 1:
                tree.set(j, none)
            tree.set(i, leaf(i, k) if k < n else none)
            if (h := before[i]) >= 0:
                tree.set(h, leaf(h, i))
        return [s for s in symbols if s >= 0]

    def merge_many(self, rows: list[list[int]]) -> list[list[int]]:
        """merge_one() of many short words at once."""
        out: list[list[int]] = [[]] * len(rows)
        by_size: dict[int, list[int]] = {}
        for r, symbols in enumerate(rows):
            if len(symbols) < 2:
                out[r] = symbols
            elif len(symbols) > LONG_WORD:
                out[r] = self.merge_one(symbols)
            else:
                by_size.setdefault(max(4, 1 << len(symbols).bit_length()), []).append(r)
        for size, group in by_size.items():
            for at in range(0, len(group), 20_000):
                part = group[at : at + 20_000]
                for r, merged in zip(part, self._forest([rows[r] for r in part], size), strict=True):
                    out[r] = merged
        return out

    def _forest(self, rows: list[list[int]], size: int) -> list[list[int]]:
        n, width = len(rows), size.bit_length() - 1  # a row has fewer symbols than leaves; the last leaf stays empty
        lengths = np.array([len(r) for r in rows])
        symbol = np.full((n, size), -1, np.int64)
        symbol[np.arange(size) < lengths[:, None]] = np.fromiter((s for r in rows for s in r), np.int64, int(lengths.sum()))
        after = np.tile(np.arange(1, size + 1), (n, 1))
        after[:, -1] = size - 1
        before = np.tile(np.arange(-1, size - 1), (n, 1))  # -1 is the empty last leaf too
        tree = np.full((n, 2 * size), NONE << 8)
        ranks = self.rank(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(n, size - 1)
        tree[:, size : 2 * size - 1] = np.where(ranks < NONE, ranks << width | np.arange(size - 1), NONE << 8)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            i, rank = root & (size - 1), root >> width
            j = after[live, i]
            k, h = after[live, j], before[live, i]
            symbol[live, i] = new = self.merged[rank]
            symbol[live, j] = -1
            after[live, i] = k
            before[live, k] = i
            left, right = symbol[live, h], symbol[live, k]
            first, second = self.rank(new, right), self.rank(left, new)
            tree[live, size + j] = NONE << 8
            tree[live, size + i] = np.where(first < NONE, first << width | i, NONE << 8)
            has = h >= 0
            tree[live[has], size + h[has]] = np.where(second[has] < NONE, second[has] << width | h[has], NONE << 8)
            rows3, node = np.concatenate([live, live, live[has]]), np.concatenate([i, j, h[has]]) + size
            for _ in range(width):
                node = node >> 1
                tree[rows3, node] = np.minimum(tree[rows3, 2 * node], tree[rows3, 2 * node + 1])
            live = live[tree[live, 1] < NONE]
        keep = symbol >= 0
        ends = np.cumsum(keep.sum(axis=1)).tolist()
        flat = symbol[keep].tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    # --- Texts ---

    def _parts(self, text: str) -> list[str | int]:
        """The stretches between special tokens, normalised, with those tokens' ids."""
        if self.marks is not None and "<|" in text and self.marks.search(text):
            return [self.special[p] if p in self.special else self._normal(p) for p in self.marks.split(text) if p]
        return [self._normal(text)]

    @staticmethod
    def _normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # without the final form
        return text.lower()

    @staticmethod
    def _chunks(text: str) -> list[str]:
        return _NOT_SPACE.findall(text) if _SEPARATOR.search(text) else text.split()

    def learn(self, chunks: set[str]) -> None:
        """Remember ids, as text, and decoded text of stretches without white space."""
        names = list(chunks)
        split = [self.split.findall(c) for c in names]
        unknown = list({w for words in split for w in words}.difference(self.words))
        if len(self.words) + len(unknown) > CACHE_WORDS:
            self.words.clear()
            unknown = list({w for words in split for w in words})
        tokens = self.tokens
        for word, own in zip(unknown, self.merge_many([self.symbols(w) for w in unknown]), strict=True):
            self.words[word] = (" ".join(map(str, own)), " ".join([tokens[i] for i in own]))
        for name, words in zip(names, split, strict=True):
            if len(words) == 1:
                self.ids[name], self.decoded[name] = self.words[words[0]]
            else:
                found = [e for w in words if (e := self.words[w])[0]]
                self.ids[name], self.decoded[name] = " ".join([e[0] for e in found]), " ".join([e[1] for e in found])

    def coded(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """Each text's ids, as text, and what they decode to."""
        split: list[list[str | list[str]]] = []
        for text in texts:
            split.append([p if isinstance(p, int) else self._chunks(p) for p in self._parts(text)] if text else [])
        known = self.ids
        unknown = {c for parts in split for p in parts if not isinstance(p, int) for c in p if c not in known}
        if len(known) + len(unknown) > CACHE_WORDS:  # the memory starts anew, with all that this slice needs
            self.ids.clear()
            self.decoded.clear()
            unknown = {c for parts in split for p in parts if not isinstance(p, int) for c in p}
        if unknown:
            self.learn(unknown)
        ids, decoded, out = self.ids.__getitem__, self.decoded.__getitem__, []
        for parts in split:
            a, b = [], []
            for p in parts:
                if isinstance(p, int):
                    a.append(str(p))
                    b.append(self.tokens[p])
                elif p:
                    found = " ".join(map(ids, p))
                    a.append(found)
                    b.append(" ".join(map(decoded, p)))
            out.append((" ".join(a), " ".join(b)))
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [list(map(int, a.split())) for a, _ in self.coded(texts)]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.tokens[i] for i in ids])

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Per text: how many ids, sha256 of the ids as text, sha256 of the decoded text."""
        digest = hashlib.sha256
        return [(a.count(" ") + 1 if a else 0, digest(a.encode()).hexdigest(), digest(b.encode()).hexdigest()) for a, b in self.coded(texts)]


@functools.lru_cache(maxsize=2)
def bpe(vocabulary: str) -> Bpe:
    """One encoder for each Python worker, kept over its tasks."""
    return Bpe(vocabulary)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every text."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bpe(vocabulary).encode(part.column(1).to_pylist()), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids; null ids give an empty text."""

    def run(batches):
        for batch in batches:
            own = bpe(vocabulary)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return coded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded and decoded, as digests."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                n, ids, decoded = zip(*bpe(vocabulary).digests(part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
