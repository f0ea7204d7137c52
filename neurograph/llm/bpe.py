"""Operator 6, byte-level BPE encoding and decoding in numpy matrices.

Words (matches of the pattern) of a batch that weren't seen before become rows of matrices, one for each class of lengths, padded with -1. Each
round every row merges its leftmost pair of least rank; ranks of pairs come from an open-addressing hash table; rows without a pair that
merges leave, and the others are moved together. Words beyond ``LONGEST`` bytes take the same merges with a heap, as a row of a matrix would
cost the square of its length.

Defined results: a null text is an empty one (no ids, and no bytes when decoded); special tokens are ordinary text; repeated texts give equal
ids; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from neurograph.llm.chunks import Remembered
from neurograph.llm.common import map_batches

#: Bytes of the words of each matrix at most.
BUCKETS = (4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)
LONGEST = BUCKETS[-1]
NONE = np.int32(2**31 - 1)
_HASH = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> id of the pair, which is also its rank: open addressing with linear probes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] < 0
            self.keys[at[left[free]]] = keys[left[free]]  # of several for one place the last stays
            won = self.keys[at[left]] == keys[left]
            self.values[at[left[won]]] = values[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _HASH) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of the pairs, NONE where a pair doesn't merge or has padding."""
        keys = (a.astype(np.int64) << 32) | (b.astype(np.int64) & 0xFFFFFFFF)
        keys[(a < 0) | (b < 0)] = -2
        out, at, left = np.full(len(keys), NONE, np.int32), self._home(keys), np.flatnonzero(keys >= 0)
        while len(left):
            seen = self.keys[at[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (seen >= 0)]
            at[left] = (at[left] + 1) & self.mask
        return out


class BytePairs:
    """A vocabulary of ranks with its pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.single = np.array([ranks[bytes([k])] for k in range(256)], np.int32)
        tokens = [b""] * (max(ranks.values()) + 1)
        keys, values = [], []
        for token, rank in ranks.items():
            tokens[rank] = token
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    keys.append((a << 32) | b)
                    values.append(rank)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int32))
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.words: dict[str, bytes] = {}
        self.memory = Remembered(self._pieces)

    @classmethod
    def load(cls, path: str, pattern: str) -> BytePairs:
        lines = Path(path).read_bytes().splitlines()
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each of ``words``, which aren't empty."""
        out: list[np.ndarray | None] = [None] * len(words)
        sizes, begin = np.fromiter(map(len, words), np.int64, len(words)), 0
        for width in BUCKETS:
            rows = np.flatnonzero((sizes > begin) & (sizes <= width))
            begin = width
            for k in range(0, len(rows), 1 << 16):
                self._rounds(rows[k : k + (1 << 16)], words, sizes, width, out)
        for k in np.flatnonzero(sizes > LONGEST):
            out[k] = self._heap(words[k])
        return out

    def _rounds(self, rows: np.ndarray, words: list[bytes], sizes: np.ndarray, width: int, out: list) -> None:
        if not len(rows):
            return
        raw = np.frombuffer(b"".join(words[r].ljust(width, b"\0") for r in rows), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < sizes[rows, None], self.single[raw], np.int32(-1))
        rank = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), width - 1) if width > 1 else np.zeros((len(ids), 0), np.int32)
        while len(rows):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            least = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), NONE)
            live = least < NONE
            for r, line in zip(rows[~live], ids[~live], strict=True):
                out[r] = line[line >= 0]
            if not live.any():
                return
            rows, ids, rank, at, least = rows[live], ids[live], rank[live], at[live], least[live]
            n, w = ids.shape
            line = np.arange(n)
            ids[line, at] = least
            keep = np.arange(w) != (at + 1)[:, None]
            ids = ids[keep].reshape(n, w - 1)
            rank = rank[keep[:, 1:]].reshape(n, w - 2)  # the merged pair's own rank goes
            for shift in (-1, 0):
                p = at + shift
                ok = np.flatnonzero((p >= 0) & (p < w - 2))
                if len(ok):
                    rank[ok, p[ok]] = self.pairs.find(ids[ok, p[ok]], ids[ok, p[ok] + 1])

    def _heap(self, word: bytes) -> np.ndarray:
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tokens: list[bytes | None] = [bytes([c]) for c in word]
        heap = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < n and (r := self.ranks.get(tokens[k] + tokens[after[k]])) is not None:
                heapq.heappush(heap, (r, k, tokens[k], tokens[after[k]]))

        for k in range(n - 1):
            offer(k)
        while heap:
            r, k, left, right = heapq.heappop(heap)
            if tokens[k] != left or after[k] >= n or tokens[after[k]] != right:
                continue
            gone = after[k]
            tokens[k], ids[k], tokens[gone], after[k] = left + right, r, None, after[gone]
            if after[k] < n:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return np.array([i for i, t in zip(ids, tokens, strict=True) if t is not None], np.int32)

    def _pieces(self, new: list[str]) -> list[bytes]:
        if len(self.words) > self.memory.most:
            self.words.clear()
        split = [self.pattern.findall(p) for p in new]
        unseen = list({w for s in split for w in s} - self.words.keys())
        hard = []
        for w in unseen:
            if (whole := self.ranks.get(w.encode())) is not None:
                self.words[w] = whole.to_bytes(4, "little")
            else:
                hard.append(w)
        self.words.update((w, ids.astype("<u4").tobytes()) for w, ids in zip(hard, self.merge([w.encode() for w in hard]), strict=True))
        return [b"".join(map(self.words.__getitem__, s)) for s in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes."""
        return self.memory.ids(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> BytePairs:
    """Loaded once in each worker."""
    return BytePairs.load(path, pattern)


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode_column(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for b in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in v.encode(_texts(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return map_batches(df.select(key, text), run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def decode_column(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text string) from ids; bytes that aren't UTF-8 are replaced; an id beyond the vocabulary raises an error; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for b in batches:
            out = [None if x is None else v.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], [key, "text"])

    return map_batches(df.select(key, ids), run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")


def digest(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for b in batches:
            ids = v.encode(_texts(b.column(1)))
            back = [v.decode(np.frombuffer(x, "<u4")) for x in ids]
            hexed = [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (ids, back)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), *hexed], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(df.select(key, text), run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
