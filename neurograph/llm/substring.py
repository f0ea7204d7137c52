"""Operator 9, substring dedup: Rabin-Karp hashes of windows of 50 words, counted in Spark.

A word that is covered by a window whose word sequence also starts in a document of a smaller doc_id is removed; neighbouring windows merge into
maximal removal intervals.

Windows that can't repeat aren't shuffled: the least hash of the 8-word grams inside a window (its anchor) is the same for equal windows, and
one in about twenty words is an anchor. Spark counts anchors first; every window whose anchor lies in two documents is then hashed and
counted by (anchor, hash), 128 bits. Nothing is lost by this, and windows of text that occurs once are never sent. Documents of equal words are one
row before all that: the copies of larger doc_id repeat wholly.

Defined results: null and empty texts have no words; texts of fewer words than a window lose nothing; rows that share a doc_id don't
repeat each other, and each is judged by itself; rows with a null doc_id lose nothing and remove nothing; an empty table gives an empty result; extra
columns are ignored by ``digest`` and kept by ``strip``.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurograph.llm.common import WordHashes, forget, free_name, map_batches, materialize, raw_bytes

WINDOW, GRAM = 50, 8
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM_BASE = 0xD6E8FEB86659FD93 | 1
_GRAM_INVERSE = pow(_GRAM_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class Powers:
    """Powers of a base and of its inverse, modulo 2**64, for texts of any length."""

    def __init__(self, base: int, inverse: int):
        self.base, self.inverse, self.n = base, inverse, 0

    def rolling(self, h: np.ndarray, size: int) -> np.ndarray:
        """Rabin-Karp hash of every run of ``size`` of ``h``: differences of the weighted prefix sums, shifted back to the run's start."""
        if len(h) >= self.n:
            self.n = max(4096, 2 * len(h))
            self.up, self.down = _powers(self.base, self.n), _powers(self.inverse, self.n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.up[: len(h)], dtype=np.uint64)])
        out = (sums[size:] - sums[:-size]) * self.down[: len(h) - size + 1]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0x9FB21C651E98DF25)
        return out ^ (out >> np.uint64(29))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Least of every run of ``size``, in three passes whatever the size."""
    n = len(x) - size + 1
    blocks = -(-len(x) // size)
    padded = np.full(blocks * size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, size)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[size - 1 : size - 1 + n])


class Hasher:
    """Word hashes, anchors and window hashes of texts; lives as long as a task."""

    def __init__(self):
        self.words, self.grams, self.windows = WordHashes(), Powers(_GRAM_BASE, _GRAM_INVERSE), Powers(_BASE, _INVERSE)

    def anchors(self, h: np.ndarray) -> np.ndarray:
        """The anchor of each window."""
        return sliding_min(self.grams.rolling(h, GRAM), WINDOW - GRAM + 1)


def covered(n: int, starts: np.ndarray) -> np.ndarray:
    """Which of n words lie in the windows at ``starts``."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return np.cumsum(edges[:n]) > 0


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of a mask as (begin, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _mark(words: list[bytes]) -> tuple[bytes, int]:
    """SHA-256 of the joined words, and 32 bits that tell rows of one doc_id apart."""
    sha = hashlib.sha256(b" ".join(words)).digest()
    return sha, zlib.crc32(sha) - (1 << 31)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, n_words, sha, whole) of every row, ``whole`` if all its words repeat as it is a copy; and (doc_id, mark, starts), the
    starts of the other rows' repeated windows."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            n, marks, shas, anchors = [], [], [], []
            for x in raw_bytes(b.column(1)):
                words = (x or b"").split()
                sha, mark = _mark(words)
                n.append(len(words))
                marks.append(mark)
                shas.append(sha)
                anchors.append(np.unique(hasher.anchors(hasher.words.of(words))).view(np.int64) if len(words) >= WINDOW else np.zeros(0, np.int64))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(a) for a in anchors])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks, pa.int32()), pa.array(n, pa.int64()), pa.array(shas, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(anchors or [np.zeros(0, np.int64)])))], ["doc_id", "mark", "n_words", "sha", "anchors"])

    docs = docs.select(docs[key].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    seen = materialize(map_batches(docs, first, "doc_id bigint, mark int, n_words bigint, sha binary, anchors array<bigint>"), "anchors")
    known = seen.where("doc_id is not null")
    least = materialize(known.groupBy("sha").agg(F.min("doc_id").alias("least")), "copies")
    copies = least.select(F.col("sha").alias("s"), "least")
    rows = seen.drop("anchors").join(copies, F.col("sha") == F.col("s"), "left").select("doc_id", "mark", "n_words", "sha", F.coalesce((F.col("n_words") >= WINDOW) & (F.col("doc_id") > F.col("least")), F.lit(False)).alias("whole"))
    kept = known.where(F.col("n_words") >= WINDOW).join(least.select(F.col("sha").alias("s"), F.col("least").alias("l")), (F.col("sha") == F.col("s")) & (F.col("doc_id") == F.col("l")), "left_semi")
    anchors = kept.select("doc_id", "mark", F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select(F.col("anchor").alias("shared"))
    shared = materialize(shared, "shared")  # for the same reason as "twice" below: so that the join can split an anchor of many documents
    wanted = anchors.join(shared, F.col("anchor") == F.col("shared"), "left_semi").groupBy("doc_id", "mark").agg(F.collect_set("anchor").alias("anchors"))
    wanted = materialize(wanted.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "anchors"), "wanted")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            marks, lists = b.column("m").to_pylist(), b.column("anchors")
            for k, x in enumerate(raw_bytes(b.column("text"))):
                words = (x or b"").split()
                if len(words) < WINDOW or _mark(words)[1] != marks[k]:
                    continue
                h = hasher.words.of(words)
                anchor = hasher.anchors(h).view(np.int64)
                at = np.flatnonzero(np.isin(anchor, lists[k].values.to_numpy()))
                if len(at):
                    d = b.column("doc_id")[k].as_py()
                    cols = [pa.array(np.full(len(at), d, np.int64)), pa.array(np.full(len(at), marks[k], np.int32)), pa.array(at.astype(np.int32)), pa.array(anchor[at]), pa.array(hasher.windows.rolling(h, WINDOW)[at].view(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "mark", "at", "anchor", "hash"])

    texts = docs.join(wanted, F.col("doc_id") == F.col("d")).select("doc_id", "m", "anchors", "text")
    windows = materialize(map_batches(texts, second, "doc_id bigint, mark int, at int, anchor bigint, hash bigint"), "windows")
    twice = windows.groupBy("anchor", "hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select(F.col("anchor").alias("a"), F.col("hash").alias("h"), "lo")
    twice = materialize(twice, "twice")  # else the join would take the aggregate's partitions, in which a passage of many documents can't be split
    hit = windows.join(twice, (F.col("anchor") == F.col("a")) & (F.col("hash") == F.col("h")) & (F.col("doc_id") > F.col("lo")))
    starts = materialize(hit.groupBy("doc_id", "mark").agg(F.collect_set("at").alias("starts")), "starts")
    forget(shared, wanted, windows, twice)
    return rows, starts


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    rows, starts = repeats(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, m, at, x in zip(b.column("doc_id").to_pylist(), b.column("m").to_pylist(), b.column("starts"), raw_bytes(b.column("text")), strict=True):
                words = (x or b"").split()
                if _mark(words)[1] != m:
                    continue
                mask = covered(len(words), at.values.to_numpy())
                kept = b" ".join(w for w, gone in zip(words, mask.tolist(), strict=True) if not gone)
                out.append((d, m, int(mask.sum()), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.string()))], ["d", "m", "gone", "kept"])

    texts = docs.select(docs[key].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    cut = texts.join(starts.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "starts"), F.col("doc_id") == F.col("d")).select("doc_id", "m", "starts", "text")
    cut = map_batches(cut, run, "d bigint, m int, gone bigint, kept string").dropDuplicates(["d", "m"])
    rows = rows.join(cut, (F.col("doc_id") == F.col("d")) & (F.col("mark") == F.col("m")), "left")
    whole, nothing = F.col("whole"), hashlib.sha256(b"").hexdigest()
    return rows.select("doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("bigint").alias("n_removed"), F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept", F.lower(F.hex("sha")))).alias("kept_sha256"))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def remove_words(raw: bytes, mask: np.ndarray) -> bytes:
    """``raw`` without the masked words and the white space after them; the rest as it was."""
    if not mask.any():
        return raw
    spans = [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for a, b in intervals(mask):
        out.append(raw[at : spans[a][0]])
        at = spans[b][0] if b < len(spans) else len(raw)
    out.append(raw[at:])
    return b"".join(out).rstrip() if mask[-1] else b"".join(out)


def strip(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all rows and columns, with the repeated words removed from their texts."""
    rows, starts = repeats(docs, key, text)
    d, m, s, w = (free_name(docs, x) for x in ("d", "m", "starts", "whole"))
    empty = F.array().cast("array<int>")
    gone = rows.where("whole").select(F.col("doc_id").alias(d), F.col("mark").alias(m), empty.alias(s), F.lit(True).alias(w)).distinct()
    gone = gone.union(starts.select("doc_id", "mark", "starts", F.lit(False)))
    listed = gone.groupBy(d).agg(F.collect_list(F.struct(F.col(m).alias("m"), F.col(s).alias("s"), F.col(w).alias("w"))).alias(s)).withColumnRenamed(d, d)
    joined = docs.join(listed, docs[key] == listed[d], "left").select(*[docs[c] for c in docs.columns], s)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = raw_bytes(b.column(text))
            found = b.column(s)
            for k, valid in enumerate(found.is_valid().to_pylist()):
                if valid and texts[k] is not None:
                    words = texts[k].split()
                    mark = _mark(words)[1]
                    for e in found[k].as_py():
                        if e["m"] == mark:
                            mask = np.ones(len(words), bool) if e["w"] else covered(len(words), np.array(e["s"], np.int64))
                            texts[k] = remove_words(texts[k], mask)
                            break
            new = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([new if c == text else b.column(c) for c in names], names)

    return map_batches(joined, run, docs.schema)
