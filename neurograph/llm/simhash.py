"""Operator 4, SimHash near-dedup with pivot distance tables.

A fingerprint's Hamming distances to fixed reference fingerprints (the pivots) are computed once. By the triangle inequality two
fingerprints within r of each other differ by at most r in each of these coordinates, so a pair with a larger coordinate difference is discarded
without being compared; only survivors are compared bit by bit.

Two ways to use it:

* ``link`` finds every pair of 64-bit fingerprints at ``radius`` 2 or fewer bits. Pairs meet in buckets of fingerprints that agree in 2 of 4 blocks, as 2 bits
  can't spoil more; of the pairs of a bucket the pivot table discards nearly all, and what it leaves is compared. (Bands of pivot distances as part of the
  bucket's key were tried: distances to a pivot lie so close together that bands cost more copies than the pairs that they save.) Equal fingerprints are one
  row before that.
* ``near_duplicates`` (the pipeline's stage; 5-word shingles, Jaccard similarity 0.8 or more) needs wide fingerprints (1024 bits), as at that
  similarity 64 bits differ in about ten, which no exact bucket scheme can follow. There buckets are min-hash keys, and within a bucket the
  pivot table and the fingerprints name the groups, in which the sets of shingles decide.

Defined results: null and empty texts have no words and the fingerprint zero, linked like any other; texts of fewer words than a shingle
are one shingle; rows with a null id keep a fingerprint and get the component of its smallest id; an empty table gives an empty result;
extra columns are ignored by ``fingerprints`` and ``components_of`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurograph.llm.common import WordHashes, forget, free_name, map_batches, materialize, raw_bytes
from neurograph.llm.components import components

SEED = 42
_MASK = (1 << 64) - 1


def mixed(i: int) -> int:
    """The i-th of a fixed sequence of 64-bit numbers (SplitMix64)."""
    z = (i * 0x9E3779B97F4A7C15) & _MASK
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
    return z ^ (z >> 31)


def shingle_hashes(raw: bytes | None, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of ``size`` words, repeats included; of all words if there are fewer; none for no words."""
    words = (raw or b"").lower().split()
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else [], np.uint64)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -size] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the rows of ``h`` (n, w) have each of the 64 * w bits; by carry-save adders, so that whole words are added at once."""
    total = np.zeros(h.shape[1] * 64, np.int64)
    level, weight = [h], 1
    while level:
        a, carries = np.concatenate(level) if len(level) > 1 else level[0], []
        while len(a) > 2:
            t = len(a) // 3
            x, y, z = a[:t], a[t : 2 * t], a[2 * t : 3 * t]
            s = x ^ y
            carries.append((x & y) | (s & z))
            a = np.concatenate([s ^ z, a[3 * t :]])
        if len(a) == 2:
            carries.append(a[:1] & a[1:])
            a = a[:1] ^ a[1:]
        total += np.unpackbits(a.astype("<u8").view(np.uint8), bitorder="little").astype(np.int64) * weight
        level, weight = carries, weight * 2
    return total


def majority(h: np.ndarray) -> np.ndarray:
    """A bit is 1 if over half of the rows have it: (w,) of uint64; zero for no rows."""
    if not len(h):
        return np.zeros(h.shape[1], np.uint64)
    return np.packbits(2 * bit_counts(h) > len(h), bitorder="little").view("<u8").astype(np.uint64)


def fingerprint(raw: bytes | None, size: int = 3) -> int:
    return int(majority(shingle_hashes(raw, size)[:, None])[0])


def fingerprints(docs: DataFrame, size: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp bigint), fp the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x, size) for x in raw_bytes(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return map_batches(docs.select(key, text), run, f"doc_id {docs.schema[key].dataType.simpleString()}, fp bigint")


def pivot_distances(fp: Column, pivots: int) -> Column:
    """The pivot table's row: distances to the pivots, one byte each."""
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(_signed(mixed(k + 1))))).cast("byte") for k in range(pivots)])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(blocks: int, radius: int) -> list[int]:
    """For each choice of ``blocks - radius`` of the blocks that a fingerprint is cut into, the mask of their bits."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    one = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [_signed(sum(one[k] for k in c)) for c in combinations(range(blocks), blocks - radius)]


def candidates(distinct: DataFrame, radius: int = 2, blocks: int = 4, block: int = 2048) -> DataFrame:
    """(choice, bits, parts, mine, unit, fp): the buckets that hold two fingerprints or more. A bucket is a choice of blocks in which fingerprints agree: of 4
    blocks at least 2 do. Buckets of over ``block`` rows are dealt to parts; each two parts meet in one ``unit``, so no task holds over two parts of a bucket."""
    kinds = F.array(*[F.struct(F.lit(n).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for n, m in enumerate(_masks(blocks, radius))])
    keyed = distinct.select("fp", F.explode(kinds).alias("k")).select("fp", "k.choice", "k.bits")
    shared = keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1").select("choice", "bits", F.ceil(F.col("n") / block).alias("parts"))
    rows = keyed.join(shared, ["choice", "bits"]).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")))
    units = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda k: F.least("mine", k) * F.col("parts") + F.greatest("mine", k))
    return rows.select("fp", "choice", "bits", "mine", "parts", F.explode(units).alias("unit"))


def meetings(rows: DataFrame, radius: int = 2, pivots: int = 12, prune: bool = True) -> DataFrame:
    """Rows of ``candidates`` as ``a`` and ``b``, every two of a unit whose pivot distances differ by at most ``radius`` in each coordinate."""
    tabled = rows.withColumn("d", pivot_distances(F.col("fp"), pivots))
    a, b = tabled.alias("a"), tabled.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("choice", "bits", "unit")])
    if prune:
        on = on & (reduce(F.greatest, [F.abs(F.col("a.d")[k] - F.col("b.d")[k]) for k in range(pivots)]) <= radius)
    once = F.least("a.mine", "b.mine") * F.col("a.parts") + F.greatest("a.mine", "b.mine") == F.col("a.unit")
    return a.join(b, on & (F.col("a.fp") < F.col("b.fp")) & once)


def link(buckets: DataFrame, radius: int = 2, blocks: int = 4, pivots: int = 12) -> DataFrame:
    """(a, b) of every two fingerprints of ``candidates`` (of the same radius and blocks) that differ in 1 to ``radius`` bits, once: in the first choice of
    blocks in which they agree. A fingerprint has at most 2,080 such neighbours."""
    met, differ = meetings(buckets, radius, pivots), F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, n) for n, m in enumerate(_masks(blocks, radius))])
    return met.where((F.bit_count(differ) <= radius) & (first == F.col("a.choice"))).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def components_of(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) from (doc_id, fp): component_id is the smallest doc_id reachable over links."""
    prints = materialize(prints, "fingerprints")
    first = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    buckets = materialize(candidates(first.select("fp"), radius), "buckets")
    links = link(buckets, radius)
    ids = first.select(F.col("fp").alias("f"), "least")
    links = links.join(ids, F.col("a") == F.col("f")).select(F.col("least").alias("a"), "b").join(ids, F.col("b") == F.col("f")).select("a", F.col("least").alias("b"))
    found = components(links, "simhash")
    forget(buckets)
    whole = first.join(found, F.col("least") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("component", "least").alias("component_id"))
    return prints.join(whole, F.col("fp") == F.col("f"), "left").select("doc_id", "fp", "component_id")


# Wide fingerprints, for the pipeline's stage.

WORDS, BANDS, ROWS, PIVOTS = 16, 16, 4, 16
#: Bits beyond the expected ones in which candidates may differ: over six standard deviations, and three for sets of 4 and 5 shingles, whose bits differ the most.
SLACK = 76
_SPREAD = np.array([mixed(100 + k) | 1 for k in range(WORDS)], np.uint64)
_MIN_A = np.array([mixed(200 + k) | 1 for k in range(BANDS * ROWS)], np.uint64)
_MIN_B = np.array([mixed(400 + k) for k in range(BANDS * ROWS)], np.uint64)
_PIVOTS = np.array([[mixed(600 + WORDS * p + k) for k in range(WORDS)] for p in range(PIVOTS)], np.uint64)


def widen(h: np.ndarray) -> np.ndarray:
    """(n, WORDS) hashes from (n,)."""
    x = h[:, None] * _SPREAD
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def sketch(h: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Wide fingerprint of a set of shingle hashes and its BANDS min-hash keys."""
    h = np.unique(h)
    wide = majority(widen(h)) if len(h) else np.zeros(WORDS, np.uint64)
    if not len(h):
        return wide.tobytes(), np.zeros(BANDS, np.int64)
    low = np.full(BANDS * ROWS, _MASK, np.uint64)
    for k in range(0, len(h), 4096):
        low = np.minimum(low, (h[k : k + 4096, None] * _MIN_A + _MIN_B).min(0))
    keys = low.reshape(BANDS, ROWS) * _MIN_A[:ROWS] + np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    keys ^= keys >> np.uint64(31)
    return wide.tobytes(), (keys * _MIN_B[:ROWS]).sum(1, dtype=np.uint64).view(np.int64)


def word_shingles(words: WordHashes, raw: bytes | None, size: int) -> np.ndarray:
    """Hashes of shingles made from the words' hashes."""
    found = (raw or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = words.of(found)
    n = max(1, len(found) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(found))):
        out = (out + h[k : k + n]) * np.uint64(mixed(900 + k) | 1)
        out ^= out >> np.uint64(32)
    return out


def expected_bits(similarity: float) -> float:
    """Differing bits of two wide fingerprints of sets of that Jaccard similarity: the angle between them."""
    return WORDS * 64 * float(np.arccos(2 * similarity / (1 + similarity))) / np.pi


class Prints:
    """The wide fingerprints of one bucket so far, with their pivot table; two are near if they differ in at most ``radius`` bits."""

    def __init__(self, radius: int):
        self.radius, self.n = radius, 0
        self.prints, self.table = np.zeros((8, WORDS), np.uint64), np.zeros((8, PIVOTS), np.int32)

    def decode(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        fp = np.frombuffer(raw, np.uint64)
        return fp, np.bitwise_count(_PIVOTS ^ fp).sum(1, dtype=np.int32)

    def near(self, x: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
        """Those of the members ``at`` that are near ``x``."""
        at = at[np.abs(self.table[at] - x[1]).max(1) <= self.radius]
        return at[np.bitwise_count(self.prints[at] ^ x[0]).sum(1, dtype=np.int32) <= self.radius]

    def append(self, x: tuple[np.ndarray, np.ndarray]) -> None:
        if self.n == len(self.prints):
            self.prints, self.table = np.concatenate([self.prints] * 2), np.concatenate([self.table] * 2)
        self.prints[self.n], self.table[self.n] = x
        self.n += 1


class Sets:
    """The shingle sets of one group of texts so far; two are near if their Jaccard similarity is ``similarity`` or more, compared exactly."""

    def __init__(self, similarity: float, size: int, words: WordHashes):
        self.similarity, self.size, self.words, self.sets, self.sizes = similarity, size, words, [], np.zeros(8, np.int64)

    def decode(self, raw: bytes | None) -> np.ndarray:
        return np.unique(word_shingles(self.words, raw, self.size))

    def near(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = self.sizes[at]
        at = at[np.minimum(n, len(x)) >= self.similarity * np.maximum(n, len(x)) - 1e-9] if len(x) else at[n == 0]
        if not len(at) or not len(x):
            return at
        out = []
        for part in np.array_split(at, len(at) // 256 + 1):
            n = self.sizes[part]
            flat = np.concatenate([self.sets[k] for k in part.tolist()])
            hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
            common = np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64)
            out.append(part[common >= self.similarity * (n + len(x) - common) - 1e-9])
        return np.concatenate(out)

    def append(self, x: np.ndarray) -> None:
        if len(self.sets) == len(self.sizes):
            self.sizes = np.concatenate([self.sizes] * 2)
        self.sizes[len(self.sets)] = len(x)
        self.sets.append(x)


class Forest:
    """Classes of the rows of one bucket so far. A row is compared with the first member of each other class, and then with all members of the
    classes that these didn't join to it: pairs are passed over only if they are in one class already."""

    def __init__(self, store):
        self.store, self.ids, self.heads, self.merged, self.labels = store, [], {}, {}, np.zeros(8, np.int64)

    def _find(self, label: int) -> int:
        while label in self.merged:
            label = self.merged[label]
        return label

    def add(self, i: int, label: int, raw: bytes | None) -> list[tuple[int, int]]:
        """Links of the row ``i``, known to be in the class ``label``, to earlier rows of other classes."""
        x, label, n, links = self.store.decode(raw), self._find(label), len(self.ids), []
        if n == len(self.labels):
            self.labels = np.concatenate([self.labels] * 2)
        labels = self.labels[:n]
        for first in (True, False):
            at = np.fromiter((k for c, k in self.heads.items() if c != label), np.int64) if first else np.flatnonzero(labels != label)
            for k in self.store.near(x, at).tolist() if len(at) else ():
                if (c := int(labels[k])) != label:
                    links.append((self.ids[k], i))
                    if label in self.heads:
                        labels[labels == c] = label
                        self.heads[label] = min(self.heads[label], self.heads.pop(c))
                        self.merged[c] = label
                    else:
                        self.merged[label], label = c, c
        self.store.append(x)
        self.ids.append(i)
        self.labels[n] = label
        self.heads.setdefault(label, n)
        return links

    def head(self) -> int:
        """The first member of the largest class."""
        found, counts = np.unique(self.labels[: len(self.ids)], return_counts=True)
        return self.ids[self.heads[int(found[counts.argmax()])]]


def _link(rows: DataFrame, store: Callable[[], object], label: str, batch: int) -> DataFrame:
    """(key, a, b) from (key, unit, id, label, data): links of each unit of each key, and one row with b null and its head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, out = None, None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "a", "b"])

        for b in batches:
            for k, u, i, c, raw in zip(*[b.column(n).to_pylist() for n in ("key", "unit", "id", "label", "data")], strict=True):
                if (k, u) != now:
                    if found:
                        out.append((now[0], found.head(), None))
                    now, found = (k, u), Forest(store())
                out += [(k, *pair) for pair in found.add(i, c, raw)]
            yield flush()
        if found:
            out.append((now[0], found.head(), None))
            yield flush()

    dealt = rows.select("key", "unit", "id", "label", "data").repartition("key", "unit").sortWithinPartitions("key", "unit", "id")
    return materialize(map_batches(dealt, run, "key bigint, a bigint, b bigint", batch), label)


def connect(keyed: DataFrame, data: DataFrame, store: Callable[[], object], label: str, block: int = 256, batch: int = 4096) -> DataFrame:
    """(node, component) of the rows of ``keyed`` (key, id) that near pairs of a key join; ``data`` is (id, data).

    Keys of over ``block`` rows are dealt to as many blocks as that takes. Blocks are linked in themselves, and their heads with one another, in blocks again. Where
    that leaves a key in several classes, all pairs of its blocks are compared: each block of the largest class with each of the rest,
    and the rest among themselves; so no pair of different classes is left out, and no task holds over about two blocks of a key.
    """
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / block).alias("blocks"))
    rows = materialize(keyed.join(sizes, "key"), label)
    deal = lambda parts: F.pmod(F.xxhash64("id"), parts)
    found = [_link(rows.join(data, "id").withColumns({"unit": deal(F.col("blocks")), "label": F.col("id")}), store, label, batch)]
    hot = rows.where("blocks > 1").select("key", "id")
    if not hot.isEmpty():
        while True:
            heads = found[-1].where("b is null").select("key", F.col("a").alias("id"))
            many = heads.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / block).alias("blocks"))
            heads = materialize(heads.join(many, "key"), label)
            if heads.isEmpty():
                break
            found.append(_link(heads.join(data, "id").withColumns({"unit": deal(F.col("blocks")), "label": F.col("id")}), store, label, batch))
            forget(heads)
        forget(heads)
        found += _rest(hot, _joined(found, label), data, store, label, block, batch)
    out = _joined(found, label)
    forget(rows, *found)
    return out


def _joined(found: list[DataFrame], label: str) -> DataFrame:
    return components(reduce(DataFrame.union, [f.where("b is not null").select("a", "b") for f in found]), label)


def _rest(hot: DataFrame, classes: DataFrame, data: DataFrame, store: Callable[[], object], label: str, block: int, batch: int) -> list[DataFrame]:
    """Links of the keys whose rows ``hot`` (key, id) are in several classes yet: all pairs of blocks that can hold rows of two classes."""
    deal = lambda parts: F.pmod(F.xxhash64("id"), parts)
    placed = materialize(hot.join(classes, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("label")), label)
    counts = placed.groupBy("key", "label").agg(F.count("*").alias("n"))
    split = counts.groupBy("key").agg(F.max_by("label", "n").alias("main"), F.max("n").alias("m"), F.sum("n").alias("n")).where("m < n")
    split = split.select("key", "main", F.ceil(F.col("m") / block).alias("mains"), F.ceil((F.col("n") - F.col("m")) / block).alias("others"))
    many = placed.join(split, "key")
    if many.isEmpty():
        forget(classes, placed)
        return []
    upto = lambda c: F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1)
    mine = F.when(F.col("label") == F.col("main"), deal(F.col("mains"))).otherwise(deal(F.col("others")))
    unit = lambda a, b: F.concat_ws("/", a, b)
    among = F.transform(upto("others"), lambda k: unit(F.least("mine", k), F.concat(F.lit("r"), F.greatest("mine", k).cast("string"))))
    units = F.when(F.col("label") == F.col("main"), F.transform(upto("others"), lambda k: unit(F.col("mine"), k))).otherwise(F.concat(F.transform(upto("mains"), lambda k: unit(k, F.col("mine"))), among))
    many = many.withColumn("mine", mine).select("key", "id", "label", F.explode(units).alias("unit"))
    out = _link(many.join(data, "id"), store, label, batch)
    forget(classes, placed)
    return [out]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8, block: int = 256) -> DataFrame:
    """(doc_id, class_id): the smallest doc_id of its class of near-duplicates, for each doc_id that isn't null.

    Texts of the same words are one row first; the others are compared with all rows of their buckets that they aren't joined to yet (``connect``).
    Fingerprints only gather candidates, within a radius that is wide for ``similarity``; what they join is one group, and in each group the sets of
    shingles themselves are compared in the same way, so every link of a class is a pair of that similarity or more.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            same, prints, keys = [], [], []
            for x in raw_bytes(b.column(1)):
                p, k = sketch(word_shingles(words, x, size))
                prints.append(p)
                keys.append(k)
                same.append(hashlib.blake2b(b" ".join((x or b"").lower().split()), digest_size=16).digest())
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(keys) + 1, BANDS, dtype=np.int32)), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.binary()), pa.array(prints, pa.binary()), flat], ["id", "same", "fp", "keys"])

    seen = materialize(map_batches(docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint"), text), run, "id bigint, same binary, fp binary, keys array<bigint>"), "sketches")
    first = materialize(seen.groupBy("same").agg(F.min("id").alias("id")), "same")
    rows = seen.join(first.select(F.col("id").alias("i")), F.col("id") == F.col("i"), "left_semi").dropDuplicates(["id", "same"])
    radius = round(expected_bits(similarity) + SLACK)
    near = connect(rows.select("id", F.explode("keys").alias("key")), rows.select("id", F.col("fp").alias("data")), lambda: Prints(radius), "near", block)
    groups = materialize(near.select(F.col("component").alias("key"), F.col("node").alias("id")), "near")
    texts = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("binary").alias("data")).join(groups.select("id"), "id", "left_semi").distinct()
    words = WordHashes()
    found = connect(groups, texts, lambda: Sets(similarity, size, words), "exact", block, 512)
    forget(groups)
    whole = first.join(found, F.col("id") == F.col("node"), "left").select(F.col("same").alias("s"), F.coalesce("component", "id").alias("class_id"))
    return seen.join(whole, F.col("same") == F.col("s")).select(F.col("id").alias("doc_id"), "class_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with all their columns, without those that repeat a document of a smaller id. Of rows that share an id and a class all stay; rows
    with a null id stay, as nothing can be said of their order."""
    same = near_duplicates(docs, key, text, **options)
    i = free_name(docs, "drop_id")
    gone = same.where("class_id <> doc_id").select(F.col("doc_id").alias(i)).distinct()
    return docs.join(gone, docs[key] == F.col(i), "left_anti")
