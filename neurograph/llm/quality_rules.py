"""Operator 1, quality rules: a learned decision list over text statistics.

Sequential covering grows one threshold conjunction at a time on two thirds of the labelled rows (by information gain
on the rows that it still covers), prunes its tail on the other third, and stops at the first rule that isn't sure
enough there. The list becomes one Spark ``CASE WHEN`` over the statistics, in order, first match wins.

Defined results: a null text counts as an empty one (no words, base_failed); an empty table gives an empty result; repeated rows are
judged alike and all returned; without labels, or with labels of one class only, the list is empty and keeps what passes the base.
Extra columns are carried along by ``judge`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neurograph.llm.common import SPACES, free_name, map_batches, raw_bytes

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_digits", "n_sentence_ends")
#: Deleting these bytes leaves one byte for each code point of a word.
_NOT_POINTS = SPACES + bytes(range(0x80, 0xC0))
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that occur twice or more."""
    n = len(words)
    if n <= size:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    windows = sum((h[k : n - size + 1 + k] * _MIX[k % 5] + np.uint64(k // 5) for k in range(1, size)), h[: n - size + 1] * _MIX[0])
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not twice.size:
        return 0
    at = np.flatnonzero(np.isin(windows, twice))
    edges = np.zeros(n + 1, np.int32)
    edges[at] += 1
    edges[at + size] -= 1
    return int(np.count_nonzero(np.cumsum(edges[:n]) > 0))


def text_stats(raw: bytes | None) -> tuple[int, ...]:
    """The values of STATS for one whole text."""
    raw = raw or b""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(raw.translate(None, _NOT_POINTS)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(set(words)),
        len(raw) - len(raw.translate(None, b"0123456789")),
        raw.count(b". ") + raw.count(b".\n") + raw.endswith(b"."),
    )


def with_stats(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``df`` with one more column, a struct of STATS; and that column's name."""
    name = free_name(df, "stats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_stats(x) for x in raw_bytes(b.column(text))]
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays(cols, list(STATS))], [*b.schema.names, name])

    kind = T.StructType([T.StructField(s, T.LongType()) for s in STATS])
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    return map_batches(df, run, schema), name


#: feature -> (numerator, denominator) of STATS; a zero denominator counts as 1.
FEATURES = {
    "n_words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"), "line_words": ("n_words", "n_lines"), "distinct_share": ("n_distinct_words", "n_words"),
    "digit_share": ("n_digits", "word_chars"), "sentence_words": ("n_words", "n_sentence_ends"),
}


def feature(name: str, stats: str) -> Column:
    top, bottom = FEATURES[name]
    x = F.col(f"`{stats}`.{top}").cast("double")
    return x / F.greatest(F.col(f"`{stats}`.{bottom}"), F.lit(1)) if bottom else x


@dataclass(frozen=True)
class Rule:
    """All of the conditions (feature, is_at_least, threshold); ``covered`` and ``right`` count the held-out rows."""

    conditions: tuple[tuple[str, bool, float], ...]
    covered: int
    right: int

    def column(self, stats: str) -> Column:
        out = F.lit(True)
        for name, above, t in self.conditions:
            out = out & (feature(name, stats) >= t if above else feature(name, stats) <= t)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>=' if a else '<='} {t:.4g}" for n, a, t in self.conditions)


def _mask(x: np.ndarray, names: list[str], conditions) -> np.ndarray:
    out = np.ones(len(x), bool)
    for n, above, t in conditions:
        v = x[:, names.index(n)]
        out &= v >= t if above else v <= t
    return out


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], most: int) -> list[tuple[str, bool, float]]:
    """Adds the condition of the largest FOIL gain until no good row is covered or nothing gains."""
    out, live = [], np.ones(len(x), bool)
    while len(out) < most and (p := int(bad[live].sum())) and p < live.sum():
        best, base = (0.0, None), np.log2(p / live.sum())
        for k, name in enumerate(names):
            v = x[live, k]
            for t in np.unique(np.quantile(v[bad[live]], np.linspace(0.02, 0.98, 25))):
                for above in (True, False):
                    hit = v >= t if above else v <= t
                    pp = int(bad[live][hit].sum())
                    if pp and (gain := pp * (np.log2(pp / hit.sum()) - base)) > best[0] + 1e-9:
                        best = (gain, (name, above, float(t)))
        if best[1] is None:
            break
        out.append(best[1])
        live &= _mask(x, names, out[-1:])
    return out


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], min_precision: float = 0.9, min_right: int = 5, max_rules: int = 16, max_conditions: int = 4) -> list[Rule]:
    """The decision list for rows ``x`` (labelled ``bad`` or not), which must be in an order unrelated to the labels."""
    held, rules, left = np.arange(len(x)) % 3 == 2, [], np.ones(len(x), bool)
    for _ in range(max_rules):
        g, h = left & ~held, left & held
        if not bad[g].any() or not bad[h].any():
            break
        conditions = _grow(x[g], bad[g], names, max_conditions)
        best = (-2.0, ())
        for k in range(len(conditions), 0, -1):
            m = _mask(x[h], names, conditions[:k])
            right, n = int(bad[h][m].sum()), int(m.sum())
            if n and (score := (2 * right - n) / n) > best[0]:
                best = (score, tuple(conditions[:k]), n, right)
        if not best[1] or best[3] < min_right or best[3] < min_precision * best[2]:
            break
        rules.append(Rule(best[1], best[2], best[3]))
        left &= ~_mask(x, names, best[1])
    return rules


def train(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000) -> list[Rule]:
    """Learns from at most ``max_labels`` labelled rows (the bound of this fit), those with the smallest hash of the id.

    A label is a row (doc_id, quality) with quality 0 for bad; rows that fail the base rules teach nothing. Rows that share a doc_id are all
    labelled; the bound holds for them as well, by the hash of the id and then the statistics.
    """
    bound = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    bound = bound.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).select(F.col("doc_id").alias("lab_id"), "quality")
    rows = docs.select("doc_id", "text").join(F.broadcast(bound), F.col("doc_id") == F.col("lab_id"))  # at most max_labels rows of two numbers
    seen, stats = with_stats(rows.select("doc_id", "quality", "text"))
    seen = seen.where(~base_failed(stats)).select("doc_id", "quality", *[feature(n, stats).alias(n) for n in FEATURES])
    few = seen.orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(max_labels)
    got = sorted(few.collect(), key=lambda r: (hash_of(r[0]), r[2:]))
    if not got:
        return []
    x = np.array([r[2:] for r in got], np.float64)
    return learn(x, np.array([r[1] == 0 for r in got]), list(FEATURES))


def hash_of(i: int) -> int:
    return (i * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF


def base_failed(stats: str) -> Column:
    n, repeat = F.col(f"`{stats}`.n_words"), F.col(f"`{stats}`.n_repeat_words")
    return (n < 10) | (100 * repeat > 20 * n)


def verdict(rules: list[Rule], stats: str) -> Column:
    """The list as one conditional expression: the first rule that matches, else null."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(r.column(stats), F.lit(str(r))).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule]) -> tuple[DataFrame, str, str]:
    """``docs`` with their statistics and the name of the rule that rejects them (``base``, or a learned one, or null)."""
    seen, stats = with_stats(docs)
    rule = free_name(seen, "rule")
    return seen.withColumn(rule, F.when(base_failed(stats), F.lit("base")).otherwise(verdict(rules, stats))), stats, rule
