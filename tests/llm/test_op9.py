import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from neurograph.llm import queries, substring

SF = "/root/testdata/sf0.01"


def brute(rows, size=50):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - size + 1):
            if d is not None:
                k = tuple(w[i : i + size])
                first[k] = min(d, first.get(k, d))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {i + j for i in range(len(w) - size + 1) if d is not None and first[tuple(w[i : i + size])] < d for j in range(size)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, substring.digest(df).collect()), key=repr)


def test_query_against_brute_force(spark, documents):
    assert sorted(map(tuple, queries.op9_substring_dedup(spark, SF).collect()), key=repr) == brute(documents)


def planted(seed=4):
    rng = np.random.default_rng(seed)
    fresh = lambda n: [f"w{int(x)}" for x in rng.integers(0, 500, n)]
    passages, rows = [fresh(n) for n in (50, 51, 49, 80, 200)], []
    for d in rng.permutation(80):
        w = fresh(int(rng.integers(0, 120)))
        for _ in range(int(rng.integers(0, 3))):
            p = passages[int(rng.integers(5))]
            w = w[: len(w) // 2] + (p if rng.random() < 0.7 else p[: len(p) - 1]) + w[len(w) // 2 :]
        rows.append((int(d), "\n".join(" ".join(w[k : k + 13]) for k in range(0, len(w), 13))))
    return rows + [(d + 1000, t) for d, t in rows[:10]]


def test_planted_passages(spark):
    rows = planted()
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_edges(spark, edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.collect()] + [(8, "word " * 60), (11, "word " * 55), (12, " ".join(f"w{k}" for k in range(100, 160))), (12, "word " * 51), (None, "word " * 70)]
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)
    assert got(nothing) == []


def test_strip_keeps_the_rest(spark):
    rows = planted(5)
    df = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id bigint, text string, starts bigint")
    out = substring.strip(df)
    assert out.columns == df.columns
    kept = {r.doc_id: r.text for r in out.collect()}
    want = {d: (n, gone, sha) for d, n, gone, sha in brute(rows)}
    for d, text in rows:
        words = kept[d].split()
        assert hashlib.sha256(" ".join(words).encode()).hexdigest() == want[d][2] and (want[d][1] or kept[d] == text)
    assert substring.strip(df.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=50, max_size=150), st.integers(2, 50))
def test_rolling_hash_and_minimum(words, size):
    h = np.array([0x9E3779B97F4A7C15 * (w + 1) % 2**64 for w in words], np.uint64)
    r = substring.Powers(substring._BASE, substring._INVERSE).rolling(h, size)
    seen = {}
    for k, x in enumerate(r.tolist()):
        assert seen.setdefault(tuple(words[k : k + size]), x) == x
    assert len(set(seen.values())) == len(seen)
    assert substring.sliding_min(h, size).tolist() == [int(h[k : k + size].min()) for k in range(len(h) - size + 1)]


def test_intervals():
    assert substring.intervals(np.array([1, 1, 0, 0, 1], bool)) == [(0, 2), (4, 5)] and substring.intervals(np.zeros(0, bool)) == []
    assert substring.remove_words(b" a b\nc  d ", np.array([0, 1, 0, 0], bool)) == b" a c  d " and substring.remove_words(b"a b c", np.array([0, 1, 1], bool)) == b"a"
