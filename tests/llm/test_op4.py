import re
import string

import numpy as np
import pytest
import xxhash

from neurograph.llm import queries, simhash
from neurograph.llm.components import components

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_print(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    """id -> smallest id reachable at 2 bits or fewer."""
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    ids, fps = [i for i, _ in prints], np.array([f for _, f in prints], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[k]) <= 2):
            a, b = find(i), find(ids[int(j)])
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query_against_brute_force(spark, documents):
    rows = {r.doc_id: r for r in queries.op4_simhash(spark, SF).collect()}
    prints = [(d, brute_print(t)) for d, t in documents]
    want = brute_components(prints)
    assert {d: (r.fingerprint, r.component_id) for d, r in rows.items()} == {d: (f"{f:016x}", want[d]) for d, f in prints}


def test_planted_links(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 64, 60, dtype=np.uint64)]
    prints = []
    for x in base:
        for _ in range(8):
            y = x
            for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
                y ^= 1 << int(b)
            prints.append(y)
    rows = [(i, f) for i, f in enumerate(prints)]
    df = spark.createDataFrame([(i, simhash._signed(f)) for i, f in rows], "doc_id bigint, fp bigint")
    got = {r.doc_id: r.component_id for r in simhash.components_of(df).collect()}
    assert got == brute_components(rows)
    distinct = sorted(set(prints))
    links = {(r.a, r.b) for r in simhash.link(simhash.candidates(df.select("fp").distinct())).collect()}
    want = {tuple(sorted((simhash._signed(a), simhash._signed(b)))) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if (a ^ b).bit_count() <= 2}
    assert links == want


def test_edges(spark, edges, nothing):
    rows = simhash.components_of(simhash.fingerprints(edges)).collect()
    assert len(rows) == edges.count() and simhash.components_of(simhash.fingerprints(nothing)).count() == 0
    texts = {r.doc_id: r.text for r in edges.collect()}
    for r in rows:
        assert r.fp & simhash._MASK == brute_print(texts[r.doc_id])
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1} and {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}


def test_bit_counts():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 7, 100, 1001):
        h = rng.integers(0, 1 << 63, (n, 3), dtype=np.uint64)
        want = np.unpackbits(h.view(np.uint8).reshape(n, -1), axis=1, bitorder="little").sum(0)
        assert (simhash.bit_counts(h) == want).all()


def test_components_of_hubs(spark):
    """A star of most links, whose centre is neither the least nor the greatest of its nodes, next to pairs and a chain that it reaches."""
    star = [(5000, k) for k in range(1000, 9000) if k != 5000]
    rest = [(2 * k, 2 * k + 1) for k in range(10_000, 11_000)] + [(k, k + 1) for k in range(100, 140)] + [(140, 8999)]
    got = {r.node: r.component for r in components(spark.createDataFrame(star + rest, "a bigint, b bigint")).collect()}
    want = dict.fromkeys([*range(100, 141), *range(1000, 9000)], 100) | {x: 2 * k for k in range(10_000, 11_000) for x in (2 * k, 2 * k + 1)}
    assert got == want


def test_components_of_chains(spark):
    chain = [(k, k + 1) for k in range(0, 300)] + [(1000, 999), (999, 1002), (5, 5), (None, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(301)}, 999: 999, 1000: 999, 1002: 999}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def near(words, rng, edits):
    out = list(words)
    for k in rng.choice(len(out), edits, replace=False):
        out[int(k)] = f"new{int(rng.integers(1 << 30))}"
    return " ".join(out)


def test_near_duplicates_by_shingles(spark):
    """Copies of 5-word Jaccard similarity 0.85 and more are in one class; independent texts are alone; one row of each class stays."""
    rng, rows = np.random.default_rng(9), []
    for g in range(40):
        words = [f"w{int(rng.integers(4000))}" for _ in range(300)]
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(words).upper()), (10 * g + 2, near(words, rng, 1)), (10 * g + 3, near(words, rng, 3))]
    rows += [(1000 + k, " ".join(f"w{int(rng.integers(4000))}" for _ in range(300))) for k in range(60)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, drop_id string")
    got = {r.doc_id: r.class_id for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: i // 10 * 10 if i < 1000 else i for i, _ in rows}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got.values())


def test_keep_one_edges(spark, edges, nothing):
    kept = simhash.keep_one(edges)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 7, 8, 9, 10] and simhash.keep_one(nothing).count() == 0


def family(variants=120, words=300, edits=5, seed=4):
    """A text (the last id) and copies of it with ``edits`` words changed in each: about 0.84 to the text, 0.73 to one another."""
    rng = np.random.default_rng(seed)
    base = [f"w{int(x)}" for x in rng.integers(0, 10**6, words)]
    out = []
    for k in range(variants):
        copy = list(base)
        for j in rng.choice(words // 10, edits, replace=False):
            copy[10 * int(j) + 4] = f"new{k}x{int(j)}"
        out.append((k, " ".join(copy)))
    return [*out, (variants, " ".join(base))]


def shingle_components(rows, similarity=0.8, size=5):
    """id -> smallest id reachable over pairs of that similarity, all pairs compared."""
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and len(a & b) >= similarity * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("block", [256, 16, 3])
def test_variants_of_one_text_against_brute_force(spark, block):
    """Texts that meet only through one that isn't the first of its buckets, in one block and in many."""
    rows = family()
    want = shingle_components(rows)
    assert set(want.values()) == {0}
    got = {r.doc_id: r.class_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), block=block).collect()}
    assert got == want


def test_pairs_below_the_similarity_stay_apart(spark):
    """Copies just below 0.8 (0.76) are no links, copies just above (0.82) and short texts at exactly 0.8 are."""
    rows = []
    for g in range(30):
        words = [f"w{g}x{k}" for k in range(300)]
        for k, edits in enumerate((0, 8, 6)):
            copy = list(words)
            for j in range(edits):
                copy[30 * j + 10 + k] = f"new{g}x{k}x{j}"
            rows.append((10 * g + k, " ".join(copy)))
        rows += [(10 * g + 5, " ".join(f"s{g}x{k}" for k in range(8))), (10 * g + 6, " ".join(f"s{g}x{k}" for k in range(9)))]
    want = shingle_components(rows)
    assert want == {i: i - 1 if i % 10 == 6 else i - 2 if i % 10 == 2 else i for i, _ in rows}
    got = {r.doc_id: r.class_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want


def test_pivots_discard_most_of_a_skewed_cell(spark):
    """Fingerprints with half of their bits in common, as a template makes them: what the pivots leave of the pairs of a cell, and that no link is lost."""
    rng = np.random.default_rng(8)
    low = int(rng.integers(0, 1 << 32))
    prints = {int(x) << 32 | low for x in rng.integers(0, 1 << 32, 3000)}
    prints |= {x ^ 1 << 40 ^ 1 << 3 for x in list(prints)[:200]}
    df = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fp bigint")
    rows = simhash.candidates(df, block=500).cache()
    assert rows.groupBy("choice", "bits").count().agg({"count": "max"}).first()[0] >= 3000
    every, left = simhash.meetings(rows, prune=False).count(), simhash.meetings(rows).count()
    rows.unpersist()
    assert every > 3000 * 2999 / 2 and left < every / 200
    ordered = sorted(prints)
    x = np.array(ordered, np.uint64)
    want = {tuple(sorted((simhash._signed(a), simhash._signed(ordered[j])))) for k, a in enumerate(ordered) for j in np.flatnonzero(np.bitwise_count(x ^ x[k]) <= 2).tolist() if j > k}
    for block in (2048, 300):
        got = [(r.a, r.b) for r in simhash.link(simhash.candidates(df, block=block)).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) >= 200


def planted_pairs(rng, n=600):
    """Pairs of texts of 100 to 400 words, of exact Jaccard similarity from 0.7 to 0.95 of their 5-word shingles."""
    rows = []
    for g in range(n):
        size = int(rng.integers(100, 400))
        words = [f"w{int(x)}" for x in rng.integers(0, 10**6, size)]
        edits = max(1, int(size * rng.uniform(0.005, 0.035)))
        rows += [(2 * g, " ".join(words)), (2 * g + 1, near(words, rng, edits))]
    return rows


def test_recall_at_the_border(spark):
    """Measured on planted pairs: over 0.95 of those of similarity 0.80 to 0.85 are joined, and none below 0.8 is."""
    rows = planted_pairs(np.random.default_rng(21))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    alike = {g: len(sets[g] & sets[g + 1]) / len(sets[g] | sets[g + 1]) for g in range(0, len(rows), 2)}
    got = {r.doc_id: r.class_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    joined = {g for g in alike if got[g] == got[g + 1]}
    border = [g for g, j in alike.items() if 0.8 <= j < 0.85]
    assert len(border) > 40 and sum(g in joined for g in border) >= 0.95 * len(border)
    assert sum(j < 0.8 for j in alike.values()) > 40 and not any(alike[g] < 0.8 for g in joined)
    assert all(g in joined for g, j in alike.items() if j >= 0.85)


def test_chains_against_brute_force(spark):
    """Texts each of which is near only to the next: one class, though its ends share little."""
    rng, rows = np.random.default_rng(22), []
    for c in range(6):
        words = [f"c{c}w{int(x)}" for x in rng.integers(0, 10**6, 300)]
        for k in range(12):
            rows.append((100 * c + k, " ".join(words)))
            for j in range(5):
                words[(25 * k + 5 * j) % 300] = f"c{c}new{k}x{j}"
    want = shingle_components(rows)
    assert len(set(want.values())) < len(rows)
    for block in (256, 8):
        got = {r.doc_id: r.class_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), block=block).collect()}
        assert got == want
