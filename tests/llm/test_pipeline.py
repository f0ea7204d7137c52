from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c
from neurograph.llm.common import materialize

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, f in c.STAGES:
        docs = materialize(f(spark, docs, SF), "test")
        out.append(docs)
    return out


def test_columns_and_order(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["quality_rules", "simhash_near_dedup", "substring_dedup", "packing"]
    assert all(s.dtypes == docs.dtypes for s in stages[:3])
    counts = [docs.count(), *[s.count() for s in stages[:3]]]
    assert counts[0] > counts[1] > counts[2] == counts[3] > 0.6 * counts[0]


def test_last_stage_packs_what_is_left(stages):
    assert stages[3].select("doc_id").distinct().count() == stages[2].count()
    r = stages[3].agg(F.sum("length"), F.sum(F.size("ids"))).first()
    assert r[0] == r[1]


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies_against_brute_force(stages):
    """Of the documents that the first stage kept: every two of similarity 0.85 and more are in one class, and every class hangs together above 0.7."""
    from neurograph.llm.simhash import near_duplicates

    docs = {r.doc_id: shingles(r.text) for r in stages[0].collect()}
    same = {r.doc_id: r.class_id for r in near_duplicates(stages[0]).collect()}
    index, best, missed, pairs = {}, {}, 0, 0
    for d, s in docs.items():
        for x in s:
            index.setdefault(x, []).append(d)
    seen = set()
    for ds in index.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    j = len(docs[a] & docs[b]) / len(docs[a] | docs[b])
                    best[a], best[b] = max(best.get(a, 0), j if same[a] == same[b] else 0), max(best.get(b, 0), j if same[a] == same[b] else 0)
                    if j >= 0.85:
                        pairs += 1
                        missed += same[a] != same[b]
    assert pairs > 20 and missed == 0
    size = {}
    for v in same.values():
        size[v] = size.get(v, 0) + 1
    assert all(best[d] >= 0.7 for d, v in same.items() if size[v] > 1)
    assert {r.doc_id for r in stages[1].collect()} == set(same.values())


def test_classes_are_components_of_pairs_at_the_stated_similarity(spark, stages):
    """Classes of the documents that the first stage kept, against all pairs of 5-word Jaccard similarity 0.8 and more: no link less, no link more."""
    from neurograph.llm.simhash import near_duplicates

    docs = {}
    for r in stages[0].select("doc_id", "text").collect():
        w = (r.text or "").encode().lower().split()
        docs[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    index, up = {}, {d: d for d in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, s in docs.items():
        common = Counter(o for x in s for o in index.get(x, ()))
        for o, n in common.items():
            if n >= 0.8 * (len(s) + len(docs[o]) - n):
                a, b = find(d), find(o)
                up[max(a, b)] = min(a, b)
        for x in s:
            index.setdefault(x, []).append(d)
    want = {d: find(d) for d in docs}
    got = {r.doc_id: r.class_id for r in near_duplicates(stages[0]).collect()}
    assert {d: (got[d], want[d]) for d in want if got[d] != want[d]} == {} and got.keys() == want.keys()


def test_edges(spark):
    rng = np.random.default_rng(3)
    prose = [" ".join(f"word{int(x)}" for x in rng.integers(0, 3000, 120)) + "." for _ in range(6)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(prose)] + [(6, None, None, None, None), (7, "", "en", "s", 0), (8, prose[0], "en", "s", 3), (8, prose[0], "en", "s", 3), (None, prose[1], "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, f in c.STAGES[:3]:
        docs = materialize(f(spark, docs, SF), name)
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in docs.collect()) == [-1, *range(6)]
    empty = docs.limit(0)
    for name, f in c.STAGES:
        empty = materialize(f(spark, empty, SF), name)
    assert empty.count() == 0
