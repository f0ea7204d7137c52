import collections
import re

import numpy as np
from pyspark.sql import functions as F

from neurograph.llm import quality_rules as q
from neurograph.llm import queries

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    lines, seen, dup = [x for x in (text or "").split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    counts = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if counts[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_query_against_brute_force(spark, documents):
    rows = {r.doc_id: r for r in queries.op1_quality_rules(spark, SF).collect()}
    assert len(rows) == len(documents)
    for d, text in documents:
        r, want = rows[d], brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert sum(rows[d].kept for d in good) >= 0.97 * len(good)


def test_edges(spark, edges, nothing):
    seen, stats, rule = q.judge(edges, [])
    assert [c for c in seen.columns if c not in (stats, rule)] == edges.columns
    rows = seen.collect()
    assert len(rows) == edges.count()
    for r in rows:
        assert tuple(r[stats])[:5] == brute(r.text)
    assert q.judge(nothing, [])[0].count() == 0


def test_training_without_labels(spark, edges):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert q.train(edges, labels) == []
    labels = spark.createDataFrame([(1, None), (None, 0), (4, 1)], "doc_id bigint, quality int")
    assert q.train(edges, labels) == []


def test_learned_list_finds_planted_conjunction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(q.FEATURES)))
    bad = (x[:, 2] > 0.7) & (x[:, 1] < 0.5)
    rules = q.learn(x, bad, list(q.FEATURES))
    hit = np.zeros(len(x), bool)
    for r in rules:
        hit |= q._mask(x, list(q.FEATURES), r.conditions)
    assert (hit & bad).sum() >= 0.9 * bad.sum() and (hit & ~bad).sum() <= 0.02 * len(x)
    assert all(len(r.conditions) <= 4 for r in rules)


def test_noise_gives_no_rules():
    rng = np.random.default_rng(2)
    x, bad = rng.random((3000, len(q.FEATURES))), rng.random(3000) < 0.3
    assert q.learn(x, bad, list(q.FEATURES)) == []


def test_column_is_the_list(spark):
    rule = q.Rule((("symbol_share", True, 0.3), ("n_words", False, 20.0)), 9, 9)
    docs = spark.createDataFrame([(1, "# # # # a b c d e f g h"), (2, "# a b c d e f g h i j k l")], "doc_id bigint, text string")
    seen, _, name = q.judge(docs, [rule])
    got = {r.doc_id: r[name] for r in seen.select("doc_id", F.col(name)).collect()}
    assert got == {1: str(rule), 2: None}
