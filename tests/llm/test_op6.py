import base64
import hashlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from neurograph.llm import bpe, chunks, queries

SF, FILE = "/root/testdata/sf0.01", P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(FILE).read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ours(text):
    return np.frombuffer(bpe.vocabulary(FILE, P.PATTERN).encode([text])[0], "<u4").tolist()


def test_query_against_library(spark, documents, library):
    rows = {r.doc_id: r for r in queries.op6_bpe(spark, SF).collect()}
    assert len(rows) == len(documents)
    for d, text in documents:
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        want = len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
        assert (rows[d].n_tokens, rows[d].ids_sha256, rows[d].decoded_sha256) == want


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t\r\x0b\x1c\x85  ab'sé—日9.,\x00")), st.characters(codec="utf-8")), max_size=60))
def test_any_text(text):
    ranks = library_cached()
    assert ours(text) == ranks.encode_ordinary(text)
    v = bpe.vocabulary(FILE, P.PATTERN)
    assert v.decode(np.array(ours(text), np.int64)).decode() == text
    assert "".join(chunks.unkeyed(k) for k in chunks.pieces(text)) == text


_kept = []


def library_cached():
    if not _kept:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(FILE).read_bytes().splitlines())}
        _kept.append(tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    return _kept[0]


@pytest.mark.parametrize("text", ["x" * 5000, "ab" * 3000, "é" * 700, " " * 4000, "\n" * 300 + "a", "a" * 128 + " " + "a" * 129, "日本語" * 200, "<|endoftext|>", "'s 't're  'll\n'd"])
def test_long_words(text, library):
    assert ours(text) == library.encode_ordinary(text)


def test_pair_table_finds_all():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 5000, 4000), rng.integers(0, 5000, 4000)
    keys, first = np.unique((a << 32) | b, return_index=True)
    t = bpe.PairTable(keys, np.arange(len(keys), dtype=np.int32))
    assert (t.find((keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32)) == np.arange(len(keys))).all()
    assert (t.find(np.array([-1, 5001, 3], np.int32), np.array([3, 1, -1], np.int32)) == bpe.NONE).all()


def test_edges(spark, edges, nothing, library):
    rows = bpe.digest(edges, FILE, P.PATTERN).collect()
    assert len(rows) == edges.count() and bpe.digest(nothing, FILE, P.PATTERN).count() == 0
    texts = {r.doc_id: r.text or "" for r in edges.collect()}
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    back = bpe.decode_column(bpe.encode_column(edges, FILE, P.PATTERN), FILE, P.PATTERN).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((r.doc_id or 0, r.text or "") for r in edges.collect())
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode_column(nulls, FILE, P.PATTERN).collect()} == {1: None, 2: ""}
