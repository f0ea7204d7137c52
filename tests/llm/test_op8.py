import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from neurograph.llm import packing, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def check(rows, ids):
    """Every id in one piece, offsets without gaps, full windows or powers of two. Gives the padding's share."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.length > 0 and r.ids_crc32 == zlib.crc32(piece) and r.doc_tokens == len(ids[r.doc_id])
    for d, found in docs.items():
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[d])
    assert docs.keys() == ids.keys()
    padded = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    return padded / max(1, sum(map(len, ids.values())))


def test_query(spark, documents, library):
    ids = {d: [*e.ids, 1] for (d, _), e in zip(documents, library.encode_batch([t or "" for _, t in documents], add_special_tokens=False), strict=True)}
    rows = queries.op8_packing(spark, SF).collect()
    assert check(rows, ids) < 0.01
    groups = defaultdict(int)
    for r in rows:
        groups[r.step_group] += r.length
    assert max(groups.values()) <= packing.STEP
    # within a task all groups but the last are full
    last = {g >> 40: max(h for h in groups if h >> 40 == g >> 40) for g in groups}
    assert all(n == packing.STEP for g, n in groups.items() if g not in last.values())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 5000), max_size=30), min_size=1, max_size=4))
def test_packer(blocks):
    p, made, lengths = packing.Packer(step=4096), [], {}
    for k, block in enumerate(blocks):
        for n in block:
            lengths[len(lengths)] = n
            p.add(len(lengths) - 1, n)
        made += p.pack(last=k == len(blocks) - 1)
    seen, groups = defaultdict(list), defaultdict(int)
    for window, group, pieces in made:
        assert sum(x[2] for x in pieces) == window and window & (window - 1) == 0 and window <= 2048
        groups[group] += window
        for d, start, n in pieces:
            seen[d].append((start, n))
    assert {d: sum(n for _, n in v) for d, v in seen.items()} == lengths and max(groups.values(), default=0) <= 4096
    for v in seen.values():
        at = 0
        for start, n in sorted(v):
            assert start == at
            at += n


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'sabé9.— <|")), st.characters(codec="utf-8")), max_size=60))
def test_ids_are_the_library_s(text):
    t = packing.tokenizer(*queries.PACKING)
    assert np.frombuffer(t.of(text), "<u4").tolist() == t.slow.encode(text, add_special_tokens=False).ids


def test_every_common_character():
    """Characters that go to the fast library are classed alike, alone and between letters, digits and spaces."""
    t = packing.tokenizer(*queries.PACKING)
    common = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not packing._COMMON.search(chr(c))]
    for form in ("{0}", "a{0}b", " {0} 1{0}2", "{0}\n{0}{0}.{0}"):
        text = [form.format(c) for c in common]
        assert [np.frombuffer(t.of(x), "<u4").tolist() for x in text] == [e.ids for e in t.slow.encode_batch(text, add_special_tokens=False)]


def test_edges(spark, edges, nothing, library):
    few = edges.where("doc_id is null or doc_id <> 5").select("doc_id", "text", "stats")
    rows = packing.pack_documents(few, *queries.PACKING, with_ids=True, block=2000).collect()
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in few.collect()}
    check(rows, ids)
    assert all(r.ids == ids[r.doc_id][r.start : r.start + r.length] for r in rows)
    assert packing.pack_documents(nothing, *queries.PACKING).count() == 0
    again = packing.pack_documents(edges.where("doc_id = 5"), *queries.PACKING).collect()
    assert sum(r.length for r in again) == 2 * len(ids[4])


def test_added_tokens_against_the_untouched_library():
    plain, t = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.tokenizer(*queries.PACKING)
    for text in ("<|endoftext|>", "one<|endoftext|>two <|endoftext|>", "日本<|endoftext|>語", "<|endoftext|", "plain text"):
        assert list(np.frombuffer(t.of(text), "<u4")) == plain.encode(text, add_special_tokens=False).ids
    assert list(np.frombuffer(t.of("<|endoftext|>"), "<u4")) == [50256]


def test_long_runs_and_added_tokens(spark, library):
    """Texts on which the fast library gives up, and the string of an added token, get the ids of the untouched library through the query's own function."""
    texts = [" " * 1_000_000, "a" + "\n" * 1_200_000 + "b", "x" * 300_000, "see <|endoftext|> here", ("ab " * 50 + " " * 99_999) * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {}
    for r in sorted(packing.pack_documents(df, *queries.PACKING, with_ids=True).collect(), key=lambda r: r.start):
        got.setdefault(r.doc_id, []).extend(r.ids)
    for k, t in enumerate(texts):
        assert got[k] == [*library.encode(t, add_special_tokens=False).ids, 1], k


def test_a_panic_of_the_fast_library_is_caught(library):
    ids = packing.Ids(*queries.PACKING)
    long, packing._RUN = packing._RUN, packing.re.compile("(?!)")
    try:
        assert np.frombuffer(ids.of(" " * 1_000_000), "<u4").tolist() == library.encode(" " * 1_000_000, add_special_tokens=False).ids
    finally:
        packing._RUN = long
