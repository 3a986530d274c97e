import base64
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from shirabe.llm import bpe, token_count

ODD = ["", None, "a  b\n\n c\t d", " x  y　 z  é à  k", "日本語 \U0001f642\U0001f642 é", "<|endoftext|> hi", "   ", "it's  don't 'll \r\n x\x1c y\x85 z", "a" * 3000, "w " * 30000, "same", "same"]


@pytest.fixture(scope="module")
def other():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(texts, other):
    valid, n, off, ids, a, b, same = bpe.encode_arrow(pa.array(texts, pa.string()), bpe.DEFAULT_TOKENIZER)
    assert same.all()
    for i, t in enumerate(texts):
        if t is None:
            assert not valid[i] and n[i] == 0
            continue
        want = other.encode_ordinary(t)
        assert list(ids[off[i] : off[i + 1]]) == want
        raw, at = t.encode(), 0
        for k, s, e in zip(want, a[off[i] : off[i + 1]], b[off[i] : off[i + 1]]):
            end = at + len(other.decode_single_token_bytes(k))
            assert s == sum(x & 0xC0 != 0x80 for x in raw[: at + 1]) - 1
            assert e == sum(x & 0xC0 != 0x80 for x in raw[:end])
            at = end
    assert token_count.count_arrow(pa.array(texts, pa.string()), bpe.DEFAULT_TOKENIZER).to_pylist() == [None if t is None else len(other.encode_ordinary(t)) for t in texts]


def test_same_as_another_library(other):
    check([t for t in ODD if t is None or len(t) < 4000], other)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8") | st.sampled_from(" \n\t　  \x85᠎'ad1."), max_size=40), max_size=4))
def test_any_text(texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    check(texts, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abzqXQj019'’+-=/_.,日本語のカタéü\u0301 \n\x85\u3000"), min_size=1, max_size=30), max_size=5))
def test_cuts_inside_runs(texts):
    """Runs without blanks, cut wherever it is called safe."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    was, bpe.LONG = bpe.LONG, 1
    try:
        check(texts, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    finally:
        bpe.LONG = was


def test_long_runs_without_blanks(other):
    r = random.Random(2)
    japanese = "".join(r.choices("私達日本語東京大阪駅前通で書くのはとても楽しいですねカタナ、。「」", k=330_000))
    base64ed = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=400_000))
    c = bpe.codec(bpe.DEFAULT_TOKENIZER)
    for t in (japanese, base64ed):
        raw = np.frombuffer(t.encode(), np.uint8)
        codes, pieces, _ = bpe.safe_pieces(raw, np.array([0, len(raw)]), c.meet)
        assert len(codes) > 1000 and max(map(len, pieces.to_pylist())) < 2000
        ids = bpe.encode_arrow(pa.array([t]), bpe.DEFAULT_TOKENIZER)[3].tolist()
        assert ids == c.tok.encode(t, add_special_tokens=False).ids
        assert token_count.count_arrow(pa.array([t]), bpe.DEFAULT_TOKENIZER).to_pylist() == [len(ids)]


def test_remembered_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "HELD", 50)
    c = bpe.Codec(bpe.DEFAULT_TOKENIZER)
    for k in range(6):
        pieces = pa.array([f" word{k}x{i}" for i in range(40)] + [" same"])
        at = c.slots(pieces)
        assert [c.ids[c.first[x] : c.first[x] + c.count[x]].tolist() for x in at] == [c.tok.encode(p, add_special_tokens=False).ids for p in pieces.to_pylist()]
        assert len(c.slot) <= 50 + 41


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 7, 8), (2, None, 7, 8)], "doc_id long, text string, n_tokens long, N_TOKENS_in long")
    got = token_count.token_counts(df, keep_text=True)
    assert got.columns[:2] == ["doc_id", "text"] and [r.n_tokens for r in got.collect()] == [2, None]
    assert sorted(v for r in got.collect() for k, v in r.asDict().items() if "_in" in k) == [7, 7, 8, 8]


def test_spark_round_trip(spark):
    df = spark.createDataFrame([(i, t, i * 2) for i, t in enumerate(ODD)] + [(None, "x", None)], "doc_id long, text string, N_Tokens int")
    got = bpe.decode(bpe.encode(df)).collect()
    assert len(got) == len(ODD) + 1
    assert all(r.decoded == r.text and r.round_trip is (None if r.text is None else True) for r in got)
    assert {r["N_Tokens_in"] for r in got if r.doc_id is not None} == {i * 2 for i in range(len(ODD))}
    empty = df.limit(0)
    assert bpe.encode(empty).count() == 0 and token_count.token_counts(empty).count() == 0
    counts = {r.doc_id: r.n_tokens for r in token_count.token_counts(df.drop("N_Tokens")).collect()}
    assert counts == {r.doc_id: r.n_tokens for r in got}


def test_decode_split_and_unknown(spark):
    ids = bpe.codec(bpe.DEFAULT_TOKENIZER).tok.encode("\U0001f642").ids
    df = spark.createDataFrame([(ids,), (ids[:1],), ([],), (None,), ([-1, 10**6, None],)], "token_ids array<int>")
    assert [r.decoded for r in bpe.decode(df).collect()] == ["\U0001f642", "�", "", None, ""]
