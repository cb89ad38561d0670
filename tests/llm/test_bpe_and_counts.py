import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import EDGES, SF_SMALL, make_docs

from credsight.llm import op1_bpe, op5_tokens

RANKS = op1_bpe.load_ranks(P.path(op1_bpe.VOCABULARY))
LIB = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = op1_bpe.Codec(P.path(op1_bpe.VOCABULARY), P.PATTERN)


def ids(t):
    return [int(x) for x in CODEC.encode(t).split()]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_encoding_is_the_librarys_and_decodes_back(t):
    assert ids(t) == LIB.encode_ordinary(t)
    assert CODEC.decode(CODEC.encode(t)) == t.encode()


def test_long_pretokens_without_white_space():
    r = random.Random(3)
    for t in ("a" * 20_000, "ab" * 10_000, "".join(r.choice("abcdet") for _ in range(20_000))):
        assert ids(t) == LIB.encode_ordinary(t)


def test_memo_keeps_the_words_of_a_large_share_of_texts(monkeypatch):
    """One worker's share of 0.5 GB has hundreds of thousands of distinct pre-tokens: each takes the queue once."""
    asked = []
    monkeypatch.setattr(op1_bpe, "encode_pretoken", lambda piece, ranks: asked.append(piece) or [len(piece)])
    c = op1_bpe.Codec(P.path(op1_bpe.VOCABULARY), P.PATTERN)
    text = [" ".join(f"x{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576 % 26)}{chr(97 + i // 456976)}"
                     for i in range(a, a + 100_000)) for a in range(0, 700_000, 100_000)]
    first = [c.encode(t) for t in text]
    assert len(set(asked)) == len(asked) >= 700_000
    asked.clear()
    assert [c.encode(t) for t in text] == first and not asked


def test_round_trip_rows(spark):
    got = op1_bpe.round_trip(make_docs(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    want = sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest(), len(LIB.encode_ordinary(t or ""))) for i, t in EDGES)
    assert sorted((str(r.doc_id), r.decoded_sha256, r.n_tokens) for r in got) == want
    assert op1_bpe.round_trip(make_docs(spark, [])).count() == 0


def test_encode_then_decode_columns(spark):
    d = spark.createDataFrame([(1, "two words", 7), (2, None, 8)], "doc_id long, text string, ids int")
    enc = op1_bpe.encode(d)
    assert enc.columns == ["doc_id", "text", "ids"]          # the new column replaces the clashing one
    rows = {r.doc_id: bytes(r.decoded) for r in op1_bpe.decode(enc).collect()}
    assert rows == {1: b"two words", 2: b""}


def test_query_on_the_table(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    got = {r.doc_id: r for r in op1_bpe.op1_bpe(spark, SF_SMALL).collect()}
    assert len(got) == len(d)
    for r in d:
        want = LIB.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(want)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()


SCORES = op5_tokens.unigram_scores(RANKS)


def best_cut(token: bytes) -> int:
    """Plain dynamic programme over all cuts of one pre-token."""
    best = [(0.0, 0)] + [None] * len(token)
    for i in range(1, len(token) + 1):
        for j in range(i):
            s = SCORES.get(token[j:i])
            if s is not None and (best[i] is None or (best[j][0] + s, best[j][1] - 1) > best[i]):
                best[i] = (best[j][0] + s, best[j][1] - 1)
    return -best[-1][1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abet hino'é1\n", max_size=40), max_size=6))
def test_counts_are_those_of_a_plain_programme(texts):
    c = op5_tokens.counter(P.path(op5_tokens.VOCABULARY), P.PATTERN)
    want = [(len(x := c.find(t)), sum(best_cut(w.encode()) for w in x)) for t in texts]
    assert c.count(texts) == want


def test_a_small_trie_gives_the_same_counts(monkeypatch):
    texts = ["the thinner things then thaw", "another than the other", "tether"] * 5
    full = op5_tokens.Counter(P.path(op5_tokens.VOCABULARY), P.PATTERN).count(texts)
    monkeypatch.setattr(op5_tokens, "MAX_NODES", 5)
    monkeypatch.setattr(op5_tokens, "MAX_MEMO", 3)
    assert op5_tokens.Counter(P.path(op5_tokens.VOCABULARY), P.PATTERN).count(texts) == full


def test_counts_of_odd_rows(spark):
    got = op5_tokens.token_counts(make_docs(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    assert {(r.n_pretokens, r.n_tokens) for r in got if r.doc_id in (1, 2)} == {(0, 0)}
    assert op5_tokens.token_counts(make_docs(spark, [])).count() == 0


def test_unknown_vocabulary_file_is_an_error(tmp_path):
    bad = tmp_path / "ranks"
    bad.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(KeyError):
        op1_bpe.Codec(str(bad), P.PATTERN).encode("b")
