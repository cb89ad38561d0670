"""Cross-tokenizer alignment against whole-text encodings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import EDGES, SF_SMALL, make_docs

from credsight.llm import op12_align as op12

AL = op12.aligner(op12.default_paths())


def brute_text(text):
    """(a ids, b ids, groups, links) from the whole text and its decoded bytes alone."""
    none = ([], [], [], [])
    if not text:
        return none
    a = AL.a.encode(" " + text, add_special_tokens=False).ids
    b = AL.b.encode(text)
    ab, bb = [AL.a_bytes[i] for i in a], [AL.b_bytes[i] for i in b]
    raw = (" " + text).encode()
    if b"".join(ab) != raw or b"".join(bb) != raw:
        return none

    def spans(tokens):
        out, at = [], 0
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    sa, sb = spans(ab), spans(bb)
    cuts = sorted({e for _, e in sa} & {e for _, e in sb})
    place = {c: k for k, c in enumerate(cuts)}
    groups = [([], []) for _ in cuts]
    for side, ids, at in ((0, a, sa), (1, b, sb)):
        k = 0
        for i, (_, e) in zip(ids, at):
            groups[k][side].append(i)
            k = place[e] + 1 if e in place else k
    links, j = [], 0
    for i, (s, e) in zip(a, sa):
        while sb[j][1] <= s:
            j += 1
        k = j
        while k < len(sb) and sb[k][0] < e:
            links.append((i, b[k]))
            k += 1
    return a, b, groups, links


def brute(rows):
    found = [(i, *brute_text(t)) for i, t in rows]
    docs = Counter()
    for *_, links in found:
        docs.update(set(links))
    top = {}
    for (a, _), n in docs.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for i, a, b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(docs[p] == top[p[0]] for p in links),
                    sum(docs[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


def codes(es):
    return np.frombuffer(b"".join(e[4] for e in es), AL.code).tolist()


ODD = ["  two  spaces ", " ", "\n", "a\n  b", "tab\t x ", "naïve café 😀 end", "\U00010348 कखा x́ y", "▁ low", "a▁b",
       "</s><s><|endoftext|> <unk> <0x0A>", "it's we'll", "x" * 3000, "日本語 テキスト 。 続く", " nb   em", "a\u0085 b\u001c c", "\x00 nul",
       "﻿bom", "１２ ½ ²"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    a, b, groups, links = brute_text(text)
    es = next(AL.entries([text]))
    got = (0, 0, 0, [], "") if es is None else (
        sum(e[0] for e in es), sum(e[1] for e in es), sum(e[2] for e in es), codes(es), b"".join(e[3] for e in es)[:-1].decode())
    assert got[:3] == (len(a), len(b), len(groups))
    assert [divmod(c, AL.width) for c in got[3]] == links
    assert got[4] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab'1.\n\t  éß😀日▁́ ​")) | st.characters(codec="utf-8"), max_size=40))
def test_chunks_equal_whole_texts(text):
    a, b, groups, links = brute_text(text)
    es = next(AL.entries([text])) or []
    assert codes(es) == [x * AL.width + y for x, y in links]
    assert (sum(e[0] for e in es), sum(e[1] for e in es), sum(e[2] for e in es)) == (len(a), len(b), len(groups))


def ends(lengths, spans):
    s = np.array(spans, np.int64).reshape(-1, 2)
    return op12.token_ends(np.array(lengths, np.int64), s[:, 0], s[:, 1]).tolist()


def test_token_ends_refine_shared_characters():
    assert ends([2, 1, 1, 1], [(0, 2), (2, 4), (2, 4), (4, 5)]) == [2, 3, 4, 5]
    assert ends([1, 1, 2], [(0, 2), (2, 2), (2, 4)]) == [1, 2, 4]      # an empty span is no cut
    assert ends([3, 1], [(0, 1), (1, 2)]) == [3, 4]                    # the bytes decide
    assert ends([], []) == []


def test_chunks_side_by_side_with_some_without_tokens():
    todo = ["a", "▁", " b.", "naïve", "x▁y", "😀1"]
    assert AL.run(todo) == [AL.run([c])[0] for c in todo]
    assert AL.run(["▁"]) == [op12.NO_TOKENS]


def test_memo_keeps_words_met_again():
    al = op12.Aligner(*op12.default_paths())
    want = [codes(es) for es in al.entries(["one two two", "one three"])]
    assert set(al.fresh) == {"one", "two", "three"} and not al.memo      # one call: words of the same group are not met again
    assert [codes(es) for es in al.entries(["one two two", "one three"])] == want
    assert set(al.memo) == {"one", "two", "three"}


def test_spans_of_a_table(spark):
    text = "naïve 😀 ▂ end"
    r = op12.align(make_docs(spark, [(1, text), (2, None), (3, "a▁b")])).orderBy("doc_id").collect()
    raw = (" " + text).encode()
    for ids, ends, tok in ((r[0].a_ids, r[0].a_ends, AL.a_bytes), (r[0].b_ids, r[0].b_ends, AL.b_bytes)):
        assert [raw[s:e] for s, e in zip([0, *ends], ends)] == [tok[i] for i in ids]
    assert r[0].cuts == sorted(set(r[0].a_ends) & set(r[0].b_ends)) and r[0].cuts[-1] == len(raw)
    assert r[1].a_ids == r[2].a_ids == r[2].cuts == []


def test_table_equals_brute_force(spark):
    rnd = random.Random(3)
    words = ["the", "The", "naïve", "zq", "x1", "日本", "😀", "it's", "run-on", "."]
    rows = EDGES + [(100 + k, t) for k, t in enumerate(ODD)] + [
        (200 + k, " ".join(rnd.choices(words, k=rnd.randrange(1, 60)))) for k in range(60)]
    want = brute(rows)
    docs = make_docs(spark, rows).selectExpr("*", "1 AS n_a", "'x' AS pairs", "2 AS count_sum")
    assert sorted(map(tuple, op12.alignment_digests(docs).collect()), key=repr) == want
    # the same in several blocks of counts
    assert sorted(map(tuple, op12.alignment_digests(docs, max_pairs=40).collect()), key=repr) == want


def test_empty_table(spark):
    assert op12.alignment_digests(make_docs(spark, [(1, "x")]).where("false")).collect() == []


def test_query_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, op12.op12_align(spark, SF_SMALL).collect()), key=repr) == brute(rows)
