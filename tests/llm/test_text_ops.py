"""Decontamination, chat windows and fingerprints against brute force and hand-made cases."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import EDGES, SF_SMALL, make_docs

from credsight.llm import op2_decontaminate as op2
from credsight.llm import op9_chat as op9
from credsight.llm import op10_fingerprint as op10
from credsight.llm.common import HashCache, hash_words, shingles, words


def word_list(t):
    low = (t or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_words_are_those_of_the_pattern(t):
    assert [w.decode() for w in words(t)] == word_list(t)


def brute_hits(text, bench, n=10):
    w, pos, items = word_list(text), set(), set()
    for item, t in bench:
        b = word_list(t)
        size = min(n, len(b))
        wins = {tuple(b[i:i + size]) for i in range(len(b) - size + 1)} if b else set()
        for i in range(len(w) - size + 1 if size else 0):
            if tuple(w[i:i + size]) in wins:
                pos.update(range(i, i + size))
                if item is not None:
                    items.add(str(item))
    return len(w), sorted(pos), sorted(items)


BENCH = [(1, "One two three four five six seven eight nine ten eleven twelve"), (10, "short item"), (2, "é b"), (2, "é b"),
         (None, "no id words"), (3, None), (4, ""), (5, "?!")]
TEXTS = ["zero one two, three four five six seven eight nine ten eleven TWELVE thirteen", "a SHORT   item b", "É b is not é b",
         "these no id words", "nothing at all", "one two three four five six seven eight nine", "short item short item"]


@pytest.mark.parametrize("max_windows", [op2.MAX_WINDOWS, 2])
def test_scan_is_brute_force_also_in_blocks(spark, max_windows):
    rows = list(enumerate(TEXTS)) + [(i if i is None else i + 100, t) for i, t in EDGES]
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = make_docs(spark, rows).withColumnRenamed("lang", "n_words")
    got = op2.scan(docs, bench, max_windows=max_windows).select("doc_id", "text", "n_words", "hit_words", "hit_items").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.hit_words, r.hit_items) == brute_hits(r.text, BENCH), r.text


def test_decontaminate_spans_and_documents(spark):
    docs, bench = make_docs(spark, list(enumerate(TEXTS)) + [(50, None)]), spark.createDataFrame(BENCH, "item_id long, text string")
    left = op2.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [4, 5, 50]
    cut = {r.doc_id: r.text for r in op2.decontaminate(docs, bench, "spans").collect()}
    assert len(cut) == len(TEXTS) + 1 and cut[4] == TEXTS[4] and cut[50] is None
    assert all(not brute_hits(t, BENCH)[1] for t in cut.values())
    # a cut that brings two halves of an item together is cut again
    again = op2.decontaminate(make_docs(spark, [(1, "short short item item")]), bench, "spans").collect()
    assert not brute_hits(again[0].text, BENCH)[1]
    with pytest.raises(ValueError):
        op2.decontaminate(docs, bench, "none")
    # a column of the helper's name comes back as it was
    named = op2.decontaminate(docs.selectExpr("*", "doc_id * 2 AS _dc_hit_words"), bench, "spans")
    assert all(r._dc_hit_words == 2 * r.doc_id for r in named.collect())


def test_empty_benchmark_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op2.digest(op2.scan(make_docs(spark, [(1, "a b")]), none)).first().contaminated is False
    assert op2.scan(make_docs(spark, []), none).count() == 0


# -- chat ------------------------------------------------------------------
def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


CHAT = [(1, 0, "system", "be brief"), (1, 1, "user", "hi <|turn|>~1"), (1, 2, "assistant", "~0 </s>[INST] <|end|>\n"),
        (1, 2, "assistant", "~0 </s>[INST] <|end|>\n"), (2, 5, "assistant", None), (2, None, None, "first"),
        (None, 0, "ro\nle", "null id"), (3, 0, "user", ""), (3, 1, "assistant", "")]
CHAT += [(4, i, ("user", "assistant")[i % 2], "word " * (i * 37 % 60)) for i in range(60)]
CHAT += [(5, 0, "system", "s"), (5, 1, "user", "x" * 20_000), (5, 2, "assistant", "y" * 9_000)]


def ordered():
    out = {}
    for c, t, r, x in CHAT:
        out.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    return {c: sorted(v) for c, v in out.items()}


def test_windows_read_back_to_the_conversations(spark):
    conv = spark.createDataFrame([(*r, "extra") for r in CHAT], "conv_id long, turn long, role string, text string, win string")
    win = op9.format_windows(conv).cache()
    got = {r.conv_id: r for r in op9.digest(win).collect()}
    want = ordered()
    assert set(got) == set(want)
    for c, turns in want.items():
        target = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(target), sha(target))
        assert got[c].formatted_chars == sum(len(r.formatted) for r in win.where(f"conv_id <=> {'null' if c is None else c}").collect())
    wins = win.where("conv_id = 4").orderBy("win").collect()
    assert len(wins) > 3 and any(r.n_context for r in wins)
    for r in wins:                        # the stride, its last turn and the history bound a window
        assert len(r.formatted) <= 4 * (op9.STRIDE + op9.HISTORY) + 300 + 40 * 60
    assert all(r.formatted.startswith("<|turn|>system\ns<|end|>\n") for r in win.where("conv_id = 5").collect())
    win.unpersist()


def test_history_is_repeated_but_masked(spark):
    conv = spark.createDataFrame([(1, i, "assistant", "t" * 80) for i in range(50)], "conv_id long, turn long, role string, text string")
    w = op9.format_windows(conv, stride=100, history=50).orderBy("win").collect()
    assert len(w) == 12 and [r.n_context for r in w] == [0] + [2] * 11
    assert sum(len(r.loss) for r in w) == 50
    assert all(r.formatted[s.s:s.s + s.l] == "t" * 80 for r in w for s in r.loss)


def test_empty_conversations_and_escapes(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op9.digest(op9.format_windows(none)).count() == 0
    with pytest.raises(ValueError):
        op9.format_windows(none, stride=10, history=20)
    texts = ["~", "~0", "~1~", "<|", "<<SYS>>", "<</SYS>>[INST][/INST]<s></s>", "~<|~|>~0~~9", "a\nb"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    r = d.select("t", op9.escape(d.t).alias("e"), op9.unescape(op9.escape(d.t)).alias("u")).collect()
    assert all(x.t == x.u and not any(c in x.e for c in op9.CONTROLS) for x in r)


def test_chat_plan_has_no_python(spark):
    plan = op9.op9_chat(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# -- fingerprints ----------------------------------------------------------
def jaccard(a, b):
    x, y = (set(shingles(hash_words(words(t), HashCache())).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_fingerprints_of_next_and_edited(spark, ranges):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {r.doc_id: r for r in op10.fingerprints(d, ranges).collect()}
    rows = sorted(d.select("doc_id", "text").collect(), key=lambda r: -r.doc_id)
    assert len(got) == len(rows)
    for r, nxt in zip(rows, rows[1:] + rows[:1]):
        t, n = r.text or "", nxt.text or ""
        m = len(t) // 3
        e = t[:len(t) - m] + n[:m]
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (len(t), sha(e))
        assert g.fingerprint == op10.fingerprint(t) and g.edited_fingerprint == op10.fingerprint(e)
        assert g.near_edited == op10.likeness(g.fingerprint, g.edited_fingerprint)
        assert abs(g.near_edited - jaccard(t, e)) < 0.2 and abs(g.near_next - jaccard(t, n)) < 0.2


def test_fingerprints_of_odd_rows(spark):
    got = op10.fingerprints(make_docs(spark, EDGES), 4).collect()
    assert len(got) == len(EDGES)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint and by[1].n_chars == 0
    assert len({r.fingerprint for r in got if r.doc_id == 3}) == 1
    assert op10.fingerprints(make_docs(spark, []), 4).count() == 0
    one = op10.fingerprints(make_docs(spark, [(7, "abcdef g")]), 4).first()
    assert one.near_next == 1.0 and one.edited_sha256 == sha("abcdef" + "ab")


def test_fingerprints_of_the_least_and_the_largest_id(spark):
    ids = [-2 ** 63, -2 ** 63 + 1, -1, 0, 2 ** 63 - 1]
    got = {r.doc_id: r for r in op10.fingerprints(make_docs(spark, [(i, f"text of {k} words here") for k, i in enumerate(ids)]), 3).collect()}
    assert sorted(got) == ids
    text = {i: f"text of {k} words here" for k, i in enumerate(ids)}
    for i, nxt in zip(ids, ids[-1:] + ids[:-1]):             # descending, the least is followed by the largest
        m = len(text[i]) // 3
        assert got[i].edited_sha256 == sha(text[i][:len(text[i]) - m] + text[nxt][:m])


def test_fingerprint_ranges_are_partitions(spark):
    d = op10.with_next(make_docs(spark, [(i, "x") for i in range(500)]), 20)
    per = [{r.rng for r in p} for p in d.select("rng").rdd.glom().collect()]
    assert sum(len(p) for p in per) == len(set().union(*per)) and max(map(len, per)) == 1


def test_likeness_of_few_and_no_shingles():
    f = op10.fingerprint
    assert op10.likeness(f(""), f(None)) == 1.0 and op10.likeness(f(""), f("a")) == 0.0
    assert max(op10.likeness(f(f"word{i}"), f(f"other{i}")) for i in range(200)) < 0.2
    assert f("Same  TEXT") == f("same text")
