"""Near-duplicate joins, line dedup and the pipeline against brute force."""

import random
import uuid

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import EDGES, SF_SMALL, make_docs
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from credsight.llm import common, op1_bpe
from credsight.llm import op2_decontaminate as op2
from credsight.llm import op4_jaccard as op4
from credsight.llm import op6_toxicity as op6
from credsight.llm import op7_lines as op7
from credsight.llm.common import words


def similar(a, b, t=0.8):
    if not a and not b:
        return True
    c = len(a & b)
    return 5 * c >= 4 * (len(a) + len(b) - c)


def brute_groups(rows):
    """(id, copy_id, class_id, n_links) of every row."""
    sets = [frozenset(op4.text_set(t).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    least = lambda ks: min((rows[k][0] for k in ks if rows[k][0] is not None), default=None)
    return [(rows[i][0], least(k for k in range(len(rows)) if sets[k] == sets[i]),
             least(k for k in range(len(rows)) if find(k) == find(i)), n[i]) for i in range(len(rows))]


def near_texts(seed=5):
    """Groups of copies and near copies, chains among them, and plain texts."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for size in (1, 1, 2, 3, 30):
        base = [r.choice(vocab) for _ in range(120)]
        for _ in range(size):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append((k, " ".join(t)))
            k += 1
            if r.random() < 0.4:
                base = t
    r.shuffle(rows)
    return rows


def key(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("block", [op4.BLOCK, 4])
def test_link_is_brute_force(spark, block):
    rows = near_texts() + [(i if i is None else i + 1000, t) for i, t in EDGES if i != 5]
    got = op4.link(make_docs(spark, rows), block=block).collect()
    assert key(map(tuple, got)) == key(brute_groups(rows))


def bare_kept(rows):
    """Of rows without words: null texts, and the row of least id of every other text."""
    least = {}
    for i, t in rows:
        if t is not None and not words(t):
            least[t] = min(least.get(t, (True, 0)), (i is None, i or 0))
    return [(i, t) for i, t in rows if t is None] + [(None if nul else i, t) for t, (nul, i) in least.items()]


def test_deduplicate_keeps_one_of_each_group(spark):
    rows = near_texts(9) + [(i if i is None else i + 1000, t) for i, t in EDGES if i != 5]
    docs = make_docs(spark, rows).withColumnRenamed("lang", "class_id")
    left = op4.deduplicate(docs)
    assert left.columns == docs.columns
    kept = left.collect()
    groups = brute_groups(rows)
    worded = [r for r in kept if words(r.text)]
    # one row per group; "null id text here" is a group without an id
    assert [r.text for r in worded if r.doc_id is None] == ["null id text here"]
    bare = {c for (i, _, c, _), (_, t) in zip(groups, rows) if not words(t)}
    assert sorted(r.doc_id for r in worded if r.doc_id is not None) == sorted(
        {c for *_, c, _ in groups if c is not None} - bare)
    assert sorted(repr((r.doc_id, r.text)) for r in kept if not words(r.text)) == sorted(map(repr, bare_kept(rows)))
    assert op4.deduplicate(make_docs(spark, [])).count() == 0 and op4.link(make_docs(spark, [])).count() == 0


def test_texts_without_words_stay(spark):
    rows = [(1, "!!!"), (2, "{}"), (3, None), (4, ""), (5, "!!!"), (6, "word"), (7, "Word."), (8, None), (9, "")]
    docs = make_docs(spark, rows).withColumns({"_nj_id": F.lit(1), "_NJ_KEY": F.lit(2)})
    left = op4.deduplicate(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 4, 6, 8]


def test_line_dedup_takes_any_column_names(spark):
    docs = make_docs(spark, [(1, "a b c\nd e f"), (2, "x y z\na b c")]).withColumns({"_ld_th": F.lit("mine"), "_ld_lines": F.lit(3), "_ld_id": F.lit(4)})
    out = op7.dedup_lines(docs, counts=False)
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r._ld_th, r._ld_lines, r._ld_id) for r in out.collect()} == {
        1: ("a b c\nd e f", "mine", 3, 4), 2: ("x y z", "mine", 3, 4)}


def test_only_the_own_cache_is_left():
    a, b = common.worker_cache("t-a"), common.worker_cache("t-b")
    a["x"], b["y"] = 1, 2
    common.only_caches_of("t-a")
    assert a == {"x": 1} and b == {} and common.worker_cache("t-a") is a
    assert op6._SCORERS is common.worker_cache("op6")


def test_bands_reach_the_recall():
    bands, rows = op4.choose_bands()
    assert bands * rows <= op4.MAX_ROWS and 1 - (1 - op4.THRESHOLD ** rows) ** bands >= op4.RECALL
    with pytest.raises(ValueError):
        op4.choose_bands(0.1, 0.999, 10)


def test_intersections_of_many_sets():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 9000, n).astype(np.uint64)) for n in (1, 50, 7000, 6000, 300)]
    got = op4._intersections(sets)
    for i in range(5):
        for j in range(5):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_components_of_a_long_chain_and_a_star(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    random.Random(2).shuffle(e)
    got = {r.node: r.root for r in op4.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)}
    assert op4.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- lines -----------------------------------------------------------------
def brute_lines(rows):
    """Texts after removal, by (id, text); ids are unique or the rows repeat."""
    seen, out = [], {}
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    for i, t in order:
        if t is None:
            out[i, t] = None
            continue
        stay = []
        for line in t.split("\n"):
            w = frozenset(words(line))
            if not w:
                stay.append(line)
                continue
            if not any(similar(w, o) for o in seen):
                stay.append(line)
            seen.append(w)
        out[i, t] = "\n".join(stay)
    return out


def line_docs(seed=3):
    r = random.Random(seed)
    vocab = [f"t{i}" for i in range(60)]
    pool = [[r.choice(vocab) for _ in range(r.choice([1, 2, 3, 4, 5, 9, 10, 25]))] for _ in range(25)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(r.randrange(0, 8)):
            line = list(r.choice(pool))
            for _ in range(r.choice([0, 0, 1, 2])):
                line[r.randrange(len(line))] = r.choice(vocab)
            lines.append(r.choice([" ", ", "]).join(line))
        rows.append((d, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("block", [op7.BLOCK, 3])
def test_line_dedup_is_brute_force(spark, block):
    rows = line_docs() + [(200, None), (201, ""), (202, "!!\n??\n"), (203, "a b\n\nb a"), (204, "same doc\nx"), (204, "same doc\nx"),
                          (None, "of a null id\nt1 t2"), (205, "w " * 50_000), (206, "\n".join(f"t{i}" for i in range(100)))]
    docs = make_docs(spark, rows).withColumnRenamed("lang", "n_lines")
    got = op7.dedup_lines(docs, block=block).collect()
    want = brute_lines(rows)
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(r[0]), str(want[r])) for r in rows)
    for r in got:
        assert r.n_lines - r.n_removed == (0 if r.text is None else r.n_lines if r.n_removed == 0 else
                                           len(r.text.split("\n")) if r.text else r.n_lines - r.n_removed)
    assert op7.dedup_lines(docs, counts=False).columns == docs.columns
    assert op7.dedup_lines(make_docs(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=12), min_size=1, max_size=12))
def test_ordered_sets_are_distinct_and_in_one_order(lines):
    h = np.array([x * 0x9E3779B97F4A7C15 % 2**64 for ln in lines for x in ln], np.uint64)
    line = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    level = np.arange(1 << op7.SLOT_BITS).astype(np.uint8) % 5
    ln, tok = op7.ordered_sets(h, line, level)
    rank = {}
    for i, x in enumerate(lines):
        mine = tok[ln == i].tolist()
        assert sorted(mine) == sorted({y * 0x9E3779B97F4A7C15 % 2**64 for y in x})
        assert mine == sorted(mine, key=lambda v: (level[v >> (64 - op7.SLOT_BITS)], v))
        rank[i] = mine


ODD = ["", "\n", "\n\n", "a", "a\n", "\na b\n\n!!\nC", "x y", "ends here", "Starts", "é É ü\u2028z", "x" * 300 + " " + "x" * 301,
       "abcdefgh abcdefghi abcdefg\nABCDEFGH " + "q" * 64 + " " + "q" * 65, None, "1\r\n2", "!", "ab" * 40 + "\n" + "line of words\n" * 60]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("cut", [0, 3])
def test_line_words_are_the_words_of_the_lines(size, cut):
    """Texts lie side by side in a batch; words neither cross them nor change with the slices."""
    for kind in (pa.string(), pa.large_string()):
        texts = pa.array(ODD * 2, kind).slice(cut)
        want = [(d, i, w) for d, t in enumerate(texts.to_pylist()) for i, x in enumerate((t or "").split("\n")) for w in words(x)]
        got = [(d, i, h) for doc, number, k, hs in op7.line_words(texts, size)
               for d, i, h in zip(np.repeat(doc, k).tolist(), np.repeat(number, k).tolist(), hs.tolist())]
        assert [r[:2] for r in got] == [r[:2] for r in want]
        of = dict(zip((r[2] for r in want), (r[2] for r in got)))
        assert [of[r[2]] for r in want] == [r[2] for r in got] and len(set(of.values())) == len(of)
    assert list(op7.line_words(pa.array([], pa.string()))) == [] and list(op7.line_words(pa.array([None], pa.string()))) == []


def test_candidates_meet_at_their_first_common_token(spark):
    """Near copies share most of a prefix, yet are listed only where no earlier token can be shared."""
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(0, 60, 2):
        line = r.sample(vocab, 45)
        rows += [(d, " ".join(line)), (d + 1, " ".join(line[:-1] + [f"only{d}"]))]
    docs = make_docs(spark, rows)
    level = op7.rarity(docs)
    classes = op7.line_classes(op7.line_rows(docs, level, 0.8)).drop("fp").cache()
    listed = {(x.bucket, x.lid) for x in op7.candidates(classes, 0.8).collect()}
    prefix = {x.lid: [t for t in x.prefix] for x in classes.collect()}
    assert len(prefix) == 60 and all(len(t) == 10 for t in prefix.values())
    assert {lid for _, lid in listed} == set(prefix)            # every class has its near copy
    # sets of 45 need 40 in common, so the first one of them is among the first six
    assert all(prefix[lid].index(bucket) < 6 for bucket, lid in listed)


def test_rarity_counts_every_slot(spark):
    docs = make_docs(spark, [(i, "often " * 3 + f"word{i}\nagain word{i}") for i in range(40)] + [(99, None), (100, "")])
    counts = np.zeros(1 << op7.SLOT_BITS, np.int64)
    for *_, h in op7.line_words(pa.array([t for (t,) in docs.select("text").collect()])):
        np.add.at(counts, (h >> np.uint64(64 - op7.SLOT_BITS)).astype(np.int64), 1)
    assert np.array_equal(op7.rarity(docs.repartition(3)), np.ceil(np.log2(counts + 1)).astype(np.uint8))
    assert not op7.rarity(make_docs(spark, [])).any()


def python_above_python(spark, df):
    """Whether a stage of the plan of ``df`` feeds one Python worker from another."""
    plan = df._jdf.queryExecution().sparkPlan().toString().split("\n")
    return any("MapInArrow" in a and "MapInArrow" in b for a, b in zip(plan, plan[1:])) or any(
        "MapInArrow" in a and "Project" in b and "MapInArrow" in c for a, b, c in zip(plan, plan[1:], plan[2:]))


def test_a_task_of_line_dedup_holds_one_python_worker(spark):
    docs = make_docs(spark, [(1, "one two three\nfour five six"), (2, "one two three"), (3, None), (4, ""), (5, "a\n\nb")])
    out = op7.dedup_lines(docs)
    assert not python_above_python(spark, out)
    assert key(tuple(r) for r in out.select("doc_id", "text", "n_lines", "n_removed").collect()) == key(
        [(1, "one two three\nfour five six", 2, 0), (2, "", 1, 1), (3, None, 0, 0), (4, "", 1, 0), (5, "a\n\nb", 3, 0)])


def test_toxicity_sends_a_kept_text_once(spark):
    docs = make_docs(spark, [(1, "some words"), (2, None)])
    out = op6.classify(docs, op6.Net(), docs.columns)
    fed = [x for x in out._jdf.queryExecution().analyzed().toString().split("\n") if "MapInArrow" in x]
    assert len(fed) == 1 and "_llm_text" not in out._jdf.queryExecution().analyzed().toString()
    assert [(r.doc_id, r.text, r.predicted) for r in out.orderBy("doc_id").collect()] == [(1, "some words", 0), (2, None, 0)]


# -- pipeline --------------------------------------------------------------
def test_stages_in_order_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    names = docs.columns
    cur, kept = docs, {}
    for name, stage in pipe.STAGES:
        out = stage(spark, cur, SF_SMALL)
        if name != "bpe":
            assert sorted(out.columns) == sorted(names)
        path = f"{tmp_path}/{uuid.uuid4().hex}"
        out.write.parquet(path)
        kept[name] = (cur, spark.read.parquet(path))
        cur = kept[name][1]
    pairs = lambda d: [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    before, after = (pairs(x) for x in kept["toxicity"])
    assert set(after) < set(before) and len(after) > 0.8 * len(before)
    net = op6.train(spark, docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    scores = op6.Scorer(net).score([t for _, t in before])
    assert set(after) == {r for r, s in zip(before, scores) if s < 0.5}
    before, after = (pairs(x) for x in kept["line_dedup"])
    want = brute_lines(before)
    assert sorted(after) == sorted((i, want[i, t]) for i, t in before)
    before, after = (pairs(x) for x in kept["jaccard_join"])
    groups = brute_groups(before)
    assert sorted(i for i, t in after if words(t)) == sorted({c for (_, _, c, _), (_, t) in zip(groups, before) if words(t)})
    assert sorted(i for i, t in after if not words(t)) == sorted(i for i, _ in bare_kept(before))
    before, after = (pairs(x) for x in kept["decontaminate"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    wins = op2.WindowSet({b" ".join(w[i:i + 10]): ["x"] for _, t in items if (w := words(t))
                          for i in range(max(1, len(w) - 9))}.items())
    assert sorted(after) == sorted(r for r in before if not wins.hits(words(r[1])))
    before, after = kept["bpe"][0].collect(), kept["bpe"][1].collect()
    import public_tokenizers as P
    codec = op1_bpe.codec(P.path(op1_bpe.VOCABULARY), P.PATTERN)
    assert {r.doc_id: r.n_tokens for r in after} == {r.doc_id: len(codec.encode(r.text or "").split()) for r in before}


def test_toxicity_stage_takes_any_column_names(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumns({"_tox": F.lit(7), "_Tox_Score": F.lit("s")})
    out = pipe.toxicity(spark, docs, SF_SMALL)
    assert out.columns == docs.columns and {(r._tox, r._Tox_Score) for r in out.select("_tox", "_Tox_Score").collect()} == {(7, "s")}


def test_stages_take_empty_tables(spark):
    docs = make_docs(spark, [])
    for name, stage in pipe.STAGES:
        assert stage(spark, docs, SF_SMALL).count() == 0, name
