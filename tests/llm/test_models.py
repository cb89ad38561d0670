"""Quality, toxicity and language: held-out accuracy, edge rows, folds."""

import zlib
from collections import Counter

import numpy as np
from llm_cases import EDGES, make_docs

from credsight.llm import op3_quality, op6_toxicity, op8_langid
from credsight.llm.common import label_sample

SF = "/root/testdata/sf0.1"


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_quality_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op3_quality.op3_quality(spark, SF).collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None]
    assert all(got[r.doc_id].held_out == (crc(r.doc_id, 4) == 2) for r in labels)
    held = [(r.quality, got[r.doc_id].predicted) for r in labels if got[r.doc_id].held_out]
    assert len(held) > 500 and np.mean([a == b for a, b in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_toxicity_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op6_toxicity.op6_toxicity(spark, SF).collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic is not None]
    held = [(r.toxic, got[r.doc_id].predicted) for r in labels if crc(r.doc_id, 5) == 0]
    # a few hundred toxic documents to learn from, some labelled so without any toxic word
    assert np.mean([a == b for a, b in held]) > 0.97
    assert np.mean([b for a, b in held if a == 1]) > 0.8 and np.mean([b for a, b in held if a == 0]) < 0.01
    assert all(r.held_out == (crc(i, 5) == 0) and 0 <= r.score <= 1 for i, r in got.items())


def test_toxicity_finds_the_held_out_documents_with_toxic_words(spark):
    got = {r.doc_id: r for r in op6_toxicity.op6_toxicity(spark, SF).collect()}
    text = {r.doc_id: set(op6_toxicity.words(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic is not None and r.doc_id in text]
    # words of at least four toxic documents, seven times as frequent there as in clean ones
    seen, n = [Counter(), Counter()], Counter(r.toxic for r in labels)
    for r in labels:
        seen[r.toxic].update(text[r.doc_id])
    toxic = {w for w, c in seen[1].items() if c >= 4 and c / n[1] > 7 * (seen[0][w] + 1) / n[0]}
    held = [(r, got[r.doc_id].predicted) for r in labels if got[r.doc_id].held_out]
    # the floors before class weights, on what a text can show, and the later bound on clean documents
    assert np.mean([r.toxic == b for r, b in held]) > 0.98
    assert np.mean([b for r, b in held if r.toxic == 1 and text[r.doc_id] & toxic]) > 0.95
    assert np.mean([b for r, b in held if r.toxic == 0]) < 0.01
    assert np.mean([b for r, b in held if r.toxic == 1]) > 0.9


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op8_langid.op8_langid(spark, sf).collect()}
    held = [(r.lang, got[r.doc_id].lang_pred) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()
            if r.lang is not None and crc(r.doc_id, 3) == 1 and got[r.doc_id].lang_pred != "und"]
    assert np.mean([a == b for a, b in held]) > 0.97


def test_language_of_odd_rows(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("x", None)],
                                  "text string, lang string")
    protos = op8_langid.prototypes(train)
    assert sorted(protos) == ["de", "en"]
    got = op8_langid.predict(make_docs(spark, EDGES + [(9, "12 34 !"), (10, "und der hund"), (11, "中文")]), protos, ["doc_id"]).collect()
    assert len(got) == len(EDGES) + 3
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].lang_pred == by[2].lang_pred == by[9].lang_pred == "und" and by[1].score == 0
    assert by[10].lang_pred == "de" and by[11].lang_pred in ("de", "en")
    none = op8_langid.predict(make_docs(spark, [(1, "words")]), {}, ["doc_id"]).collect()
    assert none[0].lang_pred == "und"
    assert op8_langid.prototypes(train.limit(0)) == {}
    assert op8_langid.predict(make_docs(spark, []), protos, ["doc_id"]).count() == 0


def test_text_vector_is_the_sum_of_its_gram_vectors():
    p = op8_langid.Profiles()
    want = sum(op8_langid.gram_vector(" añb a "[i:i + 3]).astype(int) for i in range(5))
    assert (p.vector("Añb--a!") == want).all()
    p.LIMIT = 2                                    # more n-grams than the matrix keeps
    assert (p.vector("Añb--a!") == want).all()


def test_models_without_labels_score_every_row(spark):
    docs = make_docs(spark, EDGES)
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model, ratio = op3_quality.train(spark, docs, labels)
    got = op3_quality.classify(docs, model, ratio, ["doc_id"]).collect()
    assert len(got) == len(EDGES) and {r.score for r in got} == {0.5}
    net = op6_toxicity.train(spark, docs, labels)
    got = op6_toxicity.classify(docs.withColumnRenamed("lang", "score"), net, ["doc_id", "score"]).collect()
    assert len(got) == len(EDGES) and {r.score for r in got} == {0.0}
    assert op6_toxicity.classify(make_docs(spark, []), net, ["doc_id"]).count() == 0


def test_label_sample_fills_from_documents_at_hand_and_takes_an_id_once(spark):
    long = "long words " * 4_000
    docs = make_docs(spark, [(i, f"good words {i}") for i in range(10)] + [(3, "good words 3"), (4, "other text of the id")]
                     + [(i, long + str(i)) for i in range(10, 16)] + [(i, "?!") for i in range(16, 40)] + [(90, None)])
    # class 0: short texts among many ids that documents does not hold; class 1: long or wordless texts only
    labels = spark.createDataFrame([(i, 0) for i in [*range(10), *range(1000, 3000), 90]] + [(i, 1) for i in range(10, 40)],
                                   "doc_id long, toxic int")
    got = label_sample(spark, docs, labels, "toxic", 5, 0, 200).collect()
    free = [i for i in range(40) if crc(i, 5) != 0]
    assert sorted(r._id for r in got) == free and all(r.y == (r._id >= 10) for r in got)
    few = [r._id for r in label_sample(spark, docs, labels, "toxic", 5, 0, 3).collect()]
    assert len(few) == len(set(few)) and sum(i < 10 for i in few) == 3
    assert {i for i in few if i >= 10} <= set(range(10, 16)) and sum(i >= 10 for i in few) == 2   # 3 * FIT_CHARS hold two of them
    net = op6_toxicity.train(spark, docs, labels)
    assert net.ready


def test_margin_model_separates_and_scores_empty_text():
    rows = [(op3_quality.features(t), y) for t, y in [("good plain words", 1), ("more plain words", 1), ("BAD!! LOUD!!", 0), ("LOUD!! BAD!!", 0)] * 5]
    model, ratio = op3_quality.fit(rows)
    norm = lambda f: float(np.sqrt((ratio[f] ** 2).sum()))
    score = lambda t: model.score(model.margin(f := op3_quality.features(t), norm(f)))
    assert score("plain words again") > 0.7 > score("VERY LOUD!!")
    assert 0 <= model.score(model.margin(op3_quality.features(None))) <= 1


def test_toxicity_gradients_agree_with_differences():
    m = op6_toxicity
    net = m.Net()
    docs = [m.words(t) for t in ("a fine day out", "you awful thing", "nice and calm words here", "awful awful you")]
    y = np.array([0, 1, 0, 1])
    vocab, ids, mask = {}, np.zeros((4, m.LENGTH), np.int64), np.zeros((4, m.LENGTH), m.F32)
    for j, d in enumerate(docs):
        ids[j, :len(d)] = [vocab.setdefault(w, len(vocab)) for w in d]
        mask[j, :len(d)] = 1
    net.set_priors(list(vocab), [ids[j, :len(d)] for j, d in enumerate(docs)], y)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    base = {k: v.copy() for k, v in net.p.items()}

    def loss():
        p = 1 / (1 + np.exp(-net.run(net.gates(net.inputs(list(vocab))[0].astype(np.float64)), ids, mask)))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    acc = {}
    net.step(list(vocab), ids, mask, y.astype(np.float64), acc)
    grad = {k: np.sqrt(np.maximum(acc[k] - 1e-6, 0)) * np.sign(base[k] - net.p[k]) for k in acc}
    net.p = base
    for name in ("uf", "ub", "xf", "xb", "wa", "va", "wo", "cf"):
        flat = net.p[name].ravel()
        i = int(np.argmax(np.abs(grad[name].ravel())))
        old = flat[i]
        flat[i] = old + 1e-2
        up = loss()
        flat[i] = old - 1e-2
        down = loss()
        flat[i] = old
        assert abs((up - down) / 2e-2 - grad[name].ravel()[i]) < 1e-3 * max(1, abs(up - down) * 100)


def test_windows_cover_the_text_and_the_worst_counts():
    m = op6_toxicity
    for n in (1, 31, 32, 33, 48, 49, 1000):
        s = m.window_starts(n)
        assert s[0] == 0 and max(s[-1] + m.LENGTH, n) == max(n, m.LENGTH) and all(b - a <= m.STRIDE for a, b in zip(s, s[1:]))
    calm, vile = "calm words in a row ", "you vile creature "
    rows = [(calm * n, 0) for n in range(1, 31)] + [(calm * (n % 7) + vile * (1 + n % 3) + calm * (n % 5), 1) for n in range(30)]
    sc = m.Scorer(m.Net().fit(rows, epochs=3))
    low, high = sc.score(["calm words in a row " * 400, "calm words in a row " * 200 + "you vile creature " * 3 + "calm words " * 200])
    assert low < 0.5 < high and sc.score([None, "", "?!"]) == [0.0, 0.0, 0.0]


def test_quality_dual_equals_a_plain_solver():
    """Hinge loss with boxes by class: coordinate descent against projected gradient on the dense dual."""
    r = np.random.default_rng(4)
    rows = []
    for k in range(40):
        y = int(r.random() < 0.5)
        f = np.unique(np.concatenate([r.integers(0, 60, 12), r.integers(100 + 40 * y, 140 + 40 * y, 6), r.integers(100, 180, 3)]))
        rows.append((f.astype(np.int32), y))
    model, ratio = op3_quality.fit(rows)
    y = np.array([1.0 if t else -1.0 for _, t in rows])
    x = np.zeros((len(rows), 200))
    for i, (f, _) in enumerate(rows):
        x[i, f] = ratio[f]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    kernel = (x @ x.T + 1.0) * np.outer(y, y)                   # the bias is a constant feature
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    box = np.where(y > 0, op3_quality.C * len(y) / (2 * n1), op3_quality.C * len(y) / (2 * n0))
    alpha, step = np.zeros(len(y)), 1.0 / np.linalg.norm(kernel, 2)
    for _ in range(20_000):
        alpha = np.clip(alpha - step * (kernel @ alpha - 1.0), 0.0, box)
    want = (x @ x.T + 1.0) @ (alpha * y)
    got = [model.bias + model.weights[f].sum() / np.linalg.norm(ratio[f]) for f, _ in rows]
    assert np.abs(np.array(got) - want).max() < 0.05
    obj = lambda w2, m: 0.5 * w2 + (box * np.maximum(0, 1 - y * m)).sum()
    w = x.T @ (alpha * y)
    mine = np.zeros(200)
    used = ratio[:200] != 0
    mine[used] = model.weights[:200][used] / ratio[:200][used]
    best = obj(w @ w + (alpha @ y) ** 2, want)
    assert obj(mine @ mine + model.bias ** 2, np.array(got)) < best * 1.01 + 1e-6


def test_language_prediction_is_brute_force(spark):
    """Every prediction of a table from gram vectors built letter by letter."""
    texts = {"x": ["abra cadabra", "bra bra cad", "Abracad!"], "y": ["lorem ipsum", "ipsum dolor lorem", "dolor"], "z": ["zzz éé zz", "éz zé"]}
    rows = [(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts)]
    docs = spark.createDataFrame(rows + [(90, None, "x"), (91, "123", None), (92, "cad abra", None), (93, "loré", None)],
                                 "doc_id long, text string, lang string").repartition(3)

    def vector(text):
        t = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
        t = f" {' '.join(t.split())} "
        if not t.strip():
            return None
        return sum(op8_langid.gram_vector(t[i:i + 3]).astype(float) for i in range(len(t) - 2))

    unit = lambda v: v / np.linalg.norm(v)
    sums = {}
    for _, t, lang in rows:
        sums[lang] = sums.get(lang, 0) + unit(vector(t))
    mean = np.mean([unit(v) for v in sums.values()], axis=0)
    protos = {k: unit(unit(v) - mean) for k, v in sums.items()}
    got = {r.doc_id: r.lang_pred for r in op8_langid.predict(docs, op8_langid.prototypes(docs), ["doc_id"]).collect()}
    for i, t, *_ in docs.collect():
        v = vector(t)
        assert got[i] == (op8_langid.UND if v is None else max(sorted(protos), key=lambda k: protos[k] @ unit(v))), (i, t)


def test_toxicity_scores_a_table_as_the_plain_network(spark):
    """Every window of every text one by one through the network's own layers."""
    r = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choice(vocab, r.integers(1, 120)).tolist() + ["bad"] * (k % 3 == 0)) for k in range(40)] + ["bad", "", None, "!!!", "awful " * 300]
    net = op6_toxicity.Net().fit([(t or "", int("bad" in (t or "") or "awful" in (t or ""))) for t in texts if t], epochs=1)
    assert net.ready
    docs = make_docs(spark, list(enumerate(texts)))
    got = {x.doc_id: x.score for x in op6_toxicity.classify(docs, net, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        ws = op6_toxicity.words(t)
        if not ws:
            assert got[i] == 0.0
            continue
        best = -np.inf
        for s in op6_toxicity.window_starts(len(ws)):
            w = ws[s:s + op6_toxicity.LENGTH]
            g = net.over_vocabulary(w, net.gates)
            ids, mask = np.zeros((1, op6_toxicity.LENGTH), np.int64), np.zeros((1, op6_toxicity.LENGTH), np.float32)
            ids[0, :len(w)], mask[0, :len(w)] = np.arange(len(w)), 1
            best = max(best, float(net.run(g, ids, mask)[0]))
        assert abs(got[i] - 1 / (1 + np.exp(-best))) < 1e-4, i
