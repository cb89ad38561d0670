"""Toxicity: bidirectional gated recurrent network with attention pooling.

A text is a sequence of normalised words.  The input of a word joins a word
vector and the mean vector of its character 3- to 5-grams (both hashed and
learned) with three evidence numbers: the class log-ratio of the word, and the
largest and the mean log-ratio of its character n-grams.  A GRU reads a window
of ``LENGTH`` words in each direction, attention pools the states and a
logistic unit gives the window's score.  Windows overlap by half and cover the
whole text; a text is as toxic as its worst window.

Training (numpy, back-propagation through time, Adagrad) uses a bounded sample
of at most ``PER_CLASS`` labelled documents of each class outside the held-out
fold, none longer than ``FIT_CHARS``.  Labels are of documents, not windows: in
every epoch a toxic document contributes its worst window under the current
model, a clean one its worst window and two others, some of them with every
word repeated (saying a harmless word often is not toxic).  The log-ratios that
a document is trained with leave out the document itself, as those of a new
document do, and the learned vectors of most words are blanked in a step, so
that they cannot stand in for the evidence by heart.

For scoring, the gate inputs of a word are computed once and looked up
afterwards.  Texts without words (null, empty, only punctuation) score 0.
Without training rows of both classes every score is 0.  Repeated rows give
repeated results; only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsight.llm.common import ROWS, U64, fold, label_sample, map_arrow, only_caches_of, schema_with, table, words, worker_cache

MODULUS, HELD, THRESHOLD = 5, 0, 0.5
LENGTH, STRIDE, HIDDEN, ATT = 32, 16, 8, 8
#: hash bits of the learned vectors, and of the finer log-ratio tables
WORD_BITS, GRAM_BITS, PRIOR_BITS, WORD_DIM, GRAM_DIM = 14, 15, 20, 6, 6
DIM = WORD_DIM + GRAM_DIM + 3
PER_CLASS, EPOCHS, BATCH, RATE, STUTTER = 2000, 6, 128, 0.08, 0.2
#: a small sample is gone through more often, for so many steps in all
MIN_STEPS = 240
#: share of a step's words without learned vectors
BLANK = 0.9
F32 = np.float32


def gram_slots(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, slot below 2**PRIOR_BITS) of all character 3- to 5-grams of ``<word>``."""
    sizes = np.array([len(w) + 2 for w in ws], np.int64)
    raw = np.frombuffer(b"".join(b"<" + w + b">" for w in ws), np.uint8).astype(U64)
    owner = np.repeat(np.arange(len(ws)), sizes)
    own, slot = [], []
    key = raw.copy()
    for n in range(2, 6):
        if len(raw) < n:
            break
        key = key[:len(raw) - n + 1] * U64(257) + raw[n - 1:]
        if n >= 3:
            ok = owner[:len(key)] == owner[n - 1:]
            own.append(owner[:len(key)][ok])
            x = (key[ok] + U64(n)) * U64(0x9E3779B97F4A7C15)
            slot.append((((x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)) >> U64(64 - PRIOR_BITS)).astype(np.int64))
    own, slot = np.concatenate(own), np.concatenate(slot)
    order = np.argsort(own, kind="stable")
    return own[order], slot[order]


def word_slots(ws: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, 3) >> (64 - PRIOR_BITS) for w in ws], np.int64)


def _coarse(slots: np.ndarray, bits: int) -> np.ndarray:
    return slots >> (PRIOR_BITS - bits)


def window_starts(n: int) -> list[int]:
    """Overlapping windows that cover n words; the last one ends with the text."""
    if n <= LENGTH:
        return [0]
    s = list(range(0, n - LENGTH, STRIDE))
    return s + [n - LENGTH]


def _sigmoid(x):
    return F32(1) / (F32(1) + np.exp(-np.clip(x, -30, 30)))


class Net:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        w = lambda *s, k=None: (r.standard_normal(s) / np.sqrt(k or s[0])).astype(F32)
        self.p = {"word": w(1 << WORD_BITS, WORD_DIM, k=400), "gram": w(1 << GRAM_BITS, GRAM_DIM, k=400),
                  "va": w(ATT), "wa": w(2 * HIDDEN, ATT), "ba": np.zeros(ATT, F32),
                  "wo": w(2 * HIDDEN), "bo": np.full(1, -1, F32)}
        for d in "fb":
            self.p |= {"x" + d: w(DIM, 3 * HIDDEN), "u" + d: w(HIDDEN, 3 * HIDDEN), "c" + d: np.zeros(3 * HIDDEN, F32)}
        self.word_prior = np.zeros(1 << PRIOR_BITS, F32)
        self.gram_prior = np.zeros(1 << PRIOR_BITS, F32)
        self.ready = False

    # -- inputs -----------------------------------------------------------
    def set_priors(self, ws: list[bytes], docs: list[np.ndarray], y: np.ndarray) -> None:
        """Class log-ratios of words and character n-grams by document frequency;
        documents are arrays of numbers of the words ``ws``."""
        slots = word_slots(ws)
        n = np.array([(y == 0).sum(), (y == 1).sum()], np.float64)
        # pseudo-counts in proportion to the classes: what was never seen has ratio 0
        cw = np.repeat(2 * n[:, None] / n.sum(), 1 << PRIOR_BITS, axis=1)
        cg = cw.copy()
        for d, t in zip(docs, y):
            mine = np.unique(d)
            cw[t][np.unique(slots[mine])] += 1
            cg[t][np.unique(gram_slots([ws[i] for i in mine])[1])] += 1
        self.word_prior = (np.log(cw[1] / n[1]) - np.log(cw[0] / n[0])).astype(F32) / 2
        self.gram_prior = (np.log(cg[1] / n[1]) - np.log(cg[0] / n[0])).astype(F32) / 2

        def without(c: np.ndarray, t: int) -> np.ndarray:
            least, m, c = 2 * n[t] / n.sum(), n.copy(), c.copy()
            m[t], c[t] = max(n[t] - 1, 1), np.maximum(c[t] - 1, least)
            return ((np.log(c[1] / m[1]) - np.log(c[0] / m[0])) / 2).astype(F32)

        # by label of a document: the ratios of its words without the document itself
        self.own_word = np.stack([without(cw, 0), without(cw, 1)])
        self.own_gram = np.stack([without(cg, 0), without(cg, 1)])

    def inputs(self, ws: list[bytes], label: np.ndarray | None = None):
        """Input rows of distinct words, and what the backward pass needs; in
        training, words of documents of a label."""
        slots = word_slots(ws)
        own, gs = gram_slots(ws)
        begin = np.searchsorted(own, np.arange(len(ws)))      # every <word> has a gram: words have a byte
        n = np.diff(np.append(begin, len(own))).astype(F32)[:, None]
        pri = self.gram_prior[gs] if label is None else self.own_gram[label[own], gs]
        x = np.empty((len(ws), DIM), F32)
        x[:, :WORD_DIM] = self.p["word"][_coarse(slots, WORD_BITS)]
        x[:, WORD_DIM:WORD_DIM + GRAM_DIM] = np.add.reduceat(self.p["gram"][_coarse(gs, GRAM_BITS)], begin) / n
        x[:, -3] = self.word_prior[slots] if label is None else self.own_word[label, slots]
        x[:, -2] = np.maximum.reduceat(pri, begin)
        x[:, -1] = np.add.reduceat(pri, begin) / n[:, 0]
        return x, (slots, own, gs, n)

    # -- forward ----------------------------------------------------------
    def gates(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of both directions, (words, 6 * HIDDEN)."""
        return np.concatenate([x @ self.p["xf"] + self.p["cf"], x @ self.p["xb"] + self.p["cb"]], axis=1)

    def run(self, g: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Window logits; ids (windows, LENGTH) index rows of the gate table g."""
        p, n, h3 = self.p, len(ids), 3 * HIDDEN
        s = np.empty((LENGTH, n, 2 * HIDDEN), F32)
        tape = {}
        for k, d in enumerate("fb"):
            u = p["u" + d]
            uzr, un = np.ascontiguousarray(u[:, :2 * HIDDEN]), np.ascontiguousarray(u[:, 2 * HIDDEN:])
            table_d = np.ascontiguousarray(g[:, k * h3:(k + 1) * h3])
            h = np.zeros((n, HIDDEN), F32)
            for t in range(LENGTH) if d == "f" else range(LENGTH - 1, -1, -1):
                x = table_d[ids[:, t]]
                m = mask[:, t:t + 1]
                zr = _sigmoid(x[:, :2 * HIDDEN] + h @ uzr)
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                rh = r * h
                c = np.tanh(x[:, 2 * HIDDEN:] + rh @ un)
                if keep:
                    tape[d, t] = (h, z, r, rh, c)
                h = h + m * ((F32(1) - z) * (c - h))
                s[t, :, k * HIDDEN:(k + 1) * HIDDEN] = h
        a = np.tanh(s @ p["wa"] + p["ba"])
        e = np.where(mask.T > 0, a @ p["va"], F32(-1e9))
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", e, s)
        logit = pooled @ p["wo"] + p["bo"][0]
        return (logit, (s, a, e, pooled, tape)) if keep else logit

    # -- training ---------------------------------------------------------
    def step(self, ws: list[bytes], ids: np.ndarray, mask: np.ndarray, y: np.ndarray, acc: dict,
             label: np.ndarray | None = None, blank: np.ndarray | None = None) -> float:
        p = self.p
        x, (slots, own, gs, n) = self.inputs(ws, label)
        if blank is not None:
            x[blank, :WORD_DIM + GRAM_DIM] = 0
        g = self.gates(x)
        logit, (s, a, e, pooled, tape) = self.run(g, ids, mask, keep=True)
        prob = _sigmoid(logit)
        dl = ((prob - y) / len(y)).astype(F32)
        grad = {"bo": dl.sum(keepdims=True), "wo": pooled.T @ dl}
        dp = dl[:, None] * p["wo"]
        ds = e[:, :, None] * dp
        de = np.einsum("tnk,nk->tn", s, dp)
        de = e * (de - (e * de).sum(axis=0))
        da = de[:, :, None] * p["va"] * (F32(1) - a * a)
        grad["va"] = np.einsum("tn,tnk->k", de, a)
        flat = lambda v: v.reshape(-1, v.shape[-1])
        grad["wa"], grad["ba"] = flat(s).T @ flat(da), flat(da).sum(axis=0)
        ds = ds + da @ p["wa"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u = p["u" + d]
            du, dg = np.zeros_like(u), np.zeros((len(ws), 3 * HIDDEN), F32)
            dh = np.zeros((len(ids), HIDDEN), F32)
            order = range(LENGTH - 1, -1, -1) if d == "f" else range(LENGTH)
            for t in order:
                h, z, r, rh, c = tape[d, t]
                dh = dh + ds[t, :, k * HIDDEN:(k + 1) * HIDDEN]
                m = mask[:, t:t + 1]
                step = m * dh
                dz = -step * (c - h)
                dc = step * (F32(1) - z) * (F32(1) - c * c)
                back = dh - step * (F32(1) - z)
                drh = dc @ u[:, 2 * HIDDEN:].T
                dr = drh * h
                back = back + drh * r
                dzr = np.concatenate([dz * z * (F32(1) - z), dr * r * (F32(1) - r)], axis=1)
                du[:, :2 * HIDDEN] += h.T @ dzr
                du[:, 2 * HIDDEN:] += rh.T @ dc
                back = back + dzr @ u[:, :2 * HIDDEN].T
                np.add.at(dg, ids[:, t], np.concatenate([dzr, dc], axis=1))
                dh = back
            grad["u" + d], grad["x" + d], grad["c" + d] = du, x.T @ dg, dg.sum(axis=0)
            dx += dg @ p["x" + d].T
        for name, v in grad.items():
            q = acc.setdefault(name, np.full_like(p[name], 1e-6))
            q += v * v
            p[name] -= RATE * v / np.sqrt(q)
        if blank is not None:
            dx[blank] = 0
        # hashed vectors: only the touched rows
        gw = np.zeros_like(p["word"])
        np.add.at(gw, _coarse(slots, WORD_BITS), dx[:, :WORD_DIM])
        gg = np.zeros_like(p["gram"])
        np.add.at(gg, _coarse(gs, GRAM_BITS), (dx[:, WORD_DIM:WORD_DIM + GRAM_DIM] / n)[own])
        for name, v in (("word", gw), ("gram", gg)):
            q = acc.setdefault(name, np.full_like(p[name], 1e-6))
            q += v * v
            p[name] -= RATE / 4 * v / np.sqrt(q)
        return float(-np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)))

    def over_vocabulary(self, ws: list[bytes], what, label: np.ndarray | None = None) -> np.ndarray:
        """``what(input rows)`` of all words, some thousand at a time."""
        return np.concatenate([what(self.inputs(ws[a:a + 20_000], None if label is None else label[a:a + 20_000])[0])
                               for a in range(0, len(ws), 20_000)])

    def fit(self, rows: list[tuple[str, int]], seed: int = 3, epochs: int = EPOCHS) -> "Net":
        vocab: dict[tuple[bytes, int], int] = {}          # a word is another one in documents of the other label
        docs, y = [], []
        for t, label in rows:
            d = words(t)
            if d:
                docs.append(np.array([vocab.setdefault((w, label), len(vocab)) for w in d], np.int32))
                y.append(label)
        y = np.array(y, np.int64)
        if len(set(y.tolist())) < 2:
            return self
        ws, of = [w for w, _ in vocab], np.array([t for _, t in vocab], np.int64)
        del vocab
        self.set_priors(ws, docs, y)
        rng = np.random.default_rng(seed)
        acc: dict = {}
        flat = np.concatenate(docs)
        base = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        starts = [window_starts(len(d)) for d in docs]
        win_doc = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
        win_at = base[win_doc] + np.concatenate(starts)
        win_len = np.minimum(LENGTH, np.diff(base))[win_doc]
        begin = np.searchsorted(win_doc, np.arange(len(docs) + 1))
        # first epoch: a window is as bad as the strongest evidence of one of its words
        strong = self.over_vocabulary(ws, lambda x: x[:, -3] + x[:, -2], of)[flat]
        level = np.array([strong[a:a + n].max() for a, n in zip(win_at, win_len)])
        # a rare class is shown more often, at most four times as often
        again = int(min(4, max(1, (y == 0).sum() // (y == 1).sum())))
        picks = int(again * (y == 1).sum() + 3 * (y == 0).sum())
        for _ in range(max(epochs, -(-MIN_STEPS // -(-picks // BATCH)))):
            pick = []
            for i, t in enumerate(y):
                a, b = begin[i], begin[i + 1]
                pick += [a + int(np.argmax(level[a:b]))] * (again if t else 1)
                if t == 0:
                    pick += rng.integers(a, b, 2).tolist()
            pick = rng.permutation(np.array(pick))
            for k in range(0, len(pick), BATCH):
                part = pick[k:k + BATCH]
                ids = np.zeros((len(part), LENGTH), np.int64)
                mask = np.zeros((len(part), LENGTH), F32)
                for j, w in enumerate(part):
                    mine = flat[win_at[w]:win_at[w] + win_len[w]]
                    if y[win_doc[w]] == 0 and rng.random() < STUTTER:
                        times = int(rng.integers(2, LENGTH))
                        mine = np.repeat(mine[int(rng.integers(0, len(mine))):], times)[:LENGTH]
                    ids[j, :len(mine)] = mine
                    mask[j, :len(mine)] = 1
                own, ids = np.unique(ids, return_inverse=True)
                self.step([ws[i] for i in own], ids.reshape(len(part), LENGTH), mask, y[win_doc[part]].astype(F32), acc,
                          of[own], rng.random(len(own)) < BLANK)
            table = self.over_vocabulary(ws, self.gates, of)
            level = _window_logits(self, table, flat, win_at, win_len)
        del self.own_word, self.own_gram
        self.ready = True
        return self


def _window_logits(net: Net, table: np.ndarray, flat: np.ndarray, at: np.ndarray, size: np.ndarray,
                   chunk: int = 2048) -> np.ndarray:
    """Logits of the windows that begin at ``at`` of a text of word numbers."""
    out = [np.empty(0, F32)]
    for a in range(0, len(at), chunk):
        pos = at[a:a + chunk, None] + np.arange(LENGTH)
        mask = (np.arange(LENGTH) < size[a:a + chunk, None]).astype(F32)
        out.append(net.run(table, flat[np.minimum(pos, len(flat) - 1)], mask))
    return np.concatenate(out)


class Scorer:
    """Window logits with a bounded table of the gate inputs of known words."""

    LIMIT = 120_000

    def __init__(self, net: Net):
        self.net = net
        self.index: dict[bytes, int] = {}
        self.table = np.empty((0, 6 * HIDDEN), F32)

    def _ids(self, docs: list[list[bytes]]) -> np.ndarray:
        new = {w for d in docs for w in d if w not in self.index}
        if new and len(self.index) + len(new) > self.LIMIT:
            self.index, self.table = {}, np.empty((0, 6 * HIDDEN), F32)
            new = {w for d in docs for w in d}
        if new:
            ws = list(new)
            for w in ws:
                self.index[w] = len(self.index)
            self.table = np.concatenate([self.table, self.net.over_vocabulary(ws, self.net.gates)])
        get = self.index.__getitem__
        return np.fromiter((get(w) for d in docs for w in d), np.int64, sum(map(len, docs)))

    def _layout(self, docs):
        starts, base = [], 0
        for d in docs:
            starts += [(base + s, min(LENGTH, len(d))) for s in window_starts(len(d))]
            base += len(d)
        return np.array(starts, np.int64).reshape(-1, 2)

    def windows(self, docs: list[list[bytes]]) -> np.ndarray:
        """Logits of all windows of the documents, in order; documents have words."""
        out = []
        for part in _slices(docs):
            ids, lay = self._ids(part), self._layout(part)
            out.append(_window_logits(self.net, self.table, ids, lay[:, 0], lay[:, 1]))
        return np.concatenate(out) if out else np.empty(0, F32)

    def score(self, texts: list[str | None]) -> list[float]:
        out = [0.0] * len(texts)
        if not self.net.ready:
            return out
        docs = [words(t) for t in texts]
        at = [i for i, d in enumerate(docs) if d]
        n = np.array([len(window_starts(len(docs[i]))) for i in at], np.int64)
        if len(at):
            logit = self.windows([docs[i] for i in at])
            top = np.maximum.reduceat(logit, np.concatenate([[0], np.cumsum(n)[:-1]]))
            for i, v in zip(at, _sigmoid(top.astype(np.float64))):
                out[i] = float(v)
        return out


def _slices(docs: list[list[bytes]], most: int = 60_000):
    """Consecutive documents of about ``most`` words together; a longer document is a slice of its own."""
    part, n = [], 0
    for d in docs:
        if part and n + len(d) > most:
            yield part
            part, n = [], 0
        part.append(d)
        n += len(d)
    if part:
        yield part


_SCORERS = worker_cache("op6")


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Net:
    rows = label_sample(spark, docs, labels, "toxic", MODULUS, HELD, PER_CLASS).collect()
    return Net().fit([(t, y) for _, t, y in sorted((r[0], r[1], r[2]) for r in rows)])


def classify(docs: DataFrame, net: Net, keep: list[str],
             names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``keep`` columns plus score and predicted, which replace columns of their names."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)                # a few MB, fixed by the model's size
    key = (spark.sparkContext.applicationId, shared._jbroadcast.id())
    # a text that is kept travels once
    at = keep.index("text") if "text" in keep else len(keep)
    d = docs.select(*keep) if at < len(keep) else docs.select(*keep, F.col("text").alias("_llm_text"))

    def run(batch: pa.RecordBatch) -> dict:
        only_caches_of("op6")
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shared.value)
        text = batch.column(at)
        score = []
        for a in range(0, len(text), 256):
            score += _SCORERS[key].score(text[a:a + 256].to_pylist())
        return {c: batch.column(i) for i, c in enumerate(keep)} | {
            names[0]: score, names[1]: [int(s >= THRESHOLD) for s in score]}

    return map_arrow(d, run, schema_with(docs.select(*keep), f"{names[0]} double, {names[1]} int"), ROWS)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = train(spark, docs, table(spark, sf_dir, "labels"))
    rows = docs.withColumn("held_out", fold(F.col("doc_id"), MODULUS) == HELD)
    return classify(rows, net, ["doc_id", "held_out"])
