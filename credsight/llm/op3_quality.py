"""Quality classifier: Naive Bayes support vectors.

Features are indicators of hashed n-grams: runs of one to three code points of
the raw text (case and punctuation carry the signal) and pairs of neighbouring
word shapes, with a mark for a repeated word.  Each indicator is scaled by its
class log-count ratio (Naive Bayes, add-``ALPHA``), a text's vector is scaled
to unit length, and a linear hinge-loss model is fitted by dual coordinate
descent with a box bound per class.  The margin is turned into a score by a
logistic curve fitted on the training margins (Platt), moved so that the
decision ``margin >= 0`` falls on the threshold 0.7.

The fit uses a bounded sample of at most ``PER_CLASS`` labelled documents of
each class outside the held-out fold; scoring covers every whole text.  A null
text is an empty one: both are scored by the bias alone.  Without training rows
of both classes every score is the share of class 1 (0.5 without any).
Repeated rows give repeated results; only doc_id and text are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsight.llm.common import U64, fold, label_sample, map_arrow, schema_with, table

MODULUS, HELD, THRESHOLD = 4, 2, 0.7
PER_CLASS, BITS, ALPHA, C, EPOCHS = 2500, 18, 1.0, 1.0, 40
_SPACE = re.compile(r"\s+")


def _shape(w: str) -> int:
    """A few bits that describe a word: case, digits, symbols, length."""
    core = w.strip(".,;:!?")
    return (w.isupper() | w.islower() << 1 | w.istitle() << 2 | any(map(str.isdigit, w)) << 3
            | (not core.isalnum()) << 4 | (core != w) << 5 | (w[-1:] in "!?") << 6 | min(len(w), 7) << 7)


_SHAPES: dict[str, int] = {}


def _shape_of(w: str) -> int:
    s = _SHAPES.get(w)
    if s is None:
        if len(_SHAPES) > 200_000:
            _SHAPES.clear()
        s = _SHAPES[w] = _shape(w)
    return s


def _slot(x: np.ndarray) -> np.ndarray:
    x = x * U64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> U64(31))) * U64(0xBF58476D1CE4E5B9)) >> U64(64 - BITS)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature slots of a whole text."""
    if not text:
        return np.empty(0, np.int32)
    seen = np.zeros(1 << BITS, bool)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    key = np.zeros(len(c), U64)
    for n in range(1, 4):
        if len(c) < n:
            break
        key = key[:len(c) - n + 1] * U64(1 << 21) + c[n - 1:]
        seen[_slot(key + U64(n << 60) if n == 3 else key * U64(8) + U64(n))] = True
    ws = _SPACE.split(text)
    s = np.array([_shape_of(w) for w in ws], U64)
    same = np.array([a == b for a, b in zip(ws, ws[1:])], bool)
    if len(s) > 1:
        seen[_slot((s[1:] * U64(4096) + s[:-1]) * U64(16) + U64(8) + same.astype(U64))] = True
    return np.flatnonzero(seen).astype(np.int32)


class Model:
    def __init__(self, weights: np.ndarray | None, bias: float, a: float, b: float):
        self.weights, self.bias, self.a, self.b = weights, bias, a, b

    def margin(self, f: np.ndarray, ratio_norm: float = 0.0) -> float:
        return self.bias if not len(f) else float(self.weights[f].sum()) / ratio_norm + self.bias

    def score(self, margin: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.a * margin + self.b, -30, 30))))


def fit(rows: list[tuple[np.ndarray, int]], seed: int = 5) -> tuple[Model, np.ndarray]:
    """Model and log-count ratios from (feature slots, label) rows."""
    n_slots = 1 << BITS
    y = np.array([1.0 if t else -1.0 for _, t in rows])
    if not len(y) or len(set(y)) < 2:
        share = 0.5 if not len(y) else float((y > 0).mean())
        return Model(np.zeros(n_slots), 0.0, 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))), np.zeros(n_slots)
    p, q = np.full(n_slots, ALPHA), np.full(n_slots, ALPHA)
    for f, t in rows:
        (p if t else q)[f] += 1
    n1, n0 = float((y > 0).sum()), float((y < 0).sum())
    ratio = np.log(p / (n1 + 2 * ALPHA)) - np.log(q / (n0 + 2 * ALPHA))
    x = [ratio[f] for f, _ in rows]
    x = [v / max(float(np.linalg.norm(v)), 1e-9) for v in x]
    w, bias = np.zeros(n_slots), 0.0
    box = np.where(y > 0, C * len(y) / (2 * n1), C * len(y) / (2 * n0))
    alpha = np.zeros(len(y))
    sq = np.array([float(v @ v) for v in x]) + 1.0            # the bias is a constant feature
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(y)):
            f = rows[i][0]
            g = y[i] * (float(w[f] @ x[i]) + bias) - 1.0
            new = min(max(alpha[i] - g / sq[i], 0.0), box[i])
            d = (new - alpha[i]) * y[i]
            if d:
                w[f] += d * x[i]
                bias += d
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    m = np.array([float(w[f] @ v) + bias for (f, _), v in zip(rows, x)])
    # Platt: slope by Newton steps on the balanced training margins
    a = 1.0
    wt = box / box.sum()
    goal = (y > 0).astype(float)
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(a * m, -30, 30)))
        grad = float((wt * (s - goal) * m).sum()) + 1e-3 * a
        hess = float((wt * s * (1 - s) * m * m).sum()) + 1e-3
        a = min(max(a - grad / hess, 0.1), 20.0)
    return Model(w * ratio, bias, a, float(np.log(THRESHOLD / (1 - THRESHOLD)))), ratio


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[Model, np.ndarray]:
    sample = label_sample(spark, docs, labels, "quality", MODULUS, HELD, PER_CLASS)

    def run(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "f": [features(t).tobytes() for t in batch.column(1).to_pylist()],
                "y": batch.column(2)}

    # at most 2 * PER_CLASS rows of distinct feature slots
    rows = map_arrow(sample, run, "id long, f binary, y int").collect()
    rows = sorted((r[0], bytes(r[1]), r[2]) for r in rows)
    return fit([(np.frombuffer(f, np.int32), y) for _, f, y in rows])


def classify(docs: DataFrame, model: Model, ratio: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` columns plus score and predicted."""
    spark = docs.sparkSession
    d = docs.select(*keep, F.col("text").alias("_llm_text"))
    # two vectors of 2**BITS numbers
    shared = spark.sparkContext.broadcast((model.weights.astype(np.float32), (ratio * ratio).astype(np.float32)))
    bias = model.bias

    def run(batch: pa.RecordBatch) -> dict:
        weights, square = shared.value
        score = []
        for t in batch.column(len(keep)):
            f = features(t.as_py())
            m = bias
            if len(f):
                m += float(weights[f].sum(dtype=np.float64)) / max(float(np.sqrt(square[f].sum(dtype=np.float64))), 1e-9)
            score.append(model.score(m))
        return {c: batch.column(i) for i, c in enumerate(keep)} | {
            "score": score, "predicted": [int(s >= THRESHOLD) for s in score]}

    model = Model(None, model.bias, model.a, model.b)
    return map_arrow(d, run, schema_with(docs.select(*keep), "score double, predicted int"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, ratio = train(spark, docs, table(spark, sf_dir, "labels"))
    rows = docs.withColumn("held_out", fold(F.col("doc_id"), MODULUS) == HELD)
    return classify(rows, model, ratio, ["doc_id", "held_out"])
