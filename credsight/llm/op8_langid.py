"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector, a fixed function of its code point.
The vector of a letter n-gram is the elementwise product of its letters'
vectors, the i-th rotated by n-1-i places; a text is the sum of the vectors of
its n-grams (a word is padded with a boundary letter on both sides).  A
language prototype is the sum over its training texts, each scaled to unit
length, minus the mean of the prototypes.  A text goes to the prototype of
highest cosine; ``score`` is the softmax of the cosines at ``TEMPERATURE``.

Training reads text and non-null lang of every document outside the held-out
fold; the sums are aggregated per task before one shuffle of
languages x dimension values.  Texts without a letter, null and empty ones,
give ``und`` and score 0; with no training rows every text does.  Ties go to
the alphabetically first language.  Repeated rows give repeated results; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsight.llm.common import fold, map_arrow, table

DIM, N, MODULUS, HELD, TEMPERATURE = 512, 3, 3, 1, 0.02
UND = "und"
#: True for the code points that are letters
_LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letter_vector(c: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(c.encode("utf-8", "surrogatepass"), 17)
    return (np.random.default_rng(seed).integers(0, 2, DIM) * 2 - 1).astype(np.int8)


def gram_vector(gram: str) -> np.ndarray:
    v = np.ones(DIM, np.int8)
    for i, c in enumerate(gram):
        v = v * np.roll(letter_vector(c), len(gram) - 1 - i)
    return v


class Profiles:
    """Text vectors; the n-gram vectors are kept in one bounded matrix."""

    LIMIT = 40_000

    def __init__(self):
        self._reset()

    def _reset(self):
        self.index: dict[int, int] = {}
        self.letters: dict[int, np.ndarray] = {}
        self.matrix = np.empty((1024, DIM), np.int8)

    def _letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            self.letters[c] = letter_vector(chr(c))
        return self.letters[c]

    def _rows(self, keys: list[int]) -> np.ndarray:
        if len(self.index) + len(keys) > max(self.LIMIT, len(keys)):
            self._reset()
        out = np.empty(len(keys), np.int64)
        for j, k in enumerate(keys):
            i = self.index.get(k)
            if i is None:
                i = self.index[k] = len(self.index)
                if i == len(self.matrix):
                    self.matrix = np.concatenate([self.matrix, np.empty_like(self.matrix)])
                v = np.ones(DIM, np.int8)
                for s in range(N):
                    v = v * np.roll(self._letter((k >> 21 * (N - 1 - s)) & 0x1FFFFF), N - 1 - s)
                self.matrix[i] = v
            out[j] = i
        return out

    def vector(self, text: str | None) -> np.ndarray | None:
        """Sum of the n-gram vectors, None if the text has no letter."""
        if not text:
            return None
        c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letter = _LETTER[c]
        if not letter.any():
            return None
        # every run of other characters is one boundary
        c = np.where(letter, c, 32)[np.concatenate([[True], letter[1:] | letter[:-1]])]
        n = len(c) - N + 1
        key = np.zeros(n, np.int64)
        for j in range(N):
            key = key << 21 | c[j:j + n]
        keys, counts = np.unique(key, return_counts=True)
        total = np.zeros(DIM, np.float32)
        rows = self._rows(keys.tolist()) if len(keys) <= self.LIMIT else None
        if rows is None:                       # more distinct n-grams than the matrix keeps
            for a in range(0, len(keys), self.LIMIT):
                r = self._rows(keys[a:a + self.LIMIT].tolist())
                total += counts[a:a + self.LIMIT].astype(np.float32) @ self.matrix[r].astype(np.float32)
            return total
        return counts.astype(np.float32) @ self.matrix[rows].astype(np.float32)


_PROFILES: list[Profiles] = []


def profiles() -> Profiles:
    if not _PROFILES:
        _PROFILES.append(Profiles())
    return _PROFILES[0]


def prototypes(docs: DataFrame) -> dict[str, np.ndarray]:
    """Language -> prototype from (text, lang) rows.  The result is languages x
    DIM numbers, whatever the number of rows."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        p = profiles()
        for b in batches:
            for t, lang in zip(b.column(0), b.column(1).to_pylist()):
                v = p.vector(t.as_py())
                if v is not None:
                    norm = float(np.linalg.norm(v))
                    if norm:
                        sums[lang] = sums.get(lang, 0) + v / norm
        for lang, v in sums.items():
            # rounded to integers, so that the sums do not depend on their order
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * DIM), pa.array(range(DIM), pa.int32()),
                 pa.array(np.rint(v * 1e6).astype(np.int64))], ["lang", "i", "x"])

    rows = (docs.where(F.col("lang").isNotNull()).select("text", "lang")
            .mapInArrow(run, "lang string, i int, x long")
            .groupBy("lang", "i").agg(F.sum("x").alias("x")).collect())
    out: dict[str, np.ndarray] = {}
    for lang, i, x in rows:
        out.setdefault(lang, np.zeros(DIM))[i] = x
    # the vector that all languages share (boundaries, common letters) tells nothing
    mean = np.mean([v / max(np.linalg.norm(v), 1e-9) for v in out.values()], axis=0) if len(out) > 1 else 0
    return {k: v / max(np.linalg.norm(v), 1e-9) - mean for k, v in sorted(out.items())}


def predict(docs: DataFrame, protos: dict[str, np.ndarray], keep: list[str]) -> DataFrame:
    """``keep`` columns plus lang_pred and score."""
    names = list(protos)
    m = np.array([protos[k] / max(np.linalg.norm(protos[k]), 1e-9) for k in names], np.float32).reshape(len(names), DIM)
    d = docs.select(*keep, F.col("text").alias("_llm_text"))

    def run(batch: pa.RecordBatch) -> dict:
        p = profiles()
        lang, score = [], []
        for t in batch.column(len(keep)):
            v = p.vector(t.as_py()) if names else None
            if v is None:
                lang.append(UND)
                score.append(0.0)
                continue
            cos = (m @ v).astype(np.float64) / max(float(np.linalg.norm(v)), 1e-9)
            e = np.exp((cos - cos.max()) / TEMPERATURE)
            k = int(np.argmax(cos))
            lang.append(names[k])
            score.append(float(e[k] / e.sum()))
        return {c: batch.column(i) for i, c in enumerate(keep)} | {"lang_pred": lang, "score": score}

    from credsight.llm.common import schema_with
    return map_arrow(d, run, schema_with(docs.select(*keep), "lang_pred string, score double"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    f = fold(F.col("doc_id"), MODULUS)
    protos = prototypes(docs.where(f != HELD))
    rows = docs.select("doc_id", "text", (f == HELD).alias("held_out"))
    return predict(rows, protos, ["doc_id", "held_out"])
