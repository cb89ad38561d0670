"""Document fingerprints: one-permutation MinHash, optimal densification, b-bit packing.

The shingles are the five-word runs of the normalised words (a shorter text is
one shingle).  Every shingle hash is used once: its top bits choose one of
``BINS`` bins and the bin keeps its least hash.  An empty bin copies a filled
one: with the 2-universal hash h(bin, attempt) it probes bins until one is
filled (optimal densification), so two texts that share the minima also share
the copies.  A fingerprint stores the ``BITS`` low bits of every bin, packed,
as hex.  Two different minima agree on their low bits by chance in 1 of 2**BITS
bins, which the likeness corrects: (m - c) / (1 - c), c = 2**-BITS, held
within 0 to 1.

A text without words (null, empty, only punctuation) has the fingerprint of
``BINS`` zero bins after a zero mark; it is like another such text (1.0) and
unlike any other (0.0).  Equal texts have equal fingerprints.  Rows with equal
ids are ordered by their text; a null id comes last.

The next document (descending doc_id, wrapping round) is found without a global
sort in one task: doc_id ranges are fixed by quantile bounds, every range is
sorted by Spark inside its partition, and the first row of each range -- one
per range -- is handed to the range before it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsight.llm.common import U64, HashCache, checkpointed, hash_words, mix, shingles, table, words

K, BINS, BITS = 5, 256, 4
_SHIFT = U64(64 - int(np.log2(BINS)))
_CACHE = HashCache()


def _probe(bins: np.ndarray, attempt: int) -> np.ndarray:
    x = (bins.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15) + U64(attempt * 0xD1B54A32D192ED03 & (1 << 64) - 1)
    x = (x ^ (x >> U64(32))) * U64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> U64(29))) >> _SHIFT).astype(np.int64)


_BIN_KEYS = np.arange(1, BINS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
_PROBES = np.array([_probe(np.arange(BINS), a) for a in range(64)])


def minima(s: np.ndarray) -> np.ndarray | None:
    """Densified bin minima of sorted distinct shingle hashes."""
    if not len(s):
        return None
    b = (s >> _SHIFT).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))   # sorted: the first of a bin is its least
    out = np.zeros(BINS, U64)
    filled = np.zeros(BINS, bool)
    out[b[first]] = s[first]
    filled[b[first]] = True
    todo = np.flatnonzero(~filled)
    attempt = 0
    while len(todo):
        at = _PROBES[attempt][todo] if attempt < len(_PROBES) else _probe(todo, attempt)
        ok = filled[at]
        out[todo[ok]] = out[at[ok]]
        todo = todo[~ok]
        attempt += 1
    return out


def fingerprint(text: str | None) -> str:
    m = minima(shingles(hash_words(words(text), _CACHE), K))
    if m is None:
        return "00" + "00" * (BINS * BITS // 8)
    # mixed with the bin's number: bins that copy one minimum get bits of their own, so texts
    # of few shingles do not agree in all bins by one chance
    low = (mix(m ^ _BIN_KEYS) & U64((1 << BITS) - 1)).astype(np.uint8)
    bits = np.unpackbits(low[:, None], axis=1)[:, -BITS:]
    return "01" + np.packbits(bits.ravel()).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity of two fingerprints."""
    if a[:2] == "00" or b[:2] == "00":
        return float(a[:2] == b[:2])
    x = np.unpackbits(np.frombuffer(bytes.fromhex(a[2:]), np.uint8) ^ np.frombuffer(bytes.fromhex(b[2:]), np.uint8))
    same = 1.0 - np.count_nonzero(x.reshape(BINS, BITS).any(axis=1)) / BINS
    chance = 2.0 ** -BITS
    return float(min(1.0, max(0.0, (same - chance) / (1.0 - chance))))


def edited(text: str, nxt: str) -> str:
    """The last third of ``text`` replaced by the beginning of ``nxt``."""
    m = len(text) // 3
    return text[:len(text) - m] + nxt[:m]


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, text) in (range, descending doc_id, text) order inside every
    partition, followed after each range by the next range's first row, marked
    ``borrowed``.  Null texts are empty."""
    spark = docs.sparkSession
    ranges = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    probs = [i / ranges for i in range(1, ranges)]
    # ranges - 1 numbers, whatever the table's size
    bounds = sorted(set((d.select("doc_id").agg(F.percentile_approx("doc_id", probs, 10_000)).first()[0] or [])
                        if probs else []))
    # range 0 holds the largest ids, nulls go to the last one
    if bounds:
        col = F.lit(len(bounds) + 1).cast("int")
        arr = F.array(*[F.lit(b) for b in bounds])
        above = F.size(F.filter(arr, lambda b: b < F.col("doc_id")))
        col = F.when(F.col("doc_id").isNull(), col).otherwise(F.lit(len(bounds)) - above)
    else:
        col = F.when(F.col("doc_id").isNull(), 1).otherwise(0)
    d = d.withColumn("rng", col.cast("int"))
    # the first row of every range: largest id, then least text
    heads = checkpointed(spark, d.groupBy("rng").agg(F.min(F.struct(
        F.bitwise_not("doc_id").alias("falling"), F.col("text"), F.col("doc_id"))).alias("h")))     # no overflow, unlike the negative
    order = sorted(r[0] for r in heads.select("rng").collect())       # at most ranges + 1 numbers
    before = {r: order[i - 1] for i, r in enumerate(order)}           # the first range's head closes the last one
    to = spark.createDataFrame([(k, v) for k, v in before.items()] or [(-1, -1)], "rng int, to_rng int")
    borrowed = heads.join(F.broadcast(to), "rng").select(
        F.col("to_rng").alias("rng"), F.col("h.doc_id").alias("doc_id"), F.col("h.text").alias("text"),
        F.lit(True).alias("borrowed"))
    rows = d.select("rng", "doc_id", "text", F.lit(False).alias("borrowed")).unionByName(borrowed)
    return (rows.repartitionById(len(bounds) + 2, "rng")               # a range is a partition
            .sortWithinPartitions("rng", "borrowed", F.col("doc_id").desc_nulls_last(), "text"))


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""

    def run(batches):
        last = None                                   # range, doc_id, text, fingerprint
        for b in batches:
            out = []
            for rng, i, t, borrowed in zip(*(b.column(k) for k in range(4))):
                rng, i, t, borrowed = rng.as_py(), i.as_py(), t.as_py(), borrowed.as_py()
                f = fingerprint(t)
                if last is not None and last[0] == rng:
                    e = edited(last[2], t)
                    ef = last[3] if e == last[2] else fingerprint(e)
                    out.append((last[1], len(last[2]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(),
                                last[3], ef, likeness(last[3], ef), likeness(last[3], f)))
                last = None if borrowed else (rng, i, t, f)
            cols = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=ty) for c, ty in zip(cols, _TYPES)], _NAMES)

    return with_next(docs, ranges).mapInArrow(run, _SCHEMA)


_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
           "edited_fingerprint string, near_edited double, near_next double")
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
