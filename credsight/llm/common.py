"""Helpers shared by the training-data operators.

* words: lower-case A-Z; a word is a maximal run of digits, a-z and non-ASCII
  characters.  On UTF-8 bytes this is one 256-entry translation and a split.
* folds: ``crc32`` of the decimal doc_id.
* rows are processed by ``mapInArrow``: one bounded Arrow batch at a time.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credsight.session import checkpoint_dir

#: byte -> itself for [0-9a-z] and >= 0x80, lower case for A-Z, space otherwise
WORD_BYTES = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32
    for b in range(256))

U64 = np.uint64

#: longest text a classifier is fitted on (scoring takes every whole text)
FIT_CHARS = 40_000


def words(text: str | None) -> list[bytes]:
    """Normalised words of a text as UTF-8 bytes; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


_WORKER_CACHES: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """A dict that lives on in the Python worker; :func:`only_caches_of` empties those of other owners."""
    return _WORKER_CACHES.setdefault(owner, {})


def only_caches_of(owner: str) -> None:
    """Called in a task: frees what earlier stages of a job left in a reused worker."""
    for name, cache in _WORKER_CACHES.items():
        if name != owner:
            cache.clear()


class HashCache(dict):
    """bytes -> 64-bit hash, computed on first use; emptied when full."""

    def __init__(self, limit: int = 200_000, seed: int = 0, owner: str | None = None):
        super().__init__()
        self.limit, self.seed = limit, seed
        if owner:
            _WORKER_CACHES[owner] = self

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w, self.seed)
        return h


def hash_words(ws: list[bytes], cache: HashCache) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, ws), U64, len(ws))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising mixer on 64-bit hashes (wraps on overflow)."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a word-hash sequence.

    A text of fewer than k words, but not none, is one shingle.
    """
    if not len(h):
        return np.empty(0, U64)
    k = min(k, len(h))
    n = len(h) - k + 1
    s = np.full(n, k, U64)
    for j in range(k):
        s = s * U64(0x9E3779B97F4A7C15) + h[j:j + n]
    return np.unique(mix(s))


#: rows at once where whole texts are returned; a multiple of what models score together (256)
ROWS = 1024


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str | T.StructType,
              rows: int | None = None) -> DataFrame:
    """``fn(batch) -> {column: values}`` over Arrow batches of every partition; with ``rows`` so
    many rows at a time, which bounds the results that a task holds."""
    struct = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = rows or whole.num_rows
            for a in range(0, whole.num_rows, size or 1):
                out = fn(whole.slice(a, size))
                cols = [out[f.name] if isinstance(out[f.name], (pa.Array, pa.ChunkedArray))
                        else pa.array(out[f.name], type=f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return df.mapInArrow(run, struct)


def schema_with(df: DataFrame, extra: str) -> T.StructType:
    """Columns of ``df`` and the extra ones; an extra column replaces one of its name."""
    new = T._parse_datatype_string(extra).fields
    names = {f.name.lower() for f in new}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in names] + list(new))


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, each with underscores behind it until it clashes with none."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal doc_id, modulo; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


def checkpointed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Materialise once in the shared checkpoint folder and cut the lineage."""
    checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Have the driver's JVM collect frames that nobody holds any more: Spark's cleaner then
    removes the shuffle files of their finished stages, which otherwise stay until
    the JVM happens to collect them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Like ``checkpointed``, as a Parquet table: half the bytes, and later
    steps read only their columns.  The files stay in the shared folder below
    ``credsight-llm`` until its owner clears it."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/credsight-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def label_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str,
                 modulus: int, held: int, per_class: int) -> DataFrame:
    """Bounded training sample: (_id, text, y) of at most ``per_class`` labelled
    documents of each class outside the held-out fold, one row per id.  The ids are
    taken from those that documents holds: texts of up to ``FIT_CHARS`` by the order
    of a hash of doc_id; where a class has too few, longer ones, the shortest first,
    while the class stays within ``per_class * FIT_CHARS`` characters (the first
    document always counts); last, texts without words.  An id with several texts
    counts with the one that comes first by this order.  Rows with a null id,
    label or text are left out; an id labelled twice counts once, with its larger
    label.
    """
    lab = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()
                        & (fold(F.col("doc_id"), modulus) != held))
           .groupBy("doc_id").agg(F.max(label).alias("y")))
    # one narrow row per id: no text is shuffled
    best = (docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
            .groupBy("doc_id").agg(F.min(F.struct(
                (~F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")).alias("wordless"),
                F.greatest(F.length("text"), F.lit(FIT_CHARS)).alias("over"),
                F.length("text").alias("size"), F.xxhash64("text").alias("print"))).alias("b"))
            .select("doc_id", "b.*"))
    ids = []
    for y in (0, 1):
        rows = (best.join(lab.where(F.col("y") == y), "doc_id")
                .orderBy("wordless", "over", F.xxhash64("doc_id"), "doc_id").limit(per_class)
                .select("doc_id", "size", "print").collect())          # at most per_class ids
        room = per_class * FIT_CHARS
        for k, r in enumerate(rows):
            room -= r[1]
            if room >= 0 or k == 0:
                ids.append((r[0], y, r[1], r[2]))
    chosen = spark.createDataFrame(ids, "_id long, y int, _size int, _print long")
    # the id list is bounded by per_class, so the text table is not shuffled; rows left that repeat id and text are equal
    return (docs.join(F.broadcast(chosen), (docs["doc_id"] == chosen["_id"]) & (F.length("text") == chosen["_size"])
                      & (F.xxhash64("text") == chosen["_print"]))
            .select("_id", "text", "y").dropDuplicates(["_id"]))
