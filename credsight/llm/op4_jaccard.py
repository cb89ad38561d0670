"""N-gram Jaccard join: MinHash banding, exact verification.

A document is the set of its five-word shingles (hashed to 64 bits; a shorter
text is one shingle).  Documents with equal sets form a *copy class*; only one
set per class goes on.  ``choose_bands`` takes the largest row count whose
signature stays within ``MAX_ROWS`` and the band count that finds a pair at the
threshold with the target recall.  Classes meet in the buckets of their band
hashes.

* Buckets with the same members are kept once, under their first band.
* A bucket of more than ``BLOCK`` members is cut into blocks, one job for each
  pair of blocks, so no task holds a whole hot bucket and no pair is lost.
* A job has the full shingle sets of its members and counts intersections by a
  product of incidence blocks.  A pair of classes is counted only in the job of
  the first band they share, so no list of pairs is ever made or deduplicated.
* A job returns one row per linked member: number of linked classes and
  documents, and the least member it is connected to.  Groups (connected
  components) come from alternating large-star and small-star steps on these
  edges, checkpointed after every step.

Texts without words (null, empty, punctuation only) have the empty set; they
form one copy class, J = 1 among themselves and 0 to any other.  Repeated rows
are documents of their own.  A null doc_id takes part; an id reported for a
class is its least non-null one.  Extra columns are ignored by ``link`` and
passed through by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credsight.llm.common import U64, HashCache, checkpointed, free_names, hash_words, map_arrow, only_caches_of, shingles, table, words

K, THRESHOLD, RECALL, MAX_ROWS, BLOCK = 5, 0.8, 0.999, 160, 256
_CACHE = HashCache(owner="op4")


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_rows: int = MAX_ROWS) -> tuple[int, int]:
    """(bands, rows): the most selective bands of at most ``max_rows`` hashes that reach the recall."""
    best = None
    for rows in range(1, max_rows + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))
        if bands * rows <= max_rows:
            best = (bands, rows)
    if best is None:
        raise ValueError("max_rows is too small for this recall")
    return best


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(2024).integers(1, 1 << 63, n, dtype=U64) * U64(2) + U64(1)


def band_hashes(s: np.ndarray, mult: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit hash per band; sorted distinct shingles in."""
    low = np.full(len(mult), np.iinfo(U64).max, U64)
    for a in range(0, len(s), 1024):
        np.minimum(low, (mult[:, None] * s[None, a:a + 1024]).min(axis=1), out=low)
    rows = (low >> U64(16)).reshape(bands, -1)
    h = np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)     # a bucket belongs to one band
    for j in range(rows.shape[1]):
        h = (h ^ rows[:, j]) * U64(0xBF58476D1CE4E5B9)
        h ^= h >> U64(29)
    return h.view(np.int64)


def text_set(text: str | None) -> np.ndarray:
    return shingles(hash_words(words(text), _CACHE), K)


def set_print(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _name():
    """The document's id as text; a hash of the text for a null id."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("h"), F.xxhash64("text").cast("string")))


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, fp, bands): ``key`` tells rows of one id and set from others."""

    def run(batch: pa.RecordBatch) -> dict:
        only_caches_of("op4")
        mult = _multipliers(bands * rows)
        fp, bh = [], []
        for t in batch.column(1):
            s = text_set(t.as_py())
            fp.append(set_print(s))
            bh.append(band_hashes(s, mult, bands).tolist() if len(s) else [])
        return {"doc_id": batch.column(0), "key": [f + i.encode() for f, i in zip(fp, batch.column(2).to_pylist())], "fp": fp, "bands": bh}

    d = docs.select("doc_id", "text", _name().alias("id"))
    return map_arrow(d, run, T.StructType([d.schema["doc_id"], *T._parse_datatype_string(
        "key binary, fp binary, bands array<bigint>").fields]))


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of common shingles."""
    m = len(sets)
    if m == 2:
        c = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), c], [c, len(sets[1])]], np.float32)
    cat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(cat, kind="stable")
    cat, owner = cat[order], owner[order]
    new = np.concatenate([[True], cat[1:] != cat[:-1]])
    col = np.cumsum(new) - 1
    shared = np.bincount(col)[col] > 1
    owner, col = owner[shared], col[shared]
    out = np.zeros((m, m), np.float32)
    if len(col):
        col = np.cumsum(np.concatenate([[True], col[1:] != col[:-1]])) - 1
        width = 4096
        cuts = np.searchsorted(col, np.arange(0, col[-1] + width + 1, width))
        for k in range(len(cuts) - 1):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                x = np.zeros((m, width), np.float32)
                x[owner[a:b], col[a:b] - k * width] = 1
                out += x @ x.T
    return out


def _job(members: list[tuple], threshold: float) -> list[tuple]:
    """Rows (fp, root, classes, docs) of the linked members of one job."""
    band, blk_i, blk_j = members[0][1], members[0][2], members[0][3]
    sets = [np.frombuffer(m[7], U64) for m in members]
    size = np.array([len(s) for s in sets], np.float64)
    inter = _intersections(sets).astype(np.float64)
    link = inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-9
    np.fill_diagonal(link, False)
    if blk_i != blk_j:                       # pairs inside a block have a job of their own
        blk = np.array([m[4] for m in members])
        link &= blk[:, None] != blk[None, :]
    bh = np.array([m[6] for m in members], np.int64)
    for b in range(band):                    # counted where the first shared band is
        link &= bh[:, None, b] != bh[None, :, b]
    hit = np.flatnonzero(link.any(axis=1))
    if not len(hit):
        return []
    weight = np.array([m[8] for m in members], np.int64)
    root = np.arange(len(members))           # members come sorted by fp: the least index is the least fp
    while True:
        low = np.minimum(root, np.where(link, root[None, :], len(root)).min(axis=1))
        low = low[low]
        if (low == root).all():
            break
        root = low
    return [(members[i][5], members[root[i]][5], int(link[i].sum()), int(weight[link[i]].sum())) for i in hit]


def verified_links(sig: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Copy classes (fp, rep, n_docs) and the job rows (fp, root, n_classes, n_linked)."""
    spark = sig.sparkSession
    # the row of least id stands for a class, one without an id only if there is no other
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nul"), "doc_id", "key"))
    classes = sig.groupBy("fp").agg(least.alias("r"), F.count("*").alias("n_docs"), F.first("bands").alias("bands")).select(
        "fp", F.col("r.doc_id").alias("rep"), F.col("r.key").alias("rep_key"), "n_docs", "bands")
    spread = classes.select("fp", F.posexplode("bands").alias("band", "h"))
    # equal buckets are found by count, xor, least and largest member: all of them partial aggregates
    same = (spread.groupBy("h", "band").agg(
        F.count("*").alias("c"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .where("c > 1"))
    jobs = (same.groupBy("c", "x", "a", "b").agg(F.min(F.struct("band", "h")).alias("j"))
            .select(F.col("j.h").alias("h"), F.ceil(F.col("c") / block).cast("int").alias("nb")))
    m = (spread.join(jobs, "h")
         .withColumn("blk", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("nb")).cast("int"))
         .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
         .select("h", "band", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk", "fp"))
    members = checkpointed(spark, m)
    need = members.select("fp").distinct().join(classes.select("fp", "rep_key", "n_docs", "bands"), "fp")
    # texts of the representatives: by id, then the set of the text tells it from rows with the same id
    keys = need.select(F.col("fp").alias("want"), F.expr("substr(rep_key, 17)").cast("string").alias("id"))
    d = docs.select(_name().alias("id"), "text")

    def run(batch: pa.RecordBatch) -> dict:
        want, sets = [], []
        for w, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            s = text_set(t.as_py())
            if set_print(s) == w:
                want.append(w)
                sets.append(s.tobytes())
        return {"fp": want, "set": sets}

    sets = map_arrow(d.join(keys, "id").select("want", "text"), run, "fp binary, set binary").dropDuplicates(["fp"])
    full = sets.join(need.select("fp", "n_docs", "bands"), "fp")
    rows = (members.join(full, "fp")
            .select("h", "band", "bi", "bj", "blk", "fp", "bands", "set", "n_docs"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "h", "bi", "bj").sortWithinPartitions("h", "bi", "bj", "fp")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, out = None, [], []
        for b in batches:
            cols = [b.column(i) for i in range(b.num_columns)]
            for r in range(b.num_rows):
                row = tuple(c[r].as_py() for c in cols)
                key = (row[0], row[2], row[3])
                if key != at:
                    if len(group) > 1:
                        out += _job(group, threshold)
                    at, group = key, []
                group.append(row)
                if len(out) > 20_000:
                    yield _links_batch(out)
                    out = []
        if len(group) > 1:
            out += _job(group, threshold)
        yield _links_batch(out)

    links = checkpointed(spark, rows.mapInArrow(verify, "fp binary, root binary, n_classes long, n_linked long"))
    return classes.select("fp", "rep", "n_docs", "rep_key"), links


def _links_batch(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out)) if out else [[]] * 4
    types = [pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                      ["fp", "root", "n_classes", "n_linked"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b); root is the least node.

    Large-star and small-star steps alternate until the edge set stays the
    same; each step is two joins on aggregated minima, so a node with very many
    neighbours is pre-aggregated and its join can be split.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if not large:
            both = both.where("v < u")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        j = both.join(low, "u")
        out = j.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else \
            j.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    cur = checkpointed(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(cur)
    while seen[0]:
        cur = checkpointed(spark, star(star(cur, True), False))
        now = state(cur)
        if now == seen:
            break
        seen = now
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _labelled(docs: DataFrame, threshold: float, recall: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Signatures, and the copy classes with their group: (fp, copy_id, class_id, n_links, keep_key)."""
    spark = docs.sparkSession
    bands, rows = choose_bands(threshold, recall)
    sig = checkpointed(spark, signatures(docs, bands, rows))
    classes, links = verified_links(sig, docs, threshold, block)
    near = links.groupBy("fp").agg(F.sum("n_linked").alias("n_linked"))
    comp = components(links.select(F.col("fp").alias("a"), F.col("root").alias("b")))
    c = (classes.join(near, "fp", "left").join(comp.withColumnRenamed("node", "fp"), "fp", "left")
         .withColumn("root", F.coalesce("root", "fp")))
    # the document that stays: least id, then least key
    groups = c.groupBy("root").agg(F.min("rep").alias("class_id"), F.min(F.struct(
        F.col("rep").isNull(), "rep", "rep_key")).alias("keep"))
    c = c.join(groups, "root").select(
        "fp", F.col("rep").alias("copy_id"), "class_id",
        (F.col("n_docs") - 1 + F.coalesce("n_linked", F.lit(0))).alias("n_links"),
        F.col("keep.rep_key").alias("keep_key"))
    return sig, c


def link(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, copy_id (least id with an equal set),
    class_id (least id of its connected group), n_links (documents at or above
    the threshold, copies included)."""
    sig, c = _labelled(docs, threshold, recall, block)
    return sig.select("doc_id", "fp").join(c, "fp").select("doc_id", "copy_id", "class_id", "n_links")


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Rows of ``docs``, one document of each group: the one of least id.  A text without
    words (empty, punctuation only) is a copy of equal texts alone; null texts all stay."""
    names = docs.columns
    worded = F.coalesce(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False))
    bare, docs = docs.where(~worded), docs.where(worded)
    # partial aggregates: however many empty texts there are, each task sends one
    first = F.min_by(F.struct(*names), F.struct(F.col("doc_id").isNull().alias("nul"), "doc_id"))
    bare = bare.where("text IS NULL").unionByName(bare.where("text IS NOT NULL").groupBy("text").agg(first.alias("r")).select("r.*"))
    _, c = _labelled(docs, threshold, recall, block)
    at_text = names.index("text")
    ident, key = free_names(names, "_nj_id", "_nj_key")

    def run(batch: pa.RecordBatch) -> dict:
        keys = [set_print(text_set(t.as_py())) + i.as_py().encode()
                for t, i in zip(batch.column(at_text), batch.column(len(names)))]
        return {n: batch.column(i) for i, n in enumerate(names)} | {key: keys}

    keyed = map_arrow(docs.withColumn(ident, _name()), run, T.StructType([*docs.schema.fields, T.StructField(key, T.BinaryType())]))
    keep = c.select(F.col("keep_key").alias(key)).distinct()
    return keyed.join(keep, key).dropDuplicates([key]).select(*names).unionByName(bare)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
