"""Line dedup: exact set-similarity join on line tokens.

A line (text between line feeds) is the set of its normalised words; lines
without words are never matched and stay.  A line goes if an earlier line --
by doc_id, text hash, line number -- has a Jaccard similarity of ``THRESHOLD``
or more to it.

1. Token counts over all lines go into ``SLOTS`` hashed counters; their
   logarithm, then the hash, orders the tokens by rarity.  Any total order
   gives right results, rarity keeps the buckets small.
2. Lines with equal sets form a class; its first line stands for it, all others
   go.  A class has its rarest ``n - ceil(t n) + 1`` tokens (the prefix), the
   set size and a 256-bit map of its tokens.
3. Classes that share a prefix token (32 bits of its hash) are candidates if
   their sizes, the token's positions and the bit maps allow the threshold
   (each is an upper bound of the overlap, the positions where the token is the
   first one that both have, so nothing is lost).  A left semi join only says
   which class has a candidate in which bucket; pairs are never listed.
4. Only these classes' token sets are read again and brought together by
   bucket, in blocks of at most ``BLOCK`` classes; each is compared with the
   earlier ones until one matches.  A class that matches an earlier one goes.
5. The lines that stay are listed by document.  Documents that lose a line (a
   fixed-size bit table of text hashes holds them, and few others) are joined
   to their list; the rest pass unshuffled.

Null text stays null and has no lines; an empty text has one line without
words.  A null doc_id sorts last.  Rows that repeat both id and text are one
document: they get the same result.  Other columns pass through; their names
must not begin with ``_ld``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credsight.llm.common import (
    ROWS,
    U64,
    WORD_BYTES,
    checkpointed,
    free_names,
    free_shuffles,
    map_arrow,
    mix,
    only_caches_of,
    schema_with,
    stored,
    table,
    words,
)

THRESHOLD, SLOT_BITS, BLOCK, SLICE_BYTES = 0.8, 18, 256, 1 << 20
#: counters that travel in one row
PART_BITS = 12
#: words of more bytes are hashed one by one
LONG = 64
_EPS = 1e-9
#: a line with a word (see ``common.WORD_BYTES``), from its first word on
_WORDY = r"[0-9A-Za-z\x{80}-\x{10FFFF}][^\n]*"


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text")


# -- words of lines, some thousand lines at a time -------------------------
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def span_hashes(t: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of ``size`` bytes that begin at ``start``, eight bytes at a time."""
    at = np.ndarray((len(t) + 1,), "<u8", t + bytes(8), strides=(1,))      # the eight bytes from every place on
    h = mix((at[start] & _MASK[np.minimum(size, 8)]) ^ (size.astype(U64) * U64(0x9E3779B97F4A7C15)))
    for a in range(8, LONG, 8):
        more = np.flatnonzero(size > a)
        if not len(more):
            break
        h[more] = mix(h[more] * U64(0xBF58476D1CE4E5B9) + (at[start[more] + a] & _MASK[np.minimum(size[more] - a, 8)]))
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(t[start[i]:start[i] + size[i]])
    return h


def _lines(off: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, line number, begin, end) of the lines of the documents text[off[i]:off[i + 1]]."""
    feed = np.flatnonzero(text == 10)
    doc = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, feed, "right") - 1])
    begin = np.concatenate([off[:-1], feed + 1])
    order = np.lexsort((begin, doc))
    doc, begin = doc[order], begin[order]
    end = off[doc + 1].copy()
    same = doc[1:] == doc[:-1]
    end[:-1][same] = begin[1:][same] - 1
    return doc, np.arange(len(doc)) - np.searchsorted(doc, doc), begin, end


def line_words(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document number, line number, number of words; hashes of all these words) of the lines
    with words, about ``size`` bytes of whole lines at a time.  The words are those of ``common.words``."""
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        off, text = offsets[first:last + 1] - offsets[first], data[offsets[first]:offsets[last]]
        doc, number, begin, end = _lines(off, text)
        piece = begin // size                                     # of a longer document some lines at a time
        cuts = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), len(begin)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            lo, hi = begin[a], end[b - 1]
            t = text[lo:hi].tobytes().translate(WORD_BYTES)
            word = np.frombuffer(t, np.uint8) != 32
            head, tail = word.copy(), word.copy()
            head[1:] &= ~word[:-1]
            tail[:-1] &= ~word[1:]
            at = begin[a:b] - lo                                  # a line begins: texts lie side by side
            head[at[at < len(t)]] = word[at[at < len(t)]]
            tail[at[at > 0] - 1] = word[at[at > 0] - 1]
            start = np.flatnonzero(head)
            k = np.searchsorted(start, end[a:b] - lo) - np.searchsorted(start, at)
            some = k > 0
            if some.any():
                yield (doc[a:b][some] + first, number[a:b][some], k[some],
                       span_hashes(t, start, np.flatnonzero(tail) + 1 - start))
        first = last


# -- 1. rarity -------------------------------------------------------------
def rarity(docs: DataFrame) -> np.ndarray:
    """Logarithmic token count by hash slot; 2**SLOT_BITS bytes for any input size."""

    def run(batches):
        only_caches_of("op7")
        counts = np.zeros(1 << SLOT_BITS, np.int64)
        for b in batches:
            for *_, h in line_words(b.column(0)):
                counts += np.bincount((h >> U64(64 - SLOT_BITS)).astype(np.int64), minlength=1 << SLOT_BITS)
        yield from parts(enumerate(counts.reshape(-1, 1 << PART_BITS)))

    def parts(found):
        rows = [(k, x.tobytes()) for k, x in found if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()),
                                          pa.array([x for _, x in rows], pa.binary())], ["part", "numbers"])

    def added(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(x, np.int64)
        yield from parts((k, np.minimum(np.ceil(np.log2(x + 1)), 63).astype(np.uint8)) for k, x in total.items())

    # a part of the counters, whole in one row, is added up in one task
    rows = (docs.select("text").mapInArrow(run, "part int, numbers binary").repartition("part")
            .mapInArrow(added, "part int, numbers binary").collect())
    out = np.zeros((1 << SLOT_BITS - PART_BITS, 1 << PART_BITS), np.uint8)
    for part, levels in rows:
        out[part] = np.frombuffer(levels, np.uint8)
    return out.ravel()


# -- 2. lines --------------------------------------------------------------
def ordered_sets(h: np.ndarray, line: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each line, rarest first: (line, token hash)."""
    key = (line.astype(U64) << U64(44)) | (level[(h >> U64(64 - SLOT_BITS)).astype(np.int64)].astype(U64) << U64(38)) \
        | (h >> U64(26))
    order = np.argsort(key)
    k, s = key[order], h[order]
    if ((k[1:] == k[:-1]) & (s[1:] != s[:-1])).any():      # equal leading bits: order by the whole hash
        order = np.lexsort((h, key))
        k, s = key[order], h[order]
    first = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])]) if len(s) else np.empty(0, bool)
    return line[order][first], s[first]


def prefix_size(n, threshold: float):
    return n - np.ceil(threshold * n - _EPS).astype(np.int64) + 1


_LINE = ("fp binary, doc_id long, th long, line int, n int, prefix array<int>, b0 long, b1 long, b2 long, b3 long")


def line_rows(docs: DataFrame, level: np.ndarray, threshold: float) -> DataFrame:
    """A row for each line with words."""
    shared = docs.sparkSession.sparkContext.broadcast(level)     # 2**SLOT_BITS bytes

    def run(batches):
        only_caches_of("op7")
        for b in batches:
            for doc, number, k, h in line_words(b.column(2)):
                at = pa.array(doc)
                yield batch_of(b.column(0).take(at), b.column(1).take(at), number, k, h)

    def batch_of(ids, ths, number, k, h):
        line = np.repeat(np.arange(len(k)), k)
        line, tok = ordered_sets(h, line, shared.value)
        begin = np.searchsorted(line, np.arange(len(k)))
        n = np.diff(np.append(begin, len(tok)))
        take = prefix_size(n, threshold)
        offsets = np.concatenate([[0], np.cumsum(take)])
        at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], take) + np.repeat(begin, take)
        bit = tok & U64(255)
        one = U64(1) << (bit & U64(63))
        maps = [np.bitwise_or.reduceat(np.where((bit >> U64(6)) == k, one, U64(0)), begin).view(np.int64) for k in range(4)]
        fps = [xxhash.xxh3_128_digest(tok[s:s + size].tobytes()) for s, size in zip(begin.tolist(), n.tolist())]
        return pa.RecordBatch.from_arrays([
            pa.array(fps, pa.binary()), ids, ths, pa.array(number.astype(np.int32)),
            pa.array(n.astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array((tok[at] & U64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))),
            *[pa.array(m) for m in maps]],
            ["fp", "doc_id", "th", "line", "n", "prefix", "b0", "b1", "b2", "b3"])

    return _identified(docs).mapInArrow(run, _LINE)


def line_classes(lines: DataFrame) -> DataFrame:
    """(fp, lid, pos, n, prefix, b0 to b3): lid a hash that names the class, pos its first line, null ids last."""
    pos = F.struct(F.col("doc_id").isNull().alias("nul"), "doc_id", "th", "line")
    return lines.groupBy("fp").agg(F.min(pos).alias("pos"), F.first("n").alias("n"), F.first("prefix").alias("prefix"),
                                   *[F.first(b).alias(b) for b in ("b0", "b1", "b2", "b3")]).withColumn("lid", F.xxhash64("fp"))


# -- 3. candidates ---------------------------------------------------------
_BIG, SHORT = 0xFFFF, 80


def candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """(bucket, lid): classes with a possible partner in the bucket of a token.

    A prefix row is a few numbers: 32 bits of the token with size and position
    (16 bits each, 65535: that many or more, then neither is used), the class
    and its bit map, folded to 128 bits for short sets.
    """
    both = classes.select("lid", "n", "b0", "b1", "b2", "b3", F.posexplode("prefix").alias("i", "token"))
    # a pair whose larger set has at most SHORT tokens meets among the short sets; else its smaller set
    # has more than threshold * SHORT, and both meet among the long ones
    short = both.where(F.col("n") <= SHORT).select(
        "lid", "n", "i", "token", F.col("b0").bitwiseOR(F.col("b2")).alias("b0"), F.col("b1").bitwiseOR(F.col("b3")).alias("b1"))
    long = both.where(F.col("n") > F.lit(threshold * SHORT - 1))
    return _possible(short, ["b0", "b1"], threshold).unionByName(_possible(long, ["b0", "b1", "b2", "b3"], threshold)).distinct()


def _possible(rows: DataFrame, words: list[str], threshold: float) -> DataFrame:
    """(bucket, lid) of the prefix rows that have a possible partner among them."""
    packed = (F.shiftleft(F.col("token").cast("long"), 32)
              + F.shiftleft(F.least("n", F.lit(_BIG)).cast("long"), 16) + F.least("i", F.lit(_BIG)).cast("long"))
    p = rows.select(packed.alias("p"), "lid", *words)
    a, b = p.alias("a"), p.alias("b")
    token = lambda x: F.shiftright(F.col(f"{x}.p"), 32)
    size = lambda x: F.shiftright(F.col(f"{x}.p"), 16).bitwiseAND(F.lit(_BIG))
    at = lambda x: F.col(f"{x}.p").bitwiseAND(F.lit(_BIG))
    na, nb, ia, ib = size("a"), size("b"), at("a"), at("b")
    need = (na + nb) * (threshold / (1 + threshold)) - _EPS
    lost = lambda x, y: sum(  # noqa: E731  tokens of x that y cannot have
        (F.bit_count(F.col(f"{x}.{w}").bitwiseAND(F.bitwise_not(F.col(f"{y}.{w}")))) for w in words), F.lit(0))
    fits = ((na >= nb * threshold - _EPS) & (nb >= na * threshold - _EPS)
            # a pair is looked for at its first common token only: all it shares comes from there on
            & (F.least(na - ia, nb - ib) >= need)
            & (na - lost("a", "b") >= need) & (nb - lost("b", "a") >= need))
    return a.join(b, (token("a") == token("b")) & (F.col("a.lid") != F.col("b.lid"))
                  & ((na == _BIG) | (nb == _BIG) | fits), "left_semi").select(F.shiftright("p", 32).alias("bucket"), "lid")


# -- 4. verification -------------------------------------------------------
def _bitmap(frame: DataFrame, column: str, bits: int = 24) -> np.ndarray:
    """Bit table of the hashes in a column, 2**bits bits for any number of rows."""
    slot = F.pmod(F.col(column), F.lit(1 << bits)) + 1      # the bitmap functions count from 1
    rows = (frame.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("k"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).collect())
    out = np.zeros(1 << bits, bool)
    for k, m in rows:
        x = np.unpackbits(np.frombuffer(bytes(m), np.uint8), bitorder="little")
        out[(k - 1) * len(x):k * len(x)] = x
    return np.packbits(out)


def _by_bit(frame: DataFrame, bitmap: np.ndarray, column: str, value: bool, bits: int = 24) -> DataFrame:
    """Rows whose hash is in the bit table (``value``), or the others; a null hash is not."""
    shared = frame.sparkSession.sparkContext.broadcast(bitmap)      # 2**bits bits
    at = frame.columns.index(column)

    def run(batches):
        only_caches_of("op7")
        for b in batches:
            s = np.mod(b.column(at).fill_null(0).to_numpy(zero_copy_only=False), 1 << bits)
            yield b.filter(pa.array(((shared.value[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1).astype(bool) == value))

    return frame.mapInArrow(run, frame.schema)


def class_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lid, set): tokens of the first lines of the wanted classes (lid, pos)."""
    w = wanted.select("lid", F.col("pos.doc_id").alias("w_id"), F.col("pos.th").alias("w_th"), F.col("pos.line").alias("line"))
    by_doc = w.groupBy("w_id", "w_th").agg(F.collect_list(F.struct("line", "lid")).alias("lines"))
    d = _by_bit(_identified(docs), _bitmap(w, "w_th"), "th", True)
    j = d.join(by_doc, (F.col("th") == F.col("w_th")) & F.col("doc_id").eqNullSafe(F.col("w_id"))).select("text", "lines")

    def run(batch: pa.RecordBatch) -> dict:
        only_caches_of("op7")
        lids, sets = [], []
        want = [{x["line"]: x["lid"] for x in ls} for ls in batch.column(1).to_pylist()]
        for doc, number, k, h in line_words(batch.column(0)):
            ends = np.cumsum(k)
            for d, i, a, b in zip(doc.tolist(), number.tolist(), (ends - k).tolist(), ends.tolist()):
                if i in want[d]:
                    s = np.sort(h[a:b])
                    lids.append(want[d][i])
                    sets.append(s[np.append(True, s[1:] != s[:-1])].tobytes())
        return {"lid": lids, "set": sets}

    return map_arrow(j, run, "lid long, set binary").dropDuplicates(["lid"])


def _matches(members: list[tuple], cross: bool, threshold: float) -> list[int]:
    """lids of the members that have an earlier match; members are (blk, lid, pos, set)."""
    members.sort(key=lambda m: m[2])
    sets = [np.frombuffer(m[3], U64) for m in members]
    out = []
    for k, m in enumerate(members):
        for j in range(k):
            a, b = sets[k], sets[j]
            if cross and members[j][0] == m[0] or min(len(a), len(b)) < threshold * max(len(a), len(b)) - _EPS:
                continue
            c = np.count_nonzero(b[np.minimum(b.searchsorted(a), len(b) - 1)] == a)      # both are sorted and have tokens
            if c >= threshold * (len(a) + len(b) - c) - _EPS:
                out.append(m[1])
                break
    return out


def later_matches(docs: DataFrame, classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """(lid) of the classes whose first line matches an earlier line."""
    spark = docs.sparkSession
    cand = stored(spark, candidates(classes, threshold), "line-candidates")
    free_shuffles(spark)
    wanted = _by_bit(classes.select("lid", "pos"), _bitmap(cand, "lid"), "lid", True).join(
        cand.select("lid").distinct(), "lid")
    # near copies of a line share most of their prefix: buckets with the same members are kept once
    same = cand.groupBy("bucket").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("lid")).alias("x"),
                                      F.min("lid").alias("a"), F.max("lid").alias("b"))
    sizes = (same.where("c > 1").groupBy("c", "x", "a", "b").agg(F.min("bucket").alias("bucket"))
             .select("bucket", F.ceil(F.col("c") / block).cast("int").alias("nb")))
    m = (cand.join(sizes, "bucket")
         .withColumn("blk", F.pmod(F.xxhash64("lid"), F.col("nb")).cast("int"))
         .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
         .select("bucket", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk", "lid"))
    wanted = checkpointed(spark, wanted)
    full = class_sets(docs, wanted).join(wanted, "lid")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (m.join(full, "lid").select("bucket", "bi", "bj", "blk", "lid", "pos.nul", "pos.doc_id", "pos.th", "pos.line", "set")
            .repartition(n, "bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj"))

    def verify(batches):
        only_caches_of("op7")
        at, group = None, []
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            found = []
            for r in zip(*cols):
                if r[:3] != at:
                    if len(group) > 1:
                        found += _matches(group, at[1] != at[2], threshold)
                    at, group = r[:3], []
                group.append((r[3], r[4], (r[5], r[6] or 0, r[7], r[8]), r[9]))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["lid"])
        if len(group) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(_matches(group, at[1] != at[2], threshold), pa.int64())], ["lid"])

    return rows.mapInArrow(verify, "lid long").distinct()


# -- 5. result -------------------------------------------------------------
def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, counts: bool = True) -> DataFrame:
    """``docs`` with the later matches removed from ``text``; with ``counts``
    also n_lines and n_removed, which replace columns of their names."""
    spark = docs.sparkSession
    level = rarity(docs)
    classes = stored(spark, line_classes(line_rows(docs, level, threshold)).drop("fp"), "line-classes")
    free_shuffles(spark)
    gone = later_matches(docs, classes, threshold, block)
    names = docs.columns
    ld_id, ld_h, ld_th, ld_lines = free_names(names, "_ld_id", "_ld_h", "_ld_th", "_ld_lines")
    kept = (classes.select("lid", "pos").join(gone, "lid", "left_anti")
            .groupBy(F.col("pos.doc_id").alias(ld_id), F.col("pos.th").alias(ld_h))
            .agg(F.collect_list("pos.line").alias(ld_lines)))       # lines of one document
    kept = checkpointed(spark, kept)
    free_shuffles(spark)
    # only texts that lose a line meet the list of their lines; the others need no shuffle
    d = docs.withColumn(ld_th, F.xxhash64("text"))
    has_words = F.regexp_count("text", F.lit(_WORDY))
    touched = (d.where("text is not null").select("doc_id", ld_th, has_words.alias("n"))
               .join(kept.select(ld_id, ld_h, F.size(ld_lines).alias("k")),
                     (F.col(ld_th) == F.col(ld_h)) & F.col("doc_id").eqNullSafe(F.col(ld_id)), "left")
               .where(F.col("n") != F.coalesce("k", F.lit(0))))
    at_text = names.index("text")
    bits = _bitmap(touched, ld_th)
    j = _by_bit(d, bits, ld_th, True).join(
        kept, (F.col(ld_th) == F.col(ld_h)) & F.col("doc_id").eqNullSafe(F.col(ld_id)), "left"
    ).select(*names, F.coalesce(ld_lines, F.array().cast("array<int>")).alias(ld_lines))
    def run(batch: pa.RecordBatch) -> dict:
        only_caches_of("op7")
        text, total, removed = [], [], []
        for t, ls in zip(batch.column(at_text), batch.column(len(names))):
            t, ls = t.as_py(), ls.as_py()
            if t is None:
                text.append(None)
                total.append(0)
                removed.append(0)
                continue
            lines, ls = t.split("\n"), set(ls)
            stay = [x for i, x in enumerate(lines) if i in ls or not words(x)]
            text.append("\n".join(stay))
            total.append(len(lines))
            removed.append(len(lines) - len(stay))
        return {n: batch.column(i) for i, n in enumerate(names)} | {"text": text} | (
            {"n_lines": total, "n_removed": removed} if counts else {})

    schema = schema_with(docs, "n_lines long, n_removed long") if counts else docs.schema
    # the other texts stay as they are, and need no second pass through Python
    whole = _by_bit(d, bits, ld_th, False)
    feeds = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    if counts:
        whole = whole.withColumns({"n_lines": F.coalesce(feeds + 1, F.lit(0)).cast("long"), "n_removed": F.lit(0).cast("long")})
    return map_arrow(j, run, schema, ROWS).unionByName(whole.select(*schema.names))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of what remains."""
    d = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_removed",
                    F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


_LOWER = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: doc_ids are unique in the tables, so (doc_id, line number) orders the lines
ORACLE = f"""
WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line
           FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
s AS (SELECT doc_id, i, line, list_sort(list_distinct(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))) AS w FROM l),
c AS (SELECT w, min(struct_pack(d := doc_id, i := i)) AS pos, row_number() OVER () AS k FROM s WHERE len(w) > 0 GROUP BY w),
t AS (SELECT k, unnest(w) AS tok FROM c),
f AS (SELECT tok, count(*) AS n FROM t GROUP BY tok),
r AS (SELECT t.k, t.tok, row_number() OVER (PARTITION BY t.k ORDER BY f.n, t.tok) AS rnk, count(*) OVER (PARTITION BY t.k) AS n
      FROM t JOIN f USING (tok)),
p AS (SELECT k, tok FROM r WHERE rnk <= n - ceil({THRESHOLD} * n - 1e-9) + 1),
cand AS (SELECT DISTINCT a.k AS a, b.k AS b FROM p a JOIN p b ON a.tok = b.tok AND a.k <> b.k),
gone AS (SELECT DISTINCT x.k FROM cand JOIN c x ON x.k = cand.a JOIN c y ON y.k = cand.b
         WHERE y.pos < x.pos AND 5 * len(list_intersect(x.w, y.w)) >= 4 * (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)))),
stay AS (SELECT c.pos FROM c WHERE k NOT IN (SELECT k FROM gone)),
m AS (SELECT s.doc_id, s.i, s.line, len(s.w) = 0 OR stay.pos IS NOT NULL AS kept
      FROM s LEFT JOIN stay ON stay.pos.d = s.doc_id AND stay.pos.i = s.i),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT kept) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (kept), '') AS txt FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(txt, '')) AS text_sha256
FROM documents d LEFT JOIN g USING (doc_id)
"""
