"""Benchmark decontamination: broadcast hash set of benchmark n-grams.

Words are normalised (``common.words``).  The windows of an item are its runs
of ``n`` consecutive words; an item of fewer words, but not none, is one
window.  The window set is shipped to the tasks in blocks of at most
``MAX_WINDOWS`` windows, which bounds the broadcast: a larger benchmark takes
several scans, each adding its hits to those found before, and the result is
the same.  A task rolls a hash over the words of a document, tests it against
a bit table and verifies every candidate on the words themselves.

Null text has no words and no hits, also under ``remove="spans"``.  An item without words has no windows;
an item with a null id marks hits but is not listed.  Repeated items are listed
once, repeated documents give repeated rows; other columns pass through.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsight.llm.common import U64, WORD_BYTES, checkpointed, map_arrow, only_caches_of, schema_with, table, words

N = 10
MAX_WINDOWS = 500_000
_WORD = re.compile(rb"[^ ]+")
_P = U64(0x9E3779B97F4A7C15)


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """Distinct windows: ``w`` binary (words joined by a space), ``items`` sorted ids as text."""

    def run(batch: pa.RecordBatch) -> dict:
        ids, ws = [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = words(t)
            for k in range(max(1, len(x) - n + 1) if x else 0):
                ids.append(i)
                ws.append(b" ".join(x[k:k + n]))
        return {"item": ids, "w": ws}

    rows = map_arrow(benchmark.select(F.col("item_id").cast("string"), "text"), run, "item string, w binary")
    return rows.groupBy("w").agg(F.sort_array(F.collect_set("item")).alias("items"))


class WindowSet:
    """Windows of one block with word ids, a bit table of their hashes and their items."""

    BITS = 22

    def __init__(self, rows):
        self.word: dict[bytes, int] = {}
        self.items: dict[tuple, list[str]] = {}
        for w, items in rows:
            key = tuple(self.word.setdefault(x, len(self.word) + 1) for x in w.split(b" "))
            self.items[key] = list(items)
        self.table = {}
        for key in self.items:
            t = self.table.setdefault(len(key), np.zeros(1 << self.BITS, bool))
            t[int(self._roll(np.array(key, U64), len(key))[0] >> U64(64 - self.BITS))] = True

    @staticmethod
    def _roll(ids: np.ndarray, size: int) -> np.ndarray:
        n = len(ids) - size + 1
        h = np.zeros(n, U64)
        for j in range(size):
            h = h * _P + ids[j:j + n]
        return (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9)

    def hits(self, ws: list[bytes]) -> list[tuple[int, int, list[str]]]:
        """(first word, size, items) of every occurrence of a window."""
        get = self.word.get
        ids = np.array([get(w, 0) for w in ws], U64)
        out = []
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for size, bits in self.table.items():
            if len(ids) < size:
                continue
            inside = unknown[size:] == unknown[:-size]
            if not inside.any():
                continue
            at = np.flatnonzero(inside & bits[self._roll(ids, size) >> U64(64 - self.BITS)])
            for i in at.tolist():
                items = self.items.get(tuple(ids[i:i + size].tolist()))
                if items is not None:
                    out.append((i, size, items))
        return out


_SETS: dict = {}


def _window_set(handle) -> WindowSet:
    """Built once per Python worker from the broadcast rows; only the newest block is kept."""
    if handle.id not in _SETS:
        _SETS.clear()
        _SETS[handle.id] = WindowSet(handle.rows.value)
    return _SETS[handle.id]


class _Handle:
    _next = 0

    def __init__(self, rows, app: str):
        _Handle._next += 1
        self.rows, self.id = rows, (app, _Handle._next)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, max_windows: int = MAX_WINDOWS,
         text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` plus ``n_words``, ``hit_words`` (sorted word positions inside an
    occurrence) and ``hit_items`` (sorted ids as text, distinct), their names
    after ``prefix``; they replace columns of the same names."""
    spark = docs.sparkSession
    new = [prefix + x for x in ("n_words", "hit_words", "hit_items")]
    docs = docs.drop(*new)
    wins = benchmark_windows(benchmark, n)
    n_win = wins.count()
    blocks = max(1, -(-n_win // max_windows))
    if blocks > 1:
        wins = checkpointed(spark, wins.withColumn(
            "_b", F.pmod(F.xxhash64("w"), F.lit(blocks + blocks // 4 + 1))))
        parts = [wins.where(F.col("_b") == b).select("w", "items") for b in range(blocks + blocks // 4 + 1)]
    else:
        parts = [wins]
    names = docs.columns
    added = "{} long, {} array<int>, {} array<string>".format(*new)
    out = docs
    for k, part in enumerate(parts):
        handle = _Handle(spark.sparkContext.broadcast([(bytes(r[0]), list(r[1])) for r in part.collect()]),
                         spark.sparkContext.applicationId)

        def run(batch: pa.RecordBatch, handle=handle, first=k == 0) -> dict:
            only_caches_of("op2")
            ws_set = _window_set(handle)
            cols = {c: batch.column(i) for i, c in enumerate(names)}
            old = None if first else [batch.column(len(names) + j).to_pylist() for j in (1, 2)]
            n_words, hit, items = [], [], []
            for r, t in enumerate(cols[text]):
                ws = words(t.as_py())
                pos, ids = set(old[0][r]) if old else set(), set(old[1][r]) if old else set()
                if ws:
                    for i, size, its in ws_set.hits(ws):
                        pos.update(range(i, i + size))
                        ids.update(its)
                n_words.append(len(ws))
                hit.append(sorted(pos))
                items.append(sorted(ids))
            return cols | dict(zip(new, (n_words, hit, items)))

        schema = schema_with(docs, added)
        out = map_arrow(out, run, schema)
        if k + 1 < len(parts):
            out = checkpointed(spark, out)
    return out


def cut_spans(text: str, hit_words: list[int]) -> str:
    """The text without the hit words; each cut run of them becomes one line break."""
    raw = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in _WORD.finditer(raw.translate(WORD_BYTES))]
    out, at, i = [], 0, 0
    while i < len(hit_words):
        j = i
        while j + 1 < len(hit_words) and hit_words[j + 1] == hit_words[j] + 1:
            j += 1
        out += [raw[at:spans[hit_words[i]][0]], b"\n"]
        at, i = spans[hit_words[j]][1], j + 1
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = N,
                  max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Columns of ``docs``; ``remove="documents"`` drops documents with a hit,
    ``remove="spans"`` cuts the hit words out of their texts (a cut can bring
    words together, so the cut text is scanned again until it has no hit)."""
    names = docs.columns
    pre = "_dc_"
    while any(n.lower().startswith(pre) for n in names):        # columns of the caller's are not replaced
        pre += "_"
    if remove == "documents":
        found = scan(docs, benchmark, n, max_windows, prefix=pre)
        return found.where(F.size(pre + "hit_words") == 0).select(*names)
    if remove != "spans":
        raise ValueError("remove must be 'documents' or 'spans'")
    spark = docs.sparkSession
    cur = docs
    while True:
        found = checkpointed(spark, scan(cur, benchmark, n, max_windows, prefix=pre))
        if found.where(F.size(pre + "hit_words") > 0).limit(1).count() == 0:
            return found.select(*names)

        def run(batch: pa.RecordBatch) -> dict:
            cols = {c: batch.column(i) for i, c in enumerate(names)}
            hits = batch.column(len(names) + 1).to_pylist()
            return cols | {"text": [cut_spans(t, h) if h else t
                                    for t, h in zip(cols["text"].to_pylist(), hits)]}

        cur = map_arrow(found, run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, table(spark, sf_dir, "benchmark"))
    return digest(found)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item, least({N}, len(w)) AS size,
              unnest([array_to_string(list_slice(w, i, i + least({N}, len(w)) - 1), ' ')
                      for i in range(1, greatest(1, len(w) - {N} + 1) + 1)]) AS win
       FROM b WHERE len(w) > 0),
pos AS (SELECT rid, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size),
dw AS (SELECT p.rid, p.size, p.i, array_to_string(list_slice(d.w, p.i, p.i + p.size - 1), ' ') AS win
       FROM pos p JOIN d USING (rid)),
h AS (SELECT dw.rid, dw.i, dw.size, bw.item FROM dw JOIN bw USING (size, win)),
hw AS (SELECT rid, count(DISTINCT x) AS n_hit
       FROM (SELECT rid, unnest(range(i, i + size)) AS x FROM h) GROUP BY rid),
hi AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
       FROM h GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
