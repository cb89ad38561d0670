"""Ranked lexical search with hashed max-sketches.

A document's *impact* of a term is the part it adds to a query's score for one
occurrence of the term in the query (``term_weight`` times saturated frequency,
in 64-bit integers).  A document is folded into a sketch of ``DIMS`` numbers:
every impact goes to the coordinate its term hashes to, which keeps the largest.
A query looks its terms up in the sketches of a few hundred documents at once;
the sum is an upper bound of each score, as a coordinate is never below the
impacts folded into it.  Documents are rescored exactly in the order of falling
bounds until the bound is below the k-th best exact score found so far, so
nothing that could enter the ranking (ties included) is passed over.

The queries are sent to the tasks in blocks of about ``BLOCK_CHARS`` characters
(at least one item), chosen by a hash; each block costs one scan for corpus
statistics and one for the ranking, whatever the number of items.  Terms that no
item of the block asks for are never looked up and are not folded.  A task
returns at most k documents of an item; the ranking over all tasks is taken in two
steps, so no item's hits have to meet in one task at once.

Null or empty texts have no terms: such documents count nowhere, such items
return nothing.  Rows that repeat a doc_id are documents of their own; a null
doc_id comes last among equal scores.  Rows that repeat item_id and text are one
item; a repeated item_id with another text is ranked on its own under the same id.
doc_id must be an integer.  Other columns are ignored, whatever their names.  Empty
tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credsight.llm.common import map_arrow, stored, table, words

K, DIMS, DOCS_AT_ONCE, BLOCK_CHARS, SALTS = 20, 2048, 512, 2_000_000, 16


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Items:
    """The items of one block: term numbers, coordinates, and the terms of each item."""

    def __init__(self, rows: list[tuple], dims: int = DIMS):
        self.dims = dims
        self.term: dict[bytes, int] = {}
        self.items: list[tuple] = []                     # (item_id, key), terms, times
        for item_id, text, key in rows:
            count = Counter(words(text))
            if count:
                ids = [self.term.setdefault(t, len(self.term)) for t in count]
                self.items.append(((item_id, key), ids, list(count.values())))
        self.coord = np.array([xxhash.xxh64_intdigest(t) % dims for t in self.term], np.int64)

    def found(self, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the block's terms among the words, and how often each occurs."""
        get = self.term.get
        ids = [i for i in map(get, ws) if i is not None]
        return np.unique(np.array(ids, np.int64), return_counts=True)


def impacts(weight: np.ndarray, ids: np.ndarray, tf: np.ndarray, n: int, n_docs: int, n_terms: int) -> np.ndarray:
    m = 75 + 25 * n * n_docs // n_terms
    return weight[ids] * (1_000_000_000 * tf // (1000 * tf + 12 * m))


def sketches(dims: int, coord: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One column per document: coordinatewise maxima of its impacts."""
    out = np.zeros((dims, len(docs)), np.int64)
    if docs:
        ids = np.concatenate([d[0] for d in docs])
        owner = np.repeat(np.arange(len(docs)), [len(d[0]) for d in docs])
        np.maximum.at(out, (coord[ids], owner), np.concatenate([d[1] for d in docs]))
    return out


class Ranking:
    """The k best documents of every item among those given so far.

    ``rescored`` counts exact scores, a figure for tests and tuning."""

    def __init__(self, items: Items, weight: np.ndarray, n_docs: int, n_terms: int, k: int):
        self.q, self.weight, self.n_docs, self.n_terms, self.k = items, weight, n_docs, n_terms, k
        self.best: list[list[tuple]] = [[] for _ in items.items]
        self.lookup = [(items.coord[ids], np.array(times, np.int64)) for _, ids, times in items.items]
        self.rescored = 0

    def add(self, ids: list, texts: list[str | None]) -> None:
        at, docs = [], []
        for i, t in zip(ids, texts):
            ws = words(t)
            found, tf = self.q.found(ws)
            if len(found):
                at.append((0, 0) if i is None else (1, -i))
                docs.append((found, impacts(self.weight, found, tf, len(ws), self.n_docs, self.n_terms)))
        if not docs:
            return
        sketch = sketches(self.q.dims, self.q.coord, docs)
        exact = [dict(zip(a.tolist(), b.tolist())) for a, b in docs]
        for (_, terms, times), (coord, many), best in zip(self.q.items, self.lookup, self.best):
            bound = many @ sketch[coord]
            low = best[0][0] if len(best) == self.k else 1
            near = np.flatnonzero(bound >= low)
            for j in near[np.argsort(-bound[near], kind="stable")].tolist():
                if len(best) == self.k and bound[j] < best[0][0]:
                    break
                get = exact[j].get
                score = sum(c * get(t, 0) for t, c in zip(terms, times))
                self.rescored += 1
                if score > 0:
                    row = (score, *at[j])
                    if len(best) < self.k:
                        heappush(best, row)
                    elif row > best[0]:
                        heapreplace(best, row)


def statistics(docs: DataFrame, sent) -> tuple[dict[int, int], int, int]:
    """Documents that hold each term of the block; documents with terms; terms of all documents."""

    def run(batch: pa.RecordBatch) -> dict:
        q = sent.value
        df = np.zeros(len(q.term), np.int64)
        n_docs = n_terms = 0
        for t in batch.column(0):
            ws = words(t.as_py())
            n_docs += bool(ws)
            n_terms += len(ws)
            df[q.found(ws)[0]] += 1
        at = np.flatnonzero(df)
        return {"term": [-1, -2, *at.tolist()], "n": [n_docs, n_terms, *df[at].tolist()]}

    # one number per term of the block
    got = dict(map_arrow(docs.select("text"), run, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    return got, got.pop(-1, 0), got.pop(-2, 0)


def search(docs: DataFrame, items: DataFrame, k: int = K, dims: int = DIMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = items.select("item_id", "text", F.xxhash64("text").alias("key")).where("text is not null").distinct()
    blocks = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    item_type = items.schema["item_id"].dataType.simpleString()
    parts = []
    for b in range(blocks):
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text", F.lit(7)), F.lit(blocks)) == b) if blocks > 1 else rows
        sent = spark.sparkContext.broadcast(Items([tuple(r) for r in mine.collect()], dims))
        df, n_docs, n_terms = statistics(d, sent)
        weight = np.array([term_weight(n_docs, df.get(t, 0)) for t in range(len(sent.value.term))], np.int64)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, weight=weight, n_docs=n_docs, n_terms=n_terms):
            r = Ranking(sent.value, weight, n_docs, n_terms, k)
            for batch in batches:
                for a in range(0, batch.num_rows, DOCS_AT_ONCE):
                    part = batch.slice(a, DOCS_AT_ONCE)
                    r.add(part.column(0).to_pylist(), part.column(1).to_pylist())
            out = [(item_id, key, -neg if known else None, score)
                   for ((item_id, key), _, _), best in zip(r.q.items, r.best) for score, known, neg in best]
            names, cols = ("item_id", "key", "doc_id", "score"), list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        from pyspark.sql.pandas.types import to_arrow_type
        types = [to_arrow_type(items.schema["item_id"].dataType), pa.int64(), pa.int64(), pa.int64()]
        hits = d.mapInArrow(run, f"item_id {item_type}, key long, doc_id long, score long")
        parts.append(stored(spark, hits, "op13-hits") if blocks > 1 else hits)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    first = Window.partitionBy("item_id", "key", "salt").orderBy(*order)
    last = Window.partitionBy("item_id", "key").orderBy(*order)
    return (reduce(DataFrame.unionByName, parts)
            .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
            .withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
            .withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


def op13_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL),
q AS (SELECT row_number() OVER () AS qid, item_id, {_WORDS} AS ws
      FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM d WHERE len(ws) > 0),
qt AS (SELECT qid, item_id, t, count(*) AS times FROM (SELECT qid, item_id, unnest(ws) AS t FROM q) GROUP BY ALL),
dt AS (SELECT rid, doc_id, n, t, count(*) AS tf
       FROM (SELECT rid, doc_id, len(ws) AS n, unnest(ws) AS t FROM d)
       WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM dt, s GROUP BY t),
sc AS (SELECT qid, item_id, rid, doc_id,
              CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
       FROM dt JOIN w USING (t) JOIN qt USING (t), s GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score,
         CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM sc WHERE score > 0)
WHERE rank <= {K}
"""
