"""Batch retrieval.

B1/B2 top-k cosine search, exact, over inverted lists: documents lie at the nearest
of a few centres, sorted by their angle to it.  By the triangle inequality a
ring of documents can be skipped for a query once its bound is below the k-th score
found.  The corpus is shuffled once; queries are broadcast in blocks of bounded
size; every task returns k documents per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from credsight.session import stored

QUERY_BLOCK = 1024           # queries sent to the tasks at once
CLUSTERS, SAMPLE = 64, 1024  # centres; documents that give the first lower bounds
RING_ROWS = 1024             # rows scored at once
DIGITS, SLACK = 12, 1e-9     # scores that agree to these digits are ties; bounds allow for rounding

# Recall outcome texts.
RECALL_UNKNOWN = "Node %s not found. Available nodes: %s"
RECALL_EMPTY = "Node %s has no transcript."
RECALL_NONE = "No lines in the transcript of node %s match the goal."
RECALL_MAX_LINES = 20        # default of the excerpt length


def _unit(vecs) -> np.ndarray:
    m = np.vstack([np.asarray(v, dtype=np.float64) for v in vecs])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1.0)          # a zero vector has similarity 0 to everything


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


class _Queries:
    """A block of queries: unit vectors, and for each the least score that can still be among its k best."""

    def __init__(self, rows: list, centres: np.ndarray, known: np.ndarray):
        self.row, self.qid = [r["row"] for r in rows], [r["qid"] for r in rows]
        self.k = np.array([r["k"] for r in rows])
        self.unit = _unit([r["vec"] for r in rows])
        self.angle = _angle(self.unit @ centres.T)             # of every query and list centre
        self.low = np.full(len(rows), -np.inf)
        # documents of the corpus already scored: the k-th of them is a lower bound of the k-th of all
        s = self.unit @ known.T
        for i, k in enumerate(self.k):
            if k <= s.shape[1]:
                self.low[i] = np.partition(s[i], -k)[-k] - SLACK


class _Best:
    """The k best documents of every query of a block among the lists scanned so far."""

    def __init__(self, q: _Queries):
        self.q, self.low = q, q.low.copy()
        self.kept = [(np.empty(0), np.empty(0, object))] * len(q.row)
        self.scored = 0

    def scan(self, cluster: int, cos: np.ndarray, docs: np.ndarray, unit: np.ndarray) -> None:
        """Rows of one list, sorted by their cosine to its centre."""
        ring = _angle(np.array([cos.max(), cos.min()]))        # least and largest angle to the centre
        at = self.q.angle[:, cluster]
        # the triangle inequality of angles: no document of the ring is nearer than this
        gap = np.maximum(np.maximum(ring[0] - at, at - ring[1]), 0.0)
        live = np.flatnonzero(np.cos(gap) >= self.low - SLACK)
        if not len(live):
            return
        self.scored += len(live) * len(docs)
        sims = np.round(self.q.unit[live] @ unit.T, DIGITS)
        for i, s in zip(live.tolist(), sims):
            near = np.flatnonzero(s >= self.low[i])
            if len(near):
                k = self.q.k[i]
                s, d = np.concatenate([self.kept[i][0], s[near]]), np.concatenate([self.kept[i][1], docs[near]])
                order = np.argsort(d, kind="stable")           # ties go to the lesser id
                order = order[np.argsort(-s[order], kind="stable")][:k]
                self.kept[i] = s[order], d[order]
                if len(order) == k:
                    self.low[i] = max(self.low[i], s[order[-1]])

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        rows = [(self.q.row[i], self.q.qid[i], int(self.q.k[i]), d, float(x))
                for i, (s, docs) in enumerate(self.kept) for x, d in zip(s, docs)]
        cols = list(zip(*rows)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def inverted_lists(corpus: DataFrame, centres: np.ndarray) -> DataFrame:
    """(cluster, cos, doc_id, vec): unit vectors at their nearest centre, in the order of
    (cluster, cos), so that neighbouring rows lie in a narrow ring around a centre."""
    did = corpus.schema["doc_id"].dataType
    schema = T.StructType([*T._parse_datatype_string("cluster int, cos double").fields, T.StructField("doc_id", did),
                           T.StructField("vec", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = _unit(_matrix(b.column(1)))
                s = u @ centres.T
                at = s.argmax(axis=1)
                ends = pa.array(np.arange(0, u.size + 1, u.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array(at.astype(np.int32)), pa.array(s[np.arange(len(s)), at]), b.column(0).cast(arrow.field("doc_id").type),
                    pa.ListArray.from_arrays(ends, pa.array(u.ravel())).cast(arrow.field("vec").type)], schema=arrow)

    n = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = corpus.select("doc_id", "vec").mapInArrow(assign, schema)
    return a.repartitionByRange(n, "cluster", "cos").sortWithinPartitions("cluster", "cos")


def topk_search(corpus: DataFrame, queries: DataFrame, k: int | str = 10, clusters: int = CLUSTERS,
                sample: int = SAMPLE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """B1/B2: top-k documents per query by cosine similarity, exact.

    ``corpus(doc_id, vec array<double>)``; ``queries(qid, vec array<double>[, k])``;
    ``k`` is an int or the name of a per-query k column (B2).  Rows without a
    vector have no similarity and are left out.  A null qid is a query too.  Equal
    query rows (qid and vector) are one query, with the largest k.  Scores that agree
    to ``DIGITS`` digits are ties and go to the lesser doc_id.

    The corpus is shuffled once, into inverted lists.  A block of at most about
    ``query_block`` queries is broadcast and passes over the stored lists; rows of a ring whose bound is
    below a query's k-th score so far are not scored for it.  -> (qid, rank, doc_id, score)
    """
    spark = corpus.sparkSession
    kcol = F.col(k) if isinstance(k, str) else F.lit(k)
    q = (queries.where(F.col("vec").isNotNull()).select("qid", "vec", kcol.cast("int").alias("k"))
         .groupBy("qid", "vec").agg(F.max("k").alias("k")).where("k > 0")
         .withColumn("row", F.concat_ws("-", F.xxhash64("qid", "vec"), F.xxhash64(F.lit(1), "vec", "qid"))))
    q = stored(q, "search-queries")
    c = corpus.where(F.col("vec").isNotNull()).select("doc_id", "vec")
    # at most ``sample`` vectors
    picked = [r["vec"] for r in c.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    qid, did = queries.schema["qid"].dataType.simpleString(), corpus.schema["doc_id"].dataType.simpleString()
    hit = T._parse_datatype_string(f"row string, qid {qid}, k int, doc_id {did}, score double")
    cand = spark.createDataFrame([], hit)
    if picked:
        known = _unit(picked)
        centres = known[:clusters]
        lists = stored(inverted_lists(c, centres), "search-lists")
        blocks = max(1, -(-q.count() // query_block))
        for b in range(blocks):
            rows = q.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).collect()       # about query_block rows
            if rows:
                sent = spark.sparkContext.broadcast(_Queries(rows, centres, known))
                cand = cand.unionByName(lists.mapInArrow(_scanner(sent, to_arrow_schema(hit)), hit))
    w = Window.partitionBy("row").orderBy(F.col("score").desc(), "doc_id")
    return (cand.withColumn("rank", F.row_number().over(w)).where("rank <= k")
            .select("qid", "rank", "doc_id", "score"))


def _scanner(sent, schema: pa.Schema):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(sent.value)
        for b in batches:
            if not b.num_rows:
                continue
            cluster, cos, unit = (np.asarray(b.column(0)), np.asarray(b.column(1)), _matrix(b.column(3)))
            docs = np.array(b.column(2).to_pylist(), object)
            # stretches of one centre, cut to a bounded number of rows
            cuts = np.flatnonzero(np.diff(cluster)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(cluster)]):
                for x in range(lo, hi, RING_ROWS):
                    part = slice(x, min(hi, x + RING_ROWS))
                    best.scan(cluster[x], cos[part], docs[part], unit[part])
        yield best.batch(schema)

    return scan


def centroids(emb: DataFrame, key: str = "label", vec: str = "embedding") -> DataFrame:
    """Per-key mean vector (one query per key): posexplode, average per position, re-assemble."""
    e = emb.select(key, F.posexplode(vec).alias("i", "x"))
    m = e.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return m.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))),
                                          lambda s: s["x"]).alias("vec"))


def open_page(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Open a page by docid **or** url.  Two equi-joins unioned and
    de-duplicated (an OR condition would plan as a nested-loop join).
    ``requests(req_id, docid, url)`` -> (req_id, page_id, url, html) (NULL page when missing)."""
    page = pages.select("page_id", F.col("url").alias("page_url"), "html")
    by_id = (requests.where(F.col("docid").isNotNull())
             .join(page, F.col("docid") == F.col("page_id")).select("req_id", "page_id", "page_url", "html"))
    # a url is tried when there is no docid, and when the docid is unknown
    left = requests.where(F.col("url").isNotNull()).join(by_id.select("req_id"), "req_id", "left_anti")
    by_url = left.join(page, F.col("url") == F.col("page_url")).select("req_id", "page_id", "page_url", "html")
    hits = by_id.unionByName(by_url).dropDuplicates(["req_id", "page_id"])
    return requests.select("req_id").join(hits, "req_id", "left")


def keyword_excerpt(raw_text, goal, max_lines: int = RECALL_MAX_LINES):
    """Lines of the transcript that contain any goal keyword (lower-cased
    substring match), the first ``max_lines`` of them; empty goal matches nothing."""
    kws = F.filter(F.split(F.lower(F.trim(goal)), r"\s+"), lambda w: w != "")
    lines = F.split(raw_text, "\n")
    hit = F.filter(lines, lambda ln: F.exists(kws, lambda kw: F.lower(ln).contains(kw)))
    return F.slice(hit, 1, max_lines)


def recall(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """B4 + B5: recall lookup with the two error outcomes.
    ``requests(req_id, graph_id, node_id, goal)`` -> (req_id, outcome, text)."""
    known = nodes.select("graph_id", "node_id")
    asked = requests.join(known, ["graph_id", "node_id"], "left_anti").select("graph_id").distinct()
    avail = nodes.join(asked, "graph_id", "left_semi").groupBy("graph_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "node_id"))), lambda x: x["node_id"]), ", ").alias("avail"))
    n = nodes.select("graph_id", "node_id", "raw_text", F.lit(True).alias("found"))
    j = requests.join(n, ["graph_id", "node_id"], "left").join(avail, "graph_id", "left")
    ex = keyword_excerpt(F.col("raw_text"), F.coalesce(F.col("goal"), F.lit("")))
    outcome = (F.when(F.col("found").isNull(), "unknown_node")
               .when(F.coalesce(F.col("raw_text"), F.lit("")) == "", "empty_transcript")
               .when(F.size(ex) == 0, "no_match").otherwise("ok"))
    text = (F.when(outcome == "unknown_node", F.format_string(RECALL_UNKNOWN, F.col("node_id"),
                                                              F.coalesce(F.col("avail"), F.lit(""))))
            .when(outcome == "empty_transcript", F.format_string(RECALL_EMPTY, F.col("node_id")))
            .when(outcome == "no_match", F.format_string(RECALL_NONE, F.col("node_id")))
            .otherwise(F.array_join(ex, "\n")))
    return j.select("req_id", outcome.alias("outcome"), text.alias("text"))
