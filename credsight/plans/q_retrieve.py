"""Queries for retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from credsight.functions.columns import r6, sql_r6
from credsight.functions.text import extract_calls
from credsight.operators import graph as G
from credsight.operators import retrieve as B
from credsight.plans.catalog import query
from credsight.sources.fixtures import chat_turns, dag_nodes, oracle_with
from credsight.sources.tables import read_table


def _corpus_queries(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    corpus = emb.select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    q = B.centroids(emb).select(F.col("label").cast("bigint").alias("qid"), "vec")
    return corpus, q


_CENTROID_SQL = """
WITH ex AS (SELECT label, vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i
            FROM embeddings),
cen AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM ex GROUP BY label, i) GROUP BY label),
sim AS (SELECT CAST(cen.label AS BIGINT) AS qid, e.vec_id AS doc_id,
               list_cosine_similarity(cen.c, CAST(e.embedding AS DOUBLE[])) AS score FROM cen, embeddings e),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sim)
"""


@query("topk_search", "B1", _CENTROID_SQL + f"""
SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, {sql_r6('score')} AS score FROM rk WHERE rank <= 10""")
def q_topk_search(spark, sf):
    corpus, q = _corpus_queries(spark, sf)
    r = B.topk_search(corpus, q, 10)
    return r.select("qid", "rank", "doc_id", r6(F.col("score")).alias("score"))


@query("topk_multi", "B2", _CENTROID_SQL + f"""
SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, {sql_r6('score')} AS score FROM rk WHERE rank <= qid + 3""")
def q_topk_multi(spark, sf):
    corpus, q = _corpus_queries(spark, sf)
    r = B.topk_search(corpus, q.withColumn("k", F.col("qid") + 3), "k")
    return r.select("qid", "rank", "doc_id", r6(F.col("score")).alias("score"))


@query("open_page", "B3", """
WITH req AS (SELECT page_id AS req_id,
                    CASE WHEN page_id % 2 = 0 THEN CASE WHEN page_id % 7 = 0 THEN page_id + 1000000000 ELSE page_id END END AS docid,
                    CASE WHEN page_id % 2 = 1 THEN url END AS url FROM pages),
hits AS (SELECT r.req_id, p.page_id, p.url AS page_url, length(p.html) AS n_chars FROM req r JOIN pages p ON p.page_id = r.docid
         UNION
         SELECT r.req_id, p.page_id, p.url, length(p.html) FROM req r JOIN pages p ON p.url = r.url WHERE r.docid IS NULL)
SELECT req.req_id, page_id, page_url, CAST(n_chars AS INTEGER) AS n_chars FROM req LEFT JOIN hits USING (req_id)""")
def q_open_page(spark, sf):
    pages = read_table(spark, sf, "pages")
    pid = F.col("page_id")
    req = pages.select(pid.alias("req_id"),
                       F.when(pid % 2 == 0, F.when(pid % 7 == 0, pid + 1000000000).otherwise(pid)).alias("docid"),
                       F.when(pid % 2 == 1, F.col("url")).alias("url"))
    r = B.open_page(req, pages)
    return r.select("req_id", "page_id", "page_url", F.length("html").alias("n_chars"))


@query("text_recall", "B4,B5", oracle_with("gnodes", "turns") + """,
c0 AS (SELECT conv_id, turn, regexp_extract_all(text, '(?s)<function=([^>]+)>(.*?)</function>', 1) AS fns,
              regexp_extract_all(text, '(?s)<function=([^>]+)>(.*?)</function>', 2) AS bodies
       FROM turns WHERE role = 'assistant'),
calls AS (SELECT conv_id, turn, i - 1 AS call_idx, fns[i] AS function, bodies[i] AS body FROM c0, range(1, 10) r(i)
          WHERE i <= len(fns)),
req AS (SELECT conv_id * 1000 + turn * 10 + call_idx AS req_id, conv_id AS graph_id,
               regexp_extract(body, '(?s)<parameter=node_id>(.*?)</parameter>', 1) AS node_id,
               CASE WHEN contains(body, '<parameter=goal>') THEN regexp_extract(body, '(?s)<parameter=goal>(.*?)</parameter>', 1) END AS goal
        FROM calls WHERE function = 'recall'),
av AS (SELECT graph_id, string_agg(node_id, ', ' ORDER BY seq) AS avail FROM gnodes GROUP BY graph_id),
j AS (SELECT req.*, n.raw_text, av.avail,
             list_filter(regexp_split_to_array(lower(trim(coalesce(goal, ''))), '\\s+'), lambda w: w <> '') AS kws
      FROM req LEFT JOIN gnodes n ON n.graph_id = req.graph_id AND n.node_id = req.node_id
      LEFT JOIN av ON av.graph_id = req.graph_id),
x AS (SELECT *, list_filter(string_split(raw_text, chr(10)),
                            lambda ln: len(list_filter(kws, lambda kw: contains(lower(ln), kw))) > 0)[1:20] AS ex FROM j)
SELECT req_id,
       CASE WHEN raw_text IS NULL THEN 'unknown_node' WHEN raw_text = '' THEN 'empty_transcript'
            WHEN len(ex) = 0 THEN 'no_match' ELSE 'ok' END AS outcome,
       CASE WHEN raw_text IS NULL THEN 'Node ' || node_id || ' not found. Available nodes: ' || coalesce(avail, '')
            WHEN raw_text = '' THEN 'Node ' || node_id || ' has no transcript.'
            WHEN len(ex) = 0 THEN 'No lines in the transcript of node ' || node_id || ' match the goal.'
            ELSE array_to_string(ex, chr(10)) END AS text
FROM x""")
def q_text_recall(spark, sf):
    t = chat_turns(spark, sf).filter(F.col("role") == "assistant")
    c = t.select("conv_id", "turn", F.posexplode(extract_calls(F.col("text"))).alias("call_idx", "c"))
    req = c.filter(F.col("c.function") == "recall").select(
        (F.col("conv_id") * 1000 + F.col("turn") * 10 + F.col("call_idx")).alias("req_id"),
        F.col("conv_id").alias("graph_id"), F.col("c.arguments")["node_id"].alias("node_id"),
        F.col("c.arguments")["goal"].alias("goal"))
    nodes = G.resolve_ids(dag_nodes(spark, sf))
    return B.recall(req, nodes)
