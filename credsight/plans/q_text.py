"""Queries for text / JSON operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from credsight.functions import text as X
from credsight.operators import graph as G
from credsight.operators.sessions import plan_nodes, usable
from credsight.plans.catalog import query
from credsight.sources.fixtures import chat_turns, dag_nodes, oracle_with, plan_texts, tasks
from credsight.sources.tables import read_table

CALL = X.CALL_RE.replace("(?s)", "")
PARAM = X.PARAM_RE.replace("(?s)", "")


def _calls(spark, sf):
    t = chat_turns(spark, sf).filter(F.col("role") == "assistant")
    c = t.select("conv_id", "turn", F.posexplode(X.extract_calls(F.col("text"))).alias("call_idx", "c"))
    return c.select("conv_id", "turn", F.col("call_idx").cast("bigint").alias("call_idx"),
                    F.col("c.function").alias("function"), F.col("c.arguments").alias("args"))


_CALLS_SQL = oracle_with("turns") + f""",
c0 AS (SELECT conv_id, turn, regexp_extract_all(text, '(?s){CALL}', 1) AS fns,
              regexp_extract_all(text, '(?s){CALL}', 2) AS bodies FROM turns WHERE role = 'assistant'),
calls AS (SELECT conv_id, turn, CAST(i - 1 AS BIGINT) AS call_idx, fns[i] AS function, bodies[i] AS body
          FROM c0, range(1, 10) r(i) WHERE i <= len(fns)),
kv AS (SELECT conv_id, turn, call_idx, function, j AS ppos,
              regexp_extract_all(body, '(?s){PARAM}', 1)[j] AS param,
              regexp_extract_all(body, '(?s){PARAM}', 2)[j] AS value
       FROM calls, range(1, 10) r(j) WHERE j <= len(regexp_extract_all(body, '(?s){PARAM}', 1))),
params AS (SELECT conv_id, turn, call_idx, function, param, arg_max(value, ppos) AS value FROM kv GROUP BY ALL)
"""


@query("text_calls", "C1", _CALLS_SQL + """
SELECT c.conv_id, c.turn, c.call_idx, c.function, count(p.param) AS n_params
FROM calls c LEFT JOIN params p USING (conv_id, turn, call_idx) GROUP BY ALL""")
def q_text_calls(spark, sf):
    return _calls(spark, sf).select("conv_id", "turn", "call_idx", "function",
                                    F.size("args").cast("bigint").alias("n_params"))


@query("text_params", "C1", _CALLS_SQL + """
SELECT conv_id, turn, call_idx, param, value FROM params""")
def q_text_params(spark, sf):
    c = _calls(spark, sf)
    return c.select("conv_id", "turn", "call_idx", F.explode("args").alias("param", "value"))


@query("text_missing_fields", "C2", _CALLS_SQL + """,
req AS (SELECT * FROM (VALUES ('search', 'query', 1), ('finish', 'answer', 1), ('finish', 'explanation', 2),
        ('finish', 'key_steps', 3), ('finish', 'confidence', 4), ('finish', 'uncertainties', 5),
        ('recall', 'node_id', 1), ('recall', 'goal', 2)) t(function, field, k)),
miss AS (SELECT c.conv_id, c.turn, c.call_idx, c.function,
                string_agg(r.field, ',' ORDER BY r.k) FILTER (WHERE p.param IS NULL AND r.field IS NOT NULL) AS missing
         FROM calls c LEFT JOIN req r ON r.function = c.function
         LEFT JOIN params p ON p.conv_id = c.conv_id AND p.turn = c.turn AND p.call_idx = c.call_idx AND p.param = r.field
         GROUP BY ALL),
w AS (SELECT *, count(missing) OVER (PARTITION BY conv_id, function ORDER BY turn, call_idx
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM miss)
SELECT conv_id, turn, call_idx, function, coalesce(missing, '') AS missing,
       CASE WHEN missing IS NULL THEN 'ok' WHEN k <= 3 THEN 'warn'
            WHEN function = 'finish' THEN 'accept_partial' WHEN function = 'recall' THEN 'skip' ELSE 'warn' END AS action
FROM w""")
def q_text_missing_fields(spark, sf):
    c = _calls(spark, sf).withColumn("m", X.missing_fields(F.col("function"), F.col("args")))
    has = F.size("m") > 0
    # warnings are counted per conversation and tool (bounded by the turn cap)
    w = Window.partitionBy("conv_id", "function").orderBy("turn", "call_idx").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    k = F.sum(has.cast("int")).over(w)
    action = (F.when(~has, "ok").when(k <= 3, "warn").when(F.col("function") == "finish", "accept_partial")
              .when(F.col("function") == "recall", "skip").otherwise("warn"))
    return c.select("conv_id", "turn", "call_idx", "function", F.array_join("m", ",").alias("missing"),
                    action.alias("action"))


@query("text_finish_doc", "C3", _CALLS_SQL + """,
fin AS (SELECT conv_id, turn, call_idx,
               max(value) FILTER (WHERE param = 'answer') AS answer,
               max(value) FILTER (WHERE param = 'confidence') AS confidence,
               max(value) FILTER (WHERE param = 'uncertainties') AS uncertainties
        FROM params WHERE function = 'finish' GROUP BY ALL)
SELECT c.conv_id, c.turn, c.call_idx, coalesce(answer, '') AS answer, coalesce(confidence, '0%') AS confidence,
       coalesce(uncertainties, '') AS uncertainties
FROM calls c LEFT JOIN fin USING (conv_id, turn, call_idx) WHERE c.function = 'finish'""")
def q_text_finish_doc(spark, sf):
    c = _calls(spark, sf).filter(F.col("function") == "finish")
    d = X.finish_doc(F.col("args"))
    return c.select("conv_id", "turn", "call_idx", d["answer"].alias("answer"), d["confidence"].alias("confidence"),
                    d["uncertainties"].alias("uncertainties"))


_BLOCK_SQL = oracle_with("plans") + """,
b AS (SELECT graph_id, iteration, text,
             regexp_extract_all(text, '(?s)```(?:json)?\\s*\\n?(.*?)\\n?\\s*```', 1) AS fenced FROM plans),
blk AS (SELECT graph_id, iteration,
               CASE WHEN len(fenced) > 0 THEN trim(fenced[-1], ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))
                    WHEN st > 0 THEN substr(text, st, length(text) - strpos(reverse(text), '}') + 2 - st)
               END AS block
        FROM (SELECT *, CASE WHEN strpos(text, '{"node_statuses"') > 0 THEN strpos(text, '{"node_statuses"')
                             ELSE strpos(text, '{' || chr(39) || 'node_statuses' || chr(39)) END AS st FROM b))
"""


@query("text_json_block", "C4", _BLOCK_SQL + "SELECT graph_id, iteration, block FROM blk")
def q_text_json_block(spark, sf):
    """The oracle locates the plan document by its opening key; on these
    replies that is the last top-level block the brace scan finds (the
    scan's quirks are covered by unit tests)."""
    p = plan_texts(spark, sf)
    return p.select("graph_id", "iteration", X.json_block(F.col("text")).alias("block"))


# the twin parses the located block with DuckDB's JSON functions
_PARSED_SQL = _BLOCK_SQL + """,
j AS (SELECT graph_id, iteration, block,
             CASE WHEN json_valid(block) THEN block WHEN NOT contains(block, '"') AND json_valid(replace(block, chr(39), '"'))
                  THEN replace(block, chr(39), '"') END AS doc FROM blk),
good AS (SELECT * FROM j WHERE json_type(doc, '$.node_statuses') = 'OBJECT' AND json_type(doc, '$.nodes') = 'ARRAY'),
kept AS (SELECT graph_id, iteration, pos, n FROM (
           SELECT graph_id, iteration, unnest(json_extract(doc, '$.nodes[*]')) AS n, generate_subscripts(json_extract(doc, '$.nodes[*]'), 1) AS pos FROM good)
         WHERE json_extract_string(n, '$.description') IS NOT NULL AND json_extract_string(n, '$.prompt') IS NOT NULL)
"""


def _parsed(spark, sf):
    """Replies with their block located and parsed once; every later column reads these."""
    p = plan_texts(spark, sf).withColumn("blk", X.json_block(F.col("text")))
    return p.withColumn("parsed", X.parse_plan(F.col("blk")))


@query("text_plan_parse", "C5,C6,C7,C8", _PARSED_SQL + """
SELECT j.graph_id, j.iteration,
       CASE WHEN coalesce(block, '') = '' THEN 'No JSON block found. Output a ```json block with node_statuses and nodes.'
            WHEN doc IS NULL THEN 'JSON parse failed. Check double quotes and escaping.'
            WHEN good.graph_id IS NULL THEN 'JSON must contain ''node_statuses'' (object) and ''nodes'' (array).' END AS error,
       (SELECT count(*) FROM good g, unnest(json_keys(g.doc, '$.node_statuses')) k(key) WHERE g.graph_id = j.graph_id AND g.iteration = j.iteration
          AND json_extract_string(g.doc, '$.node_statuses."' || key || '"') IN ('Success', 'Uncertain', 'Not Found', 'Failed')) AS n_statuses,
       (SELECT count(*) FROM kept k WHERE k.graph_id = j.graph_id AND k.iteration = j.iteration) AS n_nodes
FROM j LEFT JOIN (SELECT graph_id, iteration FROM good) good USING (graph_id, iteration)""")
def q_text_plan_parse(spark, sf):
    p = _parsed(spark, sf)
    st, kept = usable(F.col("parsed"))
    return p.select("graph_id", "iteration", X.plan_error_of(F.col("blk"), F.col("parsed")).alias("error"),
                    F.coalesce(F.size(st), F.lit(0)).cast("bigint").alias("n_statuses"),
                    F.coalesce(F.size(kept), F.lit(0)).cast("bigint").alias("n_nodes"))


@query("plan_nodes", "C8", _PARSED_SQL + """,
e AS (SELECT *, coalesce(json_extract_string(n, '$.id'), '') AS spec,
             sum(CASE WHEN coalesce(json_extract_string(n, '$.id'), '') = '' THEN 1 ELSE 0 END) OVER (PARTITION BY graph_id ORDER BY iteration, pos) AS c FROM kept)
SELECT graph_id, iteration, CAST(row_number() OVER (PARTITION BY graph_id, iteration ORDER BY pos) AS BIGINT) AS pos,
       CASE WHEN spec = '' THEN 't' || CAST(c AS VARCHAR) ELSE spec END AS node_id, json_extract_string(n, '$.description') AS description,
       coalesce(array_to_string(CAST(json_extract_string(n, '$.dependencies[*]') AS VARCHAR[]), ','), '') AS dependencies
FROM e""")
def q_plan_nodes(spark, sf):
    n = plan_nodes(_parsed(spark, sf))
    return n.select("graph_id", "iteration", "pos", "node_id", "description", F.array_join("dependencies", ",").alias("dependencies"))


@query("text_summary", "C13", oracle_with("gnodes") + """
SELECT graph_id, node_id, concat_ws(chr(10),
   CASE WHEN node_id <> '' THEN '[Node ' || node_id || '] ' || description END,
   CASE WHEN status <> '' THEN 'Status: ' || status END, CASE WHEN answer <> '' THEN 'Answer: ' || answer END,
   CASE WHEN explanation <> '' THEN 'Explanation: ' || explanation END,
   CASE WHEN key_steps <> '' THEN 'Key Steps: ' || key_steps END,
   CASE WHEN confidence <> '' THEN 'Confidence: ' || confidence END,
   CASE WHEN uncertainties <> '' THEN 'Uncertainties: ' || uncertainties END) AS summary FROM gnodes""")
def q_text_summary(spark, sf):
    n = G.resolve_ids(dag_nodes(spark, sf))
    return n.select("graph_id", "node_id", G.summary_col().alias("summary"))


@query("text_search_style", "C17", oracle_with("tasks") + """
SELECT row_idx, CASE WHEN contains(ability, 'WebSearch') THEN 'keyword' ELSE 'sentence' END AS search_style FROM tasks""")
def q_text_search_style(spark, sf):
    return tasks(spark, sf).select("row_idx", X.search_style(F.col("ability")).alias("search_style"))


@query("text_transcript", "C20", """
SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN '[Turn ' || CAST(turn AS VARCHAR) || ']' || chr(10) || text
                                WHEN role = 'user' AND turn > 0 THEN '[Observation]' || chr(10) || left(text, 2000) || '...'
                                ELSE text END, chr(10) || chr(10) ORDER BY turn) AS transcript
FROM conversations GROUP BY conv_id""")
def q_text_transcript(spark, sf):
    c = read_table(spark, sf, "conversations")
    part = (F.when(F.col("role") == "assistant", F.concat(F.lit("[Turn "), F.col("turn").cast("string"), F.lit("]\n"),
                                                          F.col("text")))
            .when((F.col("role") == "user") & (F.col("turn") > 0), X.observation_block(F.col("text")))
            .otherwise(F.col("text")))
    return (c.groupBy("conv_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))),
                                          lambda x: x["p"]), "\n\n").alias("transcript")))


@query("text_backoff", "C21", """
SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS n_errors,
       CAST(coalesce(list_sum(list_transform(range(count(*) FILTER (WHERE event_type = 'error')),
                                             lambda i: least(CAST(pow(2, i) AS BIGINT), 30))), 0) AS BIGINT) AS total_wait
FROM events GROUP BY user_id""")
def q_text_backoff(spark, sf):
    e = read_table(spark, sf, "events")
    g = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n_errors"))
    return g.select("user_id", "n_errors", X.backoff_total(F.col("n_errors")).alias("total_wait"))


@query("text_prompts", "C18,C17", """
SELECT item_id, CAST(k AS INTEGER) AS msg_idx, CASE WHEN k = 0 THEN 'system' ELSE 'user' END AS role,
       CASE WHEN k = 0 THEN 'You are a research agent. Write '
                            || CASE WHEN item_id % 2 = 0 THEN 'keyword' ELSE 'sentence' END || '-style search queries.'
            ELSE 'Question: ' || text || chr(10) || 'Task: ' || CASE WHEN item_id % 5 = 0 THEN 'unknown'
                                                                    ELSE 'bench-' || CAST(item_id AS VARCHAR) END END AS content
FROM benchmark, range(0, 2) r(k)""")
def q_text_prompts(spark, sf):
    b = read_table(spark, sf, "benchmark")
    ability = F.when(F.col("item_id") % 2 == 0, F.lit("WebSearch")).otherwise(F.lit("QA"))
    tid = F.when(F.col("item_id") % 5 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("bench-"), F.col("item_id").cast("string")))
    m = b.select("item_id", F.posexplode(X.render_messages(ability, F.col("text"), tid)).alias("msg_idx", "m"))
    return m.select("item_id", "msg_idx", F.col("m.role").alias("role"), F.col("m.content").alias("content"))
