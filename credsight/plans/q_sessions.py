"""Queries for attempts, runs and sessions.

The twins replay the logs row by row (recursive SQL) and parse replies with
DuckDB's own JSON functions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from credsight.operators import sessions as S
from credsight.plans.catalog import query
from credsight.sources import fixtures as X
from credsight.sources.fixtures import oracle_with

LIMIT, MIN_OUT = 400, 100
DAY = 86_400_000_000

_JSON_SQL = """
       regexp_extract(text, '(?s)```(?:json)?\\s*\\n?(.*?)\\n?\\s*```', 1) AS blk,
       CASE WHEN json_valid(blk) THEN blk WHEN NOT contains(blk, '"') AND json_valid(replace(blk, '''', '"')) THEN replace(blk, '''', '"') END AS doc,
       json_type(doc, '$.node_statuses') = 'OBJECT' AND json_type(doc, '$.nodes') = 'ARRAY' AS shaped"""
_MESSAGE_SQL = """CASE WHEN blk = '' THEN 'No JSON block found. Output a ```json block with node_statuses and nodes.'
       WHEN doc IS NULL THEN 'JSON parse failed. Check double quotes and escaping.'
       WHEN NOT coalesce(shaped, false) THEN 'JSON must contain ''node_statuses'' (object) and ''nodes'' (array).' END"""
_NODES_SQL = "list_filter(json_extract(doc, '$.nodes[*]'), lambda n: json_extract_string(n, '$.description') IS NOT NULL AND json_extract_string(n, '$.prompt') IS NOT NULL)"
_STATUSES_SQL = """list_filter(json_keys(doc, '$.node_statuses'), lambda k: json_extract_string(doc, '$.node_statuses."' || k || '"')
                   IN ('Success', 'Uncertain', 'Not Found', 'Failed'))"""

_ATTEMPTS_SQL = oracle_with("planner_log", recursive=True) + f""",
pj AS (SELECT *, {_JSON_SQL} FROM planner_log),
cls AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r,
               role = 'user' AND NOT coalesce(starts_with(text, '[FORMAT WARNING]'), false) AS prompt,
               CASE WHEN role = 'assistant' AND error IS NULL AND text IS NOT NULL THEN {_MESSAGE_SQL} END AS message,
               CASE WHEN role <> 'assistant' THEN NULL WHEN error IS NOT NULL THEN 'llm_exception' WHEN text IS NULL THEN 'llm_no_response'
                    WHEN message IS NOT NULL THEN 'parse_error'
                    WHEN len({_NODES_SQL}) = 0 AND len({_STATUSES_SQL}) = 0 THEN 'no_progress' ELSE 'ok' END AS kind,
               {LIMIT} - sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')))
                         OVER (PARTITION BY conv_id ORDER BY turn) < {MIN_OUT} AS "full"
        FROM pj),
auto(conv_id, r, turn, plan, att, going, kind, message, "full") AS (
  SELECT conv_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 0, 0, false, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), false
  FROM cls GROUP BY conv_id
  UNION ALL
  SELECT a.conv_id, c.r, c.turn,
         a.plan + CASE WHEN c.prompt OR (c.kind IS NOT NULL AND (NOT a.going OR a.att = 4)) THEN 1 ELSE 0 END,
         CASE WHEN c.prompt THEN 0 WHEN c.kind IS NULL THEN a.att WHEN NOT a.going OR a.att = 4 THEN 1 ELSE a.att + 1 END,
         CASE WHEN c.prompt THEN true WHEN c.kind IS NULL THEN a.going ELSE c.kind = 'parse_error' END,
         c.kind, c.message, c."full"
  FROM auto a JOIN cls c ON c.conv_id = a.conv_id AND c.r = a.r + 1)
"""


@query("retry_outcomes", "E13", _ATTEMPTS_SQL + """,
g AS (SELECT conv_id, plan, min(turn) AS first_turn, count(kind) AS attempts, count(*) FILTER (WHERE kind = 'parse_error' AND att < 4) AS warnings,
             arg_max(kind, r) FILTER (WHERE kind IS NOT NULL) AS last, arg_max(coalesce(message, ''), r) FILTER (WHERE kind IS NOT NULL) AS msg,
             arg_max("full", r) AS "full"
      FROM auto WHERE plan > 0 GROUP BY ALL)
SELECT conv_id, CAST(plan AS BIGINT) AS plan_no, first_turn, attempts, warnings,
       CASE WHEN last <> 'parse_error' THEN last WHEN attempts = 4 THEN 'parse_error' WHEN "full" THEN 'context_exhausted' ELSE 'open' END AS outcome,
       nullif(msg, '') AS last_message FROM g""")
def q_retry_outcomes(spark, sf):
    return S.retry_outcomes(S.planner_attempts(X.planner_log(spark, sf), LIMIT, MIN_OUT))


@query("retry_prompts", "E13,E12", _ATTEMPTS_SQL + """
SELECT conv_id, turn, CAST(att AS BIGINT) AS attempt,
       CASE WHEN att < 4 THEN '[FORMAT WARNING] ' || message || ' Reply again with one JSON object in a ```json block.' END AS prompt,
       -1 AS process_reward
FROM auto WHERE kind = 'parse_error'""")
def q_retry_prompts(spark, sf):
    return S.retry_prompts(S.planner_attempts(X.planner_log(spark, sf), LIMIT, MIN_OUT))


@query("run_outcomes", "F8", oracle_with("run_log", recursive=True) + f""",
o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY us, event_id) AS r, min(us) OVER (PARTITION BY run_id) AS begin FROM run_log),
f(run_id, r, us, begin, turns, fails, reason) AS (
  SELECT run_id, CAST(0 AS BIGINT), min(us), min(us), 0, 0, CAST(NULL AS VARCHAR) FROM o GROUP BY run_id
  UNION ALL
  SELECT * FROM (
    SELECT f.run_id, o.r, o.us, f.begin,
           f.turns + CASE WHEN o.kind IN ('empty', 'error') THEN 0 ELSE 1 END AS t2,
           CASE WHEN o.kind IN ('empty', 'error') THEN f.fails + 1 ELSE 0 END AS f2,
           CASE WHEN o.us - f.begin > {2 * DAY} THEN 'timeout' WHEN f2 >= 2 THEN 'llm_error' WHEN o.kind = 'overflow' THEN 'context_overflow'
                WHEN o.kind = 'exception' THEN 'exception' WHEN o.kind = 'finish' THEN 'completed'
                WHEN f2 = 0 AND t2 >= 3 THEN 'max_turn' END
    FROM f JOIN o ON o.run_id = f.run_id AND o.r = f.r + 1 WHERE f.reason IS NULL))
SELECT run_id, coalesce(max(reason), 'unfinished') AS reason, CAST(max(turns) AS BIGINT) AS turns, max(us) - min(begin) AS duration_us
FROM f GROUP BY run_id""")
def q_run_outcomes(spark, sf):
    return S.run_outcomes(X.run_log(spark, sf), max_turns=3, timeout_us=2 * DAY, max_empty=2)


_SESSION_SQL = oracle_with("session_log", recursive=True) + f""",
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS r FROM session_log),
f(user_id, r, event_id, kind, turns, us, opened, first, empty, plans, reason, late) AS (
  SELECT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0, 0, 'begin', false
  FROM o GROUP BY user_id
  UNION ALL
  SELECT user_id, r, event_id, kind, turns, us, op, fi, em, pl,
         CASE kind WHEN 'answer' THEN 'answer' WHEN 'context' THEN 'context_exhausted' WHEN 'exception' THEN 'llm_exception' WHEN 'parse_error' THEN 'parse_error'
              ELSE CASE WHEN em >= 3 THEN 'no_response' WHEN pl >= 6 THEN 'max_iterations' END END, is_late
  FROM (SELECT *, CASE WHEN kind = 'empty' THEN (CASE WHEN fresh THEN 0 ELSE e0 END) + 1 WHEN fresh OR kind IN ('plan', 'batch') THEN 0 ELSE e0 END AS em,
               (CASE WHEN fresh THEN 0 ELSE p0 END) + CASE WHEN kind = 'plan' THEN 1 ELSE 0 END AS pl,
               CASE WHEN fresh THEN us ELSE opened END AS op, CASE WHEN fresh THEN event_id ELSE first END AS fi
        FROM (SELECT o.*, f.opened, f.first, f.empty AS e0, f.plans AS p0, f.reason IS NULL AND o.us - f.opened > {10 * DAY} AS is_late,
                     f.reason IS NOT NULL OR o.us - f.opened > {10 * DAY} AS fresh
              FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1))),
ev AS (SELECT user_id, us, event_id, kind, turns, opened AS session_us, first AS session_id,
              coalesce(reason, CASE WHEN lead(late) OVER (PARTITION BY user_id ORDER BY r) THEN 'timeout' END) AS reason
       FROM f WHERE r > 0)
"""


@query("session_events", "F9", _SESSION_SQL + "SELECT user_id, event_id, session_us, session_id, reason FROM ev")
def q_session_events(spark, sf):
    return S.session_ends(X.session_log(spark, sf), 10 * DAY, 6).select("user_id", "event_id", "session_us", "session_id", "reason")


@query("session_counters", "F7,F9", _SESSION_SQL + """
SELECT user_id, session_us, session_id, coalesce(max(reason), 'open') AS reason, count(*) AS n_events,
       count(*) FILTER (WHERE kind = 'plan') AS plan_calls, count(*) FILTER (WHERE kind = 'batch') AS batches,
       CAST(coalesce(sum(turns) FILTER (WHERE kind = 'batch'), 0) AS BIGINT) AS total_turns, max(us) - session_us AS duration_us,
       greatest(count(*) FILTER (WHERE kind = 'plan') - 1, 0) AS grow_iterations
FROM ev GROUP BY user_id, session_us, session_id""")
def q_session_counters(spark, sf):
    return S.session_counters(S.session_ends(X.session_log(spark, sf), 10 * DAY, 6))
