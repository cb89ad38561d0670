"""Queries for plan validation (E1-E12) and violation classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from credsight.functions.columns import normalise_text, r6, sql_r6
from credsight.operators import graph as G
from credsight.operators import rules as R
from credsight.plans.catalog import query
from credsight.sources.fixtures import dag_inputs, oracle_with, rule_inputs

PAT = R"^(.+?)_refine(\d+)$"


def _viol(spark, sf):
    n, d, v = rule_inputs(spark, sf)
    return n, v, R.violations(n, d, v)


def _pl(col: str, order: str | None = None) -> str:
    return f"'[' || string_agg('''' || {col} || '''', ', ' ORDER BY {order or col}) || ']'"


_V_SQL = oracle_with("gnodes", "deps", "verdicts") + f""",
P AS (SELECT graph_id, iteration FROM gnodes UNION SELECT graph_id, iteration FROM verdicts),
batch AS (SELECT DISTINCT graph_id, iteration FROM gnodes),
prev AS (SELECT p.graph_id, p.iteration, b.iteration AS prev_b FROM P p ASOF JOIN batch b
         ON p.graph_id = b.graph_id AND p.iteration > b.iteration),
applied AS (SELECT v.graph_id, v.iteration, v.node_id, v.status FROM verdicts v JOIN prev USING (graph_id, iteration)
            JOIN gnodes n ON n.graph_id = v.graph_id AND n.node_id = v.node_id AND n.iteration = prev.prev_b),
-- replay: the status of every node at every later plan
seen AS (SELECT p.graph_id, p.iteration, n.node_id, n.exec_status FROM P p JOIN gnodes n ON n.graph_id = p.graph_id AND n.iteration < p.iteration),
state AS (SELECT s.graph_id, s.iteration, s.node_id, coalesce(a.status, s.exec_status) AS status FROM seen s
          ASOF LEFT JOIN applied a ON s.graph_id = a.graph_id AND s.node_id = a.node_id AND s.iteration > a.iteration),
miss AS (SELECT graph_id, iteration, node_id FROM state WHERE status = ''
         EXCEPT SELECT graph_id, iteration, node_id FROM verdicts),
e1 AS (SELECT graph_id, iteration, 0 AS grp, 0 AS seq, 0 AS sub, 0 AS pos, 'R_STATUS' AS rule, CAST(NULL AS VARCHAR) AS node_id,
              'node_statuses must cover all awaiting ids; without a verdict: ' || {_pl('node_id')} AS message
       FROM miss GROUP BY graph_id, iteration),
e2 AS (SELECT graph_id, iteration, 0 AS grp, 0 AS seq, 0 AS sub, 0 AS pos, 'R_EMPTY' AS rule, CAST(NULL AS VARCHAR) AS node_id,
              'plan must contain at least one new node; this one adds none' AS message
       FROM (SELECT graph_id, iteration FROM P EXCEPT SELECT graph_id, iteration FROM gnodes
             EXCEPT SELECT graph_id, iteration FROM e1)),
stage1 AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2),
ok AS (SELECT graph_id, iteration FROM P EXCEPT SELECT graph_id, iteration FROM stage1),
new AS (SELECT n.* FROM gnodes n JOIN ok USING (graph_id, iteration)),
parents AS (SELECT DISTINCT graph_id, iteration,
              CASE WHEN TRY_CAST(regexp_extract(node_id, '{PAT}', 2) AS BIGINT) = 1 THEN regexp_extract(node_id, '{PAT}', 1)
                   ELSE regexp_extract(node_id, '{PAT}', 1) || '_refine'
                        || CAST(TRY_CAST(regexp_extract(node_id, '{PAT}', 2) AS BIGINT) - 1 AS VARCHAR) END AS node_id
            FROM new WHERE regexp_matches(node_id, '{PAT}')),
pend AS (SELECT DISTINCT v.graph_id, v.iteration, v.node_id FROM verdicts v JOIN ok USING (graph_id, iteration)
         WHERE v.status IN ('Uncertain', 'Not Found')),
alive AS (SELECT p.* FROM pend p
          WHERE NOT EXISTS (SELECT 1 FROM parents r WHERE r.graph_id = p.graph_id AND r.iteration = p.iteration
                            AND r.node_id = p.node_id)
            AND CASE WHEN contains(p.node_id, '_refine')
                     THEN NOT coalesce(regexp_matches(p.node_id, '{PAT}')
                                       AND TRY_CAST(regexp_extract(p.node_id, '{PAT}', 2) AS BIGINT) >= 2, false)
                     ELSE NOT EXISTS (SELECT 1 FROM gnodes g WHERE g.graph_id = p.graph_id
                                      AND g.node_id = p.node_id || '_refine1' AND g.iteration < p.iteration) END),
e3 AS (SELECT graph_id, iteration, 1 AS grp, 0 AS seq, 0 AS sub, 0 AS pos, 'R_PENDING' AS rule, CAST(NULL AS VARCHAR) AS node_id,
              'unresolved this turn, but not addressed by any refine of the same plan: ' || {_pl('node_id')} AS message
       FROM alive GROUP BY graph_id, iteration),
b AS (SELECT graph_id, iteration, count(*) AS n,
             arg_min(node_id, seq) FILTER (WHERE ends_with(node_id, '_answer')) AS first_ans FROM new GROUP BY ALL),
e4 AS (SELECT b.graph_id, b.iteration, 2 AS grp, 0 AS seq, 0 AS sub, 0 AS pos, 'R_ANSWER_ISOLATION' AS rule, b.first_ans AS node_id,
              'answer node ''' || b.first_ans || ''' must be planned alone in its batch; planned with it: '
              || {_pl('n.node_id')} AS message
       FROM b JOIN new n ON n.graph_id = b.graph_id AND n.iteration = b.iteration AND n.node_id <> b.first_ans
       WHERE b.first_ans IS NOT NULL AND b.n > 1 GROUP BY b.graph_id, b.iteration, b.first_ans),
nd AS (SELECT d.graph_id, n.iteration, n.seq, n.node_id, d.dep_pos, d.dep_id, i.iteration AS it_d
       FROM deps d JOIN new n USING (graph_id, seq)
       LEFT JOIN gnodes i ON i.graph_id = d.graph_id AND i.node_id = d.dep_id),
e57 AS (SELECT * FROM (
        SELECT graph_id, iteration, 3 AS grp, seq, 0 AS sub, dep_pos AS pos, 'DEP' AS rule, node_id,
               CASE WHEN dep_id = node_id THEN 'node ''' || node_id || ''' depends on itself'
                    WHEN it_d = iteration THEN 'node ''' || node_id || ''' depends on ''' || dep_id
                         || ''' of the SAME batch, which has no result yet'
                    WHEN it_d IS NULL OR it_d > iteration THEN 'node ''' || node_id || ''' depends on ''' || dep_id
                         || ''', an id that does not exist' END AS message FROM nd) WHERE message IS NOT NULL),
rf AS (SELECT graph_id, iteration, seq, node_id, regexp_matches(node_id, '{PAT}') AS m,
              TRY_CAST(regexp_extract(node_id, '{PAT}', 2) AS BIGINT) AS num,
              CASE WHEN regexp_matches(node_id, '{PAT}') THEN regexp_extract(node_id, '{PAT}', 1) END AS root
       FROM new WHERE contains(node_id, '_refine')),
rf2 AS (SELECT *, CASE WHEN num = 1 THEN root ELSE root || '_refine' || CAST(num - 1 AS VARCHAR) END AS parent FROM rf),
rf3 AS (SELECT rf2.*, st.node_id IS NOT NULL AS has_parent, s.iteration AS it_self, coalesce(v.status, st.status) AS p_status
        FROM rf2 LEFT JOIN state st ON st.graph_id = rf2.graph_id AND st.iteration = rf2.iteration AND st.node_id = rf2.parent
        LEFT JOIN verdicts v ON v.graph_id = rf2.graph_id AND v.iteration = rf2.iteration AND v.node_id = rf2.parent
        LEFT JOIN gnodes s ON s.graph_id = rf2.graph_id AND s.node_id = rf2.node_id),
e8 AS (SELECT * FROM (
        SELECT graph_id, iteration, 3 AS grp, seq, 1 AS sub, 0 AS pos, 'R_REFINE' AS rule, node_id,
               CASE WHEN NOT m THEN 'refine node ''' || node_id || ''': the id is not of the form <parent>_refine<n>'
                    WHEN num > 2 THEN 'refine node ''' || node_id || ''': a line has two refines at most'
                    WHEN NOT has_parent THEN 'refine node ''' || node_id || ''': no parent ''' || parent || ''' in the graph'
                    WHEN p_status NOT IN ('Uncertain', 'Not Found') THEN 'refine node ''' || node_id || ''': parent ''' || parent
                         || ''' is ''' || p_status || ''', not unresolved'
               END AS message FROM rf3
        UNION ALL
        SELECT graph_id, iteration, 3, seq, 1, 1, 'R_REFINE', node_id,
               CASE WHEN m AND num <= 2 AND has_parent AND it_self IS NOT NULL AND it_self < iteration
                    THEN 'refine node ''' || node_id || ''': the id is in use' END FROM rf3)
       WHERE message IS NOT NULL),
sig AS (SELECT graph_id, lower(trim(regexp_replace(description, '\\s+', ' ', 'g'))) AS kd,
               lower(trim(regexp_replace(prompt, '\\s+', ' ', 'g'))) AS kp, min(iteration) AS first_it
        FROM gnodes WHERE NOT ends_with(node_id, '_answer') GROUP BY ALL),
e9 AS (SELECT n.graph_id, n.iteration, 3 AS grp, n.seq, 2 AS sub, 0 AS pos, 'R_DUP' AS rule, n.node_id,
              'node ''' || n.node_id || ''' has the same description AND prompt as an earlier node' AS message
       FROM new n JOIN sig s ON s.graph_id = n.graph_id AND s.kd = lower(trim(regexp_replace(n.description, '\\s+', ' ', 'g')))
         AND s.kp = lower(trim(regexp_replace(n.prompt, '\\s+', ' ', 'g')))
       WHERE NOT ends_with(n.node_id, '_answer') AND s.first_it < n.iteration),
viol AS (SELECT * FROM stage1 UNION ALL SELECT * FROM e3 UNION ALL SELECT * FROM e4 UNION ALL SELECT * FROM e57
         UNION ALL SELECT * FROM e8 UNION ALL SELECT * FROM e9),
msgs AS (SELECT graph_id, iteration, count(*) AS n_errors,
                CASE WHEN count(*) = 1 THEN min(message)
                     ELSE string_agg('[Error ' || CAST(rk AS VARCHAR) || '] ' || message, chr(10) ORDER BY rk) END AS error
         FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, iteration ORDER BY grp, seq, sub, pos, message) AS rk FROM viol)
         GROUP BY graph_id, iteration)
"""


@query("rule_violations", "E1,E2,E3,E4,E5,E6,E7,E8,E9", _V_SQL + """
SELECT graph_id, iteration, rule, node_id, message FROM viol""")
def q_rule_violations(spark, sf):
    return _viol(spark, sf)[2].select("graph_id", "iteration", "rule", "node_id", "message")


for _name, _rule in [("rule_status", "R_STATUS"), ("rule_empty", "R_EMPTY"), ("rule_pending", "R_PENDING"),
                     ("rule_answer_isolation", "R_ANSWER_ISOLATION"), ("rule_dep", "DEP"),
                     ("rule_refine", "R_REFINE"), ("rule_dup", "R_DUP")]:
    def _mk(rule):
        def fn(spark, sf):
            v = _viol(spark, sf)[2]
            return v.filter(F.col("rule") == rule).select("graph_id", "iteration", "node_id", "message")
        return fn
    query(_name, {"R_STATUS": "E1", "R_EMPTY": "E2", "R_PENDING": "E3", "R_ANSWER_ISOLATION": "E4", "DEP": "E5,E6,E7",
                  "R_REFINE": "E8,C10", "R_DUP": "E9,C9"}[_rule],
          _V_SQL + f"SELECT graph_id, iteration, node_id, message FROM viol WHERE rule = '{_rule}'")(_mk(_rule))


@query("rule_messages", "E10", _V_SQL + "SELECT graph_id, iteration, n_errors, error FROM msgs")
def q_rule_messages(spark, sf):
    return R.compose(_viol(spark, sf)[2])


def _classify_sql(m: str) -> str:
    """Written with substring tests, apart from the operator's patterns."""
    x = f"lower({m})"
    return f"""CASE WHEN {x} = 'refine node' OR regexp_matches({x}, '^refine node[^a-z0-9_]') THEN 'R_REFINE'
      WHEN contains({x}, 'no json block') OR contains({x}, 'json parse failed') OR contains({x}, 'json must contain') THEN 'JSON_PARSE'
      WHEN contains({x}, 'node_statuses must cover') THEN 'R_STATUS'
      WHEN contains({x}, 'plan must contain at least one new node') THEN 'R_EMPTY'
      WHEN contains({x}, 'not addressed by any refine') THEN 'R_PENDING'
      WHEN contains({x}, 'must be planned alone in its batch') THEN 'R_ANSWER_ISOLATION'
      WHEN contains({x}, 'same description and prompt') THEN 'R_DUP'
      WHEN contains({x}, 'is a new (non-refine) addition in patch mode') THEN 'R_PTP_JUSTIFICATION'
      WHEN contains({x}, 'depends on itself') OR {x} LIKE '%depends on % same batch%' OR {x} LIKE '%depends on % does not exist%'
           OR {x} LIKE '%depends on % neither an existing%' THEN 'DEP'
      ELSE 'OTHER' END"""


_TYPES = ("R_STATUS", "R_EMPTY", "R_PENDING", "R_REFINE", "R_DUP", "R_ANSWER_ISOLATION", "DEP", "JSON_PARSE",
          "R_PTP_JUSTIFICATION", "OTHER")


_COUNTS_SQL = _V_SQL + f""",
parts AS (SELECT graph_id, trim(p) AS m FROM (
            SELECT graph_id, unnest(CASE WHEN contains(error, '[Error ')
                                         THEN list_filter(string_split_regex(error, '\\[Error \\d+\\]\\s*'), lambda x: trim(x) <> '')
                                         ELSE [error] END) AS p FROM msgs)),
typed AS (SELECT graph_id, {_classify_sql('m')} AS vtype FROM parts),
calls AS (SELECT graph_id, count(*) AS plan_calls FROM P GROUP BY graph_id)
SELECT c.graph_id, c.plan_calls,
  {", ".join(f"count(t.vtype) FILTER (WHERE t.vtype = '{v}') AS n_{v.lower()}" for v in _TYPES)},
  {", ".join(sql_r6(f"CAST(count(t.vtype) FILTER (WHERE t.vtype = '{v}') AS DOUBLE) / CAST(greatest(c.plan_calls, 1) AS DOUBLE)") + f" AS rate_{v.lower()}" for v in _TYPES)}
FROM calls c LEFT JOIN typed t USING (graph_id) GROUP BY c.graph_id, c.plan_calls"""


@query("rule_counts", "E11,C11,C12", _COUNTS_SQL)
def q_rule_counts(spark, sf):
    n, v, viol = _viol(spark, sf)
    out = R.violation_counts(R.compose(viol), R.plans(n, v))
    return out.select(*[r6(F.col(c)).alias(c) if c.startswith("rate_") else F.col(c) for c in out.columns])


@query("text_violation_class", "C11,C12", _V_SQL + f""",
parts AS (SELECT graph_id, iteration, trim(p) AS m FROM (
            SELECT graph_id, iteration, unnest(CASE WHEN contains(error, '[Error ')
                   THEN list_filter(string_split_regex(error, '\\[Error \\d+\\]\\s*'), lambda x: trim(x) <> '')
                   ELSE [error] END) AS p FROM msgs))
SELECT {_classify_sql('m')} AS vtype, count(*) AS n FROM parts GROUP BY 1""")
def q_text_violation_class(spark, sf):
    msgs = R.compose(_viol(spark, sf)[2])
    parts = msgs.select(F.explode(R.split_errors(F.col("error"))).alias("m"))
    return parts.groupBy(R.classify(F.col("m")).alias("vtype")).agg(F.count(F.lit(1)).alias("n"))


@query("rule_penalty", "E12", _V_SQL + """
SELECT P.graph_id, P.iteration, CASE WHEN msgs.error IS NOT NULL THEN -1 ELSE 0 END AS process_reward
FROM P LEFT JOIN msgs USING (graph_id, iteration)""")
def q_rule_penalty(spark, sf):
    n, v, viol = _viol(spark, sf)
    return R.penalty_marks(R.plans(n, v), R.compose(viol))


@query("text_normalise", "C9", """
SELECT doc_id, lower(trim(regexp_replace(text, '[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]+', ' ', 'g'))) AS norm FROM documents""")
def q_text_normalise(spark, sf):
    from credsight.sources.tables import read_table
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", normalise_text(F.col("text")).alias("norm"))


@query("text_refine_parse", "C10", oracle_with("gnodes") + f"""
SELECT graph_id, node_id, regexp_extract(node_id, '{PAT}', 1) AS root,
       TRY_CAST(regexp_extract(node_id, '{PAT}', 2) AS BIGINT) AS n
FROM gnodes WHERE contains(node_id, '_refine')""")
def q_text_refine_parse(spark, sf):
    n, _, _ = dag_inputs(spark, sf)
    m, root, num = R.refine_parse(F.col("node_id"))
    return n.filter(F.col("node_id").contains("_refine")).select(
        "graph_id", "node_id", F.coalesce(root, F.lit("")).alias("root"), num.alias("n"))
