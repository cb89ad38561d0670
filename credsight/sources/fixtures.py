"""Derived rollout views over the given tables (see FIXTURES.md).

The test tables are a TPC-H-like star schema plus text tables.  The rollout
domain is mapped onto them so that every query's work grows with the data:

* ``tok``   one row per token position, from ``lineitem`` (trajectory = order)
* ``traj``  one row per trajectory, from ``orders`` + per-trajectory token sums
* ``nodes`` / ``deps``  task DAGs: one graph per customer, one node per order,
  one dependency per line item
* ``verdicts``  planner verdicts on the previous batch of each graph
* ``evalres``   evaluation results, from ``events``
* ``tasks``     benchmark task rows with a nested ``extra_info``, from ``events``
* ``turns``     chat turns with tool-call markup, from ``conversations``

Each view has a twin in DuckDB SQL (``ORACLE_CTES``) used by ``oracle_sql``;
the two are written independently and must agree row for row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credsight.session import stored
from credsight.sources.tables import read_table

# Fixed values of the rollout domain (status vocabulary, role suffixes).
STATUSES = ["", "Success", "Uncertain", "Not Found", "Failed"]

# Total order of line items inside one order: (l_orderkey, l_linenumber) is
# not unique, so every column takes part in the tie-break.
TOKEN_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
               "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def _d(x: float):
    return F.lit(float(x))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tok(traj_id, pos, mask, reward, value, old_logp, logp, ref_logp, pmask, vpred, logits).

    ``pos`` is a row_number inside the trajectory.  The window partitions by
    trajectory, so one task holds at most one trajectory's tokens at a time
    (bounded by the response length), and the output stays hash-partitioned
    by ``traj_id`` for the joins that follow.
    """
    li = read_table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(*TOKEN_ORDER)
    mask = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), 0).otherwise(1)
    old = _d(-10.0) * F.col("l_discount") - _d(0.1)
    return li.select(
        F.col("l_orderkey").alias("traj_id"),
        (F.row_number().over(w) - 1).cast("bigint").alias("pos"),
        mask.alias("mask"),
        ((F.col("l_quantity") - _d(25.0)) / _d(32.0)).alias("reward"),
        (F.col("l_tax") * _d(10.0)).alias("value"),
        old.alias("old_logp"),
        (old + (F.col("l_tax") - _d(0.04)) * _d(5.0)).alias("logp"),
        (old - _d(0.05) * (F.col("l_linenumber") % 5 - 2).cast("double")).alias("ref_logp"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1)
         .otherwise(0).alias("pmask"),
        (F.col("l_tax") * _d(10.0) + (F.col("l_discount") - _d(0.05)) * _d(4.0)).alias("vpred"),
        F.array(F.col("l_quantity") / _d(10.0), F.col("l_discount") * _d(10.0),
                F.col("l_tax") * _d(10.0), F.col("l_extendedprice") / _d(20000.0)).alias("logits"),
    )


def traj_sums(tok: DataFrame) -> DataFrame:
    """Per-trajectory scalars in one pass over the tokens: score, lengths and
    the number of runs of negative process mask (H4's violation count, a lag
    inside the trajectory window)."""
    w = Window.partitionBy("traj_id").orderBy("pos")
    neg = (F.col("pmask") < 0).cast("int")
    start = ((neg == 1) & (F.coalesce(F.lag(neg, 1).over(w), F.lit(0)) == 0)).cast("int")
    return tok.select("traj_id", "reward", "mask", start.alias("vstart")).groupBy("traj_id").agg(
        F.sum("reward").alias("score"),
        F.count(F.lit(1)).alias("n_tokens"),
        F.sum("mask").cast("bigint").alias("n_valid"),
        F.sum("vstart").cast("bigint").alias("n_violations"),
    )


def trajectories(spark: SparkSession, sf_dir: str, tok: DataFrame | None = None) -> DataFrame:
    """traj(traj_id, batch_idx, uid, gen_uid, is_planner, is_dummy, score, raw_score,
    n_tokens, n_valid, baseline).

    Orders without line items are empty trajectories (score 0, no tokens).
    """
    tok = tok if tok is not None else tokens(spark, sf_dir)
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    s = traj_sums(tok)
    j = o.join(s, o.o_orderkey == s.traj_id, "left")
    score = F.coalesce(F.col("score"), _d(0.0))
    return j.select(
        F.col("o_orderkey").alias("traj_id"),
        F.col("o_orderkey").alias("batch_idx"),
        F.col("o_custkey").alias("uid"),
        F.col("o_orderpriority").alias("gen_uid"),
        (F.col("o_orderstatus") == "F").alias("is_planner"),
        ((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "4-NOT SPECIFIED")).alias("is_dummy"),
        score.alias("score"),
        F.when(F.col("o_orderstatus") == "O", -score).otherwise(score).alias("raw_score"),
        F.coalesce(F.col("n_tokens"), F.lit(0).cast("bigint")).alias("n_tokens"),
        F.coalesce(F.col("n_valid"), F.lit(0).cast("bigint")).alias("n_valid"),
        F.coalesce(F.col("n_violations"), F.lit(0).cast("bigint")).alias("n_violations"),
        (F.col("o_totalprice") / _d(131072.0) - _d(2.0)).alias("baseline"),
    )


def eval_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """evalres(instance_id, seq, data_source, level, score, status, finished_at, seed, workflow, task_key).

    ``error`` events are runs without output: score 0, status failed (A6).
    """
    e = read_table(spark, sf_dir, "events")
    lvl = F.col("user_id") % 4
    return e.select(
        F.concat(F.lit("inst-"), F.col("event_id").cast("string")).alias("instance_id"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("data_source"),
        F.when(lvl == 0, F.lit(None).cast("bigint")).otherwise(lvl.cast("bigint")).alias("level"),
        F.when(F.col("event_type") == "error", _d(0.0))
         .otherwise(F.least(_d(1.0), F.floor(F.col("value")).cast("double") / _d(32.0))).alias("score"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.col("ts").alias("finished_at"),
        F.element_at(F.array(F.lit(42), F.lit(123), F.lit(777)),
                     (F.col("user_id") % 3 + 1).cast("int")).cast("bigint").alias("seed"),
        F.when(F.col("event_id") % 2 == 0, "dag").otherwise("react").alias("workflow"),
        F.col("user_id").alias("task_key"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tasks(row_idx, ability, data_source, uid, extra_info struct<instance_id, task_id,
    original_idx, dataset, level>) -- benchmark task rows (A1-A5, A12).

    Nulls in ``extra_info`` exercise the A5 fallback chain.
    """
    e = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    extra = F.struct(
        F.when(eid % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("inst-"), eid.cast("string"))).alias("instance_id"),
        F.when(eid % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("task-"), F.col("user_id").cast("string"))).alias("task_id"),
        F.when(eid % 7 == 0, F.lit(None).cast("bigint")).otherwise(eid).alias("original_idx"),
        F.when(eid % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("event_type")).alias("dataset"),
        F.when(F.col("user_id") % 4 == 0, F.lit(None).cast("bigint"))
         .otherwise((F.col("user_id") % 4).cast("bigint")).alias("level"),
    )
    return e.select(
        eid.alias("row_idx"),
        F.when(F.col("event_type").isin("click", "view"), "WebSearch")
         .otherwise(F.concat(F.lit("QA-"), F.col("event_type"))).alias("ability"),
        F.when(eid % 6 == 0, F.lit(None).cast("string")).otherwise(F.col("event_type")).alias("data_source"),
        F.when(eid % 9 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("u"), eid.cast("string"))).alias("uid"),
        extra.alias("extra_info"),
    )


# ---------------------------------------------------------------------------
# DuckDB twins (oracle side).  Literals are cast to DOUBLE so both engines do
# the same IEEE arithmetic.
# ---------------------------------------------------------------------------

ORACLE_CTES: dict[str, str] = {}

ORACLE_CTES["tok"] = """
tok AS (
  SELECT l_orderkey AS traj_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
              l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax,
              l_returnflag, l_linestatus) - 1 AS BIGINT) AS pos,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 0 ELSE 1 END AS mask,
         (l_quantity - 25.0::DOUBLE) / 32.0::DOUBLE AS reward,
         l_tax * 10.0::DOUBLE AS value,
         -10.0::DOUBLE * l_discount - 0.1::DOUBLE AS old_logp,
         (-10.0::DOUBLE * l_discount - 0.1::DOUBLE) + (l_tax - 0.04::DOUBLE) * 5.0::DOUBLE AS logp,
         (-10.0::DOUBLE * l_discount - 0.1::DOUBLE)
            - 0.05::DOUBLE * CAST(l_linenumber % 5 - 2 AS DOUBLE) AS ref_logp,
         CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN -1 ELSE 0 END AS pmask,
         l_tax * 10.0::DOUBLE + (l_discount - 0.05::DOUBLE) * 4.0::DOUBLE AS vpred,
         [l_quantity / 10.0::DOUBLE, l_discount * 10.0::DOUBLE, l_tax * 10.0::DOUBLE,
          l_extendedprice / 20000.0::DOUBLE] AS logits
  FROM lineitem)"""

ORACLE_CTES["traj"] = """
traj AS (
  SELECT o.o_orderkey AS traj_id, o.o_orderkey AS batch_idx, o.o_custkey AS uid,
         o.o_orderpriority AS gen_uid,
         o.o_orderstatus = 'F' AS is_planner,
         (o.o_orderstatus = 'P' AND o.o_orderpriority = '4-NOT SPECIFIED') AS is_dummy,
         coalesce(s.score, 0.0::DOUBLE) AS score,
         CASE WHEN o.o_orderstatus = 'O' THEN -coalesce(s.score, 0.0::DOUBLE)
              ELSE coalesce(s.score, 0.0::DOUBLE) END AS raw_score,
         coalesce(s.n_tokens, 0) AS n_tokens,
         coalesce(s.n_valid, 0) AS n_valid,
         o.o_totalprice / 131072.0::DOUBLE - 2.0::DOUBLE AS baseline
  FROM orders o LEFT JOIN (
     SELECT traj_id, sum(reward) AS score, CAST(count(*) AS BIGINT) AS n_tokens,
            CAST(sum(mask) AS BIGINT) AS n_valid
     FROM tok GROUP BY traj_id) s ON o.o_orderkey = s.traj_id)"""

ORACLE_CTES["evalres"] = """
evalres AS (
  SELECT 'inst-' || CAST(event_id AS VARCHAR) AS instance_id, event_id AS seq,
         event_type AS data_source,
         CASE WHEN user_id % 4 = 0 THEN NULL ELSE CAST(user_id % 4 AS BIGINT) END AS level,
         CASE WHEN event_type = 'error' THEN 0.0::DOUBLE
              ELSE least(1.0::DOUBLE, CAST(floor(value) AS DOUBLE) / 32.0::DOUBLE) END AS score,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
         ts AS finished_at,
         CAST(([42, 123, 777])[CAST(user_id % 3 + 1 AS INTEGER)] AS BIGINT) AS seed,
         CASE WHEN event_id % 2 = 0 THEN 'dag' ELSE 'react' END AS workflow,
         user_id AS task_key
  FROM events)"""

ORACLE_CTES["tasks"] = """
tasks AS (
  SELECT event_id AS row_idx,
         CASE WHEN event_type IN ('click', 'view') THEN 'WebSearch' ELSE 'QA-' || event_type END AS ability,
         CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_type END AS data_source,
         CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'u' || CAST(event_id AS VARCHAR) END AS uid,
         {'instance_id': CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'inst-' || CAST(event_id AS VARCHAR) END,
          'task_id': CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'task-' || CAST(user_id AS VARCHAR) END,
          'original_idx': CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id END,
          'dataset': CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END,
          'level': CASE WHEN user_id % 4 = 0 THEN NULL ELSE CAST(user_id % 4 AS BIGINT) END} AS extra_info
  FROM events)"""

# Which CTEs each CTE needs (inserted in this order).
ORACLE_DEPS = {
    "tok": [], "traj": ["tok"], "evalres": [], "tasks": [],
}


def oracle_with(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause holding the named fixture CTEs and their dependencies.

    The text ends without a trailing comma; callers append ``, more AS (...)``.
    """
    order: list[str] = []

    def add(n: str) -> None:
        for d in ORACLE_DEPS[n]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",".join(ORACLE_CTES[n] for n in order) + "\n"


# ---------------------------------------------------------------------------
# Task DAGs: one graph per customer, one node per order (insertion order =
# order key), one dependency per line item.
# ---------------------------------------------------------------------------


def dag_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nodes(graph_id, seq, okey, iteration, spec_id, status, description, prompt,
    answer, explanation, key_steps, confidence, uncertainties, raw_text).

    ``spec_id`` is the id a plan gave the node ('' = auto id, see D1).
    """
    o = read_table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    b = o.select(F.col("o_custkey").alias("graph_id"), F.col("o_orderkey").alias("okey"),
                 F.row_number().over(w).cast("bigint").alias("seq"),
                 F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"),
                 F.floor("o_totalprice").alias("tp"))
    seq, p, s = F.col("seq"), F.col("p"), F.col("s")
    n = lambda x: F.concat(F.lit("n"), x.cast("string"))
    spec = (F.when((p == "1-URGENT") & (s == "F"), F.concat(n(seq), F.lit("_answer")))
            .when((p == "3-MEDIUM") & (seq > 3), F.concat(n(seq - 3), F.lit("_refine1")))
            # a second refine follows the first by one batch (even seq) or by two or three
            .when((p == "2-HIGH") & (s == "P") & (seq > 6) & (seq % 2 == 0), F.concat(n(seq - 6), F.lit("_refine2")))
            .when((p == "2-HIGH") & (s == "P") & (seq > 10) & (seq % 2 == 1), F.concat(n(seq - 10), F.lit("_refine2")))
            .when((p == "5-LOW") & (s == "P"), F.lit(""))
            .when((p == "4-NOT SPECIFIED") & (s == "P"), F.concat(F.lit("t_"), seq.cast("string")))
            .otherwise(n(seq)))
    code = F.col("tp") % 6
    status = (F.when(code == 0, "").when(code == 1, "Success").when(code == 2, "Uncertain")
              .when(code == 3, "Not Found").when(code == 4, "Failed").otherwise("Success"))
    b = b.select("*", spec.alias("spec_id"), status.alias("status"))
    st = F.col("status")
    answer = (F.when(st == "Success", F.concat(F.lit("A"), (F.col("graph_id") % 17).cast("string")))
              .when(st == "Uncertain", F.lit("maybe")).otherwise(F.lit("")))
    return b.select(
        "graph_id", "seq", "okey", ((seq + 2) / 3).cast("bigint").alias("iteration"), "spec_id", "status",
        # as the execution left it: failed, or awaiting a verdict
        F.when(st == "Failed", st).otherwise(F.lit("")).alias("exec_status"),
        F.when(F.col("okey") % 2 == 0, F.concat(F.lit("Find  "), p))
         .otherwise(F.concat(F.lit("find "), F.lower(p))).alias("description"),
        F.concat(F.lit("Check status "), s).alias("prompt"),
        answer.alias("answer"),
        F.when(F.col("okey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("because "), p)).alias("explanation"),
        F.lit("").alias("key_steps"),
        F.concat((F.col("tp") % 100).cast("string"), F.lit("%")).alias("confidence"),
        F.when(st == "Uncertain", F.lit("source conflict")).otherwise(F.lit("")).alias("uncertainties"),
        F.when(F.col("okey") % 5 == 0, F.lit("")).otherwise(F.concat_ws(
            "\n", F.concat(F.lit("Searched "), p), F.concat(F.lit("Observed status "), s),
            F.concat(F.lit("Answer: "), answer))).alias("raw_text"),
        (F.col("okey") % 9).alias("turns"), F.when(st == "Failed", F.lit("timeout")).alias("failure_reason"),
        # keys that the document format does not know
        F.when(F.col("okey") % 4 == 0, F.concat(F.lit('{"note":"k'), (F.col("okey") % 5).cast("string"), F.lit('","rank":'),
                                                (F.col("okey") % 3).cast("string"), F.lit("}"))).alias("extra"),
    )


def dag_deps(spark: SparkSession, sf_dir: str, nodes: DataFrame | None = None) -> DataFrame:
    """deps(graph_id, seq, dep_pos, dep_id): the node's dependency list in order."""
    nodes = nodes if nodes is not None else dag_nodes(spark, sf_dir)
    li = read_table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(*TOKEN_ORDER)
    li = li.select("l_orderkey", "l_partkey", (F.row_number().over(w) - 1).cast("bigint").alias("dep_pos"))
    j = li.join(nodes.select("graph_id", "seq", F.col("okey").alias("l_orderkey")), "l_orderkey")
    dist = F.when(F.col("l_partkey") % 211 == 0, F.lit(0)).otherwise(1 + F.col("l_partkey") % 4)
    return j.select("graph_id", "seq", "dep_pos",
                    F.concat(F.lit("n"), (F.col("seq") - dist).cast("string")).alias("dep_id"))


def dag_verdicts(spark: SparkSession, sf_dir: str, nodes: DataFrame | None = None) -> DataFrame:
    """verdicts(graph_id, iteration, node_id, status): the plan at iteration k
    judges the batch of iteration k-1; some stale verdicts target older batches.
    Some verdicts differ from the stored status, which was revised after the session,
    and some nodes that failed get none."""
    nodes = nodes if nodes is not None else dag_nodes(spark, sf_dir)
    named = nodes.filter(F.col("spec_id") != "")
    said = F.when(F.col("okey") % 7 == 3, F.lit("Uncertain")).otherwise(F.col("status"))
    fresh = named.filter((F.col("status") != "") & ~((F.col("status") == "Failed") & (F.col("okey") % 3 == 1))).select(
        "graph_id", (F.col("iteration") + 1).alias("iteration"), F.col("spec_id").alias("node_id"), said.alias("status"))
    stale = named.filter(F.col("seq") % 4 == 0).select(
        "graph_id", (F.col("iteration") + 2).alias("iteration"), F.col("spec_id").alias("node_id"),
        F.lit("Failed").alias("status"))
    return fresh.unionByName(stale)


ORACLE_CTES["nodes"] = """
nodes AS (
  SELECT graph_id, seq, okey, CAST((seq + 2) // 3 AS BIGINT) AS iteration, spec_id, status,
         CASE status WHEN 'Failed' THEN 'Failed' ELSE '' END AS exec_status,
         CASE WHEN okey % 2 = 0 THEN 'Find  ' || p ELSE 'find ' || lower(p) END AS description,
         'Check status ' || s AS prompt,
         CASE WHEN status = 'Success' THEN 'A' || CAST(graph_id % 17 AS VARCHAR)
              WHEN status = 'Uncertain' THEN 'maybe' ELSE '' END AS answer,
         CASE WHEN okey % 3 = 0 THEN '' ELSE 'because ' || p END AS explanation,
         '' AS key_steps,
         CAST(tp % 100 AS VARCHAR) || '%' AS confidence,
         CASE WHEN status = 'Uncertain' THEN 'source conflict' ELSE '' END AS uncertainties,
         CASE WHEN okey % 5 = 0 THEN '' ELSE 'Searched ' || p || chr(10) || 'Observed status ' || s || chr(10)
              || 'Answer: ' || CASE WHEN status = 'Success' THEN 'A' || CAST(graph_id % 17 AS VARCHAR)
                                    WHEN status = 'Uncertain' THEN 'maybe' ELSE '' END END AS raw_text,
         okey % 9 AS turns, CASE WHEN status = 'Failed' THEN 'timeout' END AS failure_reason,
         CASE WHEN okey % 4 = 0 THEN '{"note":"k' || CAST(okey % 5 AS VARCHAR) || '","rank":' || CAST(okey % 3 AS VARCHAR) || '}' END AS extra
  FROM (
    SELECT *,
      CASE WHEN p = '1-URGENT' AND s = 'F' THEN 'n' || CAST(seq AS VARCHAR) || '_answer'
           WHEN p = '3-MEDIUM' AND seq > 3 THEN 'n' || CAST(seq - 3 AS VARCHAR) || '_refine1'
           WHEN p = '2-HIGH' AND s = 'P' AND seq % 2 = 0 AND seq > 6 THEN 'n' || CAST(seq - 6 AS VARCHAR) || '_refine2'
           WHEN p = '2-HIGH' AND s = 'P' AND seq % 2 = 1 AND seq > 10 THEN 'n' || CAST(seq - 10 AS VARCHAR) || '_refine2'
           WHEN p = '5-LOW' AND s = 'P' THEN ''
           WHEN p = '4-NOT SPECIFIED' AND s = 'P' THEN 't_' || CAST(seq AS VARCHAR)
           ELSE 'n' || CAST(seq AS VARCHAR) END AS spec_id,
      CASE tp % 6 WHEN 0 THEN '' WHEN 1 THEN 'Success' WHEN 2 THEN 'Uncertain' WHEN 3 THEN 'Not Found'
                  WHEN 4 THEN 'Failed' ELSE 'Success' END AS status
    FROM (SELECT o_custkey AS graph_id, o_orderkey AS okey,
                 CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS seq,
                 o_orderpriority AS p, o_orderstatus AS s, CAST(floor(o_totalprice) AS BIGINT) AS tp
          FROM orders)))"""

ORACLE_CTES["deps"] = """
deps AS (
  SELECT n.graph_id, n.seq, l.dep_pos,
         'n' || CAST(n.seq - CASE WHEN l.l_partkey % 211 = 0 THEN 0 ELSE 1 + l.l_partkey % 4 END AS VARCHAR) AS dep_id
  FROM (SELECT l_orderkey, l_partkey,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                    l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1
                    AS BIGINT) AS dep_pos
        FROM lineitem) l
  JOIN nodes n ON n.okey = l.l_orderkey)"""

ORACLE_CTES["verdicts"] = """
verdicts AS (
  SELECT graph_id, iteration + 1 AS iteration, spec_id AS node_id,
         CASE WHEN okey % 7 = 3 THEN 'Uncertain' ELSE status END AS status FROM nodes
  WHERE spec_id <> '' AND status <> '' AND NOT (status = 'Failed' AND okey % 3 = 1)
  UNION ALL
  SELECT graph_id, iteration + 2 AS iteration, spec_id AS node_id, 'Failed' AS status FROM nodes
  WHERE spec_id <> '' AND seq % 4 = 0)"""

# D1 auto ids: the k-th empty spec id of a graph (in seq order) becomes 't<k>'.
ORACLE_CTES["gnodes"] = """
gnodes AS (
  SELECT nodes.*, CASE WHEN spec_id = '' THEN 't' || CAST(a.k AS VARCHAR) ELSE spec_id END AS node_id
  FROM nodes LEFT JOIN (
    SELECT graph_id, seq, row_number() OVER (PARTITION BY graph_id ORDER BY seq) AS k
    FROM nodes WHERE spec_id = '') a USING (graph_id, seq))"""

ORACLE_CTES["edges"] = """
edges AS (
  SELECT d.graph_id, s.node_id AS src, n.node_id AS dst, d.dep_pos, n.seq AS dst_seq
  FROM deps d JOIN gnodes n ON n.graph_id = d.graph_id AND n.seq = d.seq
  JOIN gnodes s ON s.graph_id = d.graph_id AND s.node_id = d.dep_id AND s.seq <= n.seq)"""

ORACLE_DEPS.update({"nodes": [], "deps": ["nodes"], "verdicts": ["nodes"], "gnodes": ["nodes"],
                    "edges": ["deps", "gnodes"]})


# ---------------------------------------------------------------------------
# Chat turns with tool-call markup (from conversations) and plan texts (from
# the DAG views).  Whole turn texts are used as parameter values.
# ---------------------------------------------------------------------------


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turns(conv_id, turn, role, text): assistant turns carry one or two
    ``<function=..>`` calls built around the original text."""
    c = read_table(spark, sf_dir, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 4
    t, n = F.col("text"), F.col("turn").cast("string")
    p = lambda key, v: F.concat(F.lit(f"<parameter={key}>"), v, F.lit("</parameter>"))
    call = (F.when(k == 0, F.concat(F.lit("<function=search>"), p("query", t),
                                    F.when(F.col("turn") % 3 == 0, p("query", F.concat(t, F.lit(" again")))).otherwise(F.lit("")),
                                    F.lit("</function>")))
            .when(k == 1, F.concat(F.lit("<function=open_page>"), p("url", F.concat(F.lit("http://x.example/"), n)),
                                   F.lit("</function>")))
            .when(k == 2, F.concat(F.lit("<function=recall>"), p("node_id", F.concat(F.lit("n"), n)),
                                   F.when(F.col("turn") % 3 != 0, p("goal", t)).otherwise(F.lit("")),
                                   F.lit("</function>")))
            .otherwise(F.concat(F.lit("<function=finish>"), p("answer", t), p("explanation", F.lit(" because\n")),
                                F.when(F.col("turn") % 2 == 0, p("confidence", F.lit("70%"))).otherwise(F.lit("")),
                                F.lit("</function>"))))
    second = F.when(F.col("turn") % 5 == 1, F.concat(F.lit("\n<function=search>"), p("query", F.lit("more")),
                                                      F.lit("</function>"))).otherwise(F.lit(""))
    text = F.when(F.col("role") == "assistant", F.concat(F.lit("Thinking.\n"), call, second)).otherwise(t)
    return c.select("conv_id", "turn", "role", text.alias("text"))


def plan_texts(spark: SparkSession, sf_dir: str, nodes: DataFrame | None = None) -> DataFrame:
    """plans(graph_id, iteration, text): one planner reply per (graph, batch),
    holding the batch's node specs and the verdicts on the previous batch as
    JSON -- fenced, bare, single-quoted or missing, by iteration.  Some specs lack
    the prompt, half of them the dependencies."""
    nodes = nodes if nodes is not None else dag_nodes(spark, sf_dir)
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    spec = F.concat(F.lit("{"), F.lit('"id": '), q(F.col("spec_id")), F.lit(', "description": '),
                    q(F.col("description")),
                    F.when(F.col("okey") % 13 == 5, F.lit("")).otherwise(F.concat(F.lit(', "prompt": '), q(F.col("prompt")))),
                    F.when(F.col("okey") % 2 == 0, F.concat(F.lit(', "dependencies": ["n'), (F.col("seq") - 1).cast("string"),
                                                            F.lit('", "n1"]'))).otherwise(F.lit("")), F.lit("}"))
    specs = nodes.groupBy("graph_id", "iteration").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", spec.alias("s")))),
                                 lambda x: x["s"]), ", ").alias("specs"))
    st = nodes.filter(F.col("spec_id") != "").select(
        "graph_id", (F.col("iteration") + 1).alias("iteration"), "seq",
        F.concat(q(F.col("spec_id")), F.lit(": "),
                 q(F.when(F.col("status") == "", F.lit("Pending")).otherwise(F.col("status")))).alias("e"))
    sts = st.groupBy("graph_id", "iteration").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "e"))), lambda x: x["e"]), ", ")
        .alias("sts"))
    j = specs.join(sts, ["graph_id", "iteration"], "left")
    doc = F.concat(F.lit('{"node_statuses": {'), F.coalesce(F.col("sts"), F.lit("")), F.lit('}, "nodes": ['),
                   F.col("specs"), F.lit("]}"))
    m = F.col("iteration") % 4
    text = (F.when(m == 0, F.concat(F.lit("Plan:\n```json\n"), doc, F.lit("\n```")))
            .when(m == 1, F.concat(F.lit("Here is the plan {draft} then "), doc, F.lit(" done.")))
            .when(m == 2, F.translate(doc, '"', "'"))
            .otherwise(F.lit("I could not decide on a plan.")))
    return j.select("graph_id", "iteration", text.alias("text"))


ORACLE_CTES["turns"] = """
turns AS (
  SELECT conv_id, turn, role,
    CASE WHEN role = 'assistant' THEN 'Thinking.' || chr(10) ||
      CASE (conv_id + turn) % 4
        WHEN 0 THEN '<function=search><parameter=query>' || text || '</parameter>'
                    || CASE WHEN turn % 3 = 0 THEN '<parameter=query>' || text || ' again</parameter>' ELSE '' END
                    || '</function>'
        WHEN 1 THEN '<function=open_page><parameter=url>http://x.example/' || CAST(turn AS VARCHAR) || '</parameter></function>'
        WHEN 2 THEN '<function=recall><parameter=node_id>n' || CAST(turn AS VARCHAR) || '</parameter>'
                    || CASE WHEN turn % 3 <> 0 THEN '<parameter=goal>' || text || '</parameter>' ELSE '' END
                    || '</function>'
        ELSE '<function=finish><parameter=answer>' || text || '</parameter><parameter=explanation> because'
             || chr(10) || '</parameter>'
             || CASE WHEN turn % 2 = 0 THEN '<parameter=confidence>70%</parameter>' ELSE '' END || '</function>' END
      || CASE WHEN turn % 5 = 1 THEN chr(10) || '<function=search><parameter=query>more</parameter></function>' ELSE '' END
    ELSE text END AS text
  FROM conversations)"""

ORACLE_CTES["plans"] = """
plans AS (
  SELECT s.graph_id, s.iteration,
    CASE s.iteration % 4
      WHEN 0 THEN 'Plan:' || chr(10) || '```json' || chr(10) || doc || chr(10) || '```'
      WHEN 1 THEN 'Here is the plan {draft} then ' || doc || ' done.'
      WHEN 2 THEN replace(doc, '"', '''')
      ELSE 'I could not decide on a plan.' END AS text
  FROM (
    SELECT sp.graph_id, sp.iteration,
           '{"node_statuses": {' || coalesce(st.sts, '') || '}, "nodes": [' || sp.specs || ']}' AS doc
    FROM (SELECT graph_id, iteration,
                 string_agg('{"id": "' || spec_id || '", "description": "' || description || '"'
                            || CASE WHEN okey % 13 = 5 THEN '' ELSE ', "prompt": "' || prompt || '"' END
                            || CASE WHEN okey % 2 = 0 THEN ', "dependencies": ["n' || CAST(seq - 1 AS VARCHAR) || '", "n1"]' ELSE '' END
                            || '}', ', ' ORDER BY seq) AS specs
          FROM nodes GROUP BY graph_id, iteration) sp
    LEFT JOIN (SELECT graph_id, iteration + 1 AS iteration,
                      string_agg('"' || spec_id || '": "' || CASE WHEN status = '' THEN 'Pending' ELSE status END || '"',
                                 ', ' ORDER BY seq) AS sts
               FROM nodes WHERE spec_id <> '' GROUP BY graph_id, iteration) st
    USING (graph_id, iteration)) s)"""

ORACLE_DEPS.update({"turns": [], "plans": ["nodes"]})

# ---------------------------------------------------------------------------
# Logs of planners, executor runs and sessions
# ---------------------------------------------------------------------------


def planner_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log(conv_id, turn, role, text, error): assistant turns of conversations as
    planner replies -- usable, broken, without JSON, of a wrong shape, empty plan,
    missing, failed call -- and retry prompts after replies that cannot be parsed."""
    c = read_table(spark, sf_dir, "conversations")
    conv, turn, t = F.col("conv_id"), F.col("turn"), F.col("text")
    # every third conversation has only failing replies, so that plans use up their attempts
    kind = F.when(conv % 3 == 0, 1 + turn % 3).otherwise((conv * 5 + turn * 3) % 11)
    doc = F.concat(F.lit('{"node_statuses": {"n'), turn.cast("string"), F.lit('": "Success"}, "nodes": [{"id": "q", "description": "look at '),
                   F.length(t).cast("string"), F.lit('", "prompt": "p"}]}'))
    fence = lambda x: F.concat(F.lit("Plan:\n```json\n"), x, F.lit("\n```"))
    reply = (F.when(kind == 1, fence(F.lit('{"node_statuses": {"n1": "Success"}, "nodes": [}')))
             .when(kind == 2, t).when(kind == 3, fence(F.lit('{"node_statuses": [], "nodes": []}')))
             .when(kind == 9, fence(F.lit('{"node_statuses": {"x": "Maybe"}, "nodes": [{"description": "no prompt"}]}')))
             .when(kind == 10, fence(F.translate(doc, '"', "'"))).when(kind.isin(7, 8), F.lit(None).cast("string")).otherwise(fence(doc)))
    bot = F.col("role") == "assistant"
    before = F.lag(F.when(bot, kind)).over(Window.partitionBy("conv_id").orderBy("turn"))
    asked = F.when((F.col("role") == "user") & before.isin(1, 2, 3), F.concat(F.lit("[FORMAT WARNING] "), t)).otherwise(t)
    return c.select("conv_id", "turn", "role", F.when(bot, reply).otherwise(asked).alias("text"),
                    F.when(bot & (kind == 8), F.lit("connection reset")).alias("error"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log(run_id, us, event_id, kind): events of a user within three days as an executor run."""
    e = read_table(spark, sf_dir, "events")
    us = F.unix_micros(_utc(F.col("ts")))
    t, i = F.col("event_type"), F.col("event_id")
    kind = (F.when(t.isin("view", "click"), "turn").when(t == "signup", "empty")
            .when(t == "error", F.when(i % 4 == 0, "overflow").when(i % 4 == 1, "exception").otherwise("error"))
            .otherwise(F.when(i % 2 == 0, "finish").otherwise("turn")))
    return e.select((F.col("user_id") * 100000 + F.floor(us / (3 * 86_400_000_000))).alias("run_id"), us.alias("us"), "event_id", kind.alias("kind"))


def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log(user_id, us, event_id, kind, turns): a user's events as planner and batch events."""
    e = read_table(spark, sf_dir, "events")
    t, i = F.col("event_type"), F.col("event_id")
    kind = (F.when(t == "view", "plan").when(t == "click", "batch").when(t == "signup", "empty")
            .when(t == "error", F.when(i % 8 == 0, "context").when(i % 8 == 1, "exception").when(i % 8 == 2, "parse_error").otherwise("plan"))
            .otherwise(F.when(i % 6 == 0, "answer").otherwise("batch")))
    return e.select("user_id", F.unix_micros(_utc(F.col("ts"))).alias("us"), "event_id", kind.alias("kind"),
                    F.floor("value").cast("bigint").alias("turns"))


def _utc(c):
    """A naive wall-clock timestamp read as UTC."""
    return F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c), F.date_part(F.lit("SECOND"), c), F.lit("UTC"))


ORACLE_CTES["planner_log"] = """
plog0 AS (
  SELECT *, CASE WHEN conv_id % 3 = 0 THEN 1 + turn % 3 ELSE (conv_id * 5 + turn * 3) % 11 END AS kd,
         '{"node_statuses": {"n' || CAST(turn AS VARCHAR) || '": "Success"}, "nodes": [{"id": "q", "description": "look at '
         || CAST(length(text) AS VARCHAR) || '", "prompt": "p"}]}' AS doc
  FROM conversations),
planner_log AS (
  SELECT conv_id, turn, role,
    CASE WHEN role = 'assistant' THEN
      CASE kd WHEN 1 THEN 'Plan:' || chr(10) || '```json' || chr(10) || '{"node_statuses": {"n1": "Success"}, "nodes": [}' || chr(10) || '```'
              WHEN 2 THEN text
              WHEN 3 THEN 'Plan:' || chr(10) || '```json' || chr(10) || '{"node_statuses": [], "nodes": []}' || chr(10) || '```'
              WHEN 9 THEN 'Plan:' || chr(10) || '```json' || chr(10) || '{"node_statuses": {"x": "Maybe"}, "nodes": [{"description": "no prompt"}]}' || chr(10) || '```'
              WHEN 10 THEN 'Plan:' || chr(10) || '```json' || chr(10) || replace(doc, '"', '''') || chr(10) || '```'
              WHEN 7 THEN NULL WHEN 8 THEN NULL
              ELSE 'Plan:' || chr(10) || '```json' || chr(10) || doc || chr(10) || '```' END
         WHEN role = 'user' AND lag(CASE WHEN role = 'assistant' THEN kd END) OVER (PARTITION BY conv_id ORDER BY turn) IN (1, 2, 3)
         THEN '[FORMAT WARNING] ' || text ELSE text END AS text,
    CASE WHEN role = 'assistant' AND kd = 8 THEN 'connection reset' END AS error
  FROM plog0)"""

ORACLE_CTES["run_log"] = """
run_log AS (
  SELECT user_id * 100000 + CAST(floor(epoch_us(ts) / 259200000000.0) AS BIGINT) AS run_id, epoch_us(ts) AS us, event_id,
         CASE event_type WHEN 'view' THEN 'turn' WHEN 'click' THEN 'turn' WHEN 'signup' THEN 'empty'
              WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'overflow' WHEN 1 THEN 'exception' ELSE 'error' END
              ELSE CASE WHEN event_id % 2 = 0 THEN 'finish' ELSE 'turn' END END AS kind
  FROM events)"""

ORACLE_CTES["session_log"] = """
session_log AS (
  SELECT user_id, epoch_us(ts) AS us, event_id,
         CASE event_type WHEN 'view' THEN 'plan' WHEN 'click' THEN 'batch' WHEN 'signup' THEN 'empty'
              WHEN 'error' THEN CASE event_id % 8 WHEN 0 THEN 'context' WHEN 1 THEN 'exception' WHEN 2 THEN 'parse_error' ELSE 'plan' END
              ELSE CASE WHEN event_id % 6 = 0 THEN 'answer' ELSE 'batch' END END AS kind,
         CAST(floor(value) AS BIGINT) AS turns
  FROM events)"""

ORACLE_DEPS.update({"planner_log": [], "run_log": [], "session_log": []})


def dag_inputs(spark: SparkSession, sf_dir: str, raw: DataFrame | None = None):
    """(nodes with resolved ids, deps, verdicts) for the DAG queries, as plain
    plans: each query scans and shuffles only the columns it reads.  A query that
    reads most of them several times brings ``raw``, the stored nodes."""
    from credsight.operators.graph import resolve_ids
    raw = raw if raw is not None else dag_nodes(spark, sf_dir)
    return resolve_ids(raw), dag_deps(spark, sf_dir, raw), dag_verdicts(spark, sf_dir, raw)


#: what the rules read of a node
RULE_COLUMNS = ["graph_id", "seq", "iteration", "node_id", "exec_status", "description", "prompt"]


def rule_inputs(spark: SparkSession, sf_dir: str):
    """Inputs of the rule plans: nodes and verdicts, which several rules read,
    are narrowed and written once; so is what all inputs are derived from."""
    raw = stored(dag_nodes(spark, sf_dir).select("okey", "spec_id", "status", *[c for c in RULE_COLUMNS if c != "node_id"]), "rule-raw")
    n, d, v = dag_inputs(spark, sf_dir, raw)
    return (stored(n.select(*RULE_COLUMNS), "rule-nodes"), d.select("graph_id", "seq", "dep_pos", "dep_id"),
            stored(v.select("graph_id", "iteration", "node_id", "status"), "rule-verdicts"))
