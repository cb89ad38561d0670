"""Queries for evaluation rollups (G1-G6) and task-row shaping."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from credsight.functions.columns import r6, sql_mix_hash, sql_r6
from credsight.operators import evaluate as V
from credsight.plans.catalog import query
from credsight.session import checkpoint_dir
from credsight.sources.fixtures import eval_results, oracle_with, tasks
from credsight.sources.tables import read_table


@query("eval_overall", "G1,A6", oracle_with("evalres") + f"""
SELECT {sql_r6('avg(score)')} AS mean_score, count(*) FILTER (WHERE status = 'success') AS n_success,
       count(*) AS total FROM evalres""")
def q_eval_overall(spark, sf):
    return V.overall(eval_results(spark, sf)).select(r6(F.col("mean_score")).alias("mean_score"), "n_success", "total")


@query("eval_by_source", "G2", oracle_with("evalres") + f"""
SELECT data_source, {sql_r6('avg(score)')} AS mean_score, count(*) AS n FROM evalres GROUP BY data_source""")
def q_eval_by_source(spark, sf):
    return V.by_source(eval_results(spark, sf)).select("data_source", r6(F.col("mean_score")).alias("mean_score"), "n")


@query("eval_by_level", "G3", oracle_with("evalres") + f"""
SELECT level, {sql_r6('avg(score)')} AS mean_score, {sql_r6('avg(score) * 100.0::DOUBLE')} AS pct,
       CAST(trunc(sum(score)) AS BIGINT) AS correct, count(*) AS total
FROM evalres WHERE level IS NOT NULL GROUP BY level""")
def q_eval_by_level(spark, sf):
    return V.by_level(eval_results(spark, sf)).select(
        "level", r6(F.col("mean_score")).alias("mean_score"), r6(F.col("pct")).alias("pct"), "correct", "total")


@query("eval_grouping_sets", "G4", oracle_with("evalres") + f"""
SELECT CASE WHEN grouping(data_source) = 0 THEN 'source' WHEN grouping(level) = 0 THEN 'level' ELSE 'overall' END AS kind,
       data_source, level, {sql_r6('avg(score)')} AS mean_score, count(*) AS n,
       CAST(trunc(sum(score)) AS BIGINT) AS correct, count(*) FILTER (WHERE status = 'success') AS n_success
FROM evalres GROUP BY GROUPING SETS ((), (data_source), (level))
HAVING NOT (grouping(level) = 0 AND level IS NULL)""")
def q_eval_grouping_sets(spark, sf):
    s = V.summary_sets(eval_results(spark, sf))
    return s.select("kind", "data_source", "level", r6(F.col("mean_score")).alias("mean_score"), "n", "correct",
                    "n_success")


@query("eval_running_mean", "G5", oracle_with("evalres") + f"""
SELECT instance_id, workflow, seed,
       {sql_r6('avg(score) OVER (PARTITION BY workflow, seed ORDER BY finished_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS running_mean,
       count(*) OVER (PARTITION BY workflow, seed ORDER BY finished_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_done
FROM evalres""")
def q_eval_running_mean(spark, sf):
    r = V.running_mean(eval_results(spark, sf))
    return r.select("instance_id", "workflow", "seed", r6(F.col("running_mean")).alias("running_mean"),
                    F.col("_rank").alias("n_done"))


@query("eval_seed_compare", "G6", oracle_with("evalres") + f""",
per_run AS (SELECT workflow, seed, avg(score) AS run_mean FROM evalres GROUP BY workflow, seed),
across AS (SELECT workflow, avg(run_mean) AS mean_of_runs, stddev_samp(run_mean) AS std_of_runs, count(*) AS n_runs
           FROM per_run GROUP BY workflow),
cell AS (SELECT task_key, seed, workflow, avg(score) AS m FROM evalres GROUP BY task_key, seed, workflow),
paired AS (SELECT a.workflow, avg(a.m - b.m) AS paired_delta, count(*) AS n_pairs
           FROM cell a JOIN cell b ON a.task_key = b.task_key AND a.seed = b.seed AND a.workflow <> b.workflow
           GROUP BY a.workflow)
SELECT workflow, {sql_r6('mean_of_runs')} AS mean_of_runs, {sql_r6('std_of_runs')} AS std_of_runs, n_runs,
       {sql_r6('paired_delta')} AS paired_delta, n_pairs
FROM across LEFT JOIN paired USING (workflow)""")
def q_eval_seed_compare(spark, sf):
    s = V.seed_comparison(eval_results(spark, sf))
    return s.select("workflow", r6(F.col("mean_of_runs")).alias("mean_of_runs"),
                    r6(F.col("std_of_runs")).alias("std_of_runs"), "n_runs",
                    r6(F.col("paired_delta")).alias("paired_delta"), "n_pairs")


@query("eval_summary_json", "A7")
def q_eval_summary_json(spark, sf):
    """Rows-only: JSON number formatting differs between engines."""
    return V.summary_json(eval_results(spark, sf))


@query("eval_results_sink", "A7", oracle_with("evalres") + f"""
SELECT 'overall' AS kind, CAST(NULL AS VARCHAR) AS key, {sql_r6('avg(score)')} AS avg_score, count(*) AS n FROM evalres
UNION ALL SELECT 'source', data_source, {sql_r6('avg(score)')}, count(*) FROM evalres GROUP BY data_source
UNION ALL SELECT 'level', CAST(level AS VARCHAR), {sql_r6('avg(score)')}, count(*) FROM evalres WHERE level IS NOT NULL GROUP BY level
UNION ALL SELECT 'result ' || status, instance_id, {sql_r6('score')}, 1 FROM evalres""")
def q_eval_results_sink(spark, sf):
    """Written as JSON and read back: the summary's entries and every result."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/eval-results/{uuid.uuid4().hex}"
    V.write_results(eval_results(spark, sf), path)
    summary, detail = V.read_results(spark, path)
    null = F.lit(None).cast("string")
    rows = summary.select(F.lit("overall").alias("kind"), null.alias("key"), "avg_score").crossJoin(
        detail.agg(F.count(F.lit(1)).alias("n")))
    for kind, col in (("source", "by_source"), ("level", "by_level")):
        rows = rows.unionByName(summary.select(F.explode(col).alias("key", "v")).select(
            F.lit(kind).alias("kind"), "key", F.col("v.avg_score").alias("avg_score"), F.col("v.count").alias("n")))
    rows = rows.unionByName(detail.select(F.concat(F.lit("result "), "status").alias("kind"), F.col("instance_id").alias("key"),
                                          F.col("score").alias("avg_score"), F.lit(1).cast("bigint").alias("n")))
    return rows.withColumn("avg_score", r6(F.col("avg_score")))


@query("eval_result_record", "A6", """
SELECT 'inst-' || CAST(event_id AS VARCHAR) AS instance_id,
       CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE value END AS score,
       CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
       CASE WHEN event_id % 3 = 0 THEN 'turns' WHEN event_id % 2 = 0 THEN 'steps' END AS stat,
       CASE WHEN event_id % 3 = 0 OR event_id % 2 = 0 THEN user_id END AS stat_value
FROM events""")
def q_eval_result_record(spark, sf):
    e = read_table(spark, sf, "events")
    empty = F.create_map().cast("map<string,bigint>")
    uid = F.col("user_id").cast("bigint")
    runs = e.select(
        F.concat(F.lit("inst-"), F.col("event_id").cast("string")).alias("instance_id"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("score"),
        F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("turns"), uid)).otherwise(empty).alias("dag_stats"),
        F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("steps"), uid)).alias("env_stats"))
    r = V.result_record(runs)
    return r.select("instance_id", "score", "status", F.get(F.map_keys("stats"), 0).alias("stat"),
                    F.get(F.map_values("stats"), 0).alias("stat_value"))


# A: task rows ----------------------------------------------------------------

@query("task_items", "A1,A3,A5,A12", oracle_with("tasks") + """
SELECT row_idx, 'WebSearch' AS ability,
       coalesce(extra_info.instance_id, extra_info.task_id, CAST(extra_info.original_idx AS VARCHAR), 'unknown') AS instance_id,
       coalesce(data_source, extra_info.dataset, 'unknown') AS data_source,
       extra_info.level AS level,
       coalesce(uid, 'auto-' || CAST(row_idx AS VARCHAR)) AS uid
FROM tasks""")
def q_task_items(spark, sf):
    return V.build_items(tasks(spark, sf), benchmark="gaia")


@query("task_items_default", "A3,A5", oracle_with("tasks") + """
SELECT row_idx, ability,
       coalesce(extra_info.instance_id, extra_info.task_id, CAST(extra_info.original_idx AS VARCHAR), 'unknown') AS instance_id,
       coalesce(data_source, extra_info.dataset, 'unknown') AS data_source,
       extra_info.level AS level,
       coalesce(uid, 'auto-' || CAST(row_idx AS VARCHAR)) AS uid
FROM tasks""")
def q_task_items_default(spark, sf):
    return V.build_items(tasks(spark, sf), benchmark=None)


@query("task_limit", "A2", oracle_with("tasks") + """
SELECT row_idx, ability FROM tasks ORDER BY row_idx LIMIT 100""")
def q_task_limit(spark, sf):
    return V.limit_rows(tasks(spark, sf), 100).select("row_idx", "ability")


@query("eval_chunks", "A4", oracle_with("tasks") + """,
r AS (SELECT row_idx, row_number() OVER (ORDER BY row_idx) - 1 AS i, count(*) OVER () AS total FROM tasks),
c AS (SELECT row_idx, CASE WHEN total // 150 = 0 THEN 149 ELSE least(i // (total // 150), 149) END AS chunk FROM r)
SELECT chunk, count(*) AS n_rows, min(row_idx) AS first_row, max(row_idx) AS last_row FROM c GROUP BY chunk""")
def q_eval_chunks(spark, sf):
    c = V.chunk_ids(tasks(spark, sf).select("row_idx"), 150)
    return c.groupBy("chunk").agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_idx").alias("first_row"),
                                  F.max("row_idx").alias("last_row"))


@query("eval_chunks_ntile", "A4", oracle_with("tasks") + """,
c AS (SELECT row_idx, ntile(150) OVER (ORDER BY row_idx) - 1 AS chunk FROM tasks)
SELECT chunk, count(*) AS n_rows, min(row_idx) AS first_row, max(row_idx) AS last_row FROM c GROUP BY chunk""")
def q_eval_chunks_ntile(spark, sf):
    c = V.chunk_ids_ntile(tasks(spark, sf).select("row_idx"), 150)
    return c.groupBy("chunk").agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_idx").alias("first_row"),
                                  F.max("row_idx").alias("last_row"))


@query("prompt_filter", "A9", """
SELECT doc_id, lang, CAST(length(text) - length(replace(text, ' ', '')) + 1 AS BIGINT) AS n_tokens
FROM documents WHERE length(text) - length(replace(text, ' ', '')) + 1 <= 2048""")
def q_prompt_filter(spark, sf):
    docs = read_table(spark, sf, "documents")
    n = (F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit(""))) + 1).cast("bigint")
    return V.prompt_filter(docs, 2048, n).select("doc_id", "lang", "n_tokens")


@query("rollout_fanout", "A10", oracle_with("tasks") + """
SELECT row_idx, CAST(k AS BIGINT) AS sample_idx FROM tasks, range(0, 8) t(k)""")
def q_rollout_fanout(spark, sf):
    return V.fan_out(tasks(spark, sf).select("row_idx"), 8).select("row_idx", "sample_idx")


@query("train_batches", "A11", oracle_with("tasks") + f""",
h AS (SELECT row_idx, {sql_mix_hash('row_idx', 42)} AS hv FROM tasks),
r AS (SELECT row_idx, row_number() OVER (ORDER BY hv, row_idx) - 1 AS i FROM h)
SELECT row_idx, CAST(i // 32 AS BIGINT) AS batch_id, CAST(i // 16 AS BIGINT) AS minibatch_id FROM r""")
def q_train_batches(spark, sf):
    return V.shuffle_batches(tasks(spark, sf).select("row_idx"), "row_idx", seed=42).select(
        "row_idx", "batch_id", "minibatch_id")
