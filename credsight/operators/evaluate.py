"""A1-A12 (task rows, result records, training-set shaping) and G1-G6
(evaluation rollups)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsight.functions.columns import mix_hash
from credsight.functions.ordering import running_sums

# Benchmarks whose ability is forced to web search (A3).
WEB_SEARCH_BENCHMARKS = ["gaia", "xbench"]


# ---------------------------------------------------------------------------
# A: task rows
# ---------------------------------------------------------------------------


def limit_rows(df: DataFrame, n: int | None, order: str = "row_idx") -> DataFrame:
    """A2: first n rows in explicit order; ignored when n is None or <= 0."""
    if n is None or n <= 0:
        return df
    return df.orderBy(order).limit(n)


def override_ability(df: DataFrame, benchmark: str | None) -> DataFrame:
    """A3: gaia / xbench force ability = 'WebSearch' on every row."""
    return df.withColumn("ability", F.when(F.lit(benchmark).isin(*WEB_SEARCH_BENCHMARKS), F.lit("WebSearch"))
                         .otherwise(F.col("ability")))


def instance_id(extra: Column) -> Column:
    """A5: instance_id -> task_id -> str(original_idx) -> 'unknown'.

    Struct fields cannot tell a missing key from a null value; both fall
    through here (the reference returns None for a present-but-null key).
    """
    return F.coalesce(extra["instance_id"], extra["task_id"], extra["original_idx"].cast("string"), F.lit("unknown"))


def data_source(row_source: Column, extra: Column) -> Column:
    """A5: data_source -> extra_info.dataset -> 'unknown'."""
    return F.coalesce(row_source, extra["dataset"], F.lit("unknown"))


def build_items(tasks: DataFrame, benchmark: str | None = None) -> DataFrame:
    """A3 + A5 + A12: one work item per task row; uid defaults to a
    deterministic id derived from the row."""
    t = override_ability(tasks, benchmark)
    e = F.col("extra_info")
    return t.select(
        "row_idx", "ability",
        instance_id(e).alias("instance_id"),
        data_source(F.col("data_source"), e).alias("data_source"),
        e["level"].alias("level"),
        F.coalesce(F.col("uid"), F.concat(F.lit("auto-"), F.col("row_idx").cast("string"))).alias("uid"),
    )


def chunk_ids(df: DataFrame, num_workers: int, order: str = "row_idx") -> DataFrame:
    """A4: even chunking, last chunk takes the remainder.  With fewer rows than
    workers the chunk size is 0 and the last worker gets everything."""
    total = df.count()  # one scalar; it fixes the chunk size
    size = total // num_workers
    r = running_sums(df, [order])
    i = F.col("_rank") - 1
    cid = F.lit(num_workers - 1) if size == 0 else F.least(F.floor(i / F.lit(size)), F.lit(num_workers - 1))
    return r.withColumn("chunk", cid.cast("bigint")).drop("_rank")


def chunk_ids_ntile(df: DataFrame, num_workers: int, order: str = "row_idx") -> DataFrame:
    """A4 fixed variant: balanced chunks whose sizes differ by at most one."""
    total = df.count()
    r = running_sums(df, [order])
    # ntile semantics: the first (total % n) chunks get one extra row
    q, rem = divmod(total, num_workers)
    i = F.col("_rank") - 1
    big = F.lit(rem * (q + 1))
    cid = F.when(i < big, F.floor(i / F.lit(max(q + 1, 1)))).otherwise(
        F.lit(rem) + F.floor((i - big) / F.lit(max(q, 1))))
    return r.withColumn("chunk", cid.cast("bigint")).drop("_rank")


def prompt_filter(docs: DataFrame, max_len: int, n_tokens: Column) -> DataFrame:
    """Drop prompts longer than ``max_len`` tokens."""
    return docs.withColumn("n_tokens", n_tokens).filter(F.col("n_tokens") <= F.lit(max_len))


def fan_out(df: DataFrame, n: int) -> DataFrame:
    """A10: n rollout samples per prompt."""
    return (df.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            .withColumn("sample_idx", F.col("sample_idx").cast("bigint")))


def shuffle_batches(df: DataFrame, key: str, seed: int, batch: int = 32, minibatch: int = 16) -> DataFrame:
    """Seeded shuffle, then batch and minibatch ids in shuffled order."""
    h = df.withColumn("_h", mix_hash(F.col(key), seed))
    r = running_sums(h, ["_h", key])
    return r.select(*df.columns,
                    ((F.col("_rank") - 1) / F.lit(batch)).cast("bigint").alias("batch_id"),
                    ((F.col("_rank") - 1) / F.lit(minibatch)).cast("bigint").alias("minibatch_id"))


# ---------------------------------------------------------------------------
# G: evaluation rollups over results(instance_id, data_source, level, score, status, ...)
# ---------------------------------------------------------------------------


def overall(res: DataFrame) -> DataFrame:
    """G1."""
    return res.agg(F.avg("score").alias("mean_score"),
                   F.count_if(F.col("status") == "success").alias("n_success"),
                   F.count(F.lit(1)).alias("total"))


def by_source(res: DataFrame) -> DataFrame:
    """G2 (sorted by source)."""
    return (res.groupBy("data_source").agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n"))
            .orderBy("data_source"))


def by_level(res: DataFrame) -> DataFrame:
    """Null level excluded; ``correct`` is int(sum) (truncation)."""
    return (res.filter(F.col("level").isNotNull()).groupBy("level")
            .agg(F.avg("score").alias("mean_score"),
                 (F.avg("score") * F.lit(100.0)).alias("pct"),
                 F.sum("score").cast("bigint").alias("correct"),
                 F.count(F.lit(1)).alias("total"))
            .orderBy("level"))


def summary_sets(res: DataFrame) -> DataFrame:
    """All three summaries in one pass with GROUPING SETS (one scan, Expand)."""
    return res.sparkSession.sql("""
        SELECT CASE WHEN grouping(data_source) = 0 THEN 'source'
                    WHEN grouping(level) = 0 THEN 'level' ELSE 'overall' END AS kind,
               data_source, level,
               avg(score) AS mean_score, CAST(count(*) AS BIGINT) AS n,
               CAST(sum(score) AS BIGINT) AS correct,
               CAST(count_if(status = 'success') AS BIGINT) AS n_success
        FROM {res}
        GROUP BY GROUPING SETS ((), (data_source), (level))
        HAVING NOT (grouping(level) = 0 AND level IS NULL)""", res=res)


def running_mean(res: DataFrame, by=("workflow", "seed"), order=("finished_at", "seq")) -> DataFrame:
    """Running mean score in completion order, per run, via distributed prefix sums."""
    r = running_sums(res, list(order), list(by), ["score"])
    return r.withColumn("running_mean", F.col("_cum_score") / F.col("_rank").cast("double"))


def seed_comparison(res: DataFrame) -> DataFrame:
    """Per workflow mean / std across seed runs, and the paired difference
    to the other workflow on the same (task, seed)."""
    per_run = res.groupBy("workflow", "seed").agg(F.avg("score").alias("run_mean"))
    across = per_run.groupBy("workflow").agg(F.avg("run_mean").alias("mean_of_runs"),
                                             F.stddev_samp("run_mean").alias("std_of_runs"),
                                             F.count(F.lit(1)).alias("n_runs"))
    cell = res.groupBy("task_key", "seed", "workflow").agg(F.avg("score").alias("m"))
    a, b = cell.alias("a"), cell.alias("b")
    paired = (a.join(b, (F.col("a.task_key") == F.col("b.task_key")) & (F.col("a.seed") == F.col("b.seed"))
                     & (F.col("a.workflow") != F.col("b.workflow")))
              .groupBy(F.col("a.workflow").alias("workflow"))
              .agg(F.avg(F.col("a.m") - F.col("b.m")).alias("paired_delta"),
                   F.count(F.lit(1)).alias("n_pairs")))
    return across.join(paired, "workflow", "left")


def summary_json(res: DataFrame) -> DataFrame:
    """The written summary as one JSON document (overall, by source, by level)."""
    ov = overall(res).select(F.struct("*").alias("overall"))
    src = by_source(res).agg(F.sort_array(F.collect_list(F.struct("data_source", "mean_score", "n"))).alias("by_source"))
    lvl = by_level(res).agg(F.sort_array(F.collect_list(F.struct("level", "mean_score", "pct", "correct", "total")))
                            .alias("by_level"))
    return ov.crossJoin(src).crossJoin(lvl).select(F.to_json(F.struct("overall", "by_source", "by_level")).alias("summary"))


def result_record(runs: DataFrame, score: str = "score", stats: tuple[str, ...] = ("dag_stats", "env_stats")) -> DataFrame:
    """A run's record: score 0 and status failed without output (a null
    ``score`` column), stats the first of the map columns that has an entry."""
    some = [F.when(F.size(F.coalesce(F.col(c), F.create_map().cast("map<string,bigint>"))) > 0, F.col(c)) for c in stats]
    return runs.select(
        *[c for c in runs.columns if c not in (score, "status", *stats)],
        F.coalesce(F.col(score), F.lit(0.0)).alias("score"),
        F.when(F.col(score).isNull(), "failed").otherwise("success").alias("status"),
        F.coalesce(*some, F.create_map().cast("map<string,bigint>")).alias("stats"))


def write_results(res: DataFrame, path: str, detail: tuple[str, ...] = ("instance_id", "data_source", "level", "score", "status")) -> None:
    """The detail as JSON lines, written in parallel, and beside it the
    summary document (avg_score, by_source, by_level)."""
    def part(key: str, rows: DataFrame):
        g = rows.groupBy(F.col(key).cast("string").alias("k")).agg(F.avg("score").alias("avg_score"), F.count(F.lit(1)).alias("count"))
        entry = F.struct("k", F.struct("avg_score", "count").alias("v"))
        return g.agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias(f"by_{key}"))

    res.select(*detail).write.mode("overwrite").json(f"{path}/results")
    doc = (res.agg(F.avg("score").alias("avg_score"))
           .crossJoin(part("data_source", res).withColumnRenamed("by_data_source", "by_source"))
           .crossJoin(part("level", res.where(F.col("level").isNotNull()))))
    doc.write.mode("overwrite").json(f"{path}/summary")


def read_results(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(summary, detail) as written by :func:`write_results`."""
    group = "map<string,struct<avg_score:double,count:bigint>>"
    summary = spark.read.schema(f"avg_score double, by_source {group}, by_level {group}").json(f"{path}/summary")
    detail = spark.read.schema("instance_id string, data_source string, level bigint, score double, status string").json(f"{path}/results")
    return summary, detail
