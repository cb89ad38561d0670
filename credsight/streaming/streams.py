"""Incremental versions of the rollout analytics on Structured Streaming
(keyed state with timers: ``stateful``).

Every stream reads files (the given parquet tables, or tables Spark derived
and wrote under ``spark.checkpoint.dir``), runs with ``availableNow`` so a
job processes exactly what has arrived and stops, and keeps its offsets and
state in a checkpoint location under the same shared folder -- a restarted
driver or a lost executor resumes from the last committed micro-batch.

Aggregates that change over time are written in ``update`` mode through
``foreachBatch`` as (key, value, batch_id) rows; the current answer is the
latest row per key (:func:`latest`).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credsight.session import STREAMS, checkpoint_dir, stored


def _area(spark: SparkSession, name: str, job: str | None = None) -> str:
    """Folder of a stream's offsets, state and output.  A caller that names its
    ``job`` gets the same folder again and so goes on where it stopped."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{STREAMS}/{name}-{job or uuid.uuid4().hex[:12]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return _area(spark, name) + "/data"


def _write_batch(batch: DataFrame, out: str, batch_id: int) -> None:
    """A micro-batch has a folder of its own; written again after a failure, it replaces itself."""
    batch.write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")


def _read_batches(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    fields = T.StructType([*schema.fields, T.StructField("_batch", T.LongType())])
    return spark.read.schema(fields).parquet(out)


def stream_table(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """File-source stream over a parquet path, with the schema taken from the files."""
    import os
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if os.path.basename(path.rstrip("/")).endswith(".parquet"):
        # a single-file table: the file source watches a folder, so name the
        # file through a one-file glob (new files matching it are picked up too)
        path = path.rstrip("/")
        path = f"{path[:-1]}[{path[-1]}]"
    return r.parquet(path)


def materialise(df: DataFrame, name: str, partitions: int | None = None) -> str:
    """Write a derived table into the shared folder so it can be streamed (and
    so the stream's lineage starts at files, not at a recomputation)."""
    path = _area(df.sparkSession, name) + "/data"
    (df.repartition(partitions) if partitions else df).write.mode("overwrite").parquet(path)
    return path


def run_append(sdf: DataFrame, name: str, job: str | None = None) -> DataFrame:
    """Run an append-mode stream to completion; return all that the job wrote."""
    spark = sdf.sparkSession
    area = _area(spark, name, job)
    q = (sdf.writeStream.format("parquet").option("path", f"{area}/out")
         .option("checkpointLocation", f"{area}/ckpt").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(sdf.schema).parquet(f"{area}/out")


def materialise_in_order(df: DataFrame, name: str, ts: str, parts: int = 6, files: int = 4, last: DataFrame | None = None) -> str:
    """Write a derived table as ``parts`` successive appends in the order of ``ts``, cut at
    its quantiles, so a file stream with ``max_files=files`` sees about one part a micro-batch.
    ``last``, a closing row, is appended at the end.  The table is derived once: the
    quantiles and the parts are read from a stored copy."""
    path = _area(df.sparkSession, name) + "/data"
    df = stored(df, name)
    # parts - 1 numbers, whatever the table's size
    at = F.unix_micros(ts)
    bounds = sorted(set(df.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []))
    for lo, hi in zip([None, *bounds], [*bounds, None]):
        part = df if lo is None else df.where(at > lo)
        (part if hi is None else part.where(at <= hi)).repartition(files).write.mode("append").parquet(path)
    if last is not None:
        last.write.mode("append").parquet(path)
    return path


def run_update(sdf: DataFrame, name: str, keys: list[str], job: str | None = None) -> DataFrame:
    """Run an update-mode stream to completion through ``foreachBatch``;
    return the latest value per key."""
    spark = sdf.sparkSession
    area = _area(spark, name, job)
    out = f"{area}/out"
    q = (sdf.writeStream.foreachBatch(lambda batch, batch_id: _write_batch(batch, out, batch_id))
         .option("checkpointLocation", f"{area}/ckpt")
         .outputMode("update").trigger(availableNow=True).start())
    q.awaitTermination()
    return latest(_read_batches(spark, out, sdf.schema), keys)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Current value per key from (key, value, _batch) upsert rows (an aggregate, no window)."""
    vals = [c for c in rows.columns if c not in keys and c != "_batch"]
    agg = rows.groupBy(*keys).agg(F.max_by(F.struct(*vals), "_batch").alias("_v"))
    return agg.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in vals])


# ---------------------------------------------------------------------------
# L1 running score per source, L2 windowed score with watermark
# ---------------------------------------------------------------------------


def utc_instant(c):
    """A naive wall-clock timestamp read as UTC, as an event-time TIMESTAMP.

    Watermarks need TIMESTAMP; a plain cast would read the wall clock in the
    session time zone, so window bounds would move with that setting.
    """
    return F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c),
                            F.date_part(F.lit("SECOND"), c), F.lit("UTC"))


def results_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation results arriving as the ``events`` files (same mapping as the batch view)."""
    e = stream_table(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    return e.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("data_source"),
        F.when(F.col("event_type") == "error", F.lit(0.0))
         .otherwise(F.least(F.lit(1.0), F.floor(F.col("value")).cast("double") / F.lit(32.0))).alias("score"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        utc_instant(F.col("ts")).alias("finished_at"), "user_id")


def running_by_source(res: DataFrame) -> DataFrame:
    """L1: running mean score and count per source."""
    return res.groupBy("data_source").agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n"))


def windowed_scores(res: DataFrame, window: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """L2: tumbling-window score and failure rate per source; rows later than
    the watermark are dropped and a window's state is evicted once the
    watermark passes its end."""
    w = res.withWatermark("finished_at", late)
    return (w.groupBy(F.window("finished_at", window).alias("w"), "data_source")
            .agg(F.avg("score").alias("mean_score"), F.avg((F.col("status") == "failed").cast("double"))
                 .alias("failure_rate"), F.count(F.lit(1)).alias("n"))
            .select(F.unix_seconds(F.col("w.start")).alias("window_start_s"), "data_source", "mean_score",
                    "failure_rate", "n"))


# ---------------------------------------------------------------------------
# L3 de-duplication, L6 session timeout, L7 stream-static join
# ---------------------------------------------------------------------------


def dedup_within_watermark(events: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """L3: first arrival per key wins; state per key expires with the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int = 5400) -> DataFrame:
    """Session windows that end after 5400 s without an event, over a stream with a
    watermark on ``ts`` (the deadline counted from the first event is L6 in ``stateful``)."""
    return (events.groupBy(key, F.session_window(ts, f"{gap_seconds} seconds").alias("s"))
            .agg(F.count(F.lit(1)).alias("n_events"))
            .select(key, F.unix_micros(F.col("s.start")).alias("session_start_us"),
                    F.unix_micros(F.col("s.end")).alias("session_end_us"), "n_events"))


class VersionedTable:
    """Rows stored version by version below a folder; a reader names the version it wants."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.fields = spark, path.rstrip("/"), T._parse_datatype_string(schema)

    def version(self) -> int:
        """The latest complete version, 0 before the first."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(conf)
        done, v = 0, 1
        while fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={v}/_SUCCESS")):
            done, v = v, v + 1
        return done

    def append(self, rows: DataFrame) -> int:
        v = self.version() + 1
        rows.select(*self.fields.names).write.mode("overwrite").parquet(f"{self.path}/v={v}")
        return v

    def read(self, version: int) -> DataFrame:
        """All rows of versions up to ``version``, with their version ``v``; later folders are not listed."""
        if version == 0:
            return self.spark.createDataFrame([], T.StructType([*self.fields.fields, T.StructField("v", T.IntegerType())]))
        return (self.spark.read.schema(self.fields).option("basePath", self.path)
                .parquet(*[f"{self.path}/v={k}" for k in range(1, version + 1)]).withColumn("v", F.col("v").cast("int")))


def versioned_lookup(deps: DataFrame, nodes: VersionedTable, name: str, job: str | None = None) -> DataFrame:
    """Arriving dependency rows (graph_id, dep_id, ..) joined with the nodes stored
    when their micro-batch began.  The version is written down before the join, so a
    micro-batch that runs again after a failure sees the same nodes; only the keys of
    the graphs it touches are read.  -> the rows with found and version (of the lookup)."""
    spark = deps.sparkSession
    area = _area(spark, name, job)
    pins = VersionedTable(spark, f"{area}/pins", "pinned int")

    def sink(batch: DataFrame, batch_id: int) -> None:
        # one pin per micro-batch, in order
        if pins.version() <= batch_id:
            pins.append(spark.createDataFrame([(nodes.version(),)], "pinned int"))
        at = pins.read(batch_id + 1).where(F.col("v") == batch_id + 1).first()["pinned"]
        graphs = batch.select("graph_id").distinct()
        hit = (nodes.read(at).select("graph_id", F.col("node_id").alias("dep_id")).join(graphs, "graph_id", "left_semi")
               .distinct().withColumn("found", F.lit(True)))
        out = batch.join(hit, ["graph_id", "dep_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
        _write_batch(out.withColumn("version", F.lit(at)), f"{area}/out", batch_id)

    q = (deps.writeStream.foreachBatch(sink).option("checkpointLocation", f"{area}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    fields = T.StructType([*deps.schema.fields, T.StructField("found", T.BooleanType()), T.StructField("version", T.IntegerType())])
    return _read_batches(spark, f"{area}/out", fields)


# ---------------------------------------------------------------------------
# L5 group-complete credit (with a deadline: ``stateful``)
# ---------------------------------------------------------------------------


def group_complete_stats(traj_stream: DataFrame, expected: DataFrame, name: str, job: str | None = None,
                         incomplete: bool = False) -> DataFrame:
    """Per-group count, mean and sample deviation as a built-in streaming
    aggregation (map-side partial with mergeable centred moments, so a hot
    group is pre-combined and the variance does not cancel).

    A group counts once all of its expected rollouts have arrived; at the end
    of a run, ``incomplete=True`` (the timeout of a closing job) also returns
    the groups still waiting, with the statistics of what came.
    ``expected(uid, g_expected)``.  -> (uid, g_n, g_mean, g_std, complete) with
    the singleton rule (mean 0, std 1)."""
    agg = traj_stream.groupBy("uid").agg(F.count(F.lit(1)).alias("g_n"), F.avg("score").alias("m"),
                                         F.stddev_samp("score").alias("s"))
    r = run_update(agg, name, ["uid"], job)
    j = r.join(expected, "uid", "left").withColumn("complete", F.coalesce(F.col("g_n") >= F.col("g_expected"), F.lit(False)))
    one = F.col("g_n") == 1
    return (j if incomplete else j.where("complete")).select(
        "uid", "g_n", F.when(one, F.lit(0.0)).otherwise(F.col("m")).alias("g_mean"),
        F.when(one, F.lit(1.0)).otherwise(F.col("s")).alias("g_std"), "complete")
