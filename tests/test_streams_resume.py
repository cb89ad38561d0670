"""A named job goes on where it stopped; a batch written twice counts once; late and waiting rows."""

import uuid

from pyspark.sql import functions as F

from credsight.streaming import streams as S


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_a_named_job_resumes(spark, tmp_path):
    path, job = f"{tmp_path}/in", uuid.uuid4().hex
    schema = "data_source string, score double"
    feed(spark, path, [("a", 1.0), ("a", 0.0), ("b", 1.0)], schema)
    run = lambda: {r.data_source: (r.mean_score, r.n) for r in S.run_update(
        S.running_by_source(S.stream_table(spark, path)), "t-resume", ["data_source"], job).collect()}
    assert run() == {"a": (0.5, 2), "b": (1.0, 1)}
    feed(spark, path, [("a", 1.0), ("c", 0.0)], schema)
    assert run() == {"a": (2 / 3, 3), "b": (1.0, 1), "c": (0.0, 1)}       # the first rows were not read again
    assert run() == {"a": (2 / 3, 3), "b": (1.0, 1), "c": (0.0, 1)}


def test_a_batch_written_twice_replaces_itself(spark, tmp_path):
    out = f"{tmp_path}/out"
    d = spark.range(3)
    for _ in range(2):
        S._write_batch(d, out, 0)
    S._write_batch(d, out, 1)
    assert S._read_batches(spark, out, d.schema).groupBy("_batch").count().orderBy("_batch").collect() == [(0, 3), (1, 3)]


def test_groups_that_wait_are_returned_on_request(spark, tmp_path):
    path = f"{tmp_path}/traj"
    feed(spark, path, [("g", 1e8 + 1.0), ("h", 2.0)], "uid string, score double")
    feed(spark, path, [("g", 1e8 + 3.0)], "uid string, score double")
    want = spark.createDataFrame([("g", 2), ("h", 2)], "uid string, g_expected long")
    run = lambda **k: {r.uid: r for r in S.group_complete_stats(
        S.stream_table(spark, path, max_files=1), want, "t-wait", **k).collect()}
    done = run()
    assert set(done) == {"g"} and abs(done["g"].g_std - 2 ** 0.5) < 1e-6      # squares of 1e8 would have cancelled
    both = run(incomplete=True)
    assert {u: r.complete for u, r in both.items()} == {"g": True, "h": False}
    assert (both["h"].g_mean, both["h"].g_std) == (0.0, 1.0)


def test_deduplication_over_several_batches(spark, tmp_path):
    path = f"{tmp_path}/ev"
    schema = "user_id long, event_type string, ts timestamp, event_id long"
    t = lambda h: spark.sql(f"select timestamp'2024-01-01 00:00:00' + interval {h} hours as t").first().t
    for batch in ([(1, "x", t(0), 10)], [(1, "x", t(0), 11), (2, "y", t(5), 12)], [(3, "z", t(8), 13)], [(1, "x", t(9), 14)]):
        feed(spark, path, batch, schema)
    ev = S.stream_table(spark, path, max_files=1)
    got = S.run_append(S.dedup_within_watermark(ev, ["user_id", "event_type"], "ts", "1 hour"), "t-dedup")
    # 11 repeats 10 within the hour; 14 comes when the state of 10 has expired, so it is kept again
    assert sorted(r.event_id for r in got.select(F.col("event_id")).collect()) == [10, 12, 13, 14]
