"""Streams with timers: what waits, what is late, what a stopped job goes on with."""

import uuid

import pytest
from pyspark.sql import functions as F

from credsight.streaming import stateful as K
from credsight.streaming import streams as S

SCHEMA = "uid string, traj_id long, ts timestamp, score double, planner boolean, dummy boolean, gen string, violations long"
HOUR, START = 3600, 1000


def feed(spark, path, rows, schema=SCHEMA):
    """One file: rows as (.., hours, ..) with the hour in place of the time."""
    names = [c.split()[0] for c in schema.split(", ")]
    raw = schema.replace("ts timestamp", "ts long")
    d = spark.createDataFrame(rows, raw).withColumn("ts", F.timestamp_seconds((F.col("ts") + START) * HOUR)).select(*names)
    d.coalesce(1).write.mode("append").parquet(path)
    return d


def close(spark, path, like):
    K.closing_row(like, "ts").write.mode("append").parquet(path)


def rollouts(spark, path):
    return K.timed(S.stream_table(spark, path, max_files=1), "ts", "0 seconds")


def r(uid, k, hour, score, planner=False, dummy=False, gen=None, violations=0):
    return (uid, k, hour, score, planner, dummy, gen, violations)


def credit(spark, path, job=None, penalty=None, size=3):
    out = K.run_stateful(K.group_credit(rollouts(spark, path), ["uid"], size, 10 * HOUR, 5 * HOUR, penalty), "t-credit", job)
    return {x.traj_id: (x.state, x.g_n, None if x.adv is None else round(x.adv, 5)) for x in out.collect()}


def test_complete_late_and_missing_rollouts(spark, tmp_path):
    path = f"{tmp_path}/in"
    d = feed(spark, path, [r("a", 1, 0, 1.0), r("b", 2, 0, 5.0)])
    feed(spark, path, [r("a", 3, 2, 3.0), r("c", 9, 1, 7.0)])
    feed(spark, path, [r("a", 4, 3, 2.0), r("a", 5, 4, 9.0), r("b", 6, 9, 7.0)])     # 5 is the fourth of three: late
    feed(spark, path, [r("b", 7, 12, 1.0), r("a", 8, 20, 4.0)])                        # 7 after b's deadline; 8 opens a's next round
    close(spark, path, d)
    got = credit(spark, path)
    assert {k: v[:2] for k, v in got.items()} == {
        1: ("complete", 3), 3: ("complete", 3), 4: ("complete", 3), 5: ("late", None), 8: ("timeout", 1),
        2: ("timeout", 2), 6: ("timeout", 2), 7: ("late", None), 9: ("timeout", 1)}
    assert (got[1][2], got[3][2], got[4][2]) == (-1.0, 1.0, 0.0) and got[9][2] == round(7 / (1 + 1e-6), 5)
    assert got[2][2] == -got[6][2] and got[5][2] is None


def test_a_stopped_job_goes_on(spark, tmp_path):
    path, job = f"{tmp_path}/in", uuid.uuid4().hex
    d = feed(spark, path, [r("a", 1, 0, 1.0), r("b", 2, 0, 5.0)])
    assert credit(spark, path, job) == {}                       # nothing is decided yet
    feed(spark, path, [r("a", 3, 1, 3.0), r("a", 4, 2, 2.0)])
    feed(spark, path, [r("z", 5, 5, 0.0)])
    assert set(credit(spark, path, job)) == {1, 3, 4}           # a is complete; b waits in state
    close(spark, path, d)
    got = credit(spark, path, job)
    assert set(got) == {1, 2, 3, 4, 5} and got[2][:2] == ("timeout", 1)
    assert credit(spark, path, job) == got


def test_order_of_arrival_does_not_matter(spark, tmp_path):
    rows = [r("a", k, h, float(k * k)) for k, h in enumerate([0, 3, 1, 2, 9, 11, 30, 31])]
    seen = []
    for order in (range(8), [5, 3, 7, 1, 0, 6, 2, 4]):
        path = f"{tmp_path}/{uuid.uuid4().hex}"
        for i in order:
            d = feed(spark, path, [rows[i]])
        close(spark, path, d)
        st = K.timed(S.stream_table(spark, path, max_files=3), "ts", "100 hours")
        out = K.run_stateful(K.group_credit(st, ["uid"], 3, 10 * HOUR, 5 * HOUR), "t-order")
        seen.append(sorted(map(tuple, out.collect()), key=repr))
    assert seen[0] == seen[1]
    assert {x[0]: x[1] for x in seen[0]} == {0: "complete", 2: "complete", 3: "complete", 1: "late", 4: "timeout", 5: "timeout",
                                             6: "timeout", 7: "timeout"}


def test_role_credit(spark, tmp_path):
    path = f"{tmp_path}/in"
    d = feed(spark, path, [r("a", 1, 0, 2.0, True, gen="g", violations=9), r("a", 2, 0, 9.0, True, gen="g"),
                           r("a", 3, 1, 4.0, True, gen="h"), r("a", 4, 1, 5.0, True, True, gen="i")])
    close(spark, path, d)
    got = credit(spark, path, penalty=(0.5, 2), size=4)
    # scores 1.0 (two violations count), 9.0 (repeats g, not counted), 4.0; 4 is a dummy
    mean, std = 2.5, (1.5 ** 2 * 2) ** 0.5
    assert [got[k][2] for k in (1, 2, 3, 4)] == [*(round((s - mean) / (std + 1e-6), 5) for s in (1.0, 9.0, 4.0)), 0.0]


EVENTS = "user_id long, event_id long, ts timestamp"


def test_sessions_end_by_their_deadline(spark, tmp_path):
    path = f"{tmp_path}/in"
    d = feed(spark, path, [(1, 1, 0), (2, 2, 0)], EVENTS)
    for k, h in enumerate([1, 2, 3, 4, 5]):                     # activity does not put the end off
        feed(spark, path, [(1, 10 + k, h)], EVENTS)
    close(spark, path, d)
    out = K.run_stateful(K.deadline_sessions(K.timed(S.stream_table(spark, path, max_files=1), "ts", "0 seconds"),
                                             "user_id", "event_id", 2 * HOUR), "t-deadline")
    h, o = HOUR * 1_000_000, START * HOUR * 1_000_000
    assert sorted(map(tuple, out.collect())) == [
        (1, o, o + 2 * h, o + 2 * h, 3), (1, o + 3 * h, o + 5 * h, o + 5 * h, 3), (2, o, o + 2 * h, o, 1)]


def test_first_event_of_a_window_stays(spark, tmp_path):
    path = f"{tmp_path}/in"
    d = feed(spark, path, [(1, 1, 0), (1, 2, 0), (2, 3, 1)], EVENTS)
    feed(spark, path, [(1, 4, 2), (2, 5, 4)], EVENTS)
    feed(spark, path, [(1, 6, 3), (1, 7, 5), (1, 8, 6)], EVENTS)
    close(spark, path, d)
    out = K.run_stateful(K.first_per_window(K.timed(S.stream_table(spark, path, max_files=1), "ts", "0 seconds"),
                                            ["user_id"], "event_id", 2 * HOUR), "t-first")
    assert sorted(x.event_id for x in out.collect()) == [1, 3, 5, 6, 8]


def test_late_steps_are_replayed_in_order(spark, tmp_path):
    path, schema = f"{tmp_path}/steps", "run_id string, step long, ts timestamp, kl double, n long"
    d = feed(spark, path, [("a", 2, 2, 1.0, 10), ("b", 1, 1, 0.0, 10)], schema)
    feed(spark, path, [("a", 1, 1, 0.0, 10), ("a", 3, 3, 1.0, 10)], schema)
    close(spark, path, d)
    st = K.timed(S.stream_table(spark, path, max_files=1), "ts", "24 hours")
    got = {(x.run_id, x.step): round(x.kl_coef, 9) for x in K.run_stateful(K.adaptive_kl_in_order(st, 1.0, 0.02, 10), "t-late").collect()}
    assert got == {("a", 1): 0.8, ("a", 2): 0.96, ("a", 3): 1.152, ("b", 1): 0.8}     # every value, not only the last


def test_the_state_provider_is_put_back(spark, tmp_path):
    before = spark.conf.get(K.PROVIDER, None)
    path = f"{tmp_path}/in"
    feed(spark, path, [(1, 1, 0)], EVENTS)
    with pytest.raises(Exception):
        K.run_stateful(S.stream_table(spark, path).select(F.raise_error(F.lit("no"))), "t-fail")
    assert spark.conf.get(K.PROVIDER, None) == before


def test_validation_goes_on_after_a_stop(spark, tmp_path):
    from credsight.operators import rules as R
    from credsight.sources.fixtures import rule_inputs
    n, d, v = rule_inputs(spark, "/root/testdata/sf0.001")
    few = "graph_id % 9 = 0"
    n, d, v = n.where(few), d.where(few), v.where(few)
    want = sorted((map(tuple, R.violations(n, d, v).select("graph_id", "iteration", "rule", "node_id", "message").collect())), key=repr)
    assert len({w[2] for w in want}) >= 5
    p = K.plan_messages(n, d, v).withColumn("ts", F.timestamp_seconds("iteration")).cache()
    path, job, seen = f"{tmp_path}/plans", uuid.uuid4().hex, 0
    run = lambda: sorted(map(tuple, K.run_stateful(K.validate_plans(K.timed(
        S.stream_table(spark, path), "ts", "1 second")), "t-l8", job).collect()), key=repr)
    for part in (p.where("iteration <= 2"), p.where("iteration = 4 OR iteration = 3"), p.where("iteration > 4"), K.closing_row(p, "ts")):
        part.coalesce(1).write.mode("append").parquet(path)
        got = run()
        assert len(got) >= seen and set(got) <= set(want)
        seen = len(got)
    assert got == want


def test_a_node_stored_between_batches_is_found_from_then_on(spark, tmp_path):
    table = S.VersionedTable(spark, f"{tmp_path}/nodes", "graph_id long, node_id string")
    path, job = f"{tmp_path}/deps", uuid.uuid4().hex
    schema = "graph_id long, seq long, dep_id string"
    put = lambda rows, to, s: spark.createDataFrame(rows, s).coalesce(1).write.mode("append").parquet(to)
    run = lambda: {r.seq: (r.found, r.version) for r in S.versioned_lookup(
        S.stream_table(spark, path), table, "t-l7", job).collect()}
    put([(1, 1, "a"), (1, 2, "b")], path, schema)
    assert table.version() == 0 and run() == {1: (False, 0), 2: (False, 0)}
    assert table.append(spark.createDataFrame([(1, "a"), (2, "b")], "graph_id long, node_id string")) == 1
    put([(1, 3, "a"), (1, 4, "b")], path, schema)
    assert run() == {1: (False, 0), 2: (False, 0), 3: (True, 1), 4: (False, 1)}
    table.append(spark.createDataFrame([(1, "b"), (1, "a")], "graph_id long, node_id string"))
    put([(1, 5, "b"), (1, 6, "a"), (2, 7, "b")], path, schema)
    assert run() == {1: (False, 0), 2: (False, 0), 3: (True, 1), 4: (False, 1), 5: (True, 2), 6: (True, 2), 7: (True, 2)}


def test_a_batch_that_runs_again_sees_the_same_version(spark, tmp_path, monkeypatch):
    table = S.VersionedTable(spark, f"{tmp_path}/nodes", "graph_id long, node_id string")
    path, job = f"{tmp_path}/deps", uuid.uuid4().hex
    spark.createDataFrame([(1, 1, "a")], "graph_id long, seq long, dep_id string").write.parquet(path)
    write = S._write_batch

    def fail(*a):
        raise RuntimeError("lost")

    monkeypatch.setattr(S, "_write_batch", fail)
    with pytest.raises(Exception, match="lost"):
        S.versioned_lookup(S.stream_table(spark, path), table, "t-again", job)
    monkeypatch.setattr(S, "_write_batch", write)
    table.append(spark.createDataFrame([(1, "a")], "graph_id long, node_id string"))
    assert [(r.found, r.version) for r in S.versioned_lookup(S.stream_table(spark, path), table, "t-again", job).collect()] == [(False, 0)]
