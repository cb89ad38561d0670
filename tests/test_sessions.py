"""Attempts, executor runs and sessions on hand-made logs."""

from pyspark.sql import functions as F

from credsight.functions import text as X
from credsight.operators import metrics as M
from credsight.operators import sessions as S

OK = 'so\n```json\n{"node_statuses": {"a": "Success"}, "nodes": []}\n```'
LOG = "conv_id long, turn long, role string, text string, error string"


def outcomes(spark, rows, limit=10_000, min_out=10):
    """Rows of (conv, role letter, text, error); turns are numbered."""
    turn, data = {}, []
    for c, role, text, *err in rows:
        turn[c] = turn.get(c, -1) + 1
        data.append((c, turn[c], {"u": "user", "a": "assistant", "s": "system"}[role], text, err[0] if err else None))
    t = S.planner_attempts(spark.createDataFrame(data, LOG), limit, min_out)
    return sorted((r.conv_id, r.plan_no, r.first_turn, r.attempts, r.warnings, r.outcome) for r in S.retry_outcomes(t).collect())


def test_outcomes_of_plans(spark):
    warn = ("u", "[FORMAT WARNING] again")
    rows = [(1, "s", "sys"), (1, "u", "go"), (1, "a", "no json"), (1, *warn), (1, "a", OK), (1, "u", "next"), (1, "a", None),
            (2, "u", "go"), *[x for _ in range(4) for x in ((2, "a", "none"), (2, *warn))], (2, "a", "fifth"),
            (3, "a", OK), (3, "a", None, "boom"), (3, "u", "p"), (3, "u", "q"), (3, "a", '```json\n{"node_statuses": {}, "nodes": []}\n```')]
    assert outcomes(spark, rows) == [
        (1, 1, 1, 2, 1, "ok"), (1, 2, 5, 1, 0, "llm_no_response"),
        (2, 1, 0, 4, 3, "parse_error"), (2, 2, 9, 1, 1, "open"),
        (3, 1, 0, 1, 0, "ok"), (3, 2, 1, 1, 0, "llm_exception"), (3, 3, 2, 0, 0, "open"), (3, 4, 3, 1, 0, "no_progress")]


def test_a_full_context_stops_a_plan(spark):
    rows = [(1, "u", "w " * 5), (1, "a", "x " * 5), (1, "u", "[FORMAT WARNING] y y"), (2, "u", "z " * 20), (3, "u", "go"), (3, "a", "x")]
    assert outcomes(spark, rows, limit=20, min_out=10) == [
        (1, 1, 0, 1, 1, "context_exhausted"), (2, 1, 0, 0, 0, "context_exhausted"), (3, 1, 0, 1, 1, "open")]


def test_retry_prompts_stop_with_the_last_attempt(spark):
    data = [(1, 0, "user", "go", None)] + [(1, k, "assistant", "none", None) for k in range(1, 6)]
    t = S.planner_attempts(spark.createDataFrame(data, LOG), 1000)
    got = sorted((r.turn, r.attempt, r.prompt is None, r.process_reward) for r in S.retry_prompts(t).collect())
    assert got == [(1, 1, False, -1), (2, 2, False, -1), (3, 3, False, -1), (4, 4, True, -1), (5, 1, False, -1)]


def test_first_deciding_event_of_a_run(spark):
    runs = {1: ["turn", "finish", "overflow"], 2: ["empty", "turn", "error", "empty", "finish"], 3: ["turn"] * 4,
            4: ["turn", "exception"], 5: ["overflow"], 6: ["turn", "empty"], 7: ["empty", "error"]}
    rows = [(r, 100 * i, i, k) for r, ks in runs.items() for i, k in enumerate(ks)] + [(8, 0, 0, "turn"), (8, 900, 1, "finish")]
    log = spark.createDataFrame(rows, "run_id long, us long, event_id long, kind string").repartition(3)
    got = {r.run_id: (r.reason, r.turns, r.duration_us) for r in S.run_outcomes(log, 3, 800, 2).collect()}
    assert got == {1: ("completed", 2, 100), 2: ("llm_error", 1, 300), 3: ("max_turn", 3, 200), 4: ("exception", 2, 100),
                   5: ("context_overflow", 1, 0), 6: ("unfinished", 1, 100), 7: ("llm_error", 0, 100), 8: ("timeout", 2, 900)}


SESSION = "user_id long, us long, event_id long, kind string, turns long"


def sessions(spark, events, **kw):
    """Events of one user as (time, kind)."""
    rows = [(1, us, i, k, i) for i, (us, k) in enumerate(events)]
    out = S.session_ends(spark.createDataFrame(rows, SESSION).repartition(3), 100, 3, **kw)
    return [(r.session_us, r.reason) for r in out.orderBy("us", "event_id").collect()]


def test_ends_of_sessions(spark):
    assert sessions(spark, [(0, "plan"), (1, "batch"), (2, "answer"), (3, "plan"), (4, "parse_error"), (5, "batch")]) == [
        (0, None), (0, None), (0, "answer"), (3, None), (3, "parse_error"), (5, None)]
    # the deadline counts from the opening, and an event after it belongs to the next session, also one that ends it
    assert sessions(spark, [(0, "plan"), (90, "batch"), (101, "batch"), (201, "batch"), (202, "answer")]) == [
        (0, None), (0, "timeout"), (101, None), (101, "timeout"), (202, "answer")]
    assert sessions(spark, [(0, "empty"), (1, "empty"), (2, "plan"), (3, "empty"), (4, "empty"), (5, "empty"), (6, "empty")]) == [
        (0, None), (0, None), (0, None), (0, None), (0, None), (0, "no_response"), (6, None)]
    assert sessions(spark, [(k, "plan") for k in range(7)]) == [(0, None), (0, None), (0, "max_iterations"), (3, None), (3, None),
                                                                (3, "max_iterations"), (6, None)]


def test_sessions_over_many_batches(spark):
    """Reasons that come with the next Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert sessions(spark, [(0, "batch"), (101, "batch"), (150, "empty"), (160, "empty"), (170, "empty"), (500, "batch")]) == [
            (0, "timeout"), (101, None), (101, None), (101, None), (101, "no_response"), (500, None)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_counters_and_empty_logs(spark):
    log = spark.createDataFrame([(1, 0, 0, "plan", 9), (1, 5, 1, "batch", 4), (1, 8, 2, "batch", 3), (1, 9, 3, "plan", 9)], SESSION)
    r = S.session_counters(S.session_ends(log, 100, 30)).collect()
    assert [(x.reason, x.n_events, x.plan_calls, x.batches, x.total_turns, x.duration_us, x.grow_iterations) for x in r] == [("open", 4, 2, 2, 7, 9, 1)]
    assert S.session_ends(log.where("false"), 100, 30).collect() == []
    assert S.run_outcomes(spark.createDataFrame([], "run_id long, us long, event_id long, kind string"), 3, 1, 1).collect() == []
    assert outcomes(spark, [(1, "s", "x")]) == []


def test_plan_nodes_drops_and_numbers(spark):
    docs = ['{"node_statuses": {}, "nodes": [{"id": "", "description": "a", "prompt": "p"}, {"id": "x", "description": "b"},'
            ' {"description": "c", "prompt": "p", "dependencies": ["x"]}]}',
            '{"node_statuses": {}, "nodes": [{"id": "y", "description": "d", "prompt": "p"}, {"id": "", "description": "e", "prompt": ""}]}']
    p = spark.createDataFrame([(1, k, d) for k, d in enumerate(docs)], "graph_id long, iteration long, blk string")
    n = S.plan_nodes(p.withColumn("parsed", X.parse_plan(F.col("blk")))).orderBy("iteration", "pos").collect()
    assert [(r.iteration, r.pos, r.node_id, r.description, r.dependencies) for r in n] == [
        (0, 1, "t1", "a", []), (0, 2, "t2", "c", ["x"]), (1, 1, "y", "d", []), (1, 2, "t3", "e", [])]


def test_end_reason_asks_for_the_answer(spark):
    nodes = spark.createDataFrame([(1, 1, "a_answer", "", "yes"), (2, 1, "a_answer", "Failed", ""), (3, 1, "a_answer", "Success", "old"),
                                   (3, 2, "b_answer", "Success", "")], "graph_id long, seq long, node_id string, status string, answer string")
    replies = spark.createDataFrame([(g, 1, None) for g in (1, 2, 3)], "graph_id long, iteration long, error string")
    calls = spark.createDataFrame([(g, 2) for g in (1, 2, 3)], "graph_id long, plan_calls long")
    assert {r.graph_id: r.reason for r in M.end_reason(nodes, replies, calls).collect()} == {1: "answer", 2: "incomplete", 3: "incomplete"}
