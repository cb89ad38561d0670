"""Keys meet in buckets: few messages to the state store, the same rounds."""

import json
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from credsight.streaming import stateful as K
from credsight.streaming import streams as S


class Store:
    """State of one bucket in memory, with a count of the messages."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def _state(self, kind):
        at = {}

        def said(f):
            def run(*a):
                self.calls += 1
                return f(*a)
            return run

        if kind == "map":
            return SimpleNamespace(getValue=said(lambda k: at.get(k)), updateValue=said(lambda k, v: at.update({k: v})))
        return SimpleNamespace(
            get=said(lambda: at.get("v") if kind == "value" else iter(list(at.get("v", [])))), update=said(lambda v: at.update(v=v)),
            appendValue=said(lambda v: at.setdefault("v", []).append(v)), put=said(lambda v: at.update(v=list(v))), clear=said(at.clear))

    def getListState(self, *_):
        return self._state("list")

    def getValueState(self, *_):
        return self._state("value")

    def getMapState(self, *_):
        return self._state("map")

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.discard(ms)


def run(processor, store, rows, mark_ms):
    at = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark_ms)
    if rows:
        assert not list(processor.handleInputRows((0,), iter([pd.DataFrame(rows, columns=processor.columns)]), at))
    got = []
    for ms in sorted(t for t in store.timers if t <= mark_ms):
        got += [r for f in processor.handleExpiredTimer((0,), at, None) for r in f.itertuples(index=False, name=None)]
        store.timers.discard(ms)
    return got


def test_rounds_of_many_keys_take_few_messages():
    store, n = Store(), 5000
    p = K.Rounds(["us", "k"], ["id", "start", "end", "last", "n"], K._session, None, 10 * K.SECOND, -1)
    p.init(store)
    rows = [(f"u{i}", s * K.SECOND, i) for s in (0, 5, 11, 12) for i in range(n)]
    assert run(p, store, rows, 0) == []
    assert len(store.timers) == 1
    first = run(p, store, [], 10_001)                     # the first sessions are over, the second ones wait
    assert sorted(first) == sorted((f"u{i}", 0, 10 * K.SECOND, 5 * K.SECOND, 2) for i in range(n))
    rest = run(p, store, [(f"u{i}", 13 * K.SECOND, 9) for i in range(n)], 90_000)
    assert sorted(rest) == sorted((f"u{i}", 11 * K.SECOND, 21 * K.SECOND, 13 * K.SECOND, 3) for i in range(n))
    assert store.timers == set() and store.calls < 60


def test_a_hot_key_with_many_rounds_and_late_rows():
    store = Store()
    p = K.Rounds(["us", "k"], ["k"], K._kept, 1, 0, 3 * K.SECOND)
    p.init(store)
    n = 40_000                                             # one row a second: every fourth opens a round
    assert [k for k, in run(p, store, [("u", s * K.SECOND, s) for s in range(n)], 10 ** 9)] == list(range(0, n, 4))


def test_validation_takes_two_messages_a_graph():
    store, n = Store(), 500
    p = K.PlanRules()
    p.init(store)
    node = lambda i: {"seq": 1, "node_id": i, "exec_status": "", "kd": i, "kp": "p"}
    rows = [(f"g{g}", k * K.SECOND, k, json.dumps({"nodes": [node(f"n{k}")], "verdicts": [] if k < 2 or k == 3 else [{"node_id": f"n{k - 1}", "status": "Success"}]}))
            for g in range(n) for k in (3, 1, 2, 4)]
    assert run(p, store, rows, 0) == []
    got = run(p, store, [], 3_001)
    assert sorted(got) == sorted((f"g{g}", 3, "R_STATUS", None, "node_statuses must cover all awaiting ids; without a verdict: ['n2']") for g in range(n))
    got = run(p, store, [], 9_000)
    assert {r[1:3] for r in got} == {(4, "R_STATUS")} and len(got) == n
    assert store.calls < 4 * n + 40


def test_missing_keys_and_order_columns(spark, tmp_path):
    path, schema = f"{tmp_path}/in", "user_id long, event_id long, ts timestamp"
    d = spark.createDataFrame([(None, 1, 0), (None, 2, 1), (2 ** 62 + 1, 2 ** 62 + 3, 0), (3, None, 0), (3, 7, 1)], "user_id long, event_id long, h long") \
        .withColumn("ts", F.timestamp_seconds((F.col("h") + 1000) * 3600)).select(*[c.split()[0] for c in schema.split(", ")])
    d.coalesce(1).write.parquet(path)
    K.closing_row(d, "ts").write.mode("append").parquet(path)
    ev = lambda: K.timed(S.stream_table(spark, path), "ts", "0 seconds")
    kept = K.run_stateful(K.first_per_window(ev(), ["user_id"], "event_id", 7200), "t-null-kept").collect()
    assert sorted((r.event_id for r in kept), key=repr) == [1, 2 ** 62 + 3, None]
    got = K.run_stateful(K.deadline_sessions(ev(), "user_id", "event_id", 7200), "t-null-sessions").collect()
    assert sorted(((r.user_id, r.n_events) for r in got), key=repr) == sorted([(None, 2), (2 ** 62 + 1, 1), (3, 2)], key=repr)
