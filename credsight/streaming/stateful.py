"""Keyed state with event-time timers: L3 (kept rows), L4, L5, L6, L8.

Rows wait in state until the watermark has passed the moment that decides about
them, so a result depends on event times alone, not on how the rows were dealt
over files and micro-batches; what comes later than the watermark allows is
dropped by Spark.  Every operator emits a row once (append mode) and evicts its
state by a timer.  State lives in RocksDB under the job's checkpoint folder, so a
named job goes on where it stopped.

Keys are many and small (a group, a user, a graph), and every look at the state
is a message to the JVM.  So keys meet in hash buckets (:func:`in_buckets`): a
bucket appends what arrives as one value, has one timer, and settles all of its
keys when that goes off.
"""

from __future__ import annotations

import json
import math
import pickle
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from credsight.functions.columns import normalise_text
from credsight.operators.rules import PENDING_STATUSES
from credsight.streaming import streams as S

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000                 # event times are kept in microseconds
EPS = 1e-6                         # fixed value: added to a group's deviation


def run_stateful(sdf: DataFrame, name: str, job: str | None = None) -> DataFrame:
    """Run to completion in append mode with the state provider that timers need."""
    conf = sdf.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        return S.run_append(sdf, name, job)
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)


def closing_row(schema_of: DataFrame, ts: str) -> DataFrame:
    """A row without values whose event time is the end of time: it moves the
    watermark past all others when a job is closed."""
    row = schema_of.sparkSession.range(1)
    return row.select(*[(F.lit(END).cast(f.dataType) if f.name == ts else F.lit(None).cast(f.dataType)).alias(f.name)
                        for f in schema_of.schema.fields])


#: event time of a closing row
END = "2900-01-01 00:00:00"


def timed(sdf: DataFrame, ts: str, late: str) -> DataFrame:
    """Watermark on ``ts``, closing rows taken out after they have moved it, and the event time as ``us``.

    The condition names the event time, so it is not pushed below the watermark."""
    return (sdf.withWatermark(ts, late).where(F.col(ts) < F.lit(END).cast("timestamp"))
            .withColumn("us", F.unix_micros(ts)))


#: buckets of keys; a named job keeps the number it began with
BUCKETS = 1024
#: rows of one value in the state, and of one frame of output
CHUNK = 20_000
#: stands for a missing order column, which sorts first
NO_K = -2 ** 63


def in_buckets(rows: DataFrame, keys: list[str], columns: list[str]):
    """``columns`` of the rows, grouped by a bucket of their keys, with all keys as the JSON text ``id``;
    event times stay, as Spark drops late rows by them."""
    times = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.TimestampType) and f.name not in columns]
    return rows.select(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket"),
                       F.to_json(F.struct(*keys)).alias("id"), *columns, *times).groupBy("bucket")


class Buckets(StatefulProcessor):
    """Rows (id, us, ..) of a bucket wait until the timer at the earliest moment that may
    decide about one of them; then :meth:`settle` takes the rows of every id.

    A row that just arrived is never decided before its own time, so what arrives is
    only appended: it is read when the timer goes off, in the same micro-batch if due.
    """

    def __init__(self, columns: list[str], out: list[str]):
        self.columns, self.out = columns, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            new = list(pdf[self.columns].itertuples(index=False, name=None))
            self.waiting.appendValue((pickle.dumps(new, 5),))
            low = int(pdf["us"].min())
            first = low if first is None else min(first, low)
        if first is not None:
            ms, due = first // 1000 + 1, self.due.get()
            if due is None or ms < due[0]:
                if due is not None:
                    self.handle.deleteTimer(due[0])
                self._wake(ms)
        return iter(())

    def _wake(self, ms: int) -> None:
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held: dict[str, list[tuple]] = {}
        for value in self.waiting.get():
            for r in pickle.loads(value[0]):
                held.setdefault(r[0], []).append(r[1:])
        left, wake, out = [], [], []
        for row in self.settle(held, mark, left, wake):
            out.append(row)
            if len(out) >= CHUNK:
                yield self._frame(out)
                out = []
        if out:
            yield self._frame(out)
        if left:
            self.waiting.put([(pickle.dumps(left[i:i + CHUNK], 5),) for i in range(0, len(left), CHUNK)])
        else:
            self.waiting.clear()
        if wake:
            self._wake(min(wake) // 1000 + 1)
        else:
            self.due.clear()

    def settle(self, held: dict[str, list[tuple]], mark: int, left: list[tuple], wake: list[int]) -> Iterator[tuple]:
        """Output of the rows that the watermark has passed; the others are put into
        ``left`` and the moments that decide about them into ``wake``."""
        raise NotImplementedError

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.out, dtype=object)

    def close(self) -> None:
        pass


class Rounds(Buckets):
    """Rows of a key, ordered by (us, k), fall into rounds.

    A round opens with the first row after the one before has ended.  It closes at
    its ``size``-th row, or ``timeout`` after its first one, whichever comes first;
    rows up to ``retention`` after the close belong to no round any more.  ``emit``
    turns a closed round (complete or not) or such a row into output.
    """

    def __init__(self, fields: list[str], out: list[str], emit: Callable, size: int | None, timeout: int, retention: int):
        super().__init__(["id", *fields], out)
        self.emit, self.size, self.timeout, self.retention = emit, size, timeout, retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.until = handle.getValueState("until", "ends binary")

    def settle(self, held, mark, left, wake):
        ends = self.until.get()
        ends = pickle.loads(ends[0]) if ends is not None else {}
        kept = {}
        for key in held.keys() | ends.keys():
            rows = sorted(held.get(key, ()), key=lambda r: r[:2])
            at, until, close = yield from self._close(key, rows, ends.get(key), mark)
            if at < len(rows):
                left.extend((key, *r) for r in rows[at:])
                wake.append(close)
            if until is not None and (until >= mark or at < len(rows)):
                kept[key] = until
                if until >= mark:
                    wake.append(until)
        if kept:
            self.until.update((pickle.dumps(kept, 5),))
        elif ends:
            self.until.clear()

    def _close(self, key: str, rows: list[tuple], until: int | None, mark: int):
        """Close every round that the watermark has passed -> (rows used, end of the last round's
        retention, moment at which the open round closes)."""
        times = [r[0] for r in rows]
        at, close = 0, None
        while at < len(rows):
            if until is not None:
                j = bisect_right(times, until, at)
                for r in rows[at:j]:
                    yield from self.emit(key, [r], "late", until)
                at = j
                if at == len(rows):
                    break
            end = times[at] + self.timeout
            j = bisect_right(times, end, at)
            if self.size is not None:
                j = min(j, at + self.size)
            full = j - at == self.size
            close = times[j - 1] if full else end
            if close >= mark:                      # rows of that time or before may still come
                break
            yield from self.emit(key, rows[at:j], "complete" if full else "timeout", close)
            at, until = j, close + self.retention
        return at, until, close


# ---------------------------------------------------------------------------
# L5 group credit with a deadline
# ---------------------------------------------------------------------------


def _group_stats(scores: list[float]) -> tuple[float, float]:
    if len(scores) < 2:
        return 0.0, 1.0                            # a single score is compared with 0
    mean = math.fsum(scores) / len(scores)
    return mean, math.sqrt(math.fsum((s - mean) ** 2 for s in scores) / (len(scores) - 1))


CREDIT_FIELDS = ["us", "k", "score", "planner", "dummy", "gen", "violations"]


class Credit:
    """Advantages of a closed group: H2, or with ``penalty`` (lambda, cap) H4."""

    def __init__(self, penalty: tuple[float, int] | None):
        self.penalty = penalty

    def __call__(self, key, rows, state, close):
        if state == "late":
            for r in rows:
                yield r[1], state, None, None
            return
        scored, counted, seen = [], [], set()
        for _, k, score, planner, dummy, gen, violations in rows:
            if self.penalty and planner:
                score -= self.penalty[0] * min(violations, self.penalty[1])
            scored.append((k, score, dummy))
            if self.penalty and dummy:
                continue
            if self.penalty and planner:           # one rollout of a planner counts once
                if gen in seen:
                    continue
                seen.add(gen)
            counted.append(score)
        mean, std = _group_stats(counted)
        for k, score, dummy in scored:
            adv = 0.0 if self.penalty and dummy else (score - mean) / (std + EPS)
            yield k, state, len(rows), adv


def group_credit(rollouts: DataFrame, keys: list[str], size: int, timeout_s: int, retention_s: int,
                 penalty: tuple[float, int] | None = None) -> DataFrame:
    """Credit of a group as soon as its ``size`` rollouts are there, or of those
    that came within ``timeout_s`` of the first; rollouts that follow within
    ``retention_s`` are reported as late, without credit, and then the group is
    forgotten: a later rollout opens a new round.

    ``rollouts`` is a stream with (keys, traj_id, us, score), for H4 also (planner,
    dummy, gen, violations), from :func:`timed`.
    -> (traj_id, state complete | timeout | late, g_n, adv)
    """
    extra = {"planner": "boolean", "dummy": "boolean", "gen": "string", "violations": "long"}
    r = rollouts.withColumn("k", F.coalesce("traj_id", F.lit(NO_K)))
    for name, kind in extra.items():
        if name not in r.columns:
            r = r.withColumn(name, F.lit(None).cast(kind))
    r = r.withColumn("violations", F.coalesce("violations", F.lit(0)))
    return _order_back(in_buckets(r, keys, CREDIT_FIELDS).transformWithStateInPandas(
        Rounds(CREDIT_FIELDS, ["k", "state", "g_n", "adv"], Credit(penalty), size, timeout_s * SECOND, retention_s * SECOND),
        "k long, state string, g_n long, adv double", "append", "eventTime"), "traj_id")


def _order_back(out: DataFrame, name: str) -> DataFrame:
    """The order column under its own name, null where it was missing."""
    return out.withColumn("k", F.when(F.col("k") != NO_K, F.col("k"))).withColumnRenamed("k", name)


# ---------------------------------------------------------------------------
# L6 sessions with a deadline, L3 kept rows
# ---------------------------------------------------------------------------


def _session(key, rows, state, close):
    yield key, rows[0][0], close, rows[-1][0], len(rows)


def deadline_sessions(events: DataFrame, key: str, order: str, timeout_s: int = 5400) -> DataFrame:
    """A session ends ``timeout_s`` after its first event, whatever happens in it;
    the next event opens another.  Emitted when the deadline has passed."""
    names = ["session_start_us", "session_end_us", "last_event_us", "n_events"]
    rows = events.withColumn("k", F.coalesce(order, F.lit(NO_K)))
    out = in_buckets(rows, [key], ["us", "k"]).transformWithStateInPandas(
        Rounds(["us", "k"], ["id", *names], _session, None, timeout_s * SECOND, -1),
        "id string, " + ", ".join(f"{n} long" for n in names), "append", "eventTime")
    return out.select(_key_back(events, key), *names)


def _key_back(rows: DataFrame, key: str) -> Column:
    return F.from_json("id", T.StructType([rows.schema[key]]))[key].alias(key)


def _kept(key, rows, state, close):
    if state != "late":
        yield (rows[0][1],)


def first_per_window(events: DataFrame, keys: list[str], order: str, window_s: int) -> DataFrame:
    """L3 with the kept row: the first event of a key stays, those up to ``window_s``
    after it are repeats, the next one stays again.  -> (order)"""
    rows = events.withColumn("k", F.coalesce(order, F.lit(NO_K)))
    return _order_back(in_buckets(rows, keys, ["us", "k"]).transformWithStateInPandas(
        Rounds(["us", "k"], ["k"], _kept, 1, 0, window_s * SECOND), "k long", "append", "eventTime"), order)


# ---------------------------------------------------------------------------
# L4 adaptive KL coefficient in step order
# ---------------------------------------------------------------------------


class OrderedSteps(StatefulProcessor):
    """Steps wait in map state until the watermark has passed them, then the
    coefficient takes them in order; every value equals that of the batch."""

    def __init__(self, init: float, target: float, horizon: int):
        self.start, self.target, self.horizon = init, target, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long, step long", "kl double, n long")
        self.coef = handle.getValueState("coef", "value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            self.waiting.updateValue((r.us, r.step), (r.kl, r.n))
        yield from self._release(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._release(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def _release(self, key, mark: int) -> Iterator[Row]:
        steps = sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator())
        value = self.coef.get()[0] if self.coef.exists() else self.start
        for (us, step), (kl, n) in steps:
            if us >= mark:
                self.handle.registerTimer(us // 1000 + 1)
                break
            value *= 1.0 + min(max(kl / self.target - 1.0, -0.2), 0.2) * n / self.horizon
            self.waiting.removeKey((us, step))
            yield Row(run_id=key[0], step=step, kl=kl, n=n, kl_coef=value)
        self.coef.update((value,))

    def close(self) -> None:
        pass


def adaptive_kl_in_order(steps: DataFrame, init: float, target: float, horizon: int) -> DataFrame:
    """L4 over a stream of (run_id, step, kl, n, us) from :func:`timed`."""
    return steps.groupBy("run_id").transformWithState(
        OrderedSteps(init, target, horizon), "run_id string, step long, kl double, n long, kl_coef double", "append", "eventTime")


def month_start(step: Column) -> Column:
    """Event time of a step numbered yyyyMM."""
    return F.make_timestamp((step / 100).cast("int"), (step % 100).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))

# ---------------------------------------------------------------------------
# L8 validation of plans as they arrive
# ---------------------------------------------------------------------------

def plan_messages(nodes: DataFrame, deps: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(graph_id, iteration, nodes, verdicts): one row per plan, its texts normalised."""
    dl = deps.groupBy("graph_id", "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("dep_pos", "dep_id"))), lambda x: x["dep_id"]).alias("deps"))
    n = nodes.join(dl, ["graph_id", "seq"], "left").select("graph_id", "iteration", F.struct(
        "seq", "node_id", "exec_status", normalise_text(F.col("description")).alias("kd"), normalise_text(F.col("prompt")).alias("kp"), "deps").alias("n"))
    rows = n.unionByName(verdicts.select("graph_id", "iteration", F.struct("node_id", "status").alias("v")), allowMissingColumns=True)
    return rows.groupBy("graph_id", "iteration").agg(F.array_sort(F.collect_list("n")).alias("nodes"), F.collect_list("v").alias("verdicts"))


def _names(ids) -> str:
    return "[" + ", ".join(f"'{i}'" for i in sorted(ids)) + "]"


class Graph:
    """What the rules need of a graph's earlier plans: every id with its first and latest batch
    and its status, the ids that await a verdict, the normalised (description, prompt) of all
    nodes but answers, the latest batch."""

    __slots__ = ("known", "awaiting", "texts", "batch")

    def __init__(self, state: tuple | None = None):
        self.known, self.awaiting, self.texts, self.batch = state or ({}, set(), set(), None)

    def state(self) -> tuple:
        return self.known, self.awaiting, self.texts, self.batch


class PlanRules(Buckets):
    """E1-E9 on the plans of a graph in the order of their iterations.

    A plan that arrives early waits until the watermark has passed it.  Of the stored
    graph only a :class:`Graph` is kept, one value per graph in map state: a settled
    bucket reads and writes those of the graphs that have plans due.
    """

    def __init__(self):
        super().__init__(["id", "us", "iteration", "plan"], ["id", "iteration", "rule", "node_id", "message"])

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.graphs = handle.getMapState("graphs", "id string", "graph binary")

    def settle(self, held, mark, left, wake):
        for key, rows in held.items():
            # a plan that came again replaces the one that waits
            plans = sorted({r[1]: r for r in rows}.items())
            n = next((i for i, (_, r) in enumerate(plans) if r[0] >= mark), len(plans))
            if n < len(plans):
                wake.append(plans[n][1][0])
                left.extend((key, *r) for _, r in plans[n:])
            if not n:
                continue
            stored = self.graphs.getValue((key,))
            g = Graph(pickle.loads(stored[0]) if stored is not None else None)
            for k, (_, _, plan) in plans[:n]:
                plan = json.loads(plan)
                nodes, verdicts = plan.get("nodes") or [], {v.get("node_id"): v.get("status") for v in plan.get("verdicts") or []}
                for rule, node_id, message in self._check(g, k, nodes, verdicts):
                    yield key, k, rule, node_id, message
                self._apply(g, k, nodes, verdicts)
            self.graphs.updateValue((key,), (pickle.dumps(g.state(), 5),))

    def _check(self, g: Graph, k: int, nodes: list, verdicts: dict) -> Iterator[tuple]:
        unjudged = g.awaiting - verdicts.keys()
        if unjudged:
            yield "R_STATUS", None, f"node_statuses must cover all awaiting ids; without a verdict: {_names(unjudged)}"
            return
        if not nodes:
            yield "R_EMPTY", None, "plan must contain at least one new node; this one adds none"
            return
        refines = {n["node_id"]: PARENT.match(n["node_id"]) for n in nodes if "_refine" in n["node_id"]}
        parents = {i: _parent(m) for i, m in refines.items() if m}
        alive = set()
        for i, status in verdicts.items():
            if status in PENDING_STATUSES and i not in parents.values():
                if "_refine" in i:
                    m = PARENT.match(i)
                    spent = bool(m) and int(m.group(2)) >= 2
                else:
                    spent = f"{i}_refine1" in g.known
                if not spent:
                    alive.add(i)
        if alive:
            yield "R_PENDING", None, f"unresolved this turn, but not addressed by any refine of the same plan: {_names(alive)}"
        answers = [n["node_id"] for n in nodes if n["node_id"].endswith("_answer")]
        if answers and len(nodes) > 1:
            others = [n["node_id"] for n in nodes if n["node_id"] != answers[0]]
            yield "R_ANSWER_ISOLATION", answers[0], f"answer node '{answers[0]}' must be planned alone in its batch; planned with it: {_names(others)}"
        new = {n["node_id"] for n in nodes}
        for n in nodes:
            i = n["node_id"]
            for d in n.get("deps") or []:
                if d == i:
                    yield "DEP", i, f"node '{i}' depends on itself"
                elif d in new:
                    yield "DEP", i, f"node '{i}' depends on '{d}' of the SAME batch, which has no result yet"
                elif d not in g.known:
                    yield "DEP", i, f"node '{i}' depends on '{d}', an id that does not exist"
            if i in refines:
                yield from (("R_REFINE", i, f"refine node '{i}': {m}") for m in self._refine(g, i, refines[i], parents.get(i), verdicts))
            if not i.endswith("_answer") and (n.get("kd"), n.get("kp")) in g.texts:
                yield "R_DUP", i, f"node '{i}' has the same description AND prompt as an earlier node"

    def _refine(self, g: Graph, i: str, m, parent: str | None, verdicts: dict) -> Iterator[str]:
        if not m:
            yield "the id is not of the form <parent>_refine<n>"
        elif int(m.group(2)) > 2:
            yield "a line has two refines at most"
        elif (p := g.known.get(parent)) is None:
            yield f"no parent '{parent}' in the graph"
        else:
            status = verdicts.get(parent) or p[2]
            if status not in PENDING_STATUSES:
                yield f"parent '{parent}' is '{status}', not unresolved"
            if i in g.known:
                yield "the id is in use"

    def _apply(self, g: Graph, k: int, nodes: list, verdicts: dict) -> None:
        """First the verdicts on the latest batch, then the new batch."""
        for i, status in verdicts.items():
            at = g.known.get(i)
            if at and at[1] == g.batch:
                g.known[i] = at[0], at[1], status
                g.awaiting.discard(i)
        for n in nodes:
            i, status, text = n["node_id"], n.get("exec_status"), (n.get("kd"), n.get("kp"))
            at = g.known.get(i)
            g.known[i] = at[0] if at else k, k, status
            if status == "":
                g.awaiting.add(i)
            else:
                g.awaiting.discard(i)
            if not i.endswith("_answer"):
                g.texts.add(text)
        if nodes:
            g.batch = k


PARENT = re.compile(r"^(.+?)_refine(\d+)$")


def _parent(m) -> str:
    n = int(m.group(2))
    return m.group(1) if n == 1 else f"{m.group(1)}_refine{n - 1}"


def validate_plans(plans: DataFrame, graph_type: str = "long") -> DataFrame:
    """L8 over a stream of :func:`plan_messages` with ``us``, from :func:`timed`, the
    event time being the iteration: the violations of the batch rules, each plan once."""
    rows = plans.withColumn("plan", F.to_json(F.struct("nodes", "verdicts")))
    out = in_buckets(rows, ["graph_id"], ["us", "iteration", "plan"]).transformWithStateInPandas(
        PlanRules(), "id string, iteration long, rule string, node_id string, message string", "append", "eventTime")
    return out.select(_key_back(plans, "graph_id").cast(graph_type).alias("graph_id"), "iteration", "rule", "node_id", "message")
