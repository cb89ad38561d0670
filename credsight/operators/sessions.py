"""What planner and executor logs say about attempts, runs and sessions.

* ``planner_attempts`` / ``retry_outcomes`` (E13): replies fall into plans by gaps
  and islands over the turns of a conversation.
* ``run_outcomes`` (F8): the first event of an executor run that decides about it.
* ``session_ends`` / ``session_counters`` (F9, F7): sessions of a log, each ended by
  the first event that ends it.

Windows partition by conversation or run, which the turn cap bounds.  A log of
sessions has no such bound: it is cut behind events that end a session whatever
came before, and only what depends on earlier events (deadline, empty replies in
a row, iteration cap) is folded in order, in streaming batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsight.functions import text as X
from credsight.functions.ordering import running_sums

# Attempts of a plan, marker of a retry prompt, empty replies that end a session.
MAX_ATTEMPTS = 4
WARNING = "[FORMAT WARNING]"
MAX_EMPTY = 3
RETRY_HINT = " Reply again with one JSON object in a ```json block."


def words(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")).cast("bigint")


def usable(parsed: Column) -> tuple[Column, Column]:
    """Verdicts with a known status, and nodes that have a description and a prompt."""
    st = F.map_filter(parsed["node_statuses"], lambda k, v: v.isin(*X.PLAN_STATUSES))
    kept = F.filter(parsed["nodes"], lambda n: n["description"].isNotNull() & n["prompt"].isNotNull())
    return st, kept


def plan_nodes(replies: DataFrame) -> DataFrame:
    """Nodes of ``replies(graph_id, iteration, parsed)`` in plan order, numbered as kept.  Nodes without
    description or prompt are dropped silently, missing dependencies are none, and an
    empty id becomes ``t<n>``, n counting over all plans of a graph (bounded by the plan cap).
    -> (graph_id, iteration, pos, node_id, description, prompt, dependencies)
    """
    n = replies.select("graph_id", "iteration", F.posexplode(usable(F.col("parsed"))[1]).alias("p", "n"))
    order = Window.partitionBy("graph_id").orderBy("iteration", "p")
    blank = F.coalesce(F.col("n.id"), F.lit("")) == ""
    return n.select("graph_id", "iteration", (F.col("p") + 1).cast("bigint").alias("pos"),
                    F.when(blank, F.concat(F.lit("t"), F.sum(blank.cast("int")).over(order).cast("string"))).otherwise(F.col("n.id")).alias("node_id"),
                    "n.description", "n.prompt", F.coalesce("n.dependencies", F.array().cast("array<string>")).alias("dependencies"))


def planner_attempts(log: DataFrame, limit: int, min_out: int = 256) -> DataFrame:
    """Every row of a planner log (conv_id, turn, role, text, error) with the plan it
    belongs to, the number of the attempt and what became of it.

    A plan begins with a user turn that is no retry prompt, or with a reply that
    follows a finished plan.  It is finished by a reply other than a parse error, or
    by the ``MAX_ATTEMPTS``-th reply.  ``full`` says that after this turn fewer than
    ``min_out`` of ``limit`` words are left.
    -> (conv_id, turn, role, kind, plan, attempt, message, full)
    """
    reply = F.col("role") == "assistant"
    t = log.select("conv_id", "turn", "role", "text", "error").withColumn("blk", X.json_block(F.when(reply, F.col("text"))))
    t = t.withColumn("parsed", X.parse_plan(F.col("blk")))
    st, kept = usable(F.col("parsed"))
    bad = X.plan_error_of(F.col("blk"), F.col("parsed"))
    t = t.withColumn("message", F.when(reply & F.col("error").isNull() & F.col("text").isNotNull(), bad)).withColumn(
        "kind", F.when(reply, F.when(F.col("error").isNotNull(), "llm_exception").when(F.col("text").isNull(), "llm_no_response")
                       .when(F.col("message").isNotNull(), "parse_error")
                       .when((F.size(st) == 0) & (F.size(kept) == 0), "no_progress").otherwise("ok")))
    turns = Window.partitionBy("conv_id").orderBy("turn")
    prompt = (F.col("role") == "user") & ~F.coalesce(F.col("text").startswith(WARNING), F.lit(False))
    done = F.col("kind").isNotNull() & (F.col("kind") != "parse_error")
    t = (t.withColumn("full", F.lit(limit) - F.sum(words(F.col("text"))).over(turns) < min_out)
         # an island goes up to the end of a plan or to the next prompt
         .withColumn("island", F.sum((prompt | F.coalesce(F.lag(done).over(turns), F.lit(False))).cast("int")).over(turns)))
    inside = Window.partitionBy("conv_id", "island").orderBy("turn")
    t = t.withColumn("nth", F.sum(F.col("kind").isNotNull().cast("int")).over(inside))
    # a fifth reply without a new prompt is a plan of its own; a prompt counts with the first attempt
    cut = F.when(F.col("nth") > 0, F.floor((F.col("nth") - 1) / MAX_ATTEMPTS)).otherwise(F.lit(0))
    return (t.withColumn("plan", F.struct("island", cut.alias("part")))
            .withColumn("attempt", F.when(F.col("kind").isNotNull(), (F.col("nth") - 1) % MAX_ATTEMPTS + 1))
            .withColumn("opens", prompt)
            .select("conv_id", "turn", "role", "kind", "plan", "attempt", "message", "full", "opens"))


def retry_outcomes(attempts: DataFrame) -> DataFrame:
    """E13 per plan: attempts, retry prompts due (the first three failures), typed outcome.

    ok, no_progress, llm_no_response, llm_exception: as the last reply says.
    parse_error: four failures.  context_exhausted: the plan stopped before that, or
    without a reply, and the context is full.  open: the log ends.
    -> (conv_id, plan_no, first_turn, attempts, warnings, outcome, last_message)
    """
    last = F.max(F.struct("turn", "full"))
    g = attempts.groupBy("conv_id", "plan").agg(
        F.min("turn").alias("first_turn"), F.count("kind").alias("attempts"), F.max("opens").alias("opened"),
        F.count_if((F.col("kind") == "parse_error") & (F.col("attempt") < MAX_ATTEMPTS)).alias("warnings"),
        F.max_by("kind", F.when(F.col("kind").isNotNull(), F.col("turn"))).alias("last"),
        F.max_by("message", F.when(F.col("kind").isNotNull(), F.col("turn"))).alias("last_message"), last.alias("end"))
    g = g.where("opened OR attempts > 0")               # turns before the first prompt are no plan
    outcome = (F.when(F.col("last") != "parse_error", F.col("last"))
               .when(F.col("attempts") == MAX_ATTEMPTS, "parse_error")
               .when(F.col("end.full"), "context_exhausted").otherwise("open"))
    no = F.row_number().over(Window.partitionBy("conv_id").orderBy("plan"))
    return g.select("conv_id", no.cast("bigint").alias("plan_no"), "first_turn", "attempts", "warnings", outcome.alias("outcome"), "last_message")


def retry_prompts(attempts: DataFrame, penalise: bool = True) -> DataFrame:
    """Failed attempts: the retry prompt (none after the last attempt) and the process
    reward of the turn.  -> (conv_id, turn, attempt, prompt, process_reward)"""
    f = attempts.where(F.col("kind") == "parse_error")
    return f.select("conv_id", "turn", "attempt", F.when(F.col("attempt") < MAX_ATTEMPTS, F.concat(
        F.lit(WARNING + " "), F.col("message"), F.lit(RETRY_HINT))).alias("prompt"), F.lit(-1 if penalise else 0).alias("process_reward"))


# ---------------------------------------------------------------------------
# F8 executor runs
# ---------------------------------------------------------------------------


def run_outcomes(log: DataFrame, max_turns: int, timeout_us: int, max_empty: int) -> DataFrame:
    """F8: why an executor run ended, by its first event that decides.

    ``log(run_id, us, event_id, kind)``; kind is turn, finish, empty, error, overflow or
    exception.  At every event, in this order: more than ``timeout_us`` since the run
    began: timeout; ``max_empty`` empty replies or errors in a row: llm_error;
    overflow: context_overflow; exception; finish: completed; the ``max_turns``-th
    turn: max_turn.  A run without such an event is unfinished.
    -> (run_id, reason, turns, duration_us): turns and time up to the event that decided.
    """
    w = Window.partitionBy("run_id").orderBy("us", "event_id")
    failed = F.col("kind").isin("empty", "error")
    t = (log.withColumn("begin", F.min("us").over(Window.partitionBy("run_id")))
         .withColumn("turns", F.sum((~failed).cast("int")).over(w))
         # failures in a row: position behind the last other event
         .withColumn("nth", F.row_number().over(w))
         .withColumn("row", F.col("nth") - F.coalesce(F.max(F.when(~failed, F.col("nth"))).over(w), F.lit(0))))
    decision = (F.when(F.col("us") - F.col("begin") > timeout_us, "timeout")
                .when(failed & (F.col("row") >= max_empty), "llm_error")
                .when(F.col("kind") == "overflow", "context_overflow").when(F.col("kind") == "exception", "exception")
                .when(F.col("kind") == "finish", "completed").when(~failed & (F.col("turns") >= max_turns), "max_turn"))
    t = t.withColumn("reason", decision)
    at = F.struct("us", "event_id", "reason", "turns")
    g = t.groupBy("run_id").agg(F.min(F.when(F.col("reason").isNotNull(), at)).alias("d"), F.max(at).alias("e"), F.min("begin").alias("begin"))
    end = F.coalesce("d", "e")
    return g.select("run_id", F.coalesce("d.reason", F.lit("unfinished")).alias("reason"),
                    end["turns"].cast("bigint").alias("turns"), (end["us"] - F.col("begin")).alias("duration_us"))


# ---------------------------------------------------------------------------
# F9, F7 sessions
# ---------------------------------------------------------------------------

#: kinds that end a session at once, and the reason
ENDING = {"answer": "answer", "context": "context_exhausted", "exception": "llm_exception", "parse_error": "parse_error"}


def session_ends(log: DataFrame, timeout_us: int, max_iterations: int, max_empty: int = MAX_EMPTY) -> DataFrame:
    """every event of ``log(user_id, us, event_id, kind, ...)`` with its session and,
    on a session's last event, the reason why it ended.

    A session opens with a user's first event after the one before has ended.  An
    event more than ``timeout_us`` after the opening belongs to the next session,
    and the one before ended by timeout.  Otherwise an event of ``ENDING`` ends it; so do ``max_empty``
    ``empty`` replies in a row (no_response; any ``plan`` or ``batch`` starts the count
    anew) and the ``max_iterations``-th ``plan`` (max_iterations).  A session without an end is open.

    Events that end a session whatever came before cut the log into segments (a
    distributed running count), a segment is in one task, and its events pass
    through in order with a state of five numbers; nothing is collected.
    -> the log's columns and session_us, session_id (opening time and event), reason
    """
    cols = log.columns
    t = log.withColumn("_cut", F.col("kind").isin(*ENDING).cast("double"))
    t = running_sums(t, ["us", "event_id"], by=["user_id"], values=["_cut"])
    # the event that cuts belongs to the segment it closes
    t = t.withColumn("_seg", (F.col("_cum__cut") - F.col("_cut")).cast("bigint")).select(*cols, "_seg")
    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = t.repartition(n, "user_id", "_seg").sortWithinPartitions("user_id", "_seg", "us", "event_id")

    def fold(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seg, opened, first, empty, plans, held = None, 0, 0, 0, 0, None

        for pdf in pdfs:
            sess_us, sess_id, reasons = [], [], []
            for user, sg, us, eid, kind in zip(*(pdf[c] for c in ("user_id", "_seg", "us", "event_id", "kind"))):
                if (user, sg) != seg or opened is None:
                    fresh, late = True, False
                else:
                    fresh = late = us - opened > timeout_us
                if late:                                   # the event before was the last of its session
                    if reasons:
                        reasons[-1] = "timeout"
                    else:
                        held["reason"] = "timeout"
                if fresh:
                    seg, opened, first, empty, plans = (user, sg), us, eid, 0, 0
                empty = empty + 1 if kind == "empty" else 0 if kind in ("plan", "batch") else empty
                plans += kind == "plan"
                reason = ENDING.get(kind) or ("no_response" if empty >= max_empty else
                                              "max_iterations" if plans >= max_iterations else None)
                sess_us.append(opened)
                sess_id.append(first)
                reasons.append(reason)
                if reason:
                    opened = None
            out = pdf[cols].assign(session_us=sess_us, session_id=sess_id, reason=reasons)
            if held is not None and len(out):
                yield held
            if len(out):
                yield out.iloc[:-1]
                held = out.iloc[-1:].copy()                # its reason may come with the next batch
        if held is not None:
            yield held

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema.fields)
    return t.mapInPandas(fold, f"{fields}, session_us long, session_id long, reason string")


def session_counters(events: DataFrame) -> DataFrame:
    """F7 per session of :func:`session_ends`: reason, events, plans, grow iterations,
    batches, total turns (``turns`` of batch events), duration.  Partial aggregates only."""
    kind = F.col("kind")
    return events.groupBy("user_id", "session_us", "session_id").agg(
        F.coalesce(F.max("reason"), F.lit("open")).alias("reason"), F.count(F.lit(1)).alias("n_events"),
        F.count_if(kind == "plan").alias("plan_calls"), F.count_if(kind == "batch").alias("batches"),
        F.coalesce(F.sum(F.when(kind == "batch", F.col("turns"))), F.lit(0)).cast("bigint").alias("total_turns"),
        (F.max("us") - F.col("session_us")).alias("duration_us")).withColumn(
        "grow_iterations", F.greatest(F.col("plan_calls") - 1, F.lit(0)))
