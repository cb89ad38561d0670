"""F1-F16: rollout metrics, credit shaping and training-set selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credsight.functions.columns import mix_hash, r6
from credsight.operators.graph import DEPS_NOT_FOUND, NO_DEPS, dependency_lists


def chain_metrics(nodes: DataFrame, deps: DataFrame, closure: DataFrame) -> DataFrame:
    """chain nodes (nodes of the graph in the answer node's closure),
    off-chain nodes, chain ratio, mean dependency count, answer dependency count."""
    nd = (nodes.select("graph_id", "node_id")
          .join(dependency_lists(nodes, deps).groupBy("graph_id", "node_id").agg(F.count(F.lit(1)).alias("k")),
                ["graph_id", "node_id"], "left")
          .select("graph_id", "node_id", F.coalesce("k", F.lit(0)).alias("n_deps")))
    on = closure.select("graph_id", "node_id", F.lit(True).alias("on_chain")).distinct()
    seed = closure.select("graph_id", "seed_id").distinct()
    j = nd.join(on, ["graph_id", "node_id"], "left").join(seed, "graph_id", "left")
    g = j.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.count_if(F.col("on_chain").isNotNull()).alias("chain_nodes"),
        F.avg("n_deps").alias("mean_deps"),
        F.max(F.when(F.col("node_id") == F.col("seed_id"), F.col("n_deps"))).alias("answer_deps"))
    return g.select("graph_id", "n_nodes", "chain_nodes", (F.col("n_nodes") - F.col("chain_nodes")).alias("off_chain_nodes"),
                    r6(F.col("chain_nodes") / F.col("n_nodes").cast("double")).alias("chain_ratio"),
                    r6(F.col("mean_deps")).alias("mean_deps"),
                    F.coalesce(F.col("answer_deps"), F.lit(0)).cast("bigint").alias("answer_deps"))


def credit_shaping(nodes: DataFrame, closure: DataFrame, reward: DataFrame, alpha: float) -> DataFrame:
    """executor reward = R on the answer chain, alpha * R off it; without an
    answer node alpha falls back to 1.  ``reward(graph_id, R)``.
    -> (graph_id, node_id, on_chain, has_answer, reward)"""
    on = closure.select("graph_id", "node_id", F.lit(True).alias("on_chain")).distinct()
    has = closure.select("graph_id", F.lit(True).alias("has_answer")).distinct()
    j = (nodes.select("graph_id", "seq", "node_id").join(on, ["graph_id", "node_id"], "left")
         .join(has, "graph_id", "left").join(reward, "graph_id", "left"))
    oc = F.coalesce(F.col("on_chain"), F.lit(False))
    ha = F.coalesce(F.col("has_answer"), F.lit(False))
    r = F.when(oc | ~ha, F.col("R")).otherwise(F.lit(float(alpha)) * F.col("R"))
    return j.select("graph_id", "seq", "node_id", oc.alias("on_chain"), ha.alias("has_answer"), r.alias("reward"))


def trajectory_cap(execs: DataFrame, max_traj: int, seed: int = 7) -> DataFrame:
    """F12 + K3: keep the planner row, then on-chain executors by depth (deepest
    first, ties by original order), then a seeded hash-random sample of
    off-chain executors, up to ``max_traj`` rows per rollout.

    One ``row_number`` per rollout; the ``<= budget`` filter is planned as a
    group limit (partial top-k before the shuffle).
    ``execs(graph_id, seq, on_chain, depth, ...)`` -> kept executor rows.
    """
    w = Window.partitionBy("graph_id").orderBy(
        F.col("on_chain").desc(),
        F.when(F.col("on_chain"), -F.col("depth")),
        F.when(~F.col("on_chain"), mix_hash(F.col("graph_id"), F.col("seq"), seed)),
        F.col("seq"))
    return execs.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= max_traj - 1).drop("_k")


def kept_stats(execs: DataFrame, kept: DataFrame) -> DataFrame:
    """kept / on-chain / off-chain / truncated counts and reward means;
    the gap only when both sides are non-empty."""
    pre = execs.groupBy("graph_id").agg(F.count_if("on_chain").alias("pre_chain"))
    k = kept.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("kept"), F.count_if("on_chain").alias("chain_kept"),
        F.avg("reward").alias("exec_reward_mean"),
        F.avg(F.when(F.col("on_chain"), F.col("reward"))).alias("chain_reward_mean"),
        F.avg(F.when(~F.col("on_chain"), F.col("reward"))).alias("off_chain_reward_mean"))
    j = pre.join(k, "graph_id", "left")
    return j.select("graph_id", F.coalesce("kept", F.lit(0)).alias("kept"),
                    F.coalesce("chain_kept", F.lit(0)).alias("chain_kept"),
                    (F.coalesce("kept", F.lit(0)) - F.coalesce("chain_kept", F.lit(0))).alias("off_chain_kept"),
                    F.greatest(F.col("pre_chain") - F.coalesce("chain_kept", F.lit(0)), F.lit(0)).alias("chain_truncated"),
                    r6(F.col("exec_reward_mean")).alias("exec_reward_mean"),
                    r6(F.col("chain_reward_mean")).alias("chain_reward_mean"),
                    r6(F.col("off_chain_reward_mean")).alias("off_chain_reward_mean"),
                    r6(F.col("chain_reward_mean") - F.col("off_chain_reward_mean")).alias("reward_gap"))


def batch_cost(nodes: DataFrame, calls: DataFrame, plan_calls: DataFrame) -> DataFrame:
    """a parallel batch costs its slowest node (most model calls of a node's
    run); steps = planner steps + sum of batch maxima.  ``calls(graph_id, seq, calls)``;
    a node without a run costs nothing."""
    calls = (nodes.select("graph_id", "seq", "iteration").join(calls, ["graph_id", "seq"], "left")
             .fillna(0, ["calls"]))
    per_batch = calls.groupBy("graph_id", "iteration").agg(F.max("calls").alias("batch_max"))
    g = per_batch.groupBy("graph_id").agg(F.sum("batch_max").alias("exec_steps"))
    return (g.join(plan_calls, "graph_id")
            .select("graph_id", "exec_steps", "plan_calls", (F.col("plan_calls") + F.col("exec_steps")).alias("steps")))


def model_calls(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """Model calls of a node's run: the non-blank assistant turns of its conversation
    ``turns(conv_id, role, text)``, where ``nodes.okey`` names the conversation."""
    said = turns.where((F.col("role") == "assistant") & F.col("text").rlike(r"\S"))
    n = said.groupBy(F.col("conv_id").alias("okey")).agg(F.count(F.lit(1)).alias("calls"))
    return nodes.select("graph_id", "seq", "okey").join(n, "okey").select("graph_id", "seq", "calls")


def derived_counters(nodes: DataFrame, plan_calls: DataFrame) -> DataFrame:
    """executed nodes, unique executed, grow iterations, refine count, batches."""
    ex = F.col("status") != ""
    g = nodes.groupBy("graph_id").agg(
        F.count_if(ex).alias("executed_nodes"),
        F.countDistinct(F.when(ex, F.col("node_id"))).alias("unique_executed"),
        F.count_if(F.col("node_id").contains("_refine")).alias("refine_nodes"),
        F.countDistinct("iteration").alias("n_batches"))
    return g.join(plan_calls, "graph_id").select(
        "graph_id", "executed_nodes", "unique_executed", "refine_nodes", "n_batches", "plan_calls",
        F.greatest(F.col("plan_calls") - 1, F.lit(0)).alias("grow_iterations"))


def node_metrics(nodes: DataFrame, context: DataFrame) -> DataFrame:
    """dep_ratio = upstream tokens / prompt tokens (0 when none), and the
    execution status class.  Tokens are counted as whitespace-separated words."""
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    j = nodes.join(context, ["graph_id", "node_id"])
    up = F.when(F.col("context").isin(NO_DEPS, DEPS_NOT_FOUND), F.lit(0)).otherwise(words(F.col("context")))
    pt = words(F.col("prompt")) + up
    cls = (F.when(F.col("status").isin("Success", "Uncertain", "Not Found"), "completed")
           .when(F.col("status") == "Failed", "failed").otherwise("exception"))
    return j.select("graph_id", "node_id", up.cast("bigint").alias("upstream_tokens"), pt.cast("bigint").alias("prompt_tokens"),
                    r6(F.when(pt > 0, up / pt).otherwise(F.lit(0.0))).alias("dep_ratio"), cls.alias("exec_status"))


def tool_counts(calls: DataFrame) -> DataFrame:
    """tool calls by kind per conversation; external = search + open_page."""
    fn = F.col("function")
    return calls.groupBy("conv_id").agg(
        F.count_if(fn == "search").alias("n_search"), F.count_if(fn == "open_page").alias("n_open_page"),
        F.count_if(fn == "recall").alias("n_recall"), F.count_if(fn == "finish").alias("n_finish"),
        F.count_if(fn.isin("search", "open_page")).alias("n_external"))


def context_budget(turns: DataFrame, limit: int, ratio: float = 0.95, warn_at: float = 0.85,
                   min_out: int = 256, observation: str = "user") -> DataFrame:
    """F2-F4 per conversation (a conversation is bounded by the turn cap):

    F2 overflow: an observation (a turn of role ``observation``) that would push
    the context past ratio*limit is discarded and its tokens counted as
    truncated; the model's own turns always stay.  F3/F4 look at the live
    context, without what was discarded: the first turn after which it reaches
    warn_at*limit, and the first after which limit - used < min_out.
    An exact ordered fold over the turn array.
    """
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    t = turns.select("conv_id", "turn", words.cast("bigint").alias("n"),
                     F.coalesce(F.col("role") == observation, F.lit(False)).alias("obs"))
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "n", "obs"))).alias("ts"))
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast(turns.schema["turn"].dataType)
    init = F.struct(zero.alias("used"), zero.alias("dropped"), zero.alias("trunc"), none.alias("warn"), none.alias("out"))

    def step(acc, x):
        drop = x["obs"] & ((acc["used"] + x["n"]).cast("double") > F.lit(float(ratio * limit)))
        used = F.when(drop, acc["used"]).otherwise(acc["used"] + x["n"])
        return F.struct(
            used.alias("used"), (acc["dropped"] + drop.cast("bigint")).alias("dropped"),
            F.when(drop, acc["trunc"] + x["n"]).otherwise(acc["trunc"]).alias("trunc"),
            F.coalesce(acc["warn"], F.when(used.cast("double") >= F.lit(float(warn_at * limit)), x["turn"])).alias("warn"),
            F.coalesce(acc["out"], F.when(F.lit(limit) - used < F.lit(min_out), x["turn"])).alias("out"))

    return g.select("conv_id", F.aggregate("ts", init, step).alias("f")).select(
        "conv_id", F.col("f.used").alias("used"), F.col("f.dropped").alias("dropped_turns"),
        F.col("f.trunc").alias("truncated_tokens"), F.col("f.warn").alias("warn_turn"), F.col("f.out").alias("exhausted_turn"))


def iteration_log(plan_rows: DataFrame, exec_rows: DataFrame) -> DataFrame:
    """one log with both planner and execution rows."""
    return (plan_rows.withColumn("kind", F.lit("plan"))
            .unionByName(exec_rows.withColumn("kind", F.lit("exec")), allowMissingColumns=True))


# Failure / end-reason vocabularies (F8, F9) and the caps they use.
MAX_EXECUTOR_TURNS = 4
MAX_PLAN_ITERATIONS = 30


def failure_taxonomy(budget: DataFrame, calls: DataFrame, turns: DataFrame,
                     max_turns: int = MAX_EXECUTOR_TURNS) -> DataFrame:
    """F8: why an executor run ended, first matching reason wins:
    context_overflow (turns were discarded, F2) > max_turn (turn cap reached
    without finish) > unfinished (no finish call: the fallback record) > completed."""
    fin = calls.groupBy("conv_id").agg(F.count_if(F.col("function") == "finish").alias("n_finish"))
    nt = turns.filter(F.col("role") == "assistant").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    j = budget.select("conv_id", "dropped_turns").join(nt, "conv_id", "left").join(fin, "conv_id", "left")
    nf = F.coalesce(F.col("n_finish"), F.lit(0))
    reason = (F.when(F.col("dropped_turns") > 0, "context_overflow")
              .when((F.coalesce(F.col("n_turns"), F.lit(0)) >= max_turns) & (nf == 0), "max_turn")
              .when(nf == 0, "unfinished").otherwise("completed"))
    return j.select("conv_id", reason.alias("reason"))


def end_reason(nodes: DataFrame, plan_replies: DataFrame, plan_calls: DataFrame,
               max_iterations: int = MAX_PLAN_ITERATIONS) -> DataFrame:
    """session end reason per rollout, from graphs and planner replies: the answer
    node (D7) has an answer, whatever its status > parse error on the last reply >
    iteration cap > incomplete.  (From an event log: ``sessions.session_ends``.)"""
    is_ans = F.col("node_id").endswith("_answer")
    ans = nodes.groupBy("graph_id").agg(F.max_by(F.when(is_ans, F.col("answer")), F.when(is_ans, F.col("seq"))).alias("said"))
    last = plan_replies.groupBy("graph_id").agg(F.max_by("error", "iteration").alias("last_error"))
    j = plan_calls.join(ans, "graph_id", "left").join(last, "graph_id", "left")
    reason = (F.when(F.coalesce(F.col("said"), F.lit("")) != "", "answer")
              .when(F.col("last_error").isNotNull(), "parse_error")
              .when(F.col("plan_calls") >= max_iterations, "max_iterations").otherwise("incomplete"))
    return j.select("graph_id", reason.alias("reason"))
