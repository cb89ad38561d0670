"""Task-DAG operators over many graphs at once.

Tables: ``nodes(graph_id, seq, iteration, spec_id|node_id, status, description,
prompt, answer, explanation, key_steps, confidence, uncertainties, raw_text)``
and ``deps(graph_id, seq, dep_pos, dep_id)`` (a node's dependency list).

Numeric graph work (edges, counts) is joins and partial aggregates keyed by
(graph_id, node).  Depth, cycles and closure take small graphs in blocks and big
ones, told apart by a count, through joins, so no big graph has to fit in
one task.  Per-graph *text* (frontier lists, ledgers) is one string per
graph by definition; a planner graph is bounded by the agent's iteration
cap, which bounds those aggregates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsight.session import stored

#: graphs of more edges do not pass through one task as a whole
BIG_GRAPH_EDGES = 200_000

# Fixed values of the DAG format.
AWAITING = "Awaiting Evaluation"
NO_DEPS = "[No upstream dependencies]"
DEPS_NOT_FOUND = "[Upstream dependencies not found in graph]"
CONTEXT_SEP = "\n\n---\n\n"
REFINE_BUDGET = 3

# Texts shown to the planner (C14 state, C15 delta, C16 ledger).
EMPTY_GRAPH = "[Empty graph - initial planning]"
NO_RESULTS = "[No new results]"
STATE_HEAD, STATE_NODES = "Total nodes: ", "\n\n=== Executed Nodes ===\n"
DELTA_CHANGES, DELTA_RESULTS = "=== Status Changes ===\n", "=== New Execution Results ===\n"
LEDGER_HEAD, LEDGER_FRONTIER = "### Statuses\n", "\n\n### Frontier"
LEDGER_BUDGET = "\n\n### Refine Budget (3 attempts max per line of inquiry: original + refine1 + refine2)\n"
LEDGER_USED, LEDGER_REACHED = "/3 attempts used", " [BUDGET REACHED]"
LEDGER_AWAITING, LEDGER_UNRESOLVED = "\nAwaiting Evaluation: ", "\nUnresolved (need refine if budget remains): "
NODE_LINES = {"answer": "    Answer: ", "explanation": "    Explanation: ", "key_steps": "    Key Steps: ",
              "confidence": "    Confidence: ", "uncertainties": "    Uncertainties: "}


# ---------------------------------------------------------------------------
# D1 edges, D2 lookup, D3 update
# ---------------------------------------------------------------------------


def resolve_ids(nodes: DataFrame) -> DataFrame:
    """D1 auto id: the k-th node of a graph with an empty id becomes ``t<k>``
    (one window per graph, which the plan cap bounds)."""
    w = Window.partitionBy("graph_id").orderBy("seq")
    k = nodes.filter(F.col("spec_id") == "").select(
        "graph_id", "seq", F.concat(F.lit("t"), F.row_number().over(w).cast("string")).alias("auto_id"))
    return (nodes.join(k, ["graph_id", "seq"], "left")
            .withColumn("node_id", F.when(F.col("spec_id") == "", F.col("auto_id")).otherwise(F.col("spec_id")))
            .drop("auto_id"))


def edges(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """Edge dep -> node only when the dep is already in the graph when the
    node is added (the node registers itself first, so a self-dependency
    makes a self-edge).  -> (graph_id, src, dst, dep_pos, dst_seq)."""
    n = nodes.select("graph_id", "seq", F.col("node_id").alias("dst"))
    s = nodes.select("graph_id", F.col("node_id").alias("dep_id"), F.col("seq").alias("src_seq"))
    return (deps.join(n, ["graph_id", "seq"])
            .join(s, ["graph_id", "dep_id"])
            .filter(F.col("src_seq") <= F.col("seq"))
            .select("graph_id", F.col("dep_id").alias("src"), "dst", "dep_pos", F.col("seq").alias("dst_seq")))


def dependency_lists(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """(graph_id, node_id, dep_pos, dep_id): dependency lists keyed by node id."""
    return deps.join(nodes.select("graph_id", "seq", "node_id"), ["graph_id", "seq"]).select(
        "graph_id", "node_id", "dep_pos", "dep_id")


def has_node(keys: DataFrame, nodes: DataFrame, id_col: str = "node_id") -> DataFrame:
    """Flag keys (graph_id, <id_col>) that name a node of their graph (semi-join semantics)."""
    hit = nodes.select("graph_id", F.col("node_id").alias(id_col), F.lit(True).alias("found"))
    return keys.join(hit, ["graph_id", id_col], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def apply_updates(nodes: DataFrame, updates: DataFrame, order: str | None = None) -> DataFrame:
    """D3: partial update by key.  Several updates of a node are one, its fields
    taken from the last in the column ``order`` (needed if they may differ).  ``updates(graph_id, node_id, <field>...)``;
    NULL fields keep the stored value; unknown ids change nothing (reported
    by :func:`unknown_updates`).  A text transcript updates raw_text only."""
    fields = [c for c in updates.columns if c not in ("graph_id", "node_id", order)]
    if order is None:
        last = [F.first(c, ignorenulls=True) for c in fields]
    else:        # per field, the last value that is not null
        last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))) for c in fields]
    u = updates.groupBy("graph_id", "node_id").agg(*[x.alias(f"_u_{c}") for x, c in zip(last, fields)])
    j = nodes.join(u, ["graph_id", "node_id"], "left")
    for c in fields:
        j = j.withColumn(c, F.coalesce(F.col(f"_u_{c}"), F.col(c))).drop(f"_u_{c}")
    return j


def unknown_updates(nodes: DataFrame, updates: DataFrame) -> DataFrame:
    """D3 return value False: updates whose id is not in the graph."""
    return updates.join(nodes.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_anti")


# ---------------------------------------------------------------------------
# C13 summary, D4 upstream context
# ---------------------------------------------------------------------------


def _line(label: str, c: Column) -> Column:
    return F.when(c != "", F.concat(F.lit(label), c))


def query_doc_summary(node_id: Column, description: Column, status: Column, answer: Column,
                      explanation: Column, key_steps: Column, confidence: Column, uncertainties: Column) -> Column:
    """Summary text, empty parts skipped."""
    return F.concat_ws(
        "\n",
        F.when(node_id != "", F.concat(F.lit("[Node "), node_id, F.lit("] "), description)),
        _line("Status: ", status), _line("Answer: ", answer), _line("Explanation: ", explanation),
        _line("Key Steps: ", key_steps), _line("Confidence: ", confidence), _line("Uncertainties: ", uncertainties))


def summary_col(prefix: str = "") -> Column:
    c = lambda n: F.col(f"{prefix}{n}")
    return query_doc_summary(c("node_id"), c("description"), c("status"), c("answer"), c("explanation"),
                             c("key_steps"), c("confidence"), c("uncertainties"))


def upstream_context(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """Summaries of the *direct* dependencies found in the graph, in
    dependency order, joined by a separator; two sentinel texts."""
    summ = nodes.select("graph_id", F.col("node_id").alias("dep_id"), summary_col().alias("summary"))
    d = dependency_lists(nodes, deps).join(summ, ["graph_id", "dep_id"], "left")
    agg = d.groupBy("graph_id", "node_id").agg(
        F.count(F.lit(1)).alias("n_deps"), F.count("summary").alias("n_found"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("summary").isNotNull(),
                                                                      F.struct("dep_pos", "summary")))),
                                 lambda x: x["summary"]), CONTEXT_SEP).alias("ctx"))
    j = nodes.select("graph_id", "node_id").join(agg, ["graph_id", "node_id"], "left")
    return j.select("graph_id", "node_id",
                    F.when(F.col("n_deps").isNull(), F.lit(NO_DEPS))
                    .when(F.col("n_found") == 0, F.lit(DEPS_NOT_FOUND)).otherwise(F.col("ctx")).alias("context"))


# ---------------------------------------------------------------------------
# D5 refine budget, D6 frontier, D7/D8 answers, D13 counts
# ---------------------------------------------------------------------------


def refine_root(node_id: Column) -> Column:
    """Root line of a refine id: everything before the first '_refine'."""
    return F.substring_index(node_id, "_refine", 1)


def refine_budget(nodes: DataFrame) -> DataFrame:
    """Attempts per root line = 1 + number of refine nodes; only lines
    with a refine are reported; budget reached at >= 3; roots starting 't_'
    count only through their refines.  Ordered by first appearance."""
    is_ref = F.col("node_id").contains("_refine")
    r = nodes.filter(is_ref | ~F.col("node_id").startswith("t_")).select(
        "graph_id", "seq", F.when(is_ref, refine_root(F.col("node_id"))).otherwise(F.col("node_id")).alias("root"),
        is_ref.cast("int").alias("is_ref"))
    g = r.groupBy("graph_id", "root").agg((F.sum("is_ref") + 1).cast("bigint").alias("attempts"),
                                          F.min("seq").alias("first_seq"))
    return g.filter(F.col("attempts") > 1).withColumn("exhausted", F.col("attempts") >= REFINE_BUDGET)


def _ordered_ids(cond: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("seq", "node_id")))),
                                    lambda x: x["node_id"]), ", ")


def frontier(nodes: DataFrame) -> DataFrame:
    """Awaiting ids and unresolved (Uncertain / Not Found) ids in insertion order."""
    return nodes.groupBy("graph_id").agg(
        _ordered_ids(F.col("status") == "").alias("awaiting"),
        _ordered_ids(F.col("status").isin("Uncertain", "Not Found")).alias("unresolved"))


def answer_nodes(nodes: DataFrame) -> DataFrame:
    """The last node whose id ends with '_answer' (per graph)."""
    a = nodes.filter(F.col("node_id").endswith("_answer"))
    return a.groupBy("graph_id").agg(F.max_by("node_id", "seq").alias("answer_node_id"),
                                     F.max_by("answer", "seq").alias("answer_node_answer"))


def final_answer(nodes: DataFrame) -> DataFrame:
    """The answer node's answer when non-empty, else the last non-empty answer."""
    is_ans = F.col("node_id").endswith("_answer")
    g = nodes.groupBy("graph_id").agg(
        F.max_by(F.when(is_ans, F.col("answer")), F.when(is_ans, F.col("seq"))).alias("a1"),
        F.max_by(F.when(F.col("answer") != "", F.col("answer")),
                 F.when(F.col("answer") != "", F.col("seq"))).alias("a2"))
    return g.select("graph_id", F.coalesce(F.when(F.col("a1") != "", F.col("a1")), F.col("a2")).alias("final_answer"))


def counts(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """Nodes, edges and batches per graph."""
    nn = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_nodes"),
                                       F.countDistinct("iteration").alias("n_batches"))
    ne = e.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges"))
    return nn.join(ne, "graph_id", "left").fillna(0, ["n_edges"])


def nodes_per_batch(nodes: DataFrame) -> DataFrame:
    """New nodes per (graph, iteration)."""
    return nodes.groupBy("graph_id", "iteration").agg(F.count(F.lit(1)).alias("new_nodes"))


# ---------------------------------------------------------------------------
# D9 / D10 depth and cycles, D11 closure
# ---------------------------------------------------------------------------


def _blocks(spark) -> int:
    """Blocks of graphs for the grouped passes: several per shuffle partition, so a
    block is a fraction of a partition.  A graph itself is bounded by ``BIG_GRAPH_EDGES``."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _codes(*frames: pd.DataFrame) -> tuple[list[np.ndarray], pd.DataFrame]:
    """One number for each distinct (graph, id) over several two-column frames."""
    cat = pd.concat([f.set_axis(["graph_id", "id"], axis=1) for f in frames if len(f)] or [
        frames[0].set_axis(["graph_id", "id"], axis=1)], ignore_index=True)
    codes = cat.groupby(["graph_id", "id"], sort=False, dropna=False).ngroup().to_numpy()
    first = ~pd.Series(codes).duplicated().to_numpy()
    cuts = np.cumsum([len(f) for f in frames])[:-1]
    return np.split(codes, cuts), cat[first].reset_index(drop=True)


def _depth_block(nodes: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
    """Topological peeling of all graphs of a block at once."""
    (node, src, dst), keys = _codes(nodes[["graph_id", "node_id"]], e[["g", "s"]], e[["g", "t"]])
    n = len(keys)
    left = np.bincount(dst, minlength=n)
    depth = np.where(left == 0, 0, -1)
    front, level = left == 0, 0
    while front.any():
        hit = dst[front[src]]
        left = left - np.bincount(hit, minlength=n)
        level += 1
        front = (depth < 0) & (left == 0)
        depth[front] = level
    done = depth >= 0
    shown = np.maximum(depth, 0)
    got = done[src]
    reach = np.zeros(n, np.int64)
    np.maximum.at(reach, dst[got], depth[src[got]] + 1)      # behind a cycle: what the processed parents give
    shown = np.where(done, shown, reach)
    return pd.DataFrame({"graph_id": nodes["graph_id"], "node_id": nodes["node_id"],
                         "depth": shown[node], "processed": done[node]})


def depths(nodes: DataFrame, e: DataFrame, big_edges: int = BIG_GRAPH_EDGES) -> DataFrame:
    """Longest path from a root by layered topological peeling.

    Most graphs are small (the planner's cap) and many: their nodes and edges meet
    once, in hash blocks of whole graphs, and one numpy pass peels all graphs of a
    block level by level.  Graphs of more than ``big_edges`` edges, found by a count,
    are peeled by joins on (graph, node) instead (:func:`depths_by_level`), with the
    same result.  Nodes on or behind a cycle are never released; they
    keep the depth their processed parents gave them (0 when none), and their
    graph is flagged cyclic.

    -> (graph_id, node_id, depth, processed)
    """
    n = nodes.select("graph_id", "node_id")
    e = stored(e.select("graph_id", "src", "dst"), "graph-edges")
    big = _big_graphs(e, big_edges)
    if big is None:
        return _depths_in_blocks(n, e)
    small = _depths_in_blocks(n.join(big, "graph_id", "left_anti"), e.join(big, "graph_id", "left_anti"))
    return small.unionByName(depths_by_level(n.join(big, "graph_id", "left_semi"), e.join(big, "graph_id", "left_semi")))


def _big_graphs(rows: DataFrame, limit: int) -> DataFrame | None:
    """Graphs of more than ``limit`` rows (at most rows / limit of them); None where there is none."""
    big = stored(rows.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("graph_id"), "graph-big")
    return None if big.isEmpty() else big


def _depths_in_blocks(n: DataFrame, e: DataFrame) -> DataFrame:
    block = F.pmod(F.xxhash64("graph_id"), F.lit(_blocks(n.sparkSession))).alias("_blk")
    n = n.select("graph_id", "node_id", block)
    ed = e.select(F.col("graph_id").alias("g"), F.col("src").alias("s"), F.col("dst").alias("t"), block.alias("_eblk"))
    kind = n.schema["graph_id"].dataType.simpleString()
    return n.groupBy("_blk").cogroup(ed.groupBy("_eblk")).applyInPandas(
        _depth_block, f"graph_id {kind}, node_id string, depth bigint, processed boolean")


def depths_by_level(n: DataFrame, e: DataFrame) -> DataFrame:
    """The same by one step of joins per level, for graphs of any size.

    The state is one row per node that still waits (parents not yet released, depth
    so far).  The nodes released last meet their edges on (graph, src); what they
    release is a partial aggregate per (graph, dst).  Every level is written, so the
    lineage stays short and a lost executor repeats one step.  Rounds: the longest path.
    """
    into = e.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("left"))
    wait = stored(n.distinct().join(into, ["graph_id", "node_id"], "left").select(
        "graph_id", "node_id", F.coalesce("left", F.lit(0)).alias("left"), F.lit(0).cast("bigint").alias("depth")), "graph-wait")
    done = []
    while True:
        free = stored(wait.where("left = 0").select("graph_id", "node_id", "depth"), "graph-level")
        if free.isEmpty():
            break
        done.append(free.withColumn("processed", F.lit(True)))
        given = (free.withColumnRenamed("node_id", "src").join(e, ["graph_id", "src"])
                 .groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("k"), F.max("depth").alias("up")))
        wait = stored(wait.where("left > 0").join(given, ["graph_id", "node_id"], "left").select(
            "graph_id", "node_id", (F.col("left") - F.coalesce("k", F.lit(0))).alias("left"),
            F.greatest("depth", F.coalesce(F.col("up") + 1, F.lit(0))).alias("depth")), "graph-wait")
    out = wait.select("graph_id", "node_id", "depth", F.lit(False).alias("processed"))
    for d in done:
        out = out.unionByName(d)
    # a node that is listed twice has two rows, as in the grouped pass
    return n.join(out, ["graph_id", "node_id"]).select("graph_id", "node_id", "depth", "processed")


def graph_depth(d: DataFrame) -> DataFrame:
    """Per graph: cyclic flag and max depth (0 when cyclic, as the caller records)."""
    g = d.groupBy("graph_id").agg(F.count_if(~F.col("processed")).alias("n_unprocessed"),
                                  F.max("depth").alias("max_depth_raw"))
    return g.select("graph_id", (F.col("n_unprocessed") > 0).alias("cyclic"),
                    F.when(F.col("n_unprocessed") > 0, F.lit(0).cast("bigint"))
                    .otherwise(F.col("max_depth_raw")).alias("max_depth"), "n_unprocessed")


def _closure_block(dl: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
    """All (seed, reached id) pairs of a block: a frontier over the dependency lists."""
    (x, y, s), keys = _codes(dl[["graph_id", "x"]], dl[["graph_id", "y"]], seeds[["g", "s"]])
    s = np.unique(s)
    n = len(keys)
    order = np.argsort(x, kind="stable")
    y = y[order]
    begin = np.searchsorted(x[order], np.arange(n + 1))
    seen = front = s * n + s
    while len(front):
        seed, at = front // n, front % n
        count = begin[at + 1] - begin[at]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[at], count)
        front = np.setdiff1d(np.unique(np.repeat(seed, count) * n + y[step]), seen, assume_unique=True)
        seen = np.union1d(seen, front)
    ids = keys["id"].to_numpy()
    return pd.DataFrame({"graph_id": keys["graph_id"].to_numpy()[seen // n], "seed_id": ids[seen // n], "node_id": ids[seen % n]})


def transitive_deps(nodes: DataFrame, deps: DataFrame, seeds: DataFrame, big_edges: int = BIG_GRAPH_EDGES) -> DataFrame:
    """Transitive dependencies of each seed node, including itself; ids
    not in the graph are included (they just do not expand); cycle-safe.

    As in :func:`depths`, small graphs meet once in hash blocks, big ones go
    through joins on (graph, node).
    ``seeds(graph_id, seed_id)``.  -> (graph_id, seed_id, node_id)
    """
    dl = stored(dependency_lists(nodes, deps).select("graph_id", "node_id", "dep_id"), "graph-deps")
    seeds = seeds.select("graph_id", "seed_id")
    big = _big_graphs(dl, big_edges)
    if big is None:
        return _closure_in_blocks(dl, seeds)
    small = _closure_in_blocks(dl.join(big, "graph_id", "left_anti"), seeds.join(big, "graph_id", "left_anti"))
    return small.unionByName(closure_by_step(dl.join(big, "graph_id", "left_semi"), seeds.join(big, "graph_id", "left_semi")))


def _closure_in_blocks(dl: DataFrame, seeds: DataFrame) -> DataFrame:
    block = F.pmod(F.xxhash64("graph_id"), F.lit(_blocks(dl.sparkSession))).alias("_blk")
    x = dl.select("graph_id", F.col("node_id").alias("x"), F.col("dep_id").alias("y"), block)
    sd = seeds.select(F.col("graph_id").alias("g"), F.col("seed_id").alias("s"), block.alias("_sblk"))
    kind = dl.schema["graph_id"].dataType.simpleString()
    return x.groupBy("_blk").cogroup(sd.groupBy("_sblk")).applyInPandas(
        _closure_block, f"graph_id {kind}, seed_id string, node_id string")


def closure_by_step(dl: DataFrame, seeds: DataFrame) -> DataFrame:
    """The same by semi-naive steps: what was reached last meets its dependencies on
    (graph, node), and what was reached before is taken out.  Every step is written.
    Rounds: the longest shortest path from a seed."""
    dl = dl.distinct().withColumnRenamed("node_id", "x")
    front = stored(seeds.distinct().withColumn("node_id", F.col("seed_id")), "graph-reached")
    seen = front
    while not front.isEmpty():
        step = (front.withColumnRenamed("node_id", "x").join(dl, ["graph_id", "x"])
                .select("graph_id", "seed_id", F.col("dep_id").alias("node_id")).distinct())
        front = stored(step.join(seen, ["graph_id", "seed_id", "node_id"], "left_anti"), "graph-reached")
        seen = seen.unionByName(front)
    return seen


# ---------------------------------------------------------------------------
# D12 status application
# ---------------------------------------------------------------------------


def applicable_verdicts(nodes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A plan's verdicts apply only to nodes of the most recent executed
    batch before the plan (a turn without a reply keeps the old batch).
    -> (graph_id, iteration, node_id, status) of the verdicts that apply."""
    # distinct (graph, iteration) keys of batches and plans; the latest batch
    # before each plan is a running value over that small per-graph list
    # (bounded by the iteration cap) -- no plan x batch pairs are formed
    keys = (nodes.select("graph_id", "iteration", F.col("iteration").alias("b"))
            .unionByName(verdicts.select("graph_id", "iteration", F.lit(None).cast("bigint").alias("b")))
            .groupBy("graph_id", "iteration").agg(F.max("b").alias("b")))
    w = Window.partitionBy("graph_id").orderBy("iteration").rowsBetween(Window.unboundedPreceding, -1)
    prev = (keys.withColumn("prev_b", F.max("b").over(w))
            .join(verdicts.select("graph_id", "iteration").distinct(), ["graph_id", "iteration"])
            .filter(F.col("prev_b").isNotNull()).select("graph_id", "iteration", "prev_b"))
    v = verdicts.join(prev, ["graph_id", "iteration"])
    n = nodes.select("graph_id", "node_id", F.col("iteration").alias("node_it"))
    return v.join(n, ["graph_id", "node_id"]).filter(F.col("node_it") == F.col("prev_b")).select(
        "graph_id", "iteration", "node_id", "status")


# ---------------------------------------------------------------------------
# A8 serialise / deserialise, C14 state text, C16 ledger
# ---------------------------------------------------------------------------

#: fields of a node document, with what a missing key stands for
_DOC_TEXTS = ["description", "prompt", "status"]
_DOC_ANSWER = ["answer", "explanation", "key_steps", "confidence", "uncertainties"]
_DOC_KEYS = ["id", *_DOC_TEXTS, "dependencies", "depth", "query_doc", "transcript", *_DOC_ANSWER]


def serialize(nodes: DataFrame, deps: DataFrame, e: DataFrame) -> DataFrame:
    """A8 to_dict: one JSON document per graph (nodes keyed by id in insertion
    order, with the flat copies of the QueryDoc fields; edges as pairs).

    ``nodes`` may bring ``depth`` (D9), ``turns``, ``failure_reason``, and ``extra``, a JSON
    object of further keys that are kept as they are; what it does not bring is 0 or null."""
    for name, kind in (("depth", "bigint"), ("turns", "bigint"), ("failure_reason", "string"), ("extra", "string")):
        if name not in nodes.columns:
            nodes = nodes.withColumn(name, F.lit(None).cast(kind))
    dl = (dependency_lists(nodes, deps).groupBy("graph_id", "node_id")
          .agg(F.array_sort(F.collect_list(F.struct("dep_pos", "dep_id"))).alias("dl")))
    n = nodes.join(dl, ["graph_id", "node_id"], "left")
    zero = F.lit(0).cast("bigint")
    more = F.trim("extra")
    node = F.when(F.length(more) > 2, F.concat(F.expr("substr(node, 1, length(node) - 1)"), F.lit(","), F.expr("substr(trim(extra), 2)"))) \
        .otherwise(F.col("node"))
    n = n.withColumn("node", F.to_json(F.struct(
        F.col("node_id").alias("id"), "description", "prompt",
        F.coalesce(F.transform("dl", lambda x: x["dep_id"]), F.array().cast("array<string>")).alias("dependencies"),
        "status", F.coalesce("depth", zero).alias("depth"), F.struct(*_DOC_ANSWER).alias("query_doc"),
        F.struct("raw_text", F.coalesce("turns", zero).alias("turns"), "failure_reason").alias("transcript"), *_DOC_ANSWER))) \
        .withColumn("node", node)
    key = F.expr("substr(to_json(array(node_id)), 2, length(to_json(array(node_id))) - 2)")
    nm = n.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.concat(key, F.lit(":"), F.col("node")).alias("v")))).alias("ns"))
    ea = e.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("dst_seq", "dep_pos", "src", "dst"))).alias("es"))
    g = nm.join(ea, "graph_id", "left")
    pairs = F.coalesce(F.to_json(F.transform("es", lambda x: F.array(x["src"], x["dst"]))), F.lit("[]"))
    return g.select("graph_id", F.concat(F.lit('{"nodes":{'), F.array_join(F.transform("ns", lambda x: x["v"]), ","),
                                         F.lit('},"edges":'), pairs, F.lit("}")).alias("doc"))


def _documents(docs: DataFrame) -> DataFrame:
    """Nodes as their own JSON text by id, in document order, and the edges."""
    return docs.select("graph_id", F.from_json("doc", "struct<nodes: map<string, string>, edges: array<array<string>>>").alias("g"))


def deserialize(docs: DataFrame) -> DataFrame:
    """A8 from_dict: JSON documents back to node rows in document order.

    A missing key takes its default: empty text, depth and turns 0, no dependencies, no
    failure reason; answer fields are read from query_doc, or, where there is none, from
    their flat copies.  Keys that are not of the format come back, sorted, as a JSON object in
    ``extra`` (null if none)."""
    n = _documents(docs).select("graph_id", F.size("g.edges").alias("n_edges"), F.posexplode(F.map_entries("g.nodes")).alias("pos", "kv"))
    n = n.withColumn("d", F.try_parse_json("kv.value"))
    get = lambda path, kind: F.try_variant_get("d", f"$.{path}", kind)
    text = lambda c: F.coalesce(c, F.lit(""))
    has_doc = get("query_doc", "variant").isNotNull()
    extra = F.map_filter(F.try_variant_get("d", "$", "map<string, variant>"), lambda k, v: ~k.isin(*_DOC_KEYS))
    return n.select(
        "graph_id", (F.col("pos") + 1).alias("seq"), F.col("kv.key").alias("node_id"), *[text(get(f, "string")).alias(f) for f in _DOC_TEXTS],
        F.coalesce(get("dependencies", "array<string>"), F.array().cast("array<string>")).alias("dependencies"),
        F.coalesce(get("depth", "bigint"), F.lit(0)).cast("bigint").alias("depth"),
        *[text(F.when(has_doc, get(f"query_doc.{f}", "string")).otherwise(get(f, "string"))).alias(f) for f in _DOC_ANSWER],
        text(get("transcript.raw_text", "string")).alias("raw_text"),
        F.coalesce(get("transcript.turns", "bigint"), F.lit(0)).cast("bigint").alias("turns"),
        get("transcript.failure_reason", "string").alias("failure_reason"),
        F.when(F.size(extra) > 0, F.to_json(extra)).alias("extra"), "n_edges")


def deserialize_edges(docs: DataFrame) -> DataFrame:
    """(graph_id, pos, src, dst): the edges of the documents, in order."""
    e = _documents(docs).select("graph_id", F.posexplode("g.edges").alias("pos", "p"))
    return e.select("graph_id", "pos", F.col("p")[0].alias("src"), F.col("p")[1].alias("dst"))


def _node_blocks(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """One text block per node (C14, C15), its dependencies listed in order.
    -> (graph_id, iteration, seq, node_id, block)"""
    dl = (dependency_lists(nodes, deps).groupBy("graph_id", "node_id")
          .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dep_pos", "dep_id"))),
                                        lambda x: x["dep_id"]), ", ").alias("deps_str")))
    n = nodes.join(dl, ["graph_id", "node_id"], "left")
    asked = F.coalesce(F.concat(F.lit(" (deps: "), F.col("deps_str"), F.lit(")")), F.lit(""))
    status = F.when(F.col("status") == "", F.lit(AWAITING)).otherwise(F.col("status"))
    block = F.concat_ws(
        "\n", F.concat(F.lit("["), F.col("node_id"), F.lit("]: "), F.col("description")),
        F.concat(F.lit("    Status: "), status, asked),
        *[_line(label, F.col(name)) for name, label in NODE_LINES.items()], F.lit(""))
    return n.select("graph_id", "iteration", "seq", "node_id", block.alias("block"))


def _joined(order: str, text: str, sep: str) -> Column:
    """The texts of a group in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), sep)


def state_text(nodes: DataFrame, deps: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """C14: full graph state for the planner, nodes in insertion order.
    ``graphs(graph_id)`` lists all graphs; one without nodes has a text of its own."""
    g = _node_blocks(nodes, deps).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), _joined("seq", "block", "\n").alias("body"))
    out = g.select("graph_id", F.concat(F.lit(STATE_HEAD), F.col("n").cast("string"), F.lit(STATE_NODES), F.col("body")).alias("state_text"))
    if graphs is None:
        return out
    return graphs.select("graph_id").distinct().join(out, "graph_id", "left").select(
        "graph_id", F.coalesce("state_text", F.lit(EMPTY_GRAPH)).alias("state_text"))


def ledger_text(nodes: DataFrame) -> DataFrame:
    """Statuses + refine budget (D5) + frontier."""
    status = F.when(F.col("status") == "", F.lit(AWAITING)).otherwise(F.col("status"))
    st = nodes.groupBy("graph_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
            "seq", F.concat(F.col("node_id"), F.lit(": "), status).alias("l")))), lambda x: x["l"]), "\n")
        .alias("statuses"))
    rb = refine_budget(nodes).groupBy("graph_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_seq", F.concat(
            F.col("root"), F.lit(": "), F.col("attempts").cast("string"), F.lit(LEDGER_USED),
            F.when(F.col("exhausted"), F.lit(LEDGER_REACHED)).otherwise(F.lit(""))).alias("l")))),
            lambda x: x["l"]), "\n").alias("budget"))
    fr = frontier(nodes)
    j = st.join(rb, "graph_id", "left").join(fr, "graph_id", "left")
    budget = F.when(F.col("budget").isNotNull(), F.concat(F.lit(LEDGER_BUDGET), F.col("budget"))).otherwise(F.lit(""))
    aw = F.when(F.col("awaiting") != "", F.concat(F.lit(LEDGER_AWAITING), F.col("awaiting")))
    un = F.when(F.col("unresolved") != "", F.concat(F.lit(LEDGER_UNRESOLVED), F.col("unresolved")))
    front = F.when((F.col("awaiting") != "") | (F.col("unresolved") != ""),
                   F.concat(F.lit(LEDGER_FRONTIER), F.coalesce(aw, F.lit("")), F.coalesce(un, F.lit("")))
                   ).otherwise(F.lit(""))
    return j.select("graph_id", F.concat(F.lit(LEDGER_HEAD), F.col("statuses"), budget, front).alias("ledger"))


def delta_text(nodes: DataFrame, deps: DataFrame, applied: DataFrame, plans_df: DataFrame) -> DataFrame:
    """Delta shown to the planner at plan k -- the status changes applied
    by plan k-1 and the results of batch k-1 -- or ``[No new results]``.
    ``applied`` = D12 output; ``plans_df(graph_id, iteration)``."""
    seqs = nodes.select("graph_id", "node_id", "seq")
    ch = (applied.join(seqs, ["graph_id", "node_id"])
          .select("graph_id", (F.col("iteration") + 1).alias("iteration"), "seq",
                  F.concat(F.lit("["), F.col("node_id"), F.lit("]: "), F.col("status")).alias("l"))
          .groupBy("graph_id", "iteration")
          .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "l"))), lambda x: x["l"]), "\n")
               .alias("changes")))
    nb = (_node_blocks(nodes, deps).withColumn("iteration", F.col("iteration") + 1)
          .groupBy("graph_id", "iteration").agg(_joined("seq", "block", "\n").alias("results")))
    j = plans_df.join(ch, ["graph_id", "iteration"], "left").join(nb, ["graph_id", "iteration"], "left")
    parts = F.concat_ws(
        "\n",
        F.when(F.col("changes").isNotNull(), F.concat(F.lit(DELTA_CHANGES), F.col("changes"), F.lit("\n"))),
        F.when(F.col("results").isNotNull(), F.concat(F.lit(DELTA_RESULTS), F.col("results"))))
    return j.select("graph_id", "iteration",
                    F.when(F.col("changes").isNull() & F.col("results").isNull(), F.lit(NO_RESULTS))
                    .otherwise(parts).alias("delta"))
