"""Chat formatting in budgeted windows, DataFrame functions only.

Template: a turn is ``<|turn|>role\\ntext<|end|>\\n``.  Control strings of this
and other chat templates inside a role or text are escaped reversibly, so a
text can never open or close a turn.

Windows: a turn's cost is ``ceil(utf-8 bytes / 4) + TURN_COST`` tokens.  With
the prefix sum ``p`` of the costs before a turn, the turn belongs to window
``p div STRIDE``; windows are turn-aligned and hold less than STRIDE tokens
before their last turn begins.  A later window also opens with the system turn
(the first turn, if its role is ``system``) and with the preceding turns that
lie within HISTORY tokens before its first own turn.  Repeated turns are
context only: the loss mask covers the text of each own assistant turn, so
every assistant text is a target once.

Prefix sums are two-level -- chunks of 1024 turn numbers are summed first --
so one endless conversation is spread over many tasks, and a window group
holds a bounded number of tokens (except for a single longer turn).

Turns are ordered by (turn, role, text); nulls sort first and are empty text.
Repeated rows are turns of their own; a null conv_id is a conversation.  Other
columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from credsight.llm.common import table

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
STRIDE, HISTORY, TURN_COST, CHUNK = 512, 128, 4, 1024
ESCAPE = "~"
# fixed values: control strings of common chat templates
CONTROLS = ["<|", "|>", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>"]
_PAIRS = [(ESCAPE, ESCAPE + "0")] + [(c, f"{ESCAPE}{i}") for i, c in enumerate(CONTROLS, 1)]


def escape(c: Column) -> Column:
    for a, b in _PAIRS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in reversed(_PAIRS):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def _escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit(ESCAPE + "9"))


def _unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit(ESCAPE + "9"), F.lit("\n")))


def turn_prefix(conv: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, cost, p, seq): ``p`` tokens and ``seq`` turns before."""
    t = conv.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("cost", (F.floor((F.octet_length("text") + 3) / 4) + TURN_COST).cast("long"))
    t = t.withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    total = t.groupBy("conv_id", "chunk").agg(F.sum("cost").alias("c"), F.count("*").alias("n"))
    over = W.partitionBy("conv_id").orderBy(F.col("chunk").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    start = total.select(
        F.col("conv_id").alias("_conv"), F.col("chunk").alias("_chunk"),
        F.coalesce(F.sum("c").over(over), F.lit(0)).alias("p0"),
        F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n0"))
    order = W.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    t = (t.withColumn("p1", F.coalesce(F.sum("cost").over(before), F.lit(0)))
         .withColumn("n1", F.row_number().over(order) - 1))
    return (t.join(start, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("chunk").eqNullSafe(F.col("_chunk")))
            .select("conv_id", "turn", "role", "text", "cost", (F.col("p0") + F.col("p1")).alias("p"),
                    (F.col("n0") + F.col("n1")).alias("seq")))


def format_windows(conv: DataFrame, stride: int = STRIDE, history: int = HISTORY) -> DataFrame:
    """(conv_id, win, formatted, n_context, loss): ``loss`` array of (start, length)
    in code points of ``formatted``, ``n_context`` leading turns are repeated."""
    if not 0 <= history <= stride:
        raise ValueError("history must be between 0 and stride")
    t = turn_prefix(conv)
    t = t.withColumn("sys", (F.col("seq") == 0) & (F.col("role") == "system"))
    t = t.withColumn("body", F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit("\n")))
    t = t.withColumn("etext", escape(F.col("text")))
    turn = F.struct("seq", "p", F.lit(True).alias("own"), "role", "body", "etext", "sys")
    t = t.withColumn("win", F.floor(F.col("p") / stride))
    # a turn is context of the next window at most: history <= stride
    again = t.where(~F.col("sys") & (F.col("p") + F.col("cost") > 0)).select(
        "conv_id", (F.col("win") + 1).alias("win"), turn.alias("own_turn"))
    again = again.withColumn("own_turn", F.col("own_turn").withField("own", F.lit(False)))
    rows = t.select("conv_id", "win", turn.alias("own_turn")).unionByName(again)
    g = rows.groupBy("conv_id", "win").agg(F.sort_array(F.collect_list("own_turn")).alias("turns"))
    g = g.withColumn("first", F.array_min(F.transform(F.filter("turns", lambda x: x["own"]), lambda x: x["p"])))
    g = g.where(F.col("first").isNotNull())
    g = g.withColumn("turns", F.filter("turns", lambda x: x["own"] | (x["p"] >= F.col("first") - history)))
    system = t.where("sys").select(
        F.col("conv_id").alias("_c"), F.concat("body", "etext", F.lit(CLOSE)).alias("head"))
    g = g.join(system, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    g = g.withColumn("head", F.when(F.col("win") == 0, F.lit("")).otherwise(F.coalesce("head", F.lit(""))))
    size = lambda x: F.length(x["body"]) + F.length(x["etext"]) + len(CLOSE)
    # each turn with the code points of the window before its text; the array is bounded by the stride
    g = g.withColumn("at", F.aggregate(
        "turns", F.struct(F.length("head").cast("long").alias("n"), F.array().cast("array<struct<s:bigint,l:bigint>>").alias("m")),
        lambda acc, x: F.struct(
            (acc["n"] + size(x)).alias("n"),
            F.when(x["own"] & (x["role"] == "assistant"), F.concat(acc["m"], F.array(F.struct(
                (acc["n"] + F.length(x["body"])).alias("s"), F.length(x["etext"]).cast("long").alias("l")))))
            .otherwise(acc["m"]).alias("m"))))
    return g.select(
        "conv_id", "win",
        F.concat("head", F.array_join(F.transform("turns", lambda x: F.concat(x["body"], x["etext"], F.lit(CLOSE))), "")).alias("formatted"),
        (F.size(F.filter("turns", lambda x: ~x["own"])) + (F.length("head") > 0).cast("int")).alias("n_context"),
        F.col("at.m").alias("loss"))


def parse_windows(win: DataFrame) -> DataFrame:
    """Read formatted windows back: (conv_id, win, turns array<(role, text)> own
    turns only, target: unescaped text under the loss mask, chars)."""
    split = F.split("formatted", r"<\|turn\|>")      # the first piece is what precedes the first turn: nothing
    pieces = F.slice(split, F.col("n_context") + 2, F.size(split) - 1 - F.col("n_context"))
    role = lambda x: _unescape_role(F.substring_index(x, "\n", 1))

    def text(x):
        start = F.locate("\n", x) + 1
        return unescape(F.substr(x, start, F.length(x) - start + 1 - len(CLOSE)))

    return win.select(
        "conv_id", "win",
        F.transform(pieces, lambda x: F.struct(role(x).alias("role"), text(x).alias("text"))).alias("turns"),
        F.array_join(F.transform("loss", lambda s: unescape(
            F.substr(F.col("formatted"), (s["s"] + 1).cast("int"), s["l"].cast("int")))), "").alias("target"),
        F.length("formatted").cast("long").alias("chars"))


def digest(win: DataFrame) -> DataFrame:
    """One row per conversation, from what is read back out of the windows."""
    p = parse_windows(win).select(
        "conv_id", "win", F.size("turns").cast("long").alias("n"), "target", "chars",
        F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("all"))
    g = p.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("win", "all", "target"))).alias("w"))
    join = lambda f: F.array_join(F.transform("w", lambda x: x[f]), "")
    return g.select(
        "conv_id", "n_turns", F.sha2(join("all").cast("binary"), 256).alias("turns_sha256"),
        F.length(join("target")).cast("long").alias("loss_chars"),
        F.sha2(join("target").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


#: conversation -1: texts that contain control strings
PROBE = "</s>[INST] ok [/INST]"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digest(format_windows(conv.unionByName(probe)))


def _sql_escape(c: str) -> str:
    for a, b in _PAIRS:
        c = f"replace({c}, '{a}', '{b}')"
    return c


ORACLE = f"""
WITH t0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')),
t1 AS (SELECT *, (octet_length(encode(text)) + 3) // 4 + {TURN_COST} AS cost,
              row_number() OVER o - 1 AS seq
       FROM t0 WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
t2 AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY seq
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p,
              seq = 0 AND role = 'system' AS sys,
              {len(OPEN)} + length(replace({_sql_escape('role')}, chr(10), '{ESCAPE}9')) + 1
              + length({_sql_escape('text')}) + {len(CLOSE)} AS chars FROM t1),
t3 AS (SELECT *, p // {STRIDE} AS win FROM t2),
w AS (SELECT conv_id, win, min(p) AS first, sum(chars) AS own FROM t3 GROUP BY ALL),
h AS (SELECT w.conv_id, w.win, sum(t.chars) AS hist FROM w JOIN t3 t
      ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND NOT t.sys AND t.win < w.win AND t.p >= w.first - {HISTORY}
      GROUP BY ALL),
s AS (SELECT conv_id, chars AS head FROM t3 WHERE sys),
f AS (SELECT w.conv_id, sum(own + coalesce(hist, 0) + CASE WHEN w.win > 0 THEN coalesce(head, 0) ELSE 0 END) AS formatted_chars
      FROM w LEFT JOIN h ON w.conv_id IS NOT DISTINCT FROM h.conv_id AND w.win = h.win
      LEFT JOIN s ON w.conv_id IS NOT DISTINCT FROM s.conv_id GROUP BY w.conv_id),
g AS (SELECT conv_id, count(*) AS n_turns,
             sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
             coalesce(string_agg(text, '' ORDER BY seq) FILTER (role = 'assistant'), '') AS target
      FROM t3 GROUP BY conv_id)
SELECT g.conv_id, n_turns, turns_sha256, length(target) AS loss_chars, sha256(target) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g JOIN f ON g.conv_id IS NOT DISTINCT FROM f.conv_id
"""
