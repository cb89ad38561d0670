"""Text, JSON and scalar column functions.

Everything is a built-in expression (regex, higher-order array functions,
JSON functions) except the backward brace scan of C4, which is a per-row
state machine and runs as an Arrow-batched pandas UDF.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tool-call markup patterns, required fields per tool, plan
# status vocabulary, search styles, observation clip length, backoff cap.
CALL_RE = r"(?s)<function=([^>]+)>(.*?)</function>"
PARAM_RE = r"(?s)<parameter=([^>]+)>(.*?)</parameter>"
FENCED_RE = r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```"
REQUIRED_FIELDS = {
    "search": ["query"],
    "open_page": [],
    "finish": ["answer", "explanation", "key_steps", "confidence", "uncertainties"],
    "recall": ["node_id", "goal"],
}
PLAN_STATUSES = ["Success", "Uncertain", "Not Found", "Failed"]
SEARCH_STYLE_WEB = "keyword"
SEARCH_STYLE_EMBEDDING = "sentence"
OBSERVATION_CLIP = 2000
BACKOFF_CAP = 30
# The two quote rewrites of C6, and the errors of a reply (the classifier reads them).
QUOTED_KEY, QUOTED_VALUE = r"(?<=[{,\s])'([^']+)'\s*:", r":\s*'([^']*)'"
ERROR_NO_JSON = "No JSON block found. Output a ```json block with node_statuses and nodes."
ERROR_PARSE = "JSON parse failed. Check double quotes and escaping."
ERROR_SHAPE = "JSON must contain 'node_statuses' (object) and 'nodes' (array)."
PLAN_SCHEMA = ("struct<node_statuses: map<string, string>, "
               "nodes: array<struct<id: string, description: string, prompt: string, dependencies: array<string>>>>")


def extract_calls(text: Column) -> Column:
    """array<struct<function, arguments map>>; a repeated parameter keeps
    its last value (session setting ``spark.sql.mapKeyDedupPolicy=LAST_WIN``);
    values are not trimmed."""
    names = F.regexp_extract_all(text, F.lit(CALL_RE), 1)
    bodies = F.regexp_extract_all(text, F.lit(CALL_RE), 2)
    return F.transform(F.arrays_zip(names.alias("f"), bodies.alias("b")), lambda x: F.struct(
        x["f"].alias("function"),
        F.map_from_arrays(F.regexp_extract_all(x["b"], F.lit(PARAM_RE), 1),
                          F.regexp_extract_all(x["b"], F.lit(PARAM_RE), 2)).alias("arguments")))


def required_for(fn: Column) -> Column:
    c = F.lit(None).cast("array<string>")
    expr = F.when(F.lit(False), c)
    for name, req in REQUIRED_FIELDS.items():
        expr = expr.when(fn == name, F.array(*[F.lit(r) for r in req]).cast("array<string>"))
    return expr.otherwise(F.array().cast("array<string>"))


def missing_fields(fn: Column, args: Column) -> Column:
    """Required fields absent from the call's arguments (in schema order)."""
    return F.array_except(required_for(fn), F.map_keys(args))


def finish_doc(args: Column) -> Column:
    """Finish arguments -> QueryDoc (confidence defaults to '0%')."""
    g = lambda k, dflt="": F.coalesce(args[k], F.lit(dflt))
    return F.struct(g("answer").alias("answer"), g("explanation").alias("explanation"),
                    g("key_steps").alias("key_steps"), g("confidence", "0%").alias("confidence"),
                    g("uncertainties").alias("uncertainties"))


def fenced_block(text: Column) -> Column:
    """C4 step 1: the last fenced ```json block, stripped (NULL when none)."""
    blocks = F.regexp_extract_all(text, F.lit(FENCED_RE), 1)
    return F.when(F.size(blocks) > 0, F.trim(F.element_at(blocks, -1), F.lit(" \t\n\r\f\x0b")))


def last_object(text: str | None) -> str | None:
    """The last balanced {...} of a text, seen from its end.

    Read from the right, ``level`` is the number of closing minus opening
    braces so far.  The object opens at the first '{' that brings the level
    back to 0 after some '}' has raised it from 0 to 1; it closes at the
    latest such '}'.  Quotes are not interpreted.
    """
    if text is None:
        return None
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)[::-1]
    at = np.flatnonzero((code == ord("{")) | (code == ord("}")))
    close = code[at] == ord("}")
    level = np.cumsum(np.where(close, 1, -1))
    ends = np.flatnonzero(close & (level == 1))
    opens = np.flatnonzero(~close & (level == 0))
    if not len(ends) or not (opens := opens[opens > ends[0]]).size:
        return None
    end = ends[np.searchsorted(ends, opens[0]) - 1]
    n = len(code)
    return text[n - 1 - at[opens[0]]:n - at[end]]


@F.pandas_udf(T.StringType())
def brace_scan(texts: pd.Series) -> pd.Series:
    """C4 step 2 on Arrow batches; O(length) per row, no loop over characters."""
    return texts.map(last_object)


def json_block(text: Column) -> Column:
    """C4: fenced block if any, else the brace scan (fenced rows hand it NULL, not their text)."""
    fenced = fenced_block(text)
    return F.coalesce(fenced, brace_scan(F.when(fenced.isNull() & text.contains("}"), text)))


def normalise_quotes(t: Column) -> Column:
    """All ' -> " when the text has no ", else two targeted rewrites."""
    rewritten = F.regexp_replace(F.regexp_replace(t, QUOTED_KEY, "\"$1\":"), QUOTED_VALUE, ": \"$1\"")
    return F.when(t.contains("'") & ~t.contains('"'), F.translate(t, "'", '"')).otherwise(rewritten)


def parse_plan(block: Column) -> Column:
    """C5 + C7: strict parse, else quote-normalised parse; kept only when it is
    an object holding a ``node_statuses`` object and a ``nodes`` array."""
    def typed(t: Column) -> Column:
        v = F.try_parse_json(t)
        ok = (F.schema_of_variant(v).startswith("OBJECT")
              & F.try_variant_get(v, "$.node_statuses", "map<string,string>").isNotNull()
              & F.try_variant_get(v, "$.nodes", "array<variant>").isNotNull())
        return F.when(ok, F.from_json(t, PLAN_SCHEMA))
    strict_obj = F.schema_of_variant(F.try_parse_json(block)).startswith("OBJECT")
    return F.when(strict_obj, typed(block)).otherwise(typed(normalise_quotes(block)))


def plan_error_of(blk: Column, parsed: Column) -> Column:
    """C4/C5/C7 error text from a located block and its parsed plan (NULL when usable)."""
    parsed_ok = F.try_parse_json(blk).isNotNull() | F.try_parse_json(normalise_quotes(blk)).isNotNull()
    return (F.when(blk.isNull() | (blk == ""), F.lit(ERROR_NO_JSON)).when(~parsed_ok, F.lit(ERROR_PARSE))
            .when(parsed.isNull(), F.lit(ERROR_SHAPE)))


def plan_error(text: Column) -> Column:
    """C4/C5/C7 error text of a planner reply (NULL when the plan is usable)."""
    blk = json_block(text)
    return plan_error_of(blk, parse_plan(blk))


def search_style(ability: Column) -> Column:
    """C17: abilities containing 'WebSearch' use the keyword style."""
    return F.when(ability.contains("WebSearch"), F.lit(SEARCH_STYLE_WEB)).otherwise(F.lit(SEARCH_STYLE_EMBEDDING))


def observation_block(text: Column) -> Column:
    """C20: observation text as it enters the transcript (clipped by design)."""
    return F.concat(F.lit("[Observation]\n"), F.substring(text, 1, OBSERVATION_CLIP), F.lit("..."))


def backoff_total(attempts: Column) -> Column:
    """Total wait of ``attempts`` retries, sum of min(2^i, 30)."""
    total = F.aggregate(F.sequence(F.lit(0), attempts - 1), F.lit(0).cast("bigint"),
                        lambda acc, i: acc + F.least(F.pow(F.lit(2), i).cast("bigint"), F.lit(BACKOFF_CAP)))
    return F.when(attempts > 0, total).otherwise(F.lit(0).cast("bigint"))


# Message templates of the prompt renderer (C18); the wording is
# ours -- the reference's prompt texts are content, not computation.
SYSTEM_TEMPLATE = "You are a research agent. Write %s-style search queries."
USER_TEMPLATE = "Question: %s\nTask: %s"


def render_messages(ability: Column, question: Column, task_id: Column) -> Column:
    """Chat messages of a task row: a system message chosen by the
    search style (C17) and a user message holding the question; a missing
    task id renders as 'unknown'."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.format_string(SYSTEM_TEMPLATE, search_style(ability)).alias("content")),
        F.struct(F.lit("user").alias("role"),
                 F.format_string(USER_TEMPLATE, question, F.coalesce(task_id, F.lit("unknown"))).alias("content")))
