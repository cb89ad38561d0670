"""Named queries: one Spark callable and (where SQL can express it) one DuckDB
oracle per operator of SURVEY §2.

Query modules register here with :func:`query`; ``__spark_entry__`` exposes
the two dicts.  Every query reads the given tables (or views derived from
them by Spark) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
OPS: dict[str, str] = {}


def query(name: str, ops: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``ops`` lists the SURVEY op ids it covers; ``oracle`` is DuckDB SQL over
    the raw table views (None for operators with no SQL form).
    """
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        OPS[name] = ops
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every query module (registration happens on import); a missing one is an error."""
    import importlib
    for name in MODULES:
        importlib.import_module(f"credsight.plans.{name}")


MODULES = ["q_advantage", "q_losses", "q_eval", "q_graph", "q_rules", "q_text", "q_metrics", "q_sessions", "q_retrieve", "q_stream"]
