"""credsight: rollout analytics on Spark.

Credit assignment, off-policy diagnostics, task-DAG analytics, plan
validation, transcript parsing, retrieval and evaluation rollups over
tables of logged agent rollouts, expressed as DataFrame / SQL jobs.

Every operator is a function ``f(df, ..., cfg) -> DataFrame``; nothing is
collected to the driver except bounded scalars (row counts used for size
checks before a broadcast).
"""

__version__ = "0.1.0"
