"""A table that is cut into parts or read by several steps is derived once."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from credsight.streaming import streams as S


def test_a_table_cut_into_parts_is_derived_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    d = spark.range(1000).select("id", F.timestamp_seconds("id").alias("ts")).mapInArrow(look, "id long, ts timestamp")
    path = S.materialise_in_order(d, "t-once", "ts")
    assert seen.value == 1000 and spark.read.parquet(path).count() == 1000


def test_shared_inputs_are_derived_once(spark):
    import __spark_entry__ as E
    from credsight.sources.fixtures import rule_inputs
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString() + str(d.inputFiles())
    assert not [t for t in ("orders", "lineitem") if f"{t}.parquet" in plan(E.queries()["dag_roundtrip"](spark, SF_SMALL))]
    assert not any("orders.parquet" in plan(d) for d in rule_inputs(spark, SF_SMALL))
