"""Plan-shape checks and the extension registries (M1-M3)."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from credsight.plans import registry as Reg


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["adv_role_penalised", "adv_grpo", "loss_ppo_token_mean", "dag_edges",
                                  "rule_dup", "open_page", "eval_grouping_sets"])
def test_no_cartesian_product(spark, name):
    p = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p


def test_scans_are_pruned(spark):
    p = _plan(E.queries()["eval_overall"](spark, SF_SMALL))
    assert "ReadSchema: struct<event_type:string,value:double>" in p


def test_passk_uses_group_limit(spark):
    from pyspark.sql import functions as F
    from credsight.operators.advantage import passk
    t = spark.range(100).select(F.col("id").alias("traj_id"), (F.col("id") % 7).alias("uid"),
                                F.col("id").alias("batch_idx"), (F.col("id") * 1.5).alias("score"))
    assert "WindowGroupLimit" in _plan(passk(t))


def test_estimator_registry():
    grpo = Reg.ESTIMATORS.find("grpo")
    assert grpo is Reg.ESTIMATORS.find(Reg.AdvantageEstimator.GRPO)
    with pytest.raises(ValueError, match="grpo"):
        Reg.ESTIMATORS.find("nope")
    with pytest.raises(ValueError):
        Reg.ESTIMATORS.add("grpo")(lambda df: df)
    assert Reg.ESTIMATORS.add("grpo", grpo) is grpo


def test_loss_registry_and_kl_controller():
    f, g = (lambda df: df), (lambda df: df)
    Reg.POLICY_LOSSES.add("vanilla_copy", g)
    Reg.POLICY_LOSSES.add("vanilla_copy")(f)              # the last one counts
    assert Reg.POLICY_LOSSES.find("vanilla_copy") is f
    with pytest.raises(ValueError, match="vanilla"):
        Reg.POLICY_LOSSES.find("nope")
    with pytest.raises(ValueError):
        Reg.kl_controller("adaptive", 0.1, 0.1, 0)
    with pytest.raises(NotImplementedError):
        Reg.kl_controller("other", 0.1)


def test_operators_are_called_by_name(spark):
    tok = spark.createDataFrame([(1, 0, 1, 2.0), (1, 1, 1, 1.0), (2, 0, 1, 4.0)], "traj_id long, pos long, mask int, reward double")
    traj = spark.createDataFrame([(1, "g", 3.0, 1.0), (2, "g", 4.0, 2.0)], "traj_id long, uid string, score double, baseline double")
    inputs = {"tok": tok, "traj": traj, "else": traj}
    # one takes the trajectories, the other both tables
    assert sorted(r.adv for r in Reg.ESTIMATORS.call("grpo", inputs, {"norm_by_std": False}).collect()) == [-0.5, 0.5]
    assert sorted(r.adv for r in Reg.ESTIMATORS.call(Reg.AdvantageEstimator.REMAX, inputs).collect()) == [0.0, 2.0, 2.0]
    with pytest.raises(ValueError, match="missing tok"):
        Reg.ESTIMATORS.call("remax", {"traj": traj})
    with pytest.raises(ValueError, match="unknown nothing"):
        Reg.ESTIMATORS.call("grpo", inputs, {"nothing": 1})
