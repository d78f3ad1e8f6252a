"""Plans, scoring and repair on values of the contract, without a database."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import scoring as S
from strandline.operators.plan_queries import FLAT, SPIKE, plan, step
from strandline.plans import execute as X
from strandline.plans import plan as L
from strandline.plans import repair as W


@pytest.mark.parametrize(
    ("steps", "error", "value"),
    [([FLAT, SPIKE], None, 8.0), ([SPIKE, FLAT], None, 8.0), ([FLAT, step("add_spike", "s2", timestep=99, amplitude=1)], "execution_failed", None), ([step("add_flat", target_value=1e5)], "numeric_range_explosion", None), ([step("add_ramp", slope=1, end_value=2)], "invalid_primitive_args", None)],
)
def test_execution(spark, steps, error, value):
    rows = spark.createDataFrame([(plan(*steps),)], "t string").select(F.from_json("t", L.PLAN).alias("p"))
    got = rows.select(X.execute(F.col("p.steps"), F.lit(40)).alias("x")).first()["x"]
    assert got["error"] == error and (value is None or (len(got["values"]) == 40 and got["values"][7] == value and got["values"][8] == 5.0))


def test_oracle_plan_passes(spark):
    rows = spark.createDataFrame([(S.CASES[0][0], [])], "t string, unsupported array<string>").withColumns({"length": F.lit(40), "plan": F.from_json("t", L.PLAN)})
    rows = rows.withColumn("features", S.spec_features(F.col("plan.steps"), F.array(F.lit("add_dip")), F.lit(S._GOLD_TEXT), F.lit(40))).withColumn("series", X.execute(F.col("plan.steps"), F.lit(40))["values"])
    got = S.evaluate_cases(rows).first()
    assert got["passed"] and got["csr"] == got["primitive_f1"] == 1.0 and got["parameter_error"] == 0.0


def test_repair_keeps_a_good_plan(spark):
    good = plan({**FLAT, "semantic_layer": "segment_structure"}, {**SPIKE, "semantic_layer": "local_event"})
    rows = spark.createDataFrame([(good,)], "t string").select(F.from_json("t", L.PLAN).alias("p"))
    got = rows.select(W.repair(F.col("p"), F.lit(40)).alias("r")).first()["r"]
    assert got["iterations"] == 0 and got["notes"] == []
