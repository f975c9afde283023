"""Each rule of a published result by a case that breaks it alone, and what errors take back."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from tarnwick.operators import envelopes as E


def metric(key, **more):
    return {"id": key, "defined": True, "status": "measured", "measurement_attempted": True, "raw_value": {"x": 1.5}, "physics_score": 0.5, "evidence": []} | more


UNDEFINED = {"defined": False, "status": "not_applicable", "measurement_attempted": False, "raw_value": None, "physics_score": None}
GOOD = {
    "schema_version": E.VERSION, "task": {"id": "P7", "group": "g"}, "sample": {"id": "s1", "model": "m", "seed": 3}, "status": "complete",
    "consistency": {"status": "evaluated", "score": 0.9, "threshold": 0.8, "passed": True, "details": {"forced_rejection": False}},
    "physics": {"attempted": True, "status": "complete", "score": 0.5, "judgment": "physical", "defined_metrics": 2, "measured_metrics": 2, "coverage": 1.0},
    "metrics": {"M1": metric("M1"), "M2": metric("M2", raw_value=2)}, "score": {"total": 0.15 * 0.9 + 0.85 * 0.5, "consistency_contribution": 0.135, "physics_contribution": 0.425}, "failures": [], "provenance": {"evaluator_version": "v4"},
}
ZERO = {"status": "not_observed", "physics_score": 0.0, "raw_value": None, "evidence": ["frame 3"], "evaluation_source": E.ZERO_SOURCE}


def changed(base, **paths):
    """A copy with values at paths such as physics__score; a value of ... takes the key away."""
    out = copy.deepcopy(base)
    for path, value in paths.items():
        *way, last = path.split("__")
        at = out
        for k in way:
            at = at[k]
        if value is ...:
            del at[last]
        else:
            at[last] = value
    return out


ZEROED = changed(
    GOOD, status="scored_with_zero", metrics__M2=metric("M2", **ZERO), provenance__unobserved_zero_policy=E.ZERO_POLICY,
    physics={"attempted": True, "status": "scored_with_zero", "score": 0.25, "judgment": "physical", "defined_metrics": 2, "measured_metrics": 1, "scored_metrics": 2, "zero_policy_metrics": ["M2"]}, score__total=0.15 * 0.9 + 0.85 * 0.25,
)
FAILED = changed(
    GOOD, status="execution_error", metrics__M1=metric("M1", status="error", raw_value=None, physics_score=None), metrics__M2=metric("M2", **UNDEFINED),
    physics={"attempted": True, "status": "unavailable", "score": None, "judgment": "evidence_insufficient", "defined_metrics": 1, "measured_metrics": 0}, score={"total": None, "consistency_contribution": None, "physics_contribution": None},
)
REJECTED = changed(
    GOOD, status="consistency_rejected", consistency__score=0.5, consistency__passed=False, metrics__M1=metric("M1", status="not_run", measurement_attempted=False, raw_value=None, physics_score=None), metrics__M2=metric("M2", **UNDEFINED),
    physics={"attempted": False, "status": "not_run", "score": None, "judgment": "evidence_insufficient", "defined_metrics": 1, "measured_metrics": 0}, score__total=0.075,
)
BROKEN = {
    "parts": changed(GOOD, failures=...), "version": changed(GOOD, schema_version="v3"), "run_state": changed(GOOD, status="done"), "metric_names": changed(GOOD, metrics__M2=..., metrics__M3=metric("M3")), "metric_identity": changed(GOOD, metrics__M1__id="M2"),
    "score_range": changed(GOOD, metrics__M1__physics_score=1.2), "measured_value": changed(GOOD, metrics__M1__raw_value=None), "zero_evidence": changed(ZEROED, metrics__M2__evidence=[]), "zero_policy": changed(ZEROED, provenance={}),
    "unmeasured_value": changed(FAILED, metrics__M1__raw_value=4), "undefined_metric": changed(REJECTED, metrics__M2__measurement_attempted=True), "gate_values": changed(REJECTED, consistency__score=None, score__total=None), "gate_decision": changed(GOOD, consistency__details__forced_rejection=True),
    "physics_without_gate": changed(GOOD, consistency__passed=False, consistency__status="error"), "measured_count": changed(GOOD, physics__measured_metrics=1), "zero_assessment": changed(ZEROED, physics__zero_policy_metrics=["M1"]), "error_total": changed(FAILED, score__total=0.3),
    "error_physics": changed(FAILED, physics__score=0.1), "error_shares": changed(FAILED, score__physics_contribution=0.1), "error_metrics": changed(FAILED, metrics__M1=metric("M1"), physics__measured_metrics=1), "total_range": changed(GOOD, score__total=1.5), "total_equation": changed(GOOD, score__total=0.5),
}
#: Rules that cannot break alone.
TOGETHER = {"gate_values": ["gate_values", "gate_decision"], "error_metrics": ["error_physics", "error_metrics"], "total_range": ["total_range", "total_equation"], "measured_count": ["measured_count"]}


def broken(spark, *results):
    rows = spark.createDataFrame([(k, r if isinstance(r, str) or r is None else json.dumps(r)) for k, r in enumerate(results)], "k int, text string")
    return [r.broken for r in E.checked(rows, "text").orderBy("k").collect()]


def test_good_results_break_nothing(spark):
    assert broken(spark, GOOD, ZEROED, FAILED, REJECTED) == [[]] * 4


def test_each_rule_is_broken_by_its_case(spark):
    assert list(BROKEN) == list(E.rules(F.col("a"), E.parsed(F.col("a"))))
    for name, found in zip(BROKEN, broken(spark, *BROKEN.values())):
        assert found == TOGETHER.get(name, [name]), name


def test_what_is_no_result(spark):
    found = broken(spark, None, "", "[1]", "no json", "{}")
    assert found[:4] == [["no_result"]] * 4 and "parts" in found[4] and "run_state" in found[4]
    assert broken(spark, changed(GOOD, metrics__M1__physics_score=float("nan"))) == [["no_result"]]  # NaN is not in JSON


@pytest.mark.parametrize("base, status", [(GOOD, "execution_error"), (ZEROED, "execution_error"), (REJECTED, "consistency_error")])
def test_errors_take_successes_back(spark, base, status):
    df = E.checked(spark.createDataFrame([(json.dumps(base),)], "text string"), "text")
    wrong = df.withColumn("result", E.after_error(F.col("result"), F.lit("lost")))
    (r,) = wrong.collect()
    assert r.result.status == status and r.result.score.total is None and r.result.physics.measured_metrics == 0 and (r.result.consistency.score is None) == (status == "consistency_error")
    (again,) = wrong.select(E.named({n: c for n, c in E.rules(F.col("text"), F.col("result")).items()}).alias("broken")).collect()
    assert again.broken == []
    (same,) = df.withColumn("result", E.after_error(F.col("result"), F.lit(None).cast("string"))).collect()
    assert same.result == df.first().result


def test_the_short_form(spark):
    df = E.checked(spark.createDataFrame([(json.dumps(ZEROED),)], "text string"), "text")
    (r,) = E.short_form(df).collect()
    assert (r.task, r.sample, r.model, r.seed, r.status, r.passed, r.physics, r.zeros) == ("P7", "s1", "m", 3, "scored_with_zero", True, 0.25, ["M2"])


def test_thresholds_and_requests(spark):
    rows = [({},), ({"max_step_deg": 180.0, "min_red_pixels": 0.0},), ({"min_valid_fraction": 1.5, "other": 1.0},), ({"max_gap_sec": float("nan"), "text_threshold": float("inf")},)]
    df = spark.createDataFrame(rows, "given map<string,double>")
    assert [r.f for r in df.select(E.threshold_failures(F.col("given")).alias("f")).collect()] == [[], ["max_step_deg", "min_red_pixels"], ["min_valid_fraction", "other"], ["max_gap_sec", "text_threshold"]]
    rows = [(["a"], [1, 2], 5.0, None), (["a", "a"], [1], 5.0, ["P1"]), (["z"], [1, 1], 0.0, ["P9"]), ([], [-1], float("inf"), [])]
    df = spark.createDataFrame(rows, "models array<string>, seeds array<int>, timeout double, tasks array<string>")
    some = lambda *x: F.array(*map(F.lit, x))
    found = [r.f for r in df.select(E.request_failures(F.col("models"), some("a", "b"), F.col("seeds"), F.col("timeout"), F.col("tasks"), some("P1", "P2")).alias("f")).collect()]
    assert found == [[], ["models"], ["models", "seeds", "timeout", "tasks"], ["models", "seeds", "timeout"]]
