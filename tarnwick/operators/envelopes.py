"""The published result of one sample: JSON to typed columns, the rules that it must keep, what an error takes back, and its short form.

Rules are column expressions, each true where it holds or does not apply; a rule whose value is null is broken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.operators.rules import named

#: The version, the two metrics, the parts of a result, states of a run and of a metric, the policy of unobserved zeros, and the weights of the total.
VERSION, METRICS = "vdmbench.evaluation.v4", ("M1", "M2")
PARTS = ("schema_version", "task", "sample", "status", "consistency", "physics", "metrics", "score", "failures", "provenance")
RUN_STATES = ("complete", "partial", "unavailable", "scored_with_zero", "consistency_rejected", "consistency_error", "execution_error")
METRIC_STATES = ("measured", "unmeasurable", "not_observed", "not_run", "not_applicable", "error")
ERROR_STATES = ("execution_error", "consistency_error")
ZERO_SOURCE, ZERO_POLICY = "unobserved_zero_policy", "not_observed_zero_v1"
GATE_WEIGHT, PHYSICS_WEIGHT = 0.15, 0.85

METRIC = "struct<id:string,defined:boolean,status:string,measurement_attempted:boolean,raw_value:string,physics_score:double,evidence:array<string>,evaluation_source:string>"
ENVELOPE = (
    "schema_version string, status string, task struct<id:string>, sample struct<id:string,model:string,seed:long>,"
    " consistency struct<status:string,score:double,threshold:double,passed:boolean,details:struct<forced_rejection:boolean>>,"
    " physics struct<attempted:boolean,status:string,score:double,judgment:string,defined_metrics:int,measured_metrics:int,scored_metrics:int,coverage:double,zero_policy_metrics:array<string>>,"
    f" metrics map<string,{METRIC}>, score struct<total:double,consistency_contribution:double,physics_contribution:double>, provenance struct<unobserved_zero_policy:string>"
)


def parsed(text: Column) -> Column:
    """The result as a struct, null if the text is no JSON object of that form."""
    return F.from_json(text, ENVELOPE)


def in_unit(x: Column) -> Column:
    return ~F.isnan(x) & x.between(0, 1)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def rules(text: Column, e: Column) -> dict[str, Column]:
    """Every rule by name, over the JSON text and the struct made of it."""
    metrics = F.map_entries(e["metrics"])
    each = lambda test: F.forall(metrics, lambda x: F.coalesce(test(x["key"], x["value"]), F.lit(False)))
    states = F.transform(metrics, lambda x: x["value"]["status"])
    state = lambda m: F.coalesce(m["status"], F.lit(""))
    bare = lambda m: m["physics_score"].isNull() & m["raw_value"].isNull()
    tried = lambda m: F.coalesce(m["defined"] & m["measurement_attempted"], F.lit(False))
    gate, physics, score = e["consistency"], e["physics"], e["score"]
    judged = F.coalesce(gate["status"] == "evaluated", F.lit(False))
    passed, attempted = F.coalesce(gate["passed"], F.lit(False)), F.coalesce(physics["attempted"], F.lit(False))
    failed = F.coalesce(e["status"].isin(*ERROR_STATES), F.lit(False))
    zeros = F.array_sort(F.transform(F.filter(metrics, lambda x: state(x["value"]) == "not_observed"), lambda x: x["key"]))
    total = score["total"]
    equation = F.abs(GATE_WEIGHT * gate["score"] + F.when(attempted, PHYSICS_WEIGHT * physics["score"]).otherwise(0.0) - total) <= 1e-9
    same = lambda a, names: F.array_sort(a) == F.array_sort(F.array(*map(F.lit, names)))
    decided = (gate["score"] >= gate["threshold"]) & ~F.coalesce(gate["details"]["forced_rejection"], F.lit(False))
    return {
        "parts": same(F.json_object_keys(text), PARTS),
        "version": e["schema_version"] == VERSION,
        "run_state": e["status"].isin(*RUN_STATES),
        "metric_names": same(F.map_keys(e["metrics"]), METRICS),
        "metric_identity": each(lambda k, m: (m["id"] == k) & m["status"].isin(*METRIC_STATES)),
        "score_range": each(lambda k, m: m["physics_score"].isNull() | in_unit(m["physics_score"])),
        "measured_value": each(lambda k, m: (state(m) != "measured") | (tried(m) & m["physics_score"].isNotNull() & m["raw_value"].isNotNull())),
        "zero_evidence": each(lambda k, m: (state(m) != "not_observed") | (tried(m) & (F.coalesce(m["physics_score"], F.lit(1.0)) == 0) & m["raw_value"].isNull() & (F.size(F.coalesce(m["evidence"], F.array())) > 0) & (F.coalesce(m["evaluation_source"], F.lit("")) == ZERO_SOURCE))),
        "zero_policy": (F.size(zeros) == 0) | (F.coalesce(e["provenance"]["unobserved_zero_policy"], F.lit("")) == ZERO_POLICY),
        "unmeasured_value": each(lambda k, m: state(m).isin("measured", "not_observed") | bare(m)),
        "undefined_metric": each(lambda k, m: F.coalesce(m["defined"], F.lit(False)) | ((state(m) == "not_applicable") & ~F.coalesce(m["measurement_attempted"], F.lit(False)))),
        "gate_values": ~judged | (finite(gate["score"]) & in_unit(gate["score"]) & finite(gate["threshold"])),
        "gate_decision": ~judged | F.coalesce(gate["passed"].isNotNull() & (gate["passed"] == decided), F.lit(False)),
        "physics_without_gate": passed | ~attempted,
        "measured_count": physics["measured_metrics"] == F.size(F.filter(states, lambda s: s == "measured")),
        "zero_assessment": (e["status"] != "scored_with_zero") | (
            (F.size(zeros) > 0) & passed & attempted & (F.coalesce(physics["status"], F.lit("")) == "scored_with_zero") & F.coalesce(F.array_sort(physics["zero_policy_metrics"]) == zeros, F.lit(False)) & F.coalesce(physics["scored_metrics"] == physics["defined_metrics"], F.lit(False))
        ),
        "error_total": ~failed | total.isNull(),
        "error_physics": ~failed | (physics["score"].isNull() & (F.coalesce(physics["judgment"], F.lit("")) == "evidence_insufficient") & (F.coalesce(physics["measured_metrics"], F.lit(-1)) == 0)),
        "error_shares": ~failed | (score["physics_contribution"].isNull() & score["consistency_contribution"].isNull()),
        "error_metrics": ~failed | ~F.exists(states, lambda s: F.coalesce(s.isin("measured", "not_observed"), F.lit(False))),
        "total_range": failed | total.isNull() | in_unit(total),
        "total_equation": failed | total.isNull() | equation,
    }


def checked(df: DataFrame, text: str) -> DataFrame:
    """result (the struct) and broken (names of broken rules, in order) beside each row; what is no JSON object breaks `no_result` alone."""
    df = df.withColumn("result", parsed(F.col(text)))
    read = F.col("result").isNotNull() & F.json_object_keys(F.col(text)).isNotNull()
    return df.withColumn("broken", F.when(read, named(rules(F.col(text), F.col("result")))).otherwise(F.array(F.lit("no_result"))))


def after_error(result: Column, reason: Column) -> Column:
    """The result after an error of the run: earlier successes, measurements and scores are taken back.

    An error in the physics leaves what the gate said; one before it makes the gate's part an error too.
    """
    tried = F.coalesce(result["physics"]["attempted"], F.lit(False))
    nothing = F.lit(None)

    def metric(m):
        defined = F.coalesce(m["defined"], F.lit(False))
        status = F.when(~defined, "not_applicable").when(tried, "error").otherwise("not_run")
        return m.withField("status", status).withField("measurement_attempted", defined & tried).withField("raw_value", nothing.cast("string")).withField("physics_score", nothing.cast("double")).withField("evidence", F.array().cast("array<string>")).withField("evaluation_source", nothing.cast("string"))

    physics, gate, score = result["physics"], result["consistency"], result["score"]
    defined = F.coalesce(physics["defined_metrics"], F.lit(0))
    physics = physics.withField("status", F.when(tried, "unavailable").otherwise("not_run")).withField("score", nothing.cast("double")).withField("judgment", F.lit("evidence_insufficient")).withField("measured_metrics", F.lit(0))
    physics = physics.withField("scored_metrics", F.when(physics["scored_metrics"].isNotNull(), 0)).withField("zero_policy_metrics", F.when(physics["zero_policy_metrics"].isNotNull(), F.array().cast("array<string>"))).withField("coverage", F.when(defined > 0, 0.0))
    failed_gate = gate.withField("status", F.lit("error")).withField("score", nothing.cast("double")).withField("passed", nothing.cast("boolean")).withField("details", nothing.cast("struct<forced_rejection:boolean>"))
    for name in ("total", "consistency_contribution", "physics_contribution"):
        score = score.withField(name, nothing.cast("double"))
    out = result.withField("status", F.when(tried, "execution_error").otherwise("consistency_error")).withField("physics", physics).withField("metrics", F.transform_values(result["metrics"], lambda k, m: metric(m)))
    out = out.withField("consistency", F.when(tried, gate).otherwise(failed_gate)).withField("score", score)
    return F.when(reason.isNull(), result).otherwise(out)


def short_form(df: DataFrame, result: str = "result") -> DataFrame:
    """The fields that summaries read, one row per result."""
    e = F.col(result)
    return df.select(
        e["task"]["id"].alias("task"), e["sample"]["id"].alias("sample"), e["sample"]["model"].alias("model"), e["sample"]["seed"].alias("seed"), e["score"]["total"].alias("total"), e["status"].alias("status"), e["consistency"]["score"].alias("c"),
        e["consistency"]["passed"].alias("passed"), e["physics"]["score"].alias("physics"), e["physics"]["attempted"].alias("attempted"), e["physics"]["judgment"].alias("judgment"), e["physics"]["coverage"].alias("coverage"),
        F.coalesce(e["physics"]["zero_policy_metrics"], F.array().cast("array<string>")).alias("zeros"),
    )


#: Thresholds of needle readings by name, with their usual values.
THRESHOLDS = {
    "min_deflection_deg": 5.0, "symmetry_abs_tol_deg": 5.0, "symmetry_rel_tol": 0.20, "stable_window_sec": 0.5, "stable_angle_range_deg": 3.0, "initial_reference_tolerance_deg": 5.0, "min_valid_fraction": 0.95, "max_gap_sec": 0.10,
    "max_step_deg": 35.0, "max_speed_deg_sec": 360.0, "max_camera_rotation_deg": 0.5, "max_camera_shift_px": 3.0, "max_ellipse_residual": 0.035, "dial_white_saturation_max": 40.0, "dial_white_value_min": 135.0,
    "max_pivot_offset_fraction": 0.15, "max_pivot_drift_fraction": 0.035, "max_needle_line_residual_px": 3.0, "min_red_pixels": 12.0, "detection_threshold": 0.25, "text_threshold": 0.20,
}


def threshold_failures(given: Column) -> Column:
    """Names of thresholds, given as a map, that are not finite and positive or lie beyond their bound; names that there are not are failures too."""
    value = lambda n: F.coalesce(F.try_element_at(given, F.lit(n)).cast("double"), F.lit(THRESHOLDS[n]))
    bound = {"min_valid_fraction": lambda x: x <= 1, "max_step_deg": lambda x: x < 180}
    fine = {n: finite(value(n)) & (value(n) > 0) & bound.get(n, lambda x: F.lit(True))(value(n)) for n in THRESHOLDS}
    unknown = F.array_sort(F.array_except(F.map_keys(given), F.array(*map(F.lit, THRESHOLDS))))
    return F.concat(named(fine), unknown)


def request_failures(models: Column, configured: Column, seeds: Column, timeout: Column, tasks: Column, known: Column) -> Column:
    """Which rules a request for new samples breaks: models named once and configured, seeds named once and not negative, a finite time, known tasks (null: all)."""
    once = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    return named({
        "models": (F.size(models) > 0) & once(models) & (F.size(F.array_except(models, configured)) == 0),
        "seeds": (F.size(seeds) > 0) & once(seeds) & F.forall(seeds, lambda s: F.coalesce(s >= 0, F.lit(False))),
        "timeout": finite(timeout) & (timeout > 0),
        "tasks": tasks.isNull() | (F.size(F.array_except(tasks, known)) == 0),
    })
