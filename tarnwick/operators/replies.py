"""Replies of a judging model: JSON to typed severities and evidence, and the rules that they must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.functions.text import strip_fences

VISUAL, TASK = ("identity", "flicker", "scene", "clarity"), ("subject", "event", "order")
_EVIDENCE = T.StructType().add("start_seconds", T.DoubleType()).add("end_seconds", T.DoubleType()).add("description", T.StringType())
_ITEM = T.StructType().add("severity", T.IntegerType()).add("evidence", T.ArrayType(_EVIDENCE))
_ITEMS = T.MapType(T.StringType(), _ITEM)
_FLAGS = T.StructType().add("multiple_balls", T.BooleanType()).add("strong_background_flicker", T.BooleanType()).add("poor_visual_quality", T.BooleanType())
REPLY = T.StructType().add("reason", T.StringType()).add("assessment", _ITEMS).add("task_assessment", _ITEMS).add("quality_checks", _FLAGS)


def parsed(reply: Column) -> Column:
    """The reply as a struct, null if it is not JSON of that form; a code fence around it is taken off."""
    return F.from_json(strip_fences(reply), REPLY)


def severity(reply: Column, group: str, name: str) -> Column:
    return F.try_element_at(reply[group], F.lit(name))["severity"]


def _has_keys(items: Column, names: tuple[str, ...]) -> Column:
    keys = F.map_keys(items)
    wanted = F.array(*map(F.lit, names))
    return (F.size(F.array_except(keys, wanted)) == 0) & (F.size(F.array_except(wanted, keys)) == 0)


def broken_rules(reply: Column, seconds: Column, tolerance: float = 0.002) -> Column:
    """Names of the rules that a parsed reply breaks, in order; one rule of its own for what is no reply."""
    items = F.concat(F.map_values(reply["assessment"]), F.map_values(reply["task_assessment"]))
    spans = F.flatten(F.transform(items, lambda x: F.coalesce(x["evidence"], F.array().cast(T.ArrayType(_EVIDENCE)))))
    rules = {
        "visual_keys": _has_keys(reply["assessment"], VISUAL),
        "task_keys": _has_keys(reply["task_assessment"], TASK),
        "severity_range": F.forall(items, lambda x: F.coalesce(x["severity"].between(0, 4), F.lit(False))),
        "evidence_missing": F.forall(items, lambda x: (F.coalesce(x["severity"], F.lit(0)) == 0) | (F.size(F.coalesce(x["evidence"], F.array().cast(T.ArrayType(_EVIDENCE)))) > 0)),
        "evidence_order": F.forall(spans, lambda e: F.coalesce(e["start_seconds"] <= e["end_seconds"], F.lit(False))),
        "evidence_outside": F.forall(spans, lambda e: (e["start_seconds"] >= -tolerance) & (e["end_seconds"] <= seconds + tolerance)),
    }
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))
    return F.when(reply.isNull() | reply["assessment"].isNull() | reply["task_assessment"].isNull(), F.array(F.lit("not_a_reply"))).otherwise(found)


def checked(df: DataFrame, reply: str, seconds: str) -> DataFrame:
    """judgment (the parsed reply) and broken (names of broken rules) beside each row."""
    return df.withColumn("judgment", parsed(F.col(reply))).withColumn("broken", broken_rules(F.col("judgment"), F.col(seconds)))
