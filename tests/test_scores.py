"""Properties of the score maps, and the rules for missing and non-finite values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarnwick.functions import geometry as G
from tarnwick.functions import scores as C
from tarnwick.operators import gate
from tarnwick.operators import records as R


def values(spark, column, xs, kind="x double"):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], f"k int, {kind}")
    return [r.v for r in df.select("k", column.alias("v")).orderBy("k").collect()]


def test_scores_are_between_0_and_1_and_fall_with_the_error(spark):
    X = F.col("x")
    rng = random.Random(1)
    xs = sorted(abs(rng.gauss(0, 3)) for _ in range(200))
    for column in (C.residual_score(X, 0.3), C.half_score(X, 0.3), C.error_score(X, 2.0), C.floored_quality(X, 0.2)):
        got = values(spark, column, xs)
        assert all(0 <= v <= 1 for v in got) and all(a >= b for a, b in zip(got, got[1:]))
    assert values(spark, C.residual_score(X, 0.3), [-0.3, 0.3, 0.0]) == [0.5, 0.5, 1.0]
    with pytest.raises(ValueError):
        C.residual_score(X, 0)


def test_missing_and_non_finite_values_have_no_score(spark):
    X = F.col("x")
    odd = [None, float("nan"), float("inf"), -float("inf")]
    for column in (C.residual_score(X, 1), C.clip01(X), C.direction_score(X), C.piecewise_score(X, 1, 2)):
        assert values(spark, column, odd) == [None] * 4
    assert values(spark, C.half_score(X, 1), [None, -1.0]) == [None, None]
    # what reports a floor says so for missing values too
    assert values(spark, C.high_quality(X, 1, 0.5), odd) == [0.01] * 4 and values(spark, C.high_quality(X, 1, 0.5), [2.0, 0.5]) == [1.0, 0.5]
    assert values(spark, C.evidence_fraction(X, 4), [*odd, 8.0, 2.0]) == [0.01] * 4 + [1.0, 0.5]
    assert values(spark, C.evidence_quality(X, 4), [*odd, -1.0, 4.0]) == [0.0] * 5 + [0.5] and values(spark, C.support_quality(X, 4), [*odd, -1.0, 2.0]) == [0.0] * 5 + [0.5]
    assert values(spark, C.deflection_balance(X, F.lit(-3.0), 6), [3.0, -3.0, 9.0]) == [0.5, 0.0, 0.25]


def test_geometric_means(spark):
    X = F.col("x")
    df = spark.createDataFrame([("a", 0.25), ("a", 1.0), ("b", 0.5), ("b", None), ("c", 0.0), ("c", 0.7), ("d", None)], "g string, x double")
    got = {r.g: r.v for r in df.groupBy("g").agg(C.strict_gm(X).alias("v")).collect()}
    assert got == {"a": pytest.approx(0.5), "b": None, "c": 0.0, "d": None}
    assert values(spark, C.strict_gm_of([X, F.lit(0.25)]), [1.0, 0.0, None]) == [pytest.approx(0.5), 0.0, None]
    w = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0), (0.5, 0.0)], "x double, w double").agg(C.weighted_gm(X, F.col("w")).alias("v")).first().v
    assert w == pytest.approx(0.1)


def test_ratios_and_directions(spark):
    X = F.col("x")
    assert values(spark, C.saturated_ratio(X, F.lit(2.0), 0.2), [0.0, 1.8, 2.0, 3.0, None]) == [1.0, pytest.approx(0.5), 0.0, 0.0, None]
    assert values(spark, C.saturated_ratio(F.lit(1.0), X, 0.2), [0.0]) == [0.0]
    assert values(spark, C.direction_score(X), [0.0, 1.0, -1.0]) == [0, 1, 0] and values(spark, C.count_direction(F.lit(1), F.lit(0)), [0.0]) == [0]
    assert values(spark, C.angle_score(X), [0.0, 90.0, 180.0]) == [0, pytest.approx(0.5), 1]


def test_composite_and_gate(spark):
    X = F.col("x")
    got = values(spark, C.composite(F.lit(0.9), X, F.lit(True), X.isNotNull()), [0.5, None])
    assert got == [pytest.approx(0.15 * 0.9 + 0.85 * 0.5), pytest.approx(0.135)]
    assert values(spark, C.composite(F.lit(0.9), X, F.lit(False), F.lit(False)), [0.5]) == [None]
    sev = lambda **k: {n: F.lit(k.get(n, 0)) for n in ("identity", "flicker", "scene", "clarity")}
    task = lambda v: {n: F.lit(v) for n in ("subject", "event", "order")}
    for visual, level, want, forced in ((sev(), 0, 1.0, 0), (sev(clarity=3), 0, 0.7, 0), (sev(identity=3), 0, 0.49, 1), (sev(), 1, 0.85, 0), (sev(), 3, 0.40, 3), (sev(scene=4, flicker=4, clarity=4), 0, 0.0, 5)):
        score, reasons = gate.gate_score(visual, task(level), {})
        row = spark.range(1).select(score.alias("s"), F.size(reasons).alias("n")).first()
        assert (row.s, row.n) == (pytest.approx(want), forced)


def test_geometry(spark):
    X = F.col("x")
    assert values(spark, G.vector_angle(F.lit(1.0), F.lit(0.0), X, F.lit(1.0)), [0.0, 1.0, -1.0]) == [pytest.approx(90), pytest.approx(45), pytest.approx(135)]
    assert values(spark, G.vector_angle(F.lit(1.0), F.lit(1.0), X, X), [3.0, 0.0]) == [pytest.approx(0, abs=1e-5), None]
    assert values(spark, G.wrap180(X), [190.0, -190.0, 540.0]) == [-170, 170, -180]
    assert values(spark, G.cross_ratio(F.lit(0.0), F.lit(1.0), F.lit(2.0), X), [3.0]) == [pytest.approx(4 / 3)]
    assert values(spark, G.incline_ratio(X, 0.2), [45.0]) == [pytest.approx(1.5)] and math.isclose(G.ROLLING_RATIO, 1.19522861)


def test_groups_of_errors_only_stay_in_the_summary(spark):
    df = spark.createDataFrame([("m", "P1", 1, None, None, "execution_error", 0.8, False), ("n", "P10", 2, 0.9, 0.5, "complete", 0.8, False), ("n", "P2", 3, 0.7, 0.5, "complete", 0.8, False)], "model string, task string, sample long, c double, physics double, status string, threshold double, forced boolean")
    got = {r.model: r for r in R.summarize(R.totals(df), "model").collect()}
    assert (got["m"].videos, got["m"].errors, got["m"].total_mean) == (1, 1, None)
    assert (got["n"].scored, got["n"].consistency_passed, got["n"].physics_evaluated) == (2, 1, 1) and got["n"].total_mean == pytest.approx((0.56 + 0.105) / 2)
    assert R.grouped_summaries(R.totals(df)).count() == 1 + 2 + 3
    assert {r.counts["complete"] for r in R.status_counts(df, "model").collect() if "complete" in r.counts} == {2}
