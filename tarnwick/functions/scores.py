"""Score maps as column expressions: errors and ratios to scores between 0 and 1.

Null and non-finite inputs give null: Spark's greatest() and least() skip nulls, so every map is guarded.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

CONSISTENCY_WEIGHT, PHYSICS_WEIGHT = 0.15, 0.85


def finite(x: Column) -> Column:
    """The value, or null if it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clip01(x: Column) -> Column:
    return F.when(finite(x).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def residual_score(error: Column, scale: float) -> Column:
    """1 / (1 + |error| / scale)."""
    if not 0 < scale < float("inf"):
        raise ValueError("the scale of a residual must be finite and positive")
    # 0 stands for an infinite error, and for NaN: such errors have no score
    return F.nullif(F.nanvl(1 / (1 + F.abs(error) / scale), F.lit(0.0)), F.lit(0.0))


def half_score(error: Column, half: float) -> Column:
    """half / (half + error) for errors that aren't negative."""
    return F.when(error >= 0, half / (half + finite(error)))


def error_score(error: Column, scale: float = 1.0) -> Column:
    """1 - error / scale, clipped."""
    return clip01(1 - error / scale)


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num, den)


def saturated_ratio(num: Column, den: Column, margin: float) -> Column:
    """(1 - num/den) / margin, clipped; 0 where den is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(clip01((1 - F.try_divide(num, den)) / margin))


def direction_score(value: Column, sign: int = 1) -> Column:
    """1 if the value has the sign, else 0."""
    return F.when(finite(value).isNotNull(), (sign * value > 0).cast("double"))


def count_direction(fewer: Column, more: Column) -> Column:
    """1 if the first count is the smaller one; 0 where the second is 0."""
    return F.when(more == 0, F.lit(0.0)).otherwise((fewer < more).cast("double"))


def angle_score(degrees: Column) -> Column:
    """(1 - cos d) / 2."""
    return (1 - F.cos(F.radians(finite(degrees)))) / 2


def two_halves(first: Column, second: Column) -> Column:
    """Half a point for each of two facts; an unknown second one counts as the lower bound."""
    return F.when(first.isNotNull(), 0.5 * first.cast("double") + 0.5 * F.coalesce(second.cast("double"), F.lit(0.0)))


def floored_quality(error: Column, good: float, floor: float = 0.01) -> Column:
    """Residual score with a floor for what was measured at all."""
    return F.greatest(F.lit(floor), residual_score(error, good))


def high_quality(value: Column, target: float, scale: float, floor: float = 0.01) -> Column:
    """A high-is-good value through what it lacks to a target, floored; the floor where it is missing."""
    return floored_quality(F.greatest(F.lit(0.0), target - finite(value)) + F.lit(0.0) * finite(value), scale, floor)


def evidence_fraction(observed: Column, required: float, floor: float = 0.01) -> Column:
    """The share of required evidence that was observed, between a floor and 1; the floor where it is missing."""
    return F.greatest(F.lit(floor), clip01(observed / required))


def evidence_quality(evidence: Column, scale: float) -> Column:
    """x / (x + scale), a half at the scale; 0 where it is missing or negative."""
    return F.coalesce(F.when(finite(evidence) >= 0, clip01(evidence / (evidence + scale))), F.lit(0.0))


def support_quality(value: Column, anchor: float) -> Column:
    """Linear up to full support at the anchor; 0 where it is missing."""
    return F.coalesce(clip01(F.greatest(F.lit(0.0), finite(value)) / anchor + F.lit(0.0) * finite(value)), F.lit(0.0))


def deflection_balance(left: Column, right: Column, least: float) -> Column:
    """How evenly two deflections oppose each other, times how far the smaller one moved; 0 without any motion."""
    whole = F.abs(left) + F.abs(right)
    symmetry = 1 - F.least(F.lit(1.0), F.try_divide(F.abs(left + right), whole))
    moved = F.least(F.lit(1.0), F.least(F.abs(left), F.abs(right)) / least)
    return F.when(whole == 0, F.lit(0.0)).otherwise(symmetry * moved)


def piecewise_score(value: Column, good: float, bad: float) -> Column:
    """100 up to good, 0 from bad on, linear between."""
    return F.when(finite(value).isNotNull(), 100 * clip01((bad - value) / (bad - good)))


def recognised(score: Column) -> Column:
    """The legacy form 0.15 + 0.85 q, 0 where nothing was measured; no part of totals."""
    return F.when(score.isNull(), F.lit(0.0)).otherwise(0.15 + 0.85 * score)


def worst_and_mean(values: list[Column]) -> Column:
    """0.7 least + 0.3 mean of values that are all present."""
    whole = reduce(lambda a, b: a & b, [v.isNotNull() for v in values])
    return F.when(whole, 0.7 * F.least(*values) + 0.3 * reduce(add, values) / len(values))


def strict_gm_of(values: list[Column]) -> Column:
    """Geometric mean of the columns of a row: null if any is null, 0 if any is 0."""
    return F.pow(reduce(lambda a, b: a * b, values), F.lit(1.0 / len(values)))


def strict_gm(x: Column) -> Column:
    """The same over the rows of a group."""
    return F.when((F.count("*") == 0) | (F.count(x) < F.count("*")), F.lit(None)).when(F.min(x) == 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.ln(F.when(x > 0, x)))))


def weighted_gm(x: Column, weight: Column, floor: float = 0.01) -> Column:
    """Weighted geometric mean of a group, values clipped to floor..1, weights of 0 or less left out."""
    used = F.when(weight > 0, weight)
    held = F.greatest(F.lit(floor), F.least(F.coalesce(finite(x), F.lit(0.0)), F.lit(1.0)))
    return F.exp(F.try_divide(F.sum(used * F.ln(held)), F.sum(used)))


def defined_mean(score: Column, defined: Column) -> Column:
    """Mean over the defined metrics of a group; a missing score counts 0 and its weight stays."""
    return F.try_divide(F.sum(F.when(defined, F.coalesce(score, F.lit(0.0)))), F.sum(defined.cast("int")))


def composite(consistency: Column, physics: Column, evaluated: Column, passed: Column) -> Column:
    """0.15 C + 0.85 P of what passed the gate, 0.15 C of what it rejected, null where it did not judge."""
    return F.when(evaluated & passed, CONSISTENCY_WEIGHT * consistency + PHYSICS_WEIGHT * F.coalesce(physics, F.lit(0.0))).when(evaluated, CONSISTENCY_WEIGHT * consistency)
