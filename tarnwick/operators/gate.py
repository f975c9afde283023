"""The consistency gate: severities of seven dimensions and three flags to a score and a verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Penalties of severities 0 to 4, ceilings of task severities, the cap of a forced rejection.
PENALTIES = (0.0, 0.05, 0.15, 0.30, 0.50)
CEILINGS = (1.0, 0.85, 0.65, 0.40, 0.15)
FORCED_CAP, THRESHOLD = 0.49, 0.8


def lookup(values: tuple[float, ...], severity: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), severity.cast("int"))


def visual_score(severities: list[Column]) -> Column:
    """1 less the penalties, not below 0, to six decimals."""
    return F.round(F.greatest(F.lit(0.0), 1 - sum((lookup(PENALTIES, s) for s in severities), F.lit(0.0))), 6)


def forced_reasons(visual: dict[str, Column], task: dict[str, Column], flags: dict[str, Column]) -> Column:
    """Why a reply is rejected whatever its score: names of severities and flags.

    visual: identity, flicker, scene, clarity; task: any names; flags: multiple_balls, flicker, poor_quality, with the task's conditions in them.
    """
    reasons = [F.when(s >= 4, F.lit(f"{n}_4")) for n, s in visual.items()]
    reasons += [F.when(visual[n] >= 3, F.lit(f"{n}_3")) for n in ("identity", "flicker", "scene") if n in visual]
    reasons += [F.when(s >= 3, F.lit(f"{n}_3")) for n, s in task.items()]
    reasons += [F.when(f, F.lit(n)) for n, f in flags.items()]
    return F.array_compact(F.array(*reasons))


def gate_score(visual: dict[str, Column], task: dict[str, Column], flags: dict[str, Column]) -> tuple[Column, Column]:
    """The capped score and the reasons that force a rejection."""
    reasons = forced_reasons(visual, task, flags)
    score = visual_score(list(visual.values()))
    ceiling = F.least(*[lookup(CEILINGS, s) for s in task.values()])
    capped = F.least(score, ceiling)
    return F.when(F.size(reasons) > 0, F.least(capped, F.lit(FORCED_CAP))).otherwise(capped), reasons


def passes(score: Column, reasons: Column, threshold: float = THRESHOLD) -> Column:
    return (score >= threshold) & (F.size(reasons) == 0)
