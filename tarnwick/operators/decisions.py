"""Decisions beside the scores: judgments from evidence, acceptance bands, quality of evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.operators import series as S
from tarnwick.operators import stats as T

#: Thresholds of the judgment where a task has one of its own.
PASS_THRESHOLDS = {"P25": 0.65, "P40": 0.50}
DEFAULT_THRESHOLD = 0.80
#: Fixed value: what states outright that the event or task did not take place, or that its conditions did not hold.
FAILURE = r"\b(?:event|task)\s+(?:was\s+)?(?:not\s+completed|did\s+not\s+occur|failed)\b|\b(?:condition|conditions)\s+(?:are\s+)?(?:invalid|not\s+satisfied|failed)\b"


def pass_threshold(task: Column) -> Column:
    out = F.lit(DEFAULT_THRESHOLD)
    for name, value in PASS_THRESHOLDS.items():
        out = F.when(task == name, F.lit(value)).otherwise(out)
    return out


def states_failure(text: Column) -> Column:
    """Whether a text states a failed event, in either case of letters."""
    return F.coalesce(text.rlike("(?i)" + FAILURE), F.lit(False))


def metric_judgment(attempted: Column, event_failed: Column, measured: Column, score: Column, threshold: Column) -> Column:
    """One metric: never a failed task without explicit evidence, never a pass or fail without a measurement."""
    return (
        F.when(~attempted, "evidence_insufficient").when(event_failed, "task_failed").when(~measured | score.isNull(), "evidence_insufficient")
        .when(score >= threshold, "physics_pass").otherwise("physics_fail")
    )


def result_judgments(metrics: DataFrame, keys: list[str], judgment: str = "judgment", defined: str = "defined") -> DataFrame:
    """A sample's judgment from those of its defined metrics, with its coverage."""
    own = metrics.filter(F.col(defined))
    has = lambda v: F.bool_or(F.col(judgment) == v)
    every = F.bool_and(F.col(judgment).isin("physics_pass", "physics_fail"))
    said = F.when(has("task_failed"), "task_failed").when(F.bool_and(F.col(judgment) == "physics_pass"), "physics_pass").when(every, "physics_fail").otherwise("evidence_insufficient")
    coverage = F.avg(F.col(judgment).isin("physics_pass", "physics_fail").cast("int"))
    out = own.groupBy(*keys).agg(said.alias("said"), coverage.alias("coverage"))
    every_key = metrics.select(*keys).distinct().join(out, keys, "left")
    return every_key.select(*keys, F.coalesce("said", F.lit("evidence_insufficient")).alias("judgment"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


Get = Callable[[str], Column]
#: Strict bands of the tasks that have them, and the names of the reasons for which a measured sample is not accepted.
BANDS: dict[str, Callable[[Get], dict[str, Column]]] = {
    "P9": lambda m: {"time_ratio_relative_error_gt_10pct": m("m1") > 0.10},
    "P13": lambda m: {"period_ratio_error_gt_0.05": m("m1") > 0.05, "t30_not_greater_than_t15": ~F.coalesce(m("t30") > m("t15"), F.lit(False)), "sinusoid_residual_gt_0.25": m("fit_residual") > 0.25},
    "P11": lambda m: {"acceleration_ratio_relative_error_gt_10pct": m("m1") > 0.10, "return_time_not_longer": ~F.coalesce(m("t_down") > m("t_up"), F.lit(False)), "ramp_angle_fallback": m("angle_fallback") == 1},
    "P20": lambda m: {"index_cv_gt_0.05": m("m1") > 0.05, "pair_count_lt_3": ~F.coalesce(m("pairs") >= 3, F.lit(False)), "total_reflection_not_verified": ~F.coalesce(m("verified") == 1, F.lit(False))},
    "P28": lambda m: {"crushed_not_faster": ~F.coalesce(m("lead") == 1, F.lit(False))},
}


def accepted(df: DataFrame, quantities: str = "quantities", task: str = "task") -> DataFrame:
    """reasons (in order; unknown tasks have one too) and accepted, of samples that were measured."""
    get = lambda n: F.try_element_at(F.col(quantities), F.lit(n))
    reasons = F.array(F.lit("unknown_task"))
    for name, band in BANDS.items():
        found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in band(get).items()]))
        reasons = F.when(F.col(task) == name, F.when(get("m1").isNull(), F.array(F.lit("m1_missing"))).otherwise(found)).otherwise(reasons)
    return df.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)


def velocity_quality(df: DataFrame, keys: list[str], t: str = "t", y: str = "y") -> DataFrame:
    """slope (Theil-Sen), rms of what it leaves, displacement, and usable: three points, little residual, motion beyond its error."""
    fit = T.theil_sen(df, keys, t, y)
    rows = df.filter(F.col(t).isNotNull() & F.col(y).isNotNull()).join(fit, keys)
    left = F.col(y) - F.col("slope") * F.col(t) - F.col("intercept")
    out = rows.groupBy(*keys).agg(F.max("n").alias("n"), F.max("slope").alias("slope"), T.rms(left).alias("rms"), (F.max(t) - F.min(t)).alias("span"))
    out = out.withColumn("displacement", F.abs("slope") * F.col("span"))
    usable = (F.col("n") >= 3) & (F.col("span") > 0) & (F.col("rms") <= F.greatest(F.lit(0.75), 0.15 * F.col("displacement"))) & (F.col("displacement") >= 3 * F.greatest(F.lit(0.35), F.col("rms")))
    return out.select(*keys, "n", "slope", "rms", "displacement", F.coalesce(usable, F.lit(False)).alias("usable"))


def first_descent(df: DataFrame, least: int, fall: float, keys: list[str] = S.KEYS) -> DataFrame:
    """start and stop (exclusive) of the first unbroken run with enough frames and fall from its first value, else of the longest run."""
    found = S.runs(df, S.observed(df), keys)
    rows = df.filter(S.observed(df)).join(found, keys).filter(F.col("i").between(F.col("start"), F.col("end")))
    falls = rows.groupBy(*keys, "start", "end", "n").agg((F.max("y") - F.min_by("y", "i")).alias("fall"))
    fits = (F.col("n") >= least) & (F.col("fall") >= fall)
    out = falls.groupBy(*keys).agg(F.min(F.when(fits, F.struct("start", "end"))).alias("a"), F.max(F.struct("n", (-F.col("start")).alias("k"))).alias("b"))
    start = F.coalesce(F.col("a.start"), -F.col("b.k"))
    return out.select(*keys, start.alias("start"), F.coalesce(F.col("a.end") + 1, F.col("b.n") - F.col("b.k")).alias("stop"))


def release_return(df: DataFrame, keys: list[str] = S.KEYS) -> DataFrame:
    """period: of tracks that cross their mean twice, the time of the observed return to the first value, 0.98 to 1.25 rough periods after it.

    The first value must be an extreme, and the return within 2 % of the amplitude; of several the closest, then the one nearest to the rough period.
    """
    rough = S.crossings(df, keys).groupBy(*keys).agg(F.count("*").alias("n"), (2 * (F.max("tc") - F.min("tc"))).alias("rough")).filter("n = 2 and rough > 0")
    part = S.all_rows(keys)
    rows = df.withColumns({"_y0": F.first("y").over(part), "_t0": F.first("t").over(part), "_lo": F.min("y").over(part), "_hi": F.max("y").over(part)}).join(rough, keys)
    size, since, off = F.col("_hi") - F.col("_lo"), F.col("t") - F.col("_t0"), F.abs(F.col("y") - F.col("_y0"))
    fits = (since >= 0.98 * F.col("rough")) & (since <= 1.25 * F.col("rough")) & (off <= 0.02 * size) & (F.abs(F.col("_y0") - (F.col("_lo") + F.col("_hi")) / 2) >= 0.45 * size)
    return rows.groupBy(*keys).agg(F.min(F.when(fits, F.struct(off.alias("off"), F.abs(since - F.col("rough")).alias("far"), since.alias("since")))).alias("m")).select(*keys, F.col("m.since").alias("period"))


def resampled(df: DataFrame, n: int, keys: list[str] = S.KEYS) -> DataFrame:
    """edge, at, value: the track linearly interpolated at n evenly spaced times from its first to its last."""
    part = S.all_rows(keys)
    w = S.over(keys)
    rows = df.withColumns({"_t0": F.min("t").over(part), "_t1": F.max("t").over(part), "_tn": F.lead("t").over(w), "_yn": F.lead("y").over(w)})
    rows = rows.withColumn("_at", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(k.alias("edge"), (F.col("_t0") + (F.col("_t1") - F.col("_t0")) * k / (n - 1)).alias("at"))))
    mine = F.filter("_at", lambda e: (e["at"] >= F.col("t")) & ((e["at"] < F.col("_tn")) | F.col("_tn").isNull()))
    out = rows.withColumn("_e", F.explode(mine))
    value = F.when(F.col("_tn").isNull() | (F.col("_tn") == F.col("t")), F.col("y")).otherwise(F.col("y") + (F.col("_yn") - F.col("y")) * (F.col("_e.at") - F.col("t")) / (F.col("_tn") - F.col("t")))
    return out.select(*keys, F.col("_e.edge").alias("edge"), F.col("_e.at").alias("at"), value.alias("value"))


def without_drift(df: DataFrame, references: DataFrame, keys: list[str] = ["sample"]) -> DataFrame:  # noqa: B006
    """y less the camera's motion: the median over reference points of their displacement since each one's first frame."""
    first = Window.partitionBy(*keys, "object").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = references.withColumn("_d", F.col("y") - F.first("y").over(first)).groupBy(*keys, "i").agg(F.median("_d").alias("drift"))
    return df.join(moved, [*keys, "i"], "left").withColumn("still", F.col("y") - F.coalesce("drift", F.lit(0.0)))


def rescaled(boxes: Column, sx: Column, sy: Column) -> Column:
    """Boxes (x, y, w, h) on a canvas of another size, rounded half to even."""
    return F.transform(boxes, lambda v, k: F.bround(v * F.when(k % 2 == 0, sx).otherwise(sy)).cast("int"))


def shortened(values: Column, longest: int = 24, ends: int = 6) -> Column:
    """A long series as its length, first and last values; a short one as it is."""
    long = F.size(values) > longest
    return F.struct(F.size(values).alias("n"), F.when(long, F.slice(values, 1, ends)).otherwise(values).alias("head"), F.when(long, F.slice(values, -ends, ends)).alias("tail"))
