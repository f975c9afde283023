"""Rules by which single measurements, pairs, replies and settings pass or fail, with the names of what failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def named(rules: dict[str, Column]) -> Column:
    """The names of the rules that do not hold, in order; an unknown rule does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))


def rebound_failures(ratios: Column, m1: Column, dimensions: dict[str, Column], overall: Column, m1_max: float, dimension_min: float, overall_min: float, ratio_max: float = 0.995) -> Column:
    """Why rebounds do not pass: heights must fall (three ratios at least), M1 and all dimensions must reach their bounds."""
    low = F.array_compact(F.array(*[F.when(v < dimension_min, F.lit(n)) for n, v in dimensions.items()]))
    rules = {
        "rebound_heights_not_strictly_decreasing": (F.size(ratios) >= 3) & F.forall(ratios, lambda r: F.coalesce(r < ratio_max, F.lit(False))),
        "height_time_restitution_consistency_failed": m1 <= m1_max,
        "low_dimensions": F.size(low) == 0,
        "overall_score_below_threshold": overall >= overall_min,
    }
    return F.transform(named(rules), lambda n: F.when(n == "low_dimensions", F.concat(n, F.lit(":"), F.array_join(low, ","))).otherwise(n))


def pendulum_passes(m1: Column, period_cv: Column, fit_r2: Column, m1_max: float, cv_max: float, r2_min: float) -> Column:
    """The law, the steadiness of both periods and both fits must hold."""
    return F.coalesce((m1 <= m1_max) & (period_cv <= cv_max) & (fit_r2 >= r2_min), F.lit(False))


def line_is_sound(inliers: Column, span: Column, rmse: Column, slope: Column, least_inliers: int, least_span: float, most_rmse: float, slopes: tuple[float, float]) -> Column:
    """Whether a fitted ray has enough points, span and precision, and a slope that a ray may have."""
    return F.coalesce((inliers >= least_inliers) & (span >= least_span) & (rmse <= most_rmse) & slope.between(*slopes), F.lit(False))


def surface_is_sound(span: Column, rmse: Column, slope: Column, least_span: float, most_rmse: float, most_slope: float) -> Column:
    """Whether a fitted surface is wide, precise and level enough."""
    return F.coalesce((span >= least_span) & (rmse <= most_rmse) & (F.abs(slope) <= most_slope), F.lit(False))


def switches(df: DataFrame, limit: Column, keys: list[str]) -> DataFrame:
    """Neighbouring observed frames between which y moves faster than a limit a frame: from, to, speed."""
    w = Window.partitionBy(*keys).orderBy("i")
    seen = df.filter("valid").withColumns({"from": F.lag("i").over(w), "_y": F.lag("y").over(w), "limit": limit})
    seen = seen.withColumn("speed", F.abs(F.col("y") - F.col("_y")) / F.greatest(F.lit(1), F.col("i") - F.col("from")))
    return seen.filter(F.col("speed") > F.col("limit")).select(*keys, "from", F.col("i").alias("to"), "speed", "limit")


def tube_limit(bore: float, height: float) -> Column:
    """How fast a meniscus may move: twice the bore, 3 % of the picture's height, or 12 pixels a frame."""
    return F.lit(max(12.0, 2 * bore, 0.03 * height))


def leftovers(rows: DataFrame, pairs: DataFrame, keys: list[str], taken: str, own: str) -> DataFrame:
    """Rows that no pair has taken, where exactly one of a group is left: the isolated one."""
    left = rows.join(pairs.select(*keys, F.col(taken).alias(own)), [*keys, own], "left_anti")
    return left.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter("_n = 1").drop("_n")


def best_frame(df: DataFrame, keys: list[str], complete: Column, quality: str, frame: str) -> DataFrame:
    """The frame of best quality of each group, among complete ones if there are any; of equals the first."""
    best = F.max(F.struct(F.coalesce(complete, F.lit(False)).alias("complete"), F.col(quality).alias("quality"), (-F.col(frame)).alias("first")))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.first")).alias(frame), "b.complete", F.col("b.quality").alias(quality))


def is_subset(part: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many distinct keys of `part` are missing from `whole`, and whether none is."""
    missing = part.select(*keys).distinct().join(whole.select(*keys).distinct(), keys, "left_anti")
    return missing.agg(F.count("*").alias("missing"), (F.count("*") == 0).alias("subset"))


def nmae(residual: Column, level: Column) -> Column:
    """The median absolute residual over the median level of a group."""
    return F.try_divide(F.median(F.abs(residual)), F.abs(F.median(level)))


def median_picture(pixels: DataFrame, keys: list[str], places: list[str], value: str) -> DataFrame:
    """The still background: every place's median over frames. pixels: keys, places, a row for each frame."""
    return pixels.groupBy(*keys, *places).agg(F.median(value).alias(value), F.count(value).alias("frames"))


#: Fixed values of a judging model's settings: backends, ways of input, and ranges.
BACKENDS, INPUTS, STATIC = ("local", "http", "vllm"), ("images", "native_video", "static_sheets", "static_frames"), ("static_sheets", "static_frames")
FRAMES, EDGES, TOKENS, AUDITED = (2, 64), (112, 2048), (32, 4096), {"frames": 24, "max_edge": 640, "device": "cuda:0", "max_new_tokens": 3072}


def settings_failures(df: DataFrame) -> Column:
    """Which rules a row of settings breaks: backend, input_mode, threshold, frames, max_edge, max_new_tokens, timeout, base_url, device."""
    c = F.col
    vllm, static = c("backend") == "vllm", c("input_mode").isin(*STATIC)
    finite = lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))
    rules = {
        "backend": c("backend").isin(*BACKENDS),
        "input_mode": c("input_mode").isin(*INPUTS),
        "native_video": (c("input_mode") != "native_video") | c("backend").isin("local", "vllm"),
        "audited": ~vllm | (c("input_mode").isin("native_video", *STATIC) & (c("frames") == AUDITED["frames"]) & (c("max_edge") == AUDITED["max_edge"]) & (c("device") == AUDITED["device"])),
        "static": ~static | (vllm & (c("max_new_tokens") == AUDITED["max_new_tokens"])),
        "threshold": finite(c("threshold")) & c("threshold").between(0, 1),
        "size": c("frames").between(*FRAMES) & c("max_edge").between(*EDGES),
        "limits": c("max_new_tokens").between(*TOKENS) & finite(c("timeout")) & (c("timeout") > 0),
        "base_url": (c("backend") != "http") | c("base_url").rlike("^https?://"),
    }
    return named(rules)


def evidence_text(df: DataFrame, keys: list[str], windows: int = 4) -> DataFrame:
    """One text for each window of a clip's sampled frames: its observations in order, each window led by the first frame.

    df: keys, frame, second, observation. Frames after the first are dealt into `windows` stretches of equal size.
    """
    w = Window.partitionBy(*keys).orderBy("frame")
    rows = df.withColumns({"_k": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))})
    part = F.floor((F.col("_k") - 1) * windows / F.greatest(F.lit(1), F.col("_n") - 1)).cast("int")
    led = F.when(F.col("_k") == 0, F.sequence(F.lit(0), F.lit(windows - 1))).otherwise(F.array(part))
    rows = rows.withColumn("window", F.explode(led))
    line = F.concat(F.format_string("[%.3f s] ", F.col("second")), F.col("observation"))
    out = rows.groupBy(*keys, "window").agg(F.array_sort(F.collect_list(F.struct("frame", line.alias("line")))).alias("l"))
    return out.select(*keys, "window", F.size("l").alias("frames"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def repaired(first: Column, second: Column) -> Column:
    """A reply, or its one retry where the reply is no JSON: only if the retry has the same strings, numbers and literals in order."""
    scalars = lambda x: F.regexp_extract_all(x, F.lit(SCALAR), 0)
    is_json = lambda x: F.try_parse_json(x).isNotNull()
    return F.when(is_json(first), first).when(is_json(second) & (scalars(first) == scalars(second)), second)


#: Fixed value: the strings, numbers and literals of JSON.
SCALAR = r'"(?:[^"\\]|\\.)*"|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null'
