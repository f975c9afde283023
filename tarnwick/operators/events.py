"""Events that need levels before and behind them: sustained rises, the start of a discharge, chains of arcs.

Tracks as in operators.series: keys..., i (from any start, one row per frame), t, y, valid; all by window and aggregate expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.operators.series import KEYS, all_rows, observed, over
from tarnwick.operators.stats import MAD_SCALE

#: Fixed values of a rise, in pixels and shares: range of a steady level, least rise, least share and number of seen frames, an abrupt step, and frames that hold the half level.
LEVEL_RANGE, LEAST_RISE, SEEN_SHARE, SEEN_FRAMES, STEP_PIXELS, STEP_SHARE, HELD = 2.0, 8.0, 0.65, 8, 5.0, 0.15, 3
#: The names of what may be missing, in the order of the checks.
RISE_FLAGS = ("first_level", "last_level", "small_rise", "long_gap", "coverage", "abrupt_step", "no_half_crossing")


def rise_events(df: DataFrame, window: int, gap: int, keys: list[str] = KEYS) -> DataFrame:
    """keys, first_level, last_level, rise, half_frame, half_time, rate, flags of a surface that rises (y downwards).

    Both levels are medians of the seen frames among the first and last `window`, of which at most one may be missing, and must be
    steady. The half rise is the first frame that passes the middle level between seen neighbours and is held. A gap of more than `gap`
    frames is a fault unless the surface stands still over it away from the middle level. half_frame, half_time and rate are null if any flag is raised.
    """
    w, every = over(keys), all_rows(keys)
    seen = observed(df)
    df = df.withColumns({"_k": F.row_number().over(w) - 1, "_n": F.count("*").over(every), "_y": F.when(seen, F.col("y"))})
    ends = {"first": F.col("_k") < window, "last": F.col("_k") >= F.col("_n") - window}
    part = lambda c: F.when(c, F.col("_y"))
    levels = df.groupBy(*keys).agg(
        F.count("_y").alias("_seen"), F.max("_n").alias("_n"), (F.max("t") - F.min("t")).alias("_span"),
        *[x for n, c in ends.items() for x in (F.count(part(c)).alias(f"_{n}"), (F.max(part(c)) - F.min(part(c))).alias(f"_{n}_range"), F.percentile(part(c), F.lit(0.5)).alias(f"_{n}_level"))],
    )
    steady = lambda n: F.when((F.col(f"_{n}") >= window - 1) & (F.col(f"_{n}_range") <= LEVEL_RANGE), F.col(f"_{n}_level"))
    levels = levels.select(*keys, "_seen", "_n", "_span", steady("first").alias("first_level"), steady("last").alias("last_level")).withColumn("rise", F.col("first_level") - F.col("last_level"))
    marked = df.drop("_n").join(levels, keys)
    middle = (F.col("first_level") + F.col("last_level")) / 2
    # between a seen frame and the one seen before it
    before = lambda c: F.last(F.when(F.col("_y").isNotNull(), F.col(c)), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    y0, k0 = before("_y"), before("_k")
    step = F.abs(F.col("_y") - y0)
    spans_middle = F.coalesce(middle.between(F.least("_y", y0), F.greatest("_y", y0)), F.lit(True))
    open_gap = (F.col("_k") - k0 - 1 > gap) & ((step > 2 * LEVEL_RANGE) | spans_middle)
    above = F.col("_y") <= middle
    held = above
    for ahead in range(1, HELD):
        held = held & F.lead(above, ahead).over(w)
    crossing = held & (F.lag("_y").over(w) > middle)
    marked = marked.withColumns({"_open": F.coalesce(open_gap, F.lit(False)), "_step": step, "_cross": F.coalesce(crossing, F.lit(False))})
    found = marked.groupBy(*keys).agg(
        F.first("first_level").alias("first_level"), F.first("last_level").alias("last_level"), F.first("rise").alias("rise"), F.first("_seen").alias("_seen"), F.first("_n").alias("_n"), F.first("_span").alias("_span"),
        F.max("_open").alias("_open"), F.max("_step").alias("_step"), F.min(F.when(F.col("_cross"), F.struct("_k", "i", "t"))).alias("_half"),
    )
    large = F.coalesce(F.col("rise") >= LEAST_RISE, F.lit(False))
    faults = (
        F.col("first_level").isNull(), F.col("last_level").isNull(), F.coalesce(F.col("rise") < LEAST_RISE, F.lit(False)), F.col("_open"), F.col("_seen") < F.greatest(F.lit(SEEN_FRAMES), F.floor(F.col("_n") * SEEN_SHARE)),
        large & F.coalesce(F.col("_step") > F.greatest(F.lit(STEP_PIXELS), STEP_SHARE * F.col("rise")), F.lit(False)), large & F.col("_half").isNull(),
    )
    flags = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in zip(RISE_FLAGS, faults)]), lambda x: x.isNotNull())
    found = found.withColumn("flags", flags)
    fine = (F.size("flags") == 0) & large
    return found.select(
        *keys, "first_level", "last_level", "rise", F.when(fine, F.col("_half.i")).alias("half_frame"), F.when(fine, F.col("_half.t")).alias("half_time"), F.when(fine, F.try_divide("rise", "_span")).alias("rate"), "flags"
    )


#: Fixed value: the share of a window that must lie below the first level.
LOW_SHARE = 0.8


def discharge_starts(df: DataFrame, window: float, snr: float = 3.0, keys: list[str] = KEYS) -> DataFrame:
    """keys, start, reason: the frame from which a volume (y) is measured.

    The first `window` seconds give a slope with its error. If the volume falls there already, or they hold fewer than three
    frames, all frames count. Otherwise a wait precedes the discharge: it ends at the frame before the first one below the first level's median
    by `snr` robust deviations in the first window of which 80 % lie as low. Windows that the track does not hold in full are not looked at.
    """
    reach = f"{window + 1e-9!r}D"
    df = df.filter(observed(df))
    w = over(keys)
    rows = df.withColumns({"_k": F.row_number().over(w) - 1, "_t0": F.min("t").over(all_rows(keys)), "_t1": F.max("t").over(all_rows(keys)), "_top": F.max(F.abs("y")).over(all_rows(keys))})
    rows = rows.withColumn("_early", F.col("t") <= F.col("_t0") + window + 1e-9)
    early = rows.filter("_early")
    line = early.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("_k").alias("_from"), F.regr_slope("y", "t").alias("_s"), F.regr_sxx("y", "t").alias("_xx"), F.regr_syy("y", "t").alias("_yy"), F.regr_sxy("y", "t").alias("_xy"), F.percentile("y", F.lit(0.5)).alias("_level"))
    spread = early.join(line.select(*keys, "_level"), keys).groupBy(*keys).agg(F.percentile(F.abs(F.col("y") - F.col("_level")), F.lit(0.5)).alias("_mad"))
    error = F.sqrt(F.greatest(F.lit(0.0), F.col("_yy") - F.col("_s") * F.col("_xy")) / F.greatest(F.lit(1), F.col("_n") - 2) / F.col("_xx"))
    line = line.join(spread, keys).withColumn("_falling", (F.col("_n") >= 3) & (-F.col("_s") > snr * error))
    limit = F.col("_level") - snr * F.greatest(MAD_SCALE * F.col("_mad"), 2.220446049250313e-14 * F.greatest(F.lit(1.0), F.col("_top")))
    rows = rows.join(line.select(*keys, "_n", "_from", "_falling", "_level", "_mad"), keys).withColumn("_low", F.col("y") < limit)
    share = F.expr(f"avg(cast(_low as int)) OVER (PARTITION BY {', '.join(keys)} ORDER BY t RANGE BETWEEN CURRENT ROW AND {reach} FOLLOWING)")
    crossing = F.expr(f"min(CASE WHEN _low THEN _k END) OVER (PARTITION BY {', '.join(keys)} ORDER BY t RANGE BETWEEN CURRENT ROW AND {reach} FOLLOWING)")
    rows = rows.withColumns({"_share": share, "_crossing": crossing, "_before": F.lag("i").over(w)})
    fits = (F.col("_k") >= F.col("_from")) & (F.col("_t1") - F.col("t") >= window - 1e-9) & (F.col("_share") >= LOW_SHARE)
    found = rows.groupBy(*keys).agg(F.min(F.when(fits, F.struct("_k", "_crossing"))).alias("_found"), F.min("i").alias("_first"), F.first("_n").alias("_n"), F.first("_falling").alias("_falling"))
    found = found.withColumn("_at", F.greatest(F.lit(0), F.col("_found._crossing") - 1))
    frames = rows.select(*keys, F.col("_k").alias("_at"), F.col("i").alias("_frame"))
    reason = F.when(F.col("_n") < 3, "few_frames").when(F.col("_falling"), "falling_at_first").when(F.col("_found").isNull(), "no_start_seen").otherwise("after_wait")
    out = found.withColumn("reason", reason).join(frames, [*keys, "_at"], "left")
    return out.select(*keys, F.when(F.col("reason") == "after_wait", F.col("_frame")).otherwise(F.col("_first")).alias("start"), "reason")


def longest_chains(arcs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, start, end, arcs, height: of arcs (start, end, height) the longest run whose neighbours share an impact; of equals the tallest, then the first."""
    w = Window.partitionBy(*keys).orderBy("start")
    apart = F.coalesce((F.col("start") != F.lag("end").over(w)).cast("int"), F.lit(0))
    chained = arcs.withColumn("_new", apart).withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    chains = chained.groupBy(*keys, "_chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("arcs"), F.sum("height").alias("height"))
    best = Window.partitionBy(*keys).orderBy(F.col("arcs").desc(), F.col("height").desc(), "start")
    return chains.withColumn("_best", F.row_number().over(best)).filter("_best = 1").drop("_best", "_chain")
