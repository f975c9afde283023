"""Liquid surfaces from the colours of pixels, by window and aggregate expressions alone.

pixels: keys..., x, y, a, b (the colour plane of CIELAB), one row per pixel within a vessel's walls, rows without gaps. Lightness is left
out: the walls, the base and shadows are steps of lightness, a tinted liquid's surface is one of colour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions.colour import chroma
from tarnwick.operators import stats as T
from tarnwick.operators.masks import KEYS

#: Rows of a band, part of the vessel's height that is searched, and the least step of colour.
BAND, SEARCHED, LEAST_STEP, LEAST_COLUMNS = 9, (0.08, 0.80), 2.0, 12


def row_gains(pixels: DataFrame, band: int = BAND, keys: list[str] = KEYS) -> DataFrame:
    """keys, y, gain: how much more tinted the band below a row is than the band above it.

    A row's colour is the median over its columns, so that a block that floats in part of the width carries none. The two rows
    next to the boundary stay out of the bands.
    """
    rows = pixels.groupBy(*keys, "y").agg(F.percentile("a", F.lit(0.5)).alias("a"), F.percentile("b", F.lit(0.5)).alias("b"))
    w = Window.partitionBy(*keys).orderBy("y")
    mean = lambda c, start, end: F.avg(c).over(w.rowsBetween(start, end))
    rows = rows.withColumns({f"{c}{n}": mean(c, *place) for c in ("a", "b") for n, place in (("_up", (-band, -2)), ("_down", (2, band)))})
    step = chroma(F.col("a_down") - F.col("a_up"), F.col("b_down") - F.col("b_up"))
    more = F.signum(chroma(F.col("a_down"), F.col("b_down")) - chroma(F.col("a_up"), F.col("b_up")))
    return rows.select(*keys, "y", (step * more).alias("gain"))


def smoothed(df: DataFrame, value: str, radius: int, keys: list[str]) -> Column:
    """Mean of the rows up to `radius` away in order of y, mirrored at both ends without the end row."""
    w = Window.partitionBy(*keys).orderBy("y")
    k, n = F.row_number().over(w), F.count("*").over(Window.partitionBy(*keys))
    total = F.col(value)
    for d in range(1, radius + 1):
        # beyond an end the mirrored row is one that lies d - 2 (place - 1) behind, within the window on the other side
        before, after = F.lag(value, d).over(w), F.lead(value, d).over(w)
        for near, place in ((before, k), (after, n - k + 1)):
            back = F.coalesce(*[F.when(place == p, (F.lead if near is before else F.lag)(value, d - 2 * (p - 1)).over(w)) for p in range(1, d + 1)])
            total = total + F.when(place > d, near).otherwise(back)
    return total / (2 * radius + 1)


def surface_rows(pixels: DataFrame, vessel: tuple[float, float], band: int = BAND, searched: tuple[float, float] = SEARCHED, least_step: float = LEAST_STEP, keys: list[str] = KEYS) -> DataFrame:
    """keys, row, step: the row of the strongest gain within the searched part of a vessel from y = top to bottom; frames whose step is too small have none."""
    top, bottom = vessel
    gains = row_gains(pixels, band, keys)
    size = Window.partitionBy(*keys)
    low, high = int(top + searched[0] * (bottom - top)), int(top + searched[1] * (bottom - top))
    inside = gains.withColumn("_last", F.max("y").over(size)).filter((F.col("y") >= max(low, band + 1)) & (F.col("y") < F.least(F.lit(high), F.col("_last") - band)))
    inside = inside.withColumn("_n", F.count("*").over(size)).filter("_n >= 8")
    inside = inside.withColumn("_gain", smoothed(inside, "gain", 2, keys))
    best = inside.groupBy(*keys).agg(F.max(F.struct(F.col("_gain").alias("g"), (-F.col("y")).alias("y"))).alias("_best"))
    return best.select(*keys, (-F.col("_best.y")).alias("row"), F.col("_best.g").alias("step")).filter(F.col("step") >= least_step)


def surface_points(pixels: DataFrame, rows: DataFrame, band: int = BAND, keys: list[str] = KEYS) -> DataFrame:
    """keys, x, height: per column the centre of mass of the colour's rise within a band around the row, finer than a pixel.

    The rise from one row to the next lies between the two.
    """
    tint = pixels.join(rows.select(*keys, "row"), keys).filter(F.abs(F.col("y") - F.col("row")) <= band)
    tint = tint.select(*keys, "x", "y", chroma(F.col("a"), F.col("b")).alias("_c"))
    w = Window.partitionBy(*keys, "x").orderBy("y")
    rise = tint.withColumn("_rise", F.greatest(F.lead("_c").over(w) - F.col("_c"), F.lit(0.0)))
    mass = rise.groupBy(*keys, "x").agg(F.sum("_rise").alias("m"), F.sum(F.col("_rise") * (F.col("y") + 0.5)).alias("s"))
    return mass.filter("m > 1e-6").select(*keys, "x", (F.col("s") / F.col("m")).alias("height"))


def surface_lines(points: DataFrame, rows: DataFrame, keys: list[str] = KEYS, least_columns: int = LEAST_COLUMNS) -> DataFrame:
    """keys, row, step, columns, tilt in degrees, height in the middle of the columns, rms of the heights off their line.

    With fewer columns than least_columns the surface is level at its row.
    """
    fits = T.ols(points, keys, "x", "height").select(*keys, F.col("n").alias("columns"), "slope", "intercept", F.col("rmse").alias("rms"))
    middle = points.groupBy(*keys).agg(((F.min("x") + F.max("x")) / 2).alias("_middle"))
    out = rows.join(fits, keys, "left").join(middle, keys, "left").withColumn("columns", F.coalesce("columns", F.lit(0)))
    fitted = F.col("columns") >= least_columns
    return out.select(
        *keys, "row", "step", "columns", F.when(fitted, F.degrees(F.atan("slope"))).otherwise(0.0).alias("tilt"), F.when(fitted, F.col("intercept") + F.col("slope") * F.col("_middle")).otherwise(F.col("row")).alias("height"),
        F.when(fitted, F.col("rms")).otherwise(0.0).alias("rms"),
    )


def tint_surfaces(pixels: DataFrame, vessel: tuple[float, float], band: int = BAND, least_step: float = LEAST_STEP, keys: list[str] = KEYS) -> DataFrame:
    """The surface of every frame that shows one: row, step, tilt, height and rms."""
    rows = surface_rows(pixels, vessel, band, least_step=least_step, keys=keys)
    return surface_lines(surface_points(pixels, rows, band, keys), rows, keys)
