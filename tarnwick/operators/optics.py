"""Rays at an interface, ridges of profiles and the walls of vessels, from what operators.edges and operators.votes find.

An interface is a point (px, py) with a unit normal (nx, ny) that points into the second medium.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.operators import kernels as K
from tarnwick.operators.edges import sobel
from tarnwick.operators.masks import KEYS


def rays(segments: DataFrame, interface: tuple[float, float, float, float], least_slope: float = 0.02) -> DataFrame:
    """Adds to segments (x0, y0, x1, y1): side (first or second medium, by the middle), along (where their line meets the interface), angle to the normal in degrees, and lean.

    lean is the way along the interface for one along the normal, with its sign; segments that run along the interface, to within least_slope, are left out.
    """
    px, py, nx, ny = interface
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    size = F.hypot(dx.cast("double"), dy.cast("double"))
    across, along = (dx * nx + dy * ny) / size, (dy * nx - dx * ny) / size
    mx, my = (F.col("x0") + F.col("x1")) / 2 - px, (F.col("y0") + F.col("y1")) / 2 - py
    off, place = mx * nx + my * ny, my * nx - mx * ny
    out = segments.filter(size > 0).withColumns({"_across": across, "_along": along, "_off": off, "_place": place}).filter(F.abs("_across") >= least_slope)
    lean = F.col("_along") / F.col("_across")
    out = out.withColumns({"side": F.when(F.col("_off") < 0, "first").otherwise("second"), "along": F.col("_place") - F.col("_off") * lean, "angle": F.degrees(F.acos(F.least(F.lit(1.0), F.abs("_across")))), "lean": lean})
    return out.drop("_across", "_along", "_off", "_place")


#: How far clustered rays may lie apart along the interface, in pixels and as a share of the picture's width, and in degrees.
APART, APART_SHARE, APART_DEGREES = 12.0, 0.018, 4.0


def clustered(along: np.ndarray, angle: np.ndarray, lean: np.ndarray, length: np.ndarray, apart: float, degrees: float) -> np.ndarray:
    """Cluster numbers from 0: from the longest on, a ray joins the first cluster whose mean, weighted by length, is near and leans the same way."""
    number = np.empty(len(along), int)
    sums: list[np.ndarray] = []  # length, and length times place, angle and lean
    for k in np.lexsort((along, -length)).tolist():
        own = length[k] * np.array([1.0, along[k], angle[k], lean[k]])
        for c, s in enumerate(sums):
            place, turn, way = s[1:] / s[0]
            if way * lean[k] >= 0 and abs(along[k] - place) <= apart and abs(angle[k] - turn) <= degrees:
                sums[c], number[k] = s + own, c
                break
        else:
            number[k] = len(sums)
            sums.append(own)
    return number


def ray_clusters(found: DataFrame, width: int, keys: list[str] = KEYS, degrees: float = APART_DEGREES) -> DataFrame:
    """keys, side, cluster, along, angle, lean, length, n: rays of one beam together, of means weighted by length.

    Both edges of a thick beam meet the interface apart by its thickness over the cosine.
    """
    apart = max(APART, APART_SHARE * width)

    def cluster(c):
        number = clustered(c["along"], c["angle"], c["lean"], c["length"], apart, degrees)
        out = []
        for k in range(number.max() + 1):
            own = number == k
            mean = lambda n: float(np.average(c[n][own], weights=c["length"][own]))
            out.append((k, mean("along"), mean("angle"), mean("lean"), float(c["length"][own].max()), int(own.sum())))
        return out

    kinds = dict(found.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", side string, cluster int, along double, angle double, lean double, length double, n int"
    return K.grouped(found.select(*keys, "side", "along", "angle", "lean", F.col("length").cast("double").alias("length")), [*keys, "side"], ["length", "along"], cluster, schema)


def ridges(profiles: DataFrame, keys: list[str], least: float = 12.0, share: float = 0.45) -> DataFrame:
    """keys, ridge, start, stop, centre, peak of bands that stand out of a profile (keys, i, y), bright or dark.

    A band is a run of at least two places whose distance from the profile's median exceeds `least` and a share of the greatest; its centre is that of the distances.
    """
    whole, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("i")
    rows = profiles.withColumn("_c", F.abs(F.col("y") - F.percentile("y", F.lit(0.5)).over(whole)))
    rows = rows.withColumn("_top", F.max("_c").over(whole)).filter((F.col("_top") >= least) & (F.col("_c") > F.greatest(F.lit(least), share * F.col("_top"))))
    rows = rows.withColumn("_run", F.col("i") - F.row_number().over(w))
    bands = rows.groupBy(*keys, "_run").agg(F.min("i").alias("start"), F.max("i").alias("stop"), (F.sum(F.col("_c") * F.col("i")) / F.sum("_c")).alias("centre"), F.max("_c").alias("peak"), F.count("*").alias("_n")).filter("_n >= 2")
    return bands.withColumn("ridge", F.row_number().over(Window.partitionBy(*keys).orderBy("start"))).drop("_run", "_n")


#: Share of the strongest changes that count as edges, columns that a wall's support is averaged over, the radius in which it is the greatest, the least distance of walls, least support, and the walls' distance in widths.
EDGE_PERCENT, SMOOTH, PEAK_RADIUS, WALLS_APART, LEAST_SUPPORT, WALL_GAP, WALL_ROWS, WALL_REACH = 98.5, 5, 6, 15, 0.10, (0.15, 0.85), 20, 3


def walls(p: np.ndarray) -> tuple[int, int, int, int] | None:
    """x0, x1, y0, y1 of a straight-walled vessel: the pair of upright edges whose weaker one has the most support, and the rows over which they show."""
    h, w = p.shape
    change = np.abs(sobel(p)[0])
    strong = (change >= np.percentile(change, EDGE_PERCENT)) & (change > 0)
    counts = np.pad(strong.sum(axis=0).astype(float), SMOOTH // 2, mode="reflect")
    support = np.convolve(counts, np.ones(SMOOTH) / SMOOTH, "valid")
    near = np.lib.stride_tricks.sliding_window_view(np.pad(support, PEAK_RADIUS, constant_values=-1.0), 2 * PEAK_RADIUS + 1).max(axis=1)
    places = np.arange(w)
    peaks = np.flatnonzero((support == near) & (support >= LEAST_SUPPORT * h) & (places >= 3) & (places < w - 3))
    kept: list[int] = []
    for x in peaks[np.argsort(-support[peaks], kind="stable")].tolist():
        if all(abs(x - other) > WALLS_APART for other in kept):
            kept.append(x)
    pairs = [(min(support[a], support[b]), -i, -j, min(a, b), max(a, b)) for i, a in enumerate(kept) for j, b in enumerate(kept) if i < j and WALL_GAP[0] * w <= abs(a - b) <= WALL_GAP[1] * w]
    if not pairs:
        return None
    *_, x0, x1 = max(pairs)
    shown = np.zeros(h, bool)
    for x in (x0, x1):
        shown |= strong[:, max(0, x - WALL_REACH) : x + WALL_REACH + 1].any(axis=1)
    rows = np.flatnonzero(shown)
    return (x0, x1, int(rows[0]), int(rows[-1])) if len(rows) >= WALL_ROWS else None


def vessel_walls(pixels: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, x0, x1, y0, y1 of the vessel in every frame that shows one."""
    from tarnwick.operators.edges import grid

    def find(c):
        found = walls(grid(c))
        return [found] if found else []

    kinds = dict(pixels.dtypes)
    return K.grouped(pixels.select(*keys, "x", "y", "value"), keys, ["y", "x"], find, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", x0 int, x1 int, y0 int, y1 int")
