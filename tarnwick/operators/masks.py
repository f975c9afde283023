"""Masks of pictures as runs: morphology by interval arithmetic, connected components by union of runs.

pixels: keys..., x, y and what a flag needs, one row per pixel. A mask is a table of runs (keys..., y, a, b): row y is set from column a
to b, both included; runs of a row neither touch nor overlap. One window turns pixels into runs, so that everything after works
on a small part of the rows. `rows` lists the rows of every picture (keys..., y, width). A picture is bounded, hence so are the runs
of a row and of a frame, which are the groups here. Null flags count as not set.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.operators import kernels as K

KEYS = ["sample", "frame"]


def picture_rows(pixels: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, y, width of all rows from the first to the last of each picture."""
    size = pixels.groupBy(*keys).agg((F.max("x") + 1).cast("int").alias("width"), F.max("y").alias("last"))
    return size.select(*keys, F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))).alias("y"), "width")


def mask_runs(pixels: DataFrame, flag: Column, keys: list[str] = KEYS) -> DataFrame:
    """The runs of pixels with the flag."""
    rows = Window.partitionBy(*keys, "y").orderBy("x")
    spots = pixels.filter(flag).select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    spots = spots.withColumn("_run", F.col("x") - F.row_number().over(rows))
    return spots.groupBy(*keys, "y", "_run").agg(F.min("x").alias("a"), F.max("x").alias("b")).drop("_run")


def merged(runs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Runs that touch or overlap become one."""
    rows = Window.partitionBy(*keys, "y").orderBy("a", "b")
    apart = F.coalesce((F.col("a") > F.max("b").over(rows.rowsBetween(Window.unboundedPreceding, -1)) + 1).cast("int"), F.lit(0))
    numbered = runs.withColumn("_new", apart).withColumn("_run", F.sum("_new").over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "y", "_run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_run")


def complement(runs: DataFrame, rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """What is not set within the pictures."""
    own = runs.groupBy(*keys, "y").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("_runs"))
    gaps = F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform("_runs", lambda r: r["b"] + 1)), F.concat(F.transform("_runs", lambda r: r["a"] - 1), F.array(F.col("width") - 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )
    none = F.expr("cast(array() as array<struct<a:int,b:int>>)")
    full = rows.join(own, [*keys, "y"], "left").withColumn("_runs", F.coalesce("_runs", none))
    return full.select(*keys, "y", F.explode(gaps).alias("_gap")).select(*keys, "y", "_gap.a", "_gap.b").filter("a <= b")


def rectangle(up: int, aside: int) -> list[tuple[int, int]]:
    """A box as half widths by row: (dy, half)."""
    return [(dy, aside) for dy in range(-up, up + 1)]


def ellipse(up: int, aside: int) -> list[tuple[int, int]]:
    """An ellipse as half widths by row."""
    return [(dy, int(round(aside * (1 - (dy / up) ** 2) ** 0.5)) if up else aside) for dy in range(-up, up + 1)]


def dilated(runs: DataFrame, rows: DataFrame, shape: list[tuple[int, int]], keys: list[str] = KEYS) -> DataFrame:
    """Every run grown by a shape (symmetric, as half widths by row), within the picture."""
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(half).alias("half")) for dy, half in shape]))
    grown = runs.select("*", steps.alias("_s")).select(*keys, (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("a") - F.col("_s.half")).alias("a"), (F.col("b") + F.col("_s.half")).alias("b"))
    inside = grown.join(rows, [*keys, "y"]).select(*keys, "y", F.greatest("a", F.lit(0)).alias("a"), F.least(F.col("b"), F.col("width") - 1).alias("b"))
    return merged(inside.filter("a <= b"), keys)


def eroded(runs: DataFrame, rows: DataFrame, shape: list[tuple[int, int]], keys: list[str] = KEYS) -> DataFrame:
    """The places whose whole shape is set; what lies outside the picture takes nothing away."""
    return complement(dilated(complement(runs, rows, keys), rows, shape, keys), rows, keys)


def opened(runs: DataFrame, rows: DataFrame, shape: list[tuple[int, int]], keys: list[str] = KEYS) -> DataFrame:
    """Without what is smaller than the shape."""
    return dilated(eroded(runs, rows, shape, keys), rows, shape, keys)


def closed(runs: DataFrame, rows: DataFrame, shape: list[tuple[int, int]], keys: list[str] = KEYS) -> DataFrame:
    """With gaps filled that are smaller than the shape."""
    return eroded(dilated(runs, rows, shape, keys), rows, shape, keys)


def united(y: np.ndarray, a: np.ndarray, b: np.ndarray, diagonal: bool) -> np.ndarray:
    """Component numbers, from 1 by first run, of one frame's runs in order of (y, a)."""
    parent = list(range(len(y)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    reach = int(diagonal)
    above, row = 0, 0
    for i in range(len(y)):
        if i and y[i] != y[i - 1]:
            above, row = row, i
        # runs of the row above that end before this one starts meet no later run either
        while above < row and (y[above] != y[i] - 1 or b[above] + reach < a[i]):
            above += 1
        k = above
        while k < row and a[k] <= b[i] + reach:
            p, q = root(k), root(i)
            parent[max(p, q)] = min(p, q)
            k += 1
    roots = np.array([root(i) for i in range(len(y))], int)
    return np.unique(roots, return_inverse=True)[1] + 1


def labelled(runs: DataFrame, keys: list[str] = KEYS, diagonal: bool = True) -> DataFrame:
    """Runs with the number of their component within the frame; diagonal: corners connect too."""

    def label(c):
        return {n: c[n] for n in ("y", "a", "b")} | {"component": united(c["y"], c["a"], c["b"], diagonal)}

    kinds = dict(runs.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", y int, a int, b int, component int"
    return K.grouped(runs, keys, ["y", "a"], label, schema)


def components(runs: DataFrame, keys: list[str] = KEYS, diagonal: bool = True) -> DataFrame:
    """One row per connected component: area, box (x0, y0, x1, y1 included), centre, and central second moments."""
    n, a, b, y = F.col("b") - F.col("a") + 1, F.col("a").cast("double"), F.col("b").cast("double"), F.col("y").cast("double")
    sx = n * (a + b) / 2
    sxx = (b * (b + 1) * (2 * b + 1) - (a - 1) * a * (2 * a - 1)) / 6
    sums = labelled(runs, keys, diagonal).groupBy(*keys, "component").agg(
        F.sum(n).alias("area"), F.min("a").alias("x0"), F.min("y").alias("y0"), F.max("b").alias("x1"), F.max("y").alias("y1"),
        F.sum(sx).alias("sx"), F.sum(n * y).alias("sy"), F.sum(sxx).alias("sxx"), F.sum(sx * y).alias("sxy"), F.sum(n * y * y).alias("syy"),
    )
    cx, cy, area = F.col("sx") / F.col("area"), F.col("sy") / F.col("area"), F.col("area")
    return sums.select(
        *keys, "component", "area", "x0", "y0", "x1", "y1", cx.alias("cx"), cy.alias("cy"),
        (F.col("sxx") / area - cx * cx).alias("mxx"), (F.col("sxy") / area - cx * cy).alias("mxy"), (F.col("syy") / area - cy * cy).alias("myy"),
    )


def orientation(df: DataFrame) -> DataFrame:
    """Adds the long axis of a component: degrees from the x axis (y downwards) and the ratio of the axes' deviations."""
    half, cross = (F.col("mxx") - F.col("myy")) / 2, F.col("mxy")
    middle, root = (F.col("mxx") + F.col("myy")) / 2, F.hypot(half, cross)
    return df.withColumns({"degrees": F.degrees(F.atan2(cross, half)) / 2, "elongation": F.sqrt(F.try_divide(middle + root, F.greatest(middle - root, F.lit(0.0))))})


def tracked_component(parts: DataFrame, keys: list[str], least_area: int, order: list[Column]) -> DataFrame:
    """The best component of each frame of at least some area, as an observation (x, y, r, valid): r is that of a disc of its area."""
    w = Window.partitionBy(*keys).orderBy(*order)
    best = parts.withColumn("_k", F.row_number().over(w)).filter("_k = 1")
    valid = F.col("area") >= least_area
    only = lambda c: F.when(valid, c)
    return best.select(*keys, only(F.col("cx")).alias("x"), only(F.col("cy")).alias("y"), only(F.sqrt(F.col("area") / F.pi())).alias("r"), valid.alias("valid"))
