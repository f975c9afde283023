"""Hough transforms: points vote for lines and circles, and peaks of the votes are found.

points: keys..., x, y (whole pixels), for circles also the gradient gx, gy. Votes are counted in the tasks where
the points lie, batch by batch, and once more by Spark before the shuffle, so that only cells travel. Peaks are cells with enough
votes that no neighbour exceeds: candidates are few, and are compared by an equi-join with their eight neighbours.
Points with a null place take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.operators.masks import KEYS

#: Cosines and sines are whole millionths: cells are then found by integer arithmetic.
UNIT = 1_000_000


def direction_table(angles: int) -> tuple[list[int], list[int]]:
    """Cosine and sine, in units, of `angles` directions over half a turn."""
    turns = [math.pi * k / angles for k in range(angles)]
    return [round(UNIT * math.cos(t)) for t in turns], [round(UNIT * math.sin(t)) for t in turns]


def _counted(points: DataFrame, keys: list[str], cells, names: list[str]) -> DataFrame:
    """Votes by keys and cell; cells gives the cells of a batch of one frame's points, each as one row of integers."""

    def run(frames):
        for frame in frames:
            for key, own in frame.groupby(keys, sort=False, dropna=False):
                found, votes = np.unique(cells(own), axis=0, return_counts=True)
                out = pd.DataFrame(found, columns=names)
                for name, value in zip(keys, key):
                    out[name] = value
                yield out.assign(votes=votes)[[*keys, *names, "votes"]]

    kinds = dict(points.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{n} int" for n in names), "votes long"])
    return points.filter("x is not null and y is not null").mapInPandas(run, schema).groupBy(*keys, *names).agg(F.sum("votes").alias("votes"))


def line_votes(points: DataFrame, keys: list[str] = KEYS, angles: int = 180, step: float = 1.0) -> DataFrame:
    """angle, rho: the cells of the lines x cos + y sin = rho * step that points vote for; angle counts directions over half a turn."""
    cos, sin = map(np.array, direction_table(angles))
    width = round(step * UNIT)

    def cells(p):
        x, y = (p[c].to_numpy().astype(np.int64)[:, None] for c in ("x", "y"))
        rho = (2 * (x * cos + y * sin) + width) // (2 * width)
        return np.stack([np.broadcast_to(np.arange(angles), rho.shape), rho], 2).reshape(-1, 2)

    return _counted(points.select(*keys, "x", "y"), keys, cells, ["angle", "rho"])


def _unbeaten(cells: DataFrame, near: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Candidates that none of their neighbours beats; near: keys, names of the neighbour and, with a prefix, of the cell beside it."""
    beaten = near.join(cells.withColumnRenamed("votes", "_votes"), [*keys, *names])
    own = [F.col(f"_{n}") for n in names]
    # of equal votes the first cell stands
    better = (F.col("_votes") > F.col("votes")) | ((F.col("_votes") == F.col("votes")) & (F.struct(*names) < F.struct(*[c.alias(n) for c, n in zip(own, names)])))
    lost = beaten.filter(better).select(*keys, *[c.alias(n) for c, n in zip(own, names)]).distinct()
    return cells.join(lost, [*keys, *names], "left_anti")


def _neighbours(cells: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    first, second = names
    return cells.select(*keys, "votes", *[F.col(n).alias(f"_{n}") for n in names], F.explode(steps).alias("_s")).select(
        *keys, "votes", f"_{first}", f"_{second}", (F.col(f"_{first}") + F.col("_s.a")).alias(first), (F.col(f"_{second}") + F.col("_s.b")).alias(second)
    )


def line_peaks(votes: DataFrame, least: int, keys: list[str] = KEYS, angles: int = 180, step: float = 1.0) -> DataFrame:
    """keys, angle, rho, votes, degrees, distance of the lines: cells of at least so many votes that no neighbour exceeds.

    Beyond half a turn the directions start again with the distance's sign turned.
    """
    cells = votes.filter(F.col("votes") >= least)
    near = _neighbours(cells, keys, ["angle", "rho"])
    over = (F.col("angle") < 0) | (F.col("angle") >= angles)
    near = near.withColumns({"rho": F.when(over, -F.col("rho")).otherwise(F.col("rho")), "angle": F.pmod("angle", F.lit(angles))})
    return _unbeaten(cells, near, keys, ["angle", "rho"]).withColumns({"degrees": F.col("angle") * (180.0 / angles), "distance": F.col("rho") * step})


def segments(points: DataFrame, lines: DataFrame, keys: list[str] = KEYS, near: float = 1.0, gap: float = 3.0, least_length: float = 10.0) -> DataFrame:
    """The parts of lines that points cover: keys, angle, rho, part, x0, y0, x1, y1, n, length.

    A line's points lie at most `near` off; along it, a way of more than `gap` without points ends a part.
    """
    turn = F.radians("degrees")
    own = points.join(lines.select(*keys, "angle", "rho", F.cos(turn).alias("_c"), F.sin(turn).alias("_s"), "distance"), keys)
    own = own.filter(F.abs(F.col("x") * F.col("_c") + F.col("y") * F.col("_s") - F.col("distance")) <= near)
    own = own.withColumn("_at", F.col("y") * F.col("_c") - F.col("x") * F.col("_s"))
    w = Window.partitionBy(*keys, "angle", "rho").orderBy("_at", "x", "y")
    own = own.withColumn("_new", F.coalesce((F.col("_at") - F.lag("_at").over(w) > gap).cast("int"), F.lit(0)))
    own = own.withColumn("part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    ends = own.groupBy(*keys, "angle", "rho", "part").agg(F.min(F.struct("_at", "x", "y")).alias("a"), F.max(F.struct("_at", "x", "y")).alias("b"), F.count("*").alias("n"))
    ends = ends.withColumn("length", F.col("b._at") - F.col("a._at")).filter(F.col("length") >= least_length)
    return ends.select(*keys, "angle", "rho", "part", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"), "n", "length")


def centre_votes(points: DataFrame, least_radius: int, most_radius: int, keys: list[str] = KEYS) -> DataFrame:
    """cx, cy: the pixels that lie at a radius from points along their gradient, either way."""
    radii = np.concatenate([sign * np.arange(least_radius, most_radius + 1.0) for sign in (1, -1)])

    def cells(p):
        gx, gy = p["gx"].to_numpy(), p["gy"].to_numpy()
        size = np.sqrt(gx * gx + gy * gy)
        turned = size > 0
        x, y = (np.floor(p[c].to_numpy()[turned, None] + radii * (g[turned] / size[turned])[:, None] + 0.5) for c, g in (("x", gx), ("y", gy)))
        return np.stack([x, y], 2).reshape(-1, 2).astype(int)

    return _counted(points.select(*keys, "x", "y", "gx", "gy"), keys, cells, ["cx", "cy"])


def centre_peaks(votes: DataFrame, least: int, keys: list[str] = KEYS) -> DataFrame:
    """keys, cx, cy, votes of the centres: pixels of at least so many votes that no neighbour exceeds."""
    cells = votes.filter(F.col("votes") >= least)
    return _unbeaten(cells, _neighbours(cells, keys, ["cx", "cy"]), keys, ["cx", "cy"])


def circles(points: DataFrame, centres: DataFrame, least_radius: int, most_radius: int, least_cover: float = 0.5, keys: list[str] = KEYS) -> DataFrame:
    """keys, cx, cy, votes, r, n, cover: of each centre the radius at which points cover most of the circle (the smaller of equals).

    A circle's points lie at its radius to within half a pixel; cover is their number over the circumference, of at least least_cover.
    """
    own = points.select(*keys, "x", "y").join(centres, keys)
    own = own.withColumn("r", F.floor(F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2) + 0.5).cast("int"))
    rings = own.filter(F.col("r").between(least_radius, most_radius)).groupBy(*keys, "cx", "cy", "votes", "r").agg(F.count("*").alias("n"))
    rings = rings.withColumn("cover", F.col("n") / (2 * math.pi * F.col("r")))
    w = Window.partitionBy(*keys, "cx", "cy").orderBy(F.col("cover").desc(), "r")
    return rings.withColumn("_k", F.row_number().over(w)).filter((F.col("_k") == 1) & (F.col("cover") >= least_cover)).drop("_k")
