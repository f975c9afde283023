"""Plane geometry and physical constants as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of physics.
WATER_INDEX, ICE_DENSITY, ROLLING_RATIO = 1.333, 0.917, math.sqrt(10 / 7)


def elliptic_k(k: float) -> float:
    """The complete elliptic integral of the first kind, by the arithmetic-geometric mean."""
    a, b = 1.0, math.sqrt(1 - k * k)
    for _ in range(64):
        if abs(a - b) < 1e-15:
            break
        a, b = (a + b) / 2, math.sqrt(a * b)
    return math.pi / (2 * a)


def period_factor(degrees: float) -> float:
    """Period of a pendulum at an amplitude over that at small ones."""
    return 2 / math.pi * elliptic_k(math.sin(math.radians(degrees) / 2))


PERIOD_RATIO_30_15 = period_factor(30) / period_factor(15)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def vector_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees between two vectors; the cosine is clamped, as rounding may pass 1."""
    cosine = F.try_divide(ax * bx + ay * by, F.hypot(ax, ay) * F.hypot(bx, by))
    return F.degrees(F.acos(F.when(cosine.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def line_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees between two lines, 90 at most."""
    angle = vector_angle(ax, ay, bx, by)
    return F.least(angle, 180 - angle)


def wrap180(degrees: Column) -> Column:
    """The same angle in [-180, 180)."""
    return F.pmod(degrees + 180, F.lit(360.0)) - 180


def snell_index(incident: Column, refracted: Column) -> Column:
    """sin i / sin t of angles in degrees."""
    return F.try_divide(F.sin(F.radians(incident)), F.sin(F.radians(refracted)))


def incline_ratio(degrees: Column, friction: float) -> Column:
    """Deceleration going up over acceleration coming down a rough incline."""
    s, c = F.sin(F.radians(degrees)), F.cos(F.radians(degrees))
    return F.try_divide(s + friction * c, s - friction * c)


def cross_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """(AC BD) / (BC AD) of positions along a line."""
    return F.try_divide((c - a) * (d - b), (c - b) * (d - a))
