"""Colours of pixels as column expressions: CIELAB, hue, saturation and value, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: sRGB to XYZ for the white of D65, that white, and the constants of CIELAB.
TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)
DARK, SLOPE = 0.008856, 7.787


def linear(c: Column) -> Column:
    """A channel of 0 to 255 without the gamma of sRGB, from 0 to 1."""
    x = c / 255.0
    return F.when(x > 0.04045, F.pow((x + 0.055) / 1.055, F.lit(2.4))).otherwise(x / 12.92)


def lab(red: Column, green: Column, blue: Column) -> tuple[Column, Column, Column]:
    """L from 0 to 100 and the signed a and b of CIELAB."""
    channels = [linear(c) for c in (red, green, blue)]

    def root(row, white):
        t = sum((c * w for c, w in zip(channels[1:], row[1:])), channels[0] * row[0]) / white
        return t, F.when(t > DARK, F.pow(t, F.lit(1 / 3))).otherwise(t * SLOPE + 16 / 116)

    (_, fx), (y, fy), (_, fz) = (root(r, w) for r, w in zip(TO_XYZ, WHITE))
    return F.when(y > DARK, fy * 116 - 16).otherwise(y * 903.3), (fx - fy) * 500, (fy - fz) * 200


def chroma(a: Column, b: Column) -> Column:
    """How colourful a pixel is, whatever its lightness."""
    return F.sqrt(a * a + b * b)


def hsv(red: Column, green: Column, blue: Column) -> tuple[Column, Column, Column]:
    """Hue in half degrees (0 to 180), saturation and value from 0 to 255."""
    most, least = F.greatest(red, green, blue), F.least(red, green, blue)
    d = most - least
    turn = F.when(d == 0, 0.0).when(most == red, (green - blue) / d).when(most == green, (blue - red) / d + 2).otherwise((red - green) / d + 4)
    return F.pmod(turn * 30, F.lit(180.0)), F.when(most == 0, 0.0).otherwise(255 * d / most), most


def hue_distance(hue: Column, other: float) -> Column:
    """Distance of hues in half degrees around the circle."""
    d = F.abs(hue - other)
    return F.least(d, 180 - d)


def of_colour(hue: Column, saturation: Column, value: Column, like: float, tolerance: float = 14.0, least_saturation: float = 0.0, least_value: float = 0.0) -> Column:
    """Whether a pixel has a hue, strongly and brightly enough."""
    return (hue_distance(hue, like) <= tolerance) & (saturation >= least_saturation) & (value >= least_value)
