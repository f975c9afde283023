"""Gradients and thin edges of pictures: one task works on one frame.

pixels: keys..., x, y, value, one row per pixel of a rectangle that starts at 0, 0. Missing pixels and null values count as 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tarnwick.operators import kernels as K
from tarnwick.operators.masks import KEYS, united


def grid(c: dict) -> np.ndarray:
    """The picture of one frame's columns x, y and value."""
    out = np.zeros((int(c["y"].max()) + 1, int(c["x"].max()) + 1))
    out[c["y"].astype(int), c["x"].astype(int)] = np.nan_to_num(c["value"].astype(float))
    return out


def sobel(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences along x and y, smoothed across with weights 1, 2, 1; the border is repeated outwards."""
    q = np.pad(p, 1, mode="edge")
    across = q[:, 2:] - q[:, :-2]
    down = q[2:] - q[:-2]
    return across[:-2] + 2 * across[1:-1] + across[2:], down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]


#: Fixed value: the tangent of 22.5 degrees, where a direction passes from along an axis to a diagonal.
OCTANT = 2**0.5 - 1


def thinned(gx: np.ndarray, gy: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Pixels that exceed the neighbour behind them along the gradient and are no less than the one before; outside is 0."""
    q = np.pad(size, 1)
    h, w = size.shape
    at = lambda dy, dx: q[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    level, steep = np.abs(gy) <= OCTANT * np.abs(gx), np.abs(gx) <= OCTANT * np.abs(gy)
    same = gx * gy > 0
    out = np.zeros_like(size, bool)
    for sector, dy, dx in ((level, 0, 1), (steep & ~level, 1, 0), (~level & ~steep & same, 1, 1), (~level & ~steep & ~same, -1, 1)):
        out |= sector & (size > at(-dy, -dx)) & (size >= at(dy, dx))
    return out


def reached(weak: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """Weak pixels that a chain of weak neighbours, corners included, connects with a strong one; by components of runs."""
    edge = np.diff(np.pad(weak, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    y, a = np.nonzero(edge == 1)
    b = np.nonzero(edge == -1)[1] - 1
    if not len(y):
        return weak
    numbers = np.zeros(weak.shape, int)
    numbers[weak] = np.repeat(united(y, a, b, True), b - a + 1)
    good = np.zeros(numbers.max() + 1, bool)
    good[numbers[strong & weak]] = True
    return weak & good[numbers]


def canny(p: np.ndarray, low: float, high: float):
    """gx, gy, size and the flags of thin edges: above `low`, and joined to one above `high`."""
    gx, gy = sobel(p)
    size = np.sqrt(gx * gx + gy * gy)
    thin = thinned(gx, gy, size)
    return gx, gy, size, reached(thin & (size > low), thin & (size > high))


def edges(pixels: DataFrame, low: float, high: float, keys: list[str] = KEYS) -> DataFrame:
    """keys, x, y, gx, gy, size of the edge pixels of every frame."""

    def find(c):
        gx, gy, size, found = canny(grid(c), low, high)
        y, x = np.nonzero(found)
        return {"x": x, "y": y, "gx": gx[found], "gy": gy[found], "size": size[found]}

    kinds = dict(pixels.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", x int, y int, gx double, gy double, size double"
    return K.grouped(pixels.select(*keys, "x", "y", "value"), keys, ["y", "x"], find, schema)


def profile_edge(p: np.ndarray, along: int) -> tuple[int, float]:
    """Place and sub-pixel place of the strongest step of the median profile along an axis (0: down, 1: across)."""
    steps = np.abs(np.diff(np.median(p, axis=1 - along)))
    k = int(np.argmax(steps))
    if 0 < k < len(steps) - 1 and (bend := steps[k - 1] - 2 * steps[k] + steps[k + 1]) < 0:
        return k, k + 0.5 + float(np.clip(0.5 * (steps[k - 1] - steps[k + 1]) / bend, -0.5, 0.5))
    return k, k + 0.5
