"""How far a textured disc has turned: polar pictures of successive frames, correlated around the circle.

A frame's disc is read along rings in its own task. One task then works through a clip's polar pictures: the turn since the last usable
frame is chained, and the turn since the first one is looked for over the whole circle; where both agree up to whole turns the
direct one stands, as its error does not add up.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.operators import kernels as K
from tarnwick.operators.templates import packed, unpacked

#: The rings' part of the radius, least radius in pixels and least texture, the largest turn between frames in degrees,
#: the least correlation, how much a better match elsewhere may exceed it, and the most frames without a picture.
RINGS, LEAST_RADIUS, LEAST_TEXTURE, LARGEST_STEP, LEAST_CORRELATION, AMBIGUOUS, FRAMES_BACK = (0.24, 0.87), 8.0, 2.0, 45.0, 0.65, 0.05, 2
#: How far, in degrees, chained and direct turn may differ.
AGREED = 10.0


@lru_cache(maxsize=8)
def rings_at(cx: float, cy: float, r: float, angles: int, rings: int) -> tuple[np.ndarray, np.ndarray]:
    """x and y of the places on rings around a centre; discs that stand still share them."""
    turn, away = 2 * np.pi * np.arange(angles) / angles, r * np.linspace(*RINGS, rings)[:, None]
    return cx + away * np.cos(turn), cy + away * np.sin(turn)


def polar(p: np.ndarray, cx: float, cy: float, r: float, angles: int = 360, rings: int = 30) -> np.ndarray | None:
    """Values on rings around a centre, each ring less its mean, by bilinear interpolation; None beyond the picture or without texture."""
    if not np.isfinite([cx, cy, r]).all() or r < LEAST_RADIUS:
        return None
    x, y = rings_at(cx, cy, r, angles, rings)
    if min(x.min(), y.min()) < 0 or x.max() >= p.shape[1] - 1 or y.max() >= p.shape[0] - 1:
        return None
    i, j = x.astype(int), y.astype(int)
    u, v = x - i, y - j
    values = p[j, i] * (1 - u) * (1 - v) + p[j, i + 1] * u * (1 - v) + p[j + 1, i] * (1 - u) * v + p[j + 1, i + 1] * u * v
    values -= values.mean(axis=1, keepdims=True)
    return values if np.sqrt(np.mean(values**2)) >= LEAST_TEXTURE else None


def around(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of polar picture a with b turned by each step of the circle."""
    shared = np.fft.irfft((np.fft.rfft(a, axis=1) * np.conj(np.fft.rfft(b, axis=1))).sum(axis=0), a.shape[1])
    return shared / max(np.sqrt((a * a).sum() * (b * b).sum()), 1e-12)


def best_turn(c: np.ndarray, largest: float) -> tuple[float, float, bool]:
    """Degrees of the best match up to `largest` either way, to a part of a step, its correlation, and whether a clearly better one lies beyond."""
    n = len(c)
    signed = (np.arange(n) * 360.0 / n + 180) % 360 - 180
    near = np.flatnonzero(np.abs(signed) <= largest)
    k = int(near[np.argmax(c[near])])
    before, after = c[(k - 1) % n], c[(k + 1) % n]
    bend = before - 2 * c[k] + after
    part = float(np.clip(0.5 * (before - after) / bend, -0.5, 0.5)) if bend < -1e-12 else 0.0
    return float(signed[k] + part * 360.0 / n), float(c[k]), bool(c.max() - c[k] > AMBIGUOUS)


def texture_turn(polars: list[np.ndarray | None]) -> list[tuple[float | None, float | None, float | None, float | None]]:
    """degrees, chained, direct and correlation for each frame of a clip; frames that cannot be measured are empty."""
    out: list[tuple] = [(None, None, None, None)] * len(polars)
    first = last = None
    for i, p in enumerate(polars):
        if p is None:
            continue
        if first is None:
            first, last = p, (i, p, 0.0)
            out[i] = (0.0, 0.0, 0.0, 1.0)
            continue
        if i - last[0] > FRAMES_BACK:
            continue
        step, score, doubtful = best_turn(around(p, last[1]), LARGEST_STEP)
        if doubtful or score < LEAST_CORRELATION:
            continue
        chained = last[2] + step
        whole, likeness, _ = best_turn(around(p, first), 180.0)
        direct = whole + 360 * round((chained - whole) / 360)
        agreed = likeness >= LEAST_CORRELATION and abs(direct - chained) <= AGREED
        turned = direct if agreed else chained
        out[i] = (turned, chained, direct if agreed else None, score)
        last = (i, p, turned)
    return out


def parts(batches, rows: int = 256):
    """Batches of few rows: pictures are held as Python and NumPy objects besides, and Arrow's batches have ten thousand rows."""
    for b in batches:
        yield from (b.slice(k, rows) for k in range(0, b.num_rows, rows))


def polar_pictures(pixels: DataFrame, places: DataFrame, angles: int = 360, rings: int = 30) -> DataFrame:
    """sample, frame, polar (binary, null if it cannot be read) for the discs of `places` (sample, frame, cx, cy, r)."""
    kinds = dict(pixels.dtypes)

    def read(batches):
        for b in parts(batches):
            columns = [b.column(n).to_pylist() for n in ("width", "picture", "cx", "cy", "r")]
            found = [polar(unpacked(w, p), *(np.nan if v is None else v for v in at), angles, rings) for w, p, *at in zip(*columns)]
            yield pa.RecordBatch.from_arrays([b.column("sample"), b.column("frame"), pa.array([None if f is None else f.tobytes() for f in found], pa.binary())], names=["sample", "frame", "polar"])

    discs = packed(pixels).join(places.select("sample", "frame", *[F.col(n).cast("double").alias(n) for n in ("cx", "cy", "r")]), ["sample", "frame"])
    return discs.mapInArrow(read, f"sample {kinds['sample']}, frame {kinds['frame']}, polar binary")


def texture_turns(pixels: DataFrame, places: DataFrame, angles: int = 360, rings: int = 30) -> DataFrame:
    """sample, frame, degrees, chained, direct, score, valid: the turn since the first readable frame, clockwise as the picture's y points down."""

    def follow(c):
        found = texture_turn([None if p is None else np.frombuffer(p).reshape(rings, angles) for p in c["polar"]])
        return [(int(f), *row, row[0] is not None) for f, row in zip(c["frame"], found)]

    kinds = dict(pixels.dtypes)
    schema = f"sample {kinds['sample']}, frame int, degrees double, chained double, direct double, score double, valid boolean"
    return K.grouped(polar_pictures(pixels, places, angles, rings), ["sample"], ["frame"], follow, schema)


def steps_between(pairs: DataFrame, angles: int = 360, rings: int = 30) -> DataFrame:
    """sample, frame, step, score, doubtful of each row's polar picture against the one in `before`."""
    kinds = dict(pairs.dtypes)

    def compare(batches):
        for b in parts(batches):
            a, c = ([np.frombuffer(x.as_py()).reshape(rings, angles) for x in b.column(n)] for n in ("polar", "before"))
            step, score, doubtful = zip(*(best_turn(around(x, y), LARGEST_STEP) for x, y in zip(a, c)))
            yield pa.RecordBatch.from_arrays([b.column("sample"), b.column("frame"), pa.array(step), pa.array(score), pa.array(doubtful)], names=["sample", "frame", "step", "score", "doubtful"])

    return pairs.select("sample", "frame", "polar", "before").mapInArrow(compare, f"sample {kinds['sample']}, frame {kinds['frame']}, step double, score double, doubtful boolean")
