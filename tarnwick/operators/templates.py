"""Targets followed by their appearance: normalised cross-correlation in a window that moves along.

Pixels of a frame are packed to one row by a task of their own; then one task follows the target through one clip, whose frames it
holds as single precision numbers. Sums and squares under all places of a window come from summed-area tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.operators import kernels as K
from tarnwick.operators.edges import grid, sobel

#: Least score, and after two misses; growth of the window by a miss and at most; the farthest jump in windows; found places that give the speed.
LEAST_SCORE, LEAST_AFTER_MISSES, GROWTH, MOST_GROWTH, MOST_JUMP, RECENT = 0.30, 0.24, 0.45, 1.5, 1.15, 3


def packed(pixels: DataFrame, sample: str = "sample", frame: str = "frame") -> DataFrame:
    """sample, frame, width, picture (binary): one row per frame."""

    def pack(c):
        p = grid(c)
        return [(p.shape[1], p.astype(np.float32).tobytes())]

    kinds = dict(pixels.dtypes)
    return K.grouped(pixels.select(sample, frame, "x", "y", "value"), [sample, frame], [], pack, f"{sample} {kinds[sample]}, {frame} {kinds[frame]}, width int, picture binary")


def unpacked(width: int, picture: bytes) -> np.ndarray:
    return np.frombuffer(picture, np.float32).reshape(-1, width).astype(float)


def box_sums(p: np.ndarray, h: int, w: int) -> np.ndarray:
    """Sums under all boxes of h by w, from a summed-area table."""
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w]


def correlation(p: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation of a template with every place of a picture, from -1 to 1; 0 where either is flat."""
    h, w = template.shape
    if p.shape[0] < h or p.shape[1] < w:
        return np.zeros((0, 0))
    t = template - template.mean()
    p = p - p.mean()  # smaller numbers, smaller errors
    shared = np.einsum("ijkl,kl->ij", np.lib.stride_tricks.sliding_window_view(p, (h, w)), t)
    sums, squares = box_sums(p, h, w), box_sums(p * p, h, w)
    energy = (squares - sums * sums / t.size) * (t * t).sum()
    return np.where(energy > 1e-12, shared / np.sqrt(np.maximum(energy, 1e-12)), 0.0)


def appearance(p: np.ndarray, own: float = 0.42, outline: float = 0.58, gain: float = 0.7) -> np.ndarray:
    """A blend of brightness and of the strength of edges, both from 0 to 255: outlines count where shades change."""
    gx, gy = sobel(p)
    return own * p + outline * np.minimum(255.0, gain * np.sqrt(gx * gx + gy * gy))


def follow_template(pictures: list[np.ndarray], x: int, y: int, half: int, search: int) -> list[tuple[float | None, float | None, float | None, bool]]:
    """x, y, score, found in each picture of what lies within `half` pixels of (x, y) in the first one.

    A frame's window is centred where the target would be at the median speed of its last places, and is wider after each miss. The
    best place counts if it is like enough and no farther off than a window; otherwise the frame is a miss.
    """
    if not pictures or min(x, y) < half or y + half >= pictures[0].shape[0] or x + half >= pictures[0].shape[1]:
        return [(None, None, None, False)] * len(pictures)
    template = pictures[0][y - half : y + half + 1, x - half : x + half + 1]
    places, out, misses = [(0, np.array([x, y], float))], [(float(x), float(y), 1.0, True)], 0
    for i, p in enumerate(pictures[1:], 1):
        last, place = places[-1]
        steps = np.diff([q for _, q in places[-RECENT:]], axis=0)
        expected = place + (np.median(steps, axis=0) * (i - last) if len(places) >= RECENT else 0.0)
        reach = int(search * (1 + min(MOST_GROWTH, GROWTH * misses)))
        low = np.maximum(np.floor(expected - reach).astype(int), half)
        high = np.minimum(np.ceil(expected + reach).astype(int), np.array(p.shape[::-1]) - 1 - half)
        if (high >= low).all():
            scores = correlation(p[low[1] - half : high[1] + half + 1, low[0] - half : high[0] + half + 1], template)
            k = np.unravel_index(int(np.argmax(scores)), scores.shape)
            best = low + np.array([k[1], k[0]])
            score = float(scores[k])
            if score >= (LEAST_SCORE if misses < 2 else LEAST_AFTER_MISSES) and np.hypot(*(best - expected)) <= MOST_JUMP * reach:
                places.append((i, best.astype(float)))
                out.append((float(best[0]), float(best[1]), score, True))
                misses = 0
                continue
        misses += 1
        out.append((None, None, None, False))
    return out


def template_tracks(pixels: DataFrame, starts: DataFrame, half: int, search: int, outlines: bool = False) -> DataFrame:
    """sample, frame, x, y, score, valid of a target that starts at x, y (starts: sample, x, y) in the first frame of its clip.

    outlines: follow the blend of brightness and edges instead of the values.
    """

    def follow(c):
        pictures = [unpacked(w, p) for w, p in zip(c["width"], c["picture"])]
        pictures = [appearance(p) for p in pictures] if outlines else pictures
        found = follow_template(pictures, int(c["x"][0]), int(c["y"][0]), half, search)
        return [(int(f), *row) for f, row in zip(c["frame"], found)]

    clips = packed(pixels).join(starts.select("sample", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")), "sample")
    kinds = dict(pixels.dtypes)
    return K.grouped(clips, ["sample"], ["frame"], follow, f"sample {kinds['sample']}, frame int, x double, y double, score double, valid boolean")
