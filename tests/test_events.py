"""Rises, starts of discharges and chains of arcs: drawn cases and versions written out frame by frame."""

import numpy as np
import pytest

from tarnwick.operators import events as V

TRACK = "track int, i int, t double, y double, valid boolean"
FPS = 10


def tracks(spark, *series):
    rows = [(k, i, i / FPS, None if not np.isfinite(y) else float(y), bool(np.isfinite(y))) for k, ys in enumerate(series) for i, y in enumerate(ys)]
    return spark.createDataFrame(rows, TRACK)


def ramp(n=60, start=20, stop=40, top=100.0, rise=30.0):
    return top - rise * np.clip((np.arange(n) - start) / (stop - start), 0, 1)


def holes(y, *frames):
    y = y.copy()
    y[list(frames)] = np.nan
    return y


def rises(spark, *series, window=5, gap=2):
    return {r.track: r for r in V.rise_events(tracks(spark, *series), window, gap).collect()}


def test_a_rise_is_found_at_its_half(spark):
    r = rises(spark, ramp())[0]
    assert (r.first_level, r.last_level, r.rise, r.half_frame, r.flags) == (100, 70, 30, 30, [])
    assert r.half_time == pytest.approx(3.0) and r.rate == pytest.approx(30 / 5.9)


def test_each_fault_of_a_rise(spark):
    unsteady = ramp() + np.where(np.arange(60) < 3, 4, 0)
    cases = {
        "first_level": unsteady, "last_level": holes(ramp(), 57, 58), "small_rise": ramp(rise=7.0), "long_gap": holes(ramp(), 28, 29, 30), "coverage": holes(ramp(), *range(7, 20), *range(42, 54)),
        "abrupt_step": np.where(np.arange(60) < 30, 100.0, 60.0), "no_half_crossing": holes(ramp(), 30, 31),
    }
    found = rises(spark, *cases.values())
    for k, flag in enumerate(cases):
        assert flag in found[k].flags and found[k].half_frame is None, flag
    assert found[list(cases).index("coverage")].flags == ["coverage"]  # the surface stands still over its gaps
    assert found[list(cases).index("small_rise")].flags == ["small_rise"]


def test_a_rise_that_falls_back_is_not_held(spark):
    y = ramp()
    y[30:32] = 86.5  # passes the middle, then not for three frames
    y[29] = 84.0
    r = rises(spark, y)[0]
    assert r.half_frame == 32
    assert rises(spark, np.full(60, np.nan))[0].flags == ["first_level", "last_level", "coverage"]


def plain_start(t, v, window, snr):
    """The rule, frame by frame."""
    first = t <= t[0] + window + 1e-9
    if first.sum() < 3:
        return 0, "few_frames"
    slope, level = np.polyfit(t[first], v[first], 1)
    left = v[first] - level - slope * t[first]
    if -slope > snr * np.sqrt((left @ left) / max(1, first.sum() - 2) / ((t[first] - t[first].mean()) ** 2).sum()):
        return 0, "falling_at_first"
    middle = np.median(v[first])
    low = v < middle - snr * max(1.4826 * np.median(abs(v[first] - middle)), 2.220446049250313e-14 * max(1, abs(v).max()))
    for i in range(first.sum() - 1, len(t)):
        near = (t >= t[i]) & (t <= t[i] + window + 1e-9)
        if t[-1] - t[i] >= window - 1e-9 and low[near].mean() >= 0.8:
            return max(0, np.flatnonzero(near & low)[0] - 1), "after_wait"
    return 0, "no_start_seen"


def test_discharge_starts_equal_the_rule_frame_by_frame(spark):
    draw = np.random.default_rng(4)
    n = 80
    k = np.arange(n)
    series = [500 - 4 * np.maximum(0, k - wait) + draw.normal(0, noise, n) for wait in (0, 12, 30, 60, 79) for noise in (0.0, 0.8)]
    series += [np.full(n, 7.0), np.where((k > 20) & (k < 24), 1.0, 9.0), np.array([5.0, 4.0]), 500 - 4.0 * k]
    found = {r.track: (r.start, r.reason) for r in V.discharge_starts(tracks(spark, *series), 1.0).collect()}
    for j, v in enumerate(series):
        assert found[j] == plain_start(np.arange(len(v)) / FPS, v, 1.0, 3.0), j
    assert {r for _, r in found.values()} == {"falling_at_first", "after_wait", "no_start_seen", "few_frames"}


def test_unseen_frames_do_not_count_for_the_start(spark):
    v = 500 - 4.0 * np.maximum(0, np.arange(60) - 20)
    (r,) = V.discharge_starts(tracks(spark, holes(v, 3, 22, 23)), 1.0).collect()
    assert (r.start, r.reason) == (20, "after_wait")


def test_chains_share_impacts_and_the_longest_then_tallest_stands(spark):
    arcs = [
        (0, 0, 4, 9.0), (0, 4, 9, 5.0), (0, 10, 13, 8.0), (0, 13, 16, 4.0), (0, 16, 19, 1.0),  # three of less height win over two
        (1, 0, 4, 1.0), (1, 4, 6, 2.0), (1, 8, 10, 2.0), (1, 10, 12, 2.0),  # as long: the taller
        (2, 0, 4, 3.0), (2, 6, 9, 3.0),  # as tall: the first
    ]
    df = spark.createDataFrame(arcs, "track int, start int, end int, height double")
    assert sorted(map(tuple, V.longest_chains(df).collect())) == [(0, 10, 19, 3, 13.0), (1, 8, 12, 2, 4.0), (2, 0, 4, 1, 3.0)]
    assert V.longest_chains(df.limit(0)).collect() == []
