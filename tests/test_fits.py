"""Fits against twins written out candidate by candidate, and against made motions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.operators import fits
from tarnwick.operators import stats as T


def plain_release(y, hint):
    """Candidate by candidate, by plain least squares on scaled rows."""
    t, best = np.arange(len(y), dtype=float), None
    for start in np.arange(0, min(max(1, hint + 4), len(y) // 3) + 0.01, 0.5):
        u = np.maximum(t - start, 0) / max(len(y) - 1 - start, 1)
        basis, w = np.c_[np.ones(len(y)), u**2, u**3], np.ones(len(y))
        for _ in range(5):
            c = np.linalg.lstsq(basis * w[:, None] ** 0.5, y * w**0.5, rcond=None)[0]
            left = y - basis @ c
            scale = max(0.25, 1.4826 * np.median(np.abs(left - np.median(left))))
            w = np.minimum(1, 1.5 * scale / np.maximum(np.abs(left), 1e-9))
        loss = np.mean(np.minimum(left**2, (3 * scale) ** 2))
        if best is None or loss < best[0]:
            best = (loss, start, basis @ c)
    return best


def fall(release, n=40, g=0.4, jerk=0.0, noise=0.2, seed=0):
    s = np.maximum(0, np.arange(n) - release)
    return 10 + g * s**2 / 2 + jerk * s**3 + np.random.default_rng(seed).normal(0, noise, n)


@pytest.mark.parametrize("release, jerk, spoilt", [(0, 0.0, []), (4.5, 0.0, [20]), (7, 0.003, []), (3, 0.0, [10, 11, 30])])
def test_releases_equal_trying_each_candidate(release, jerk, spoilt):
    y = fall(release, jerk=jerk, seed=len(spoilt))
    y[spoilt] += 60
    found, (loss, start, curve) = fits.released(y, 5), plain_release(y, 5)
    assert found["loss"] == pytest.approx(loss, rel=1e-6) and found["release"] == start
    assert found["fit"] == pytest.approx(curve, abs=1e-4)
    assert abs(start - release) <= 1.5


def test_model_of_a_release():
    assert fits.release_model(fall(5), 5)["model"] == "parabola"
    assert fits.release_model(fall(5, jerk=0.02), 5)["model"] == "cubic"
    assert fits.release_model(np.ones(3), 1) is None and fits.released(np.array([1.0, np.nan, 2, 3, 4]), 1) is None
    still = fits.release_model(np.full(30, 7.0), 3)
    assert still["rms"] < 1e-6 and still["noise"] == 0.15 and still["model"] == "parabola"


def climb(turn=2.0, up=12.0, down=7.0, n=90, noise=0.3, seed=1):
    t = np.linspace(0, 4, n)
    x = 100 - np.where(t < turn, up, down) * (t - turn) ** 2 / 2
    return t, x + np.random.default_rng(seed).normal(0, noise, n)


@pytest.mark.parametrize("spoilt", [[], [5], [5, 40, 41, 80]])
def test_a_vertex_leaves_out_what_stands_off(spoilt):
    t, x = climb()
    x[spoilt] += 9
    found = fits.vertex(t, x)
    assert found["turn"] == pytest.approx(2, abs=0.05) and found["before"] == pytest.approx(12, rel=0.05) and found["after"] == pytest.approx(7, rel=0.05)
    assert found["kept"] == pytest.approx(1 - len(spoilt) / 90, abs=0.03)
    assert all(q["rmse"] < 0.6 and q["explained"] > 0.99 for q in found["quality"])
    # the same by plain fits: what is farther off than the limit is left out, until nothing changes
    basis = np.c_[np.ones(90), np.where(t <= found["turn"], -((t - found["turn"]) ** 2) / 2, 0), np.where(t >= found["turn"], -((t - found["turn"]) ** 2) / 2, 0)]
    keep = np.ones(90, bool)
    for _ in range(4):
        c = np.linalg.lstsq(basis[keep], x[keep], rcond=None)[0]
        off = x - basis @ c - np.median((x - basis @ c)[keep])
        new = np.abs(off) <= max(1.25, 4 * 1.4826 * np.median(np.abs(off[keep])))
        if (new == keep).all():
            break
        keep = new
    assert (found["top"], found["before"], found["after"]) == pytest.approx(tuple(c), rel=1e-6)


def test_no_vertex_in_short_or_one_sided_motion():
    t, x = climb()
    assert fits.vertex(t[:10], x[:10]) is None and fits.vertex(t, t * 5.0) is None


def flow(beta, n=200, noise=0.0, k=0.05, seed=2):
    """Heights and volumes of a vessel that empties by V' = -k h^beta, V = h."""
    t = np.linspace(0, 10, n)
    h = np.empty(n)
    h[0] = 4.0
    for i in range(1, n):  # fine steps
        x = h[i - 1]
        for _ in range(50):
            x -= k * x**beta * (t[i] - t[i - 1]) / 50
        h[i] = x
    return t, h, h + np.random.default_rng(seed).normal(0, noise, n)


@pytest.mark.parametrize("beta", [0.0, 0.5, 1.0, 2.5, 12.0])
def test_exponents_of_made_flows(beta):
    k = 0.25 / 4**beta  # about as fast for each
    t, h, v = flow(beta, k=k)
    found = fits.discharge_fit(t, h, v, 0.4, 8)
    assert found["beta"] == pytest.approx(beta, abs=0.02) and found["bound"] == (16 if beta > 8 else 8)
    t, h, v = flow(beta, k=k, noise=0.004)
    found = fits.discharge_fit(t, h, v, 0.4, 8)
    assert found["low"] - 2 * found["se"] <= beta <= found["high"] + 2 * found["se"] and 0 < found["se"]


def plain_loss(fit, v, beta, t, h):
    w = (h / np.median(h)) ** beta
    area = np.append(0, np.cumsum(np.diff(t) * (w[1:] + w[:-1]) / 2))[fit.rows]
    y = v[fit.rows]
    basis = np.c_[np.ones(len(y)), area]
    c = np.linalg.lstsq(basis, y, rcond=None)[0]
    return float(np.mean((y - basis @ c) ** 2)) / np.ptp(y) ** 2 if c[1] < 0 else np.inf


def test_losses_equal_one_fit_each_and_the_best_is_the_least():
    t, h, v = flow(0.5, noise=0.01)
    rows = np.arange(0, 200, 8)
    fit = fits.DischargeFit(t[: rows[-1] + 1], h[: rows[-1] + 1], v, rows)
    betas = np.linspace(-3, 3, 13)
    assert fit.losses(betas) == pytest.approx([plain_loss(fit, v, b, t[: rows[-1] + 1], h[: rows[-1] + 1]) for b in betas], rel=1e-6)
    found = fits.discharge_fit(t, h, v, 8 * (t[1] - t[0]), 5)
    near = found["beta"] + np.linspace(-0.5, 0.5, 2001)
    assert fit.losses(np.array([found["beta"]]))[0] <= fit.losses(near).min() + 1e-12
    # the error from differences of the residuals
    y = (v[rows] - v[rows].mean()) / np.ptp(v[rows])

    def model(p):
        w = (h[: rows[-1] + 1] / np.median(h[: rows[-1] + 1])) ** p[2]
        return p[0] + p[1] * np.append(0, np.cumsum(np.diff(t[: rows[-1] + 1]) * (w[1:] + w[:-1]) / 2))[rows]

    x = model([0, 1, found["beta"]])
    p = np.array([*np.polyfit(x, y, 1)[::-1], found["beta"]])
    jac = np.stack([(model(p + d) - model(p - d)) / 2e-5 for d in 1e-5 * np.eye(3)], 1)
    left = y - model(p)
    assert found["se"] == pytest.approx(np.sqrt(np.linalg.inv(jac.T @ jac)[2, 2] * (left @ left) / (len(rows) - 3)), rel=1e-3)


def test_reasons_for_no_exponent():
    t, h, v = flow(0.5)
    reason = lambda *a, **k: fits.discharge_fit(*a, **({"window": 0.4, "least": 8} | k))["reason"]
    gap = v.copy()
    gap[50] = np.nan
    assert reason(t[:2], h[:2], v[:2]) == "few_surfaces" and reason(t, h, gap) == "gap" and reason(t[::-1], h, v) == "times"
    assert reason(t, h, v[::-1]) == "no_net_discharge" and reason(t, h, v, window=3.0) == "few_samples" and reason(t, np.ones(200), v) == "constant"
    assert reason(t, h, v, start=200) == "no_net_discharge"


def test_sines_with_a_trend(spark):
    t = np.linspace(0, 9, 80)
    y = 3 + 0.7 * t + 2 * np.sin(2 * np.pi * t / 2.5 + 0.4)
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(t, y)] + [("b", 1.0, 2.0)], "k string, t double, y double")
    r = {x.k: x for x in T.sinusoid_trend(df, ["k"], "t", "y", 2.5).collect()}
    assert (r["a"].trend, r["a"].amplitude, r["a"].phase) == pytest.approx((0.7, 2, 0.4), abs=1e-9) and r["a"].rmse < 1e-6
    assert r["b"].trend is None
    z = y + np.random.default_rng(0).normal(0, 0.5, 80)
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(t, z)], "k string, t double, y double")
    basis = np.c_[np.ones(80), t, np.cos(2 * np.pi * t / 2.5), np.sin(2 * np.pi * t / 2.5)]
    c = np.linalg.lstsq(basis, z, rcond=None)[0]
    (r,) = T.sinusoid_trend(df, ["k"], "t", "y", 2.5).withColumn("x", F.lit(1)).collect()
    assert (r.trend, r.amplitude, r.rmse) == pytest.approx((c[1], np.hypot(c[2], c[3]), np.sqrt(np.mean((z - basis @ c) ** 2))))
