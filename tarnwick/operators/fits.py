"""Fits that reject outliers or choose their own range, in NumPy for one track; all candidates of a search are fitted at once."""

from __future__ import annotations

import numpy as np

from tarnwick.operators import kernels as K
from tarnwick.operators.stats import MAD_SCALE


def weighted_solutions(basis: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Least squares coefficients for each of many bases (g, n, k) with weights (g, n)."""
    gram = np.einsum("gnk,gn,gnl->gkl", basis, w, basis)
    right = np.einsum("gnk,gn,n->gk", basis, w, y)
    size = np.trace(gram, axis1=1, axis2=2)[:, None, None] / basis.shape[2]
    return np.linalg.solve(gram + 1e-13 * size * np.eye(basis.shape[2]), right[:, :, None])[:, :, 0]


def robust_scale(r: np.ndarray, axis: int = -1) -> np.ndarray:
    return MAD_SCALE * np.median(np.abs(r - np.median(r, axis=axis, keepdims=True)), axis=axis)


#: Fixed values of a release: half frames searched up to 4 after the hint and at most a third of the track, reweightings, weight and loss bounds in
#: deviations, the least deviation in pixels, and the bounds of the noise.
RELEASE_STEP, AFTER_HINT, REWEIGHTINGS, WEIGHT_AT, LOSS_AT, LEAST_SCALE, NOISE = 0.5, 4, 5, 1.5, 3.0, 0.25, (0.15, 1.5)


def released(y: np.ndarray, hint: int, cubic: bool = True) -> dict | None:
    """Release frame and held-then-falling curve of places, one per frame: c0 + c2 u^2 (+ c3 u^3) for u = 0..1 from the release to the end.

    Every half frame up to a bound is tried with a reweighted fit; the least capped mean square decides. rms is that of all places,
    noise that of their changes from frame to frame. None for fewer than four places.
    """
    n = len(y)
    if n < 4 or not np.isfinite(y).all():
        return None
    starts = np.arange(0, min(max(1, hint + AFTER_HINT), n // 3) + 0.01, RELEASE_STEP)
    u = np.maximum(np.arange(n) - starts[:, None], 0) / np.maximum(n - 1 - starts, 1)[:, None]
    basis = np.stack([np.ones_like(u), u**2, *([u**3] if cubic else [])], axis=2)
    w = np.ones_like(u)
    for _ in range(REWEIGHTINGS):
        c = weighted_solutions(basis, y, w)
        left = y - np.einsum("gnk,gk->gn", basis, c)
        scale = np.maximum(LEAST_SCALE, robust_scale(left))[:, None]
        w = np.minimum(1, WEIGHT_AT * scale / np.maximum(np.abs(left), 1e-9))
    loss = np.minimum(left**2, (LOSS_AT * scale) ** 2).mean(axis=1)
    k = int(np.argmin(loss))
    rms, noise = float(np.sqrt(np.mean(left[k] ** 2))), float(np.clip(robust_scale(np.diff(left[k])) / np.sqrt(2), *NOISE))
    return {"release": float(starts[k]), "loss": float(loss[k]), "rms": rms, "noise": noise, "systematic": float(np.sqrt(max(0.0, rms**2 - noise**2))), "coefficients": c[k], "fit": y - left[k]}


def release_model(y: np.ndarray, hint: int) -> dict | None:
    """The release with a free cubic term, and which of parabola and cubic the places ask for: the criterion of Schwarz on the capped losses."""
    wide, plain = released(y, hint), released(y, hint, cubic=False)
    if wide is None:
        return None
    n = len(y)
    worth = [n * np.log(max(f["loss"], LEAST_SCALE**2 / n)) + k * np.log(n) for f, k in ((plain, 3), (wide, 4))]
    return wide | {"cubic": float(wide["coefficients"][2]), "model": "parabola" if worth[0] <= worth[1] else "cubic"}


#: Fixed values of a vertex: rounds of rejection, the limit in deviations and at least in pixels, and what must be kept.
VERTEX_ROUNDS, VERTEX_LIMIT, VERTEX_PIXELS, VERTEX_KEPT, VERTEX_LEAST = 4, 4.0, 1.25, 0.70, 10


def vertex(t: np.ndarray, x: np.ndarray) -> dict | None:
    """Turn and decelerations before and after it, fitted anew without the places that stand off.

    The turn comes from the trimmed search. At most four times the places farther off than the limit leave (or come back), unless too few would be left. quality
    holds rmse, explained share and kept share of both sides. None without a turn.
    """
    found = K.shared_vertex(t, x)
    if found is None:
        return None
    turn = found[0]
    basis = np.c_[np.ones(len(t)), -(np.minimum(0, t - turn) ** 2) / 2, -(np.maximum(0, t - turn) ** 2) / 2]
    keep = np.ones(len(t), bool)
    for _ in range(VERTEX_ROUNDS):
        c = np.linalg.lstsq(basis[keep], x[keep], rcond=None)[0]
        left = x - basis @ c
        middle = np.median(left[keep])
        near = np.abs(left - middle) <= max(VERTEX_PIXELS, VERTEX_LIMIT * float(robust_scale(left[keep])))
        if near.sum() < max(VERTEX_LEAST, int(VERTEX_KEPT * len(t))) or (near == keep).all():
            break
        keep = near
    left = x - basis @ c

    middle_row = int(np.argmin(np.abs(t - turn)))

    def side(rows: slice) -> dict:
        own = keep[rows] if keep[rows].any() else np.ones_like(keep[rows])
        e, v = left[rows][own], x[rows][own]
        return {"rmse": float(np.sqrt(np.mean(e**2))), "explained": 1 - float(e @ e) / max(float(((v - v.mean()) ** 2).sum()), 1e-12), "kept": float(own.mean())}

    return {"turn": turn, "top": float(c[0]), "before": float(c[1]), "after": float(c[2]), "kept": float(keep.mean()), "quality": (side(slice(0, middle_row + 1)), side(slice(middle_row, None)))}


#: Fixed values of a discharge: grid points of a range of exponents, its first and last bound, the least change of ln h, and the worst condition of the fit.
EXPONENTS, FIRST_BOUND, LAST_BOUND, LEAST_LOG_CHANGE, WORST_CONDITION = 129, 8.0, 1024.0, 1e-8, 1e10


class DischargeFit:
    """V = a - k * integral of h^beta: the loss of many exponents at once, on volumes that are a window apart.

    Heights enter relative to their median and powers relative to the greatest, so that no exponent overflows.
    """

    def __init__(self, t: np.ndarray, h: np.ndarray, v: np.ndarray, rows: np.ndarray):
        self.rows, self.t = rows, t
        self.log = np.log(h / np.median(h))
        self.scale = float(np.ptp(v[rows]))
        self.y = (v[rows] - v[rows].mean()) / self.scale

    def areas(self, values: np.ndarray) -> np.ndarray:
        """Integrals of many functions (g, n) up to each sample."""
        steps = np.diff(self.t) * (values[:, 1:] + values[:, :-1]) / 2
        return np.concatenate([np.zeros((len(values), 1)), np.cumsum(steps, axis=1)], axis=1)[:, self.rows]

    def powers(self, betas: np.ndarray) -> np.ndarray:
        e = betas[:, None] * self.log
        return np.exp(e - e.max(axis=1, keepdims=True))

    def losses(self, betas: np.ndarray) -> np.ndarray:
        """Mean squares of the best lines of the volume over the integral; infinite where it would not fall."""
        x = self.areas(self.powers(betas))
        whole = x[:, -1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            x = x / whole
            d = x - x.mean(axis=1, keepdims=True)
            xy, xx = d @ self.y, (d * d).sum(axis=1)
            loss = np.maximum(0, self.y @ self.y - xy * xy / xx) / len(self.y)
        return np.where((whole[:, 0] > np.finfo(float).tiny) & (xx > 0) & (xy < 0), loss, np.inf)

    def error(self, beta: float) -> float | None:
        """Standard error of the exponent from the fit's derivatives; None if it is not determined."""
        p = self.powers(np.array([beta]))
        raw, bent = self.areas(p)[0], self.areas(p * self.log)[0]
        x = raw / raw[-1]
        slope = float(np.polyfit(x, self.y, 1)[0])
        basis = np.c_[np.ones(len(x)), x, slope * (bent - x * bent[-1]) / raw[-1]]
        if not np.linalg.cond(basis) <= WORST_CONDITION:
            return None
        left = self.y - np.polyval(np.polyfit(x, self.y, 1), x)
        return float(np.sqrt(max(0.0, np.linalg.pinv(basis.T @ basis)[2, 2]) * float(left @ left) / max(1, len(x) - 3)))


def discharge_fit(t: np.ndarray, h: np.ndarray, v: np.ndarray, window: float, least: int, start: int = 0) -> dict:
    """beta, its standard error and the samples used, or the reason why there is none.

    The range of exponents doubles until the best one lies inside it; finer grids around the best point follow.
    """
    fine = np.isfinite(h) & np.isfinite(v) & np.isfinite(t) & (np.nan_to_num(h) > 0) & (np.nan_to_num(v) >= 0)
    places = np.flatnonzero(fine)
    if len(places) < 3:
        return {"reason": "few_surfaces"}
    inside = slice(max(places[0], start), places[-1] + 1)
    if not fine[places[0] : places[-1] + 1].all():
        return {"reason": "gap"}
    t, h, v = t[inside], h[inside], v[inside]
    if (np.diff(t) <= 0).any():
        return {"reason": "times"}
    small = np.finfo(float).eps * max(1.0, float(np.abs(v).max(initial=0)))
    if not len(t) or np.median(v[t <= t[0] + window + 1e-9]) - np.median(v[t >= t[-1] - window - 1e-9]) <= 0 or np.ptp(v) <= small:
        return {"reason": "no_net_discharge"}
    rows = np.array(K.spaced(t, window))
    if len(rows) < least:
        return {"reason": "few_samples", "n": len(rows)}
    t, h = t[: rows[-1] + 1], h[: rows[-1] + 1]
    if np.ptp(np.log(h)) <= LEAST_LOG_CHANGE or np.ptp(v[rows]) <= small:
        return {"reason": "constant", "n": len(rows)}
    fit = DischargeFit(t, h, v, rows)
    bound = FIRST_BOUND
    while True:
        grid = np.linspace(-bound, bound, EXPONENTS)
        losses = fit.losses(grid)
        k = int(np.argmin(losses))
        if not np.isfinite(losses[k]):
            return {"reason": "never_falls", "n": len(rows)}
        if 0 < k < EXPONENTS - 1:
            break
        if bound >= LAST_BOUND:
            return {"reason": "out_of_range", "n": len(rows)}
        bound = min(2 * bound, LAST_BOUND)
    beta, width = float(grid[k]), float(grid[1] - grid[0])
    while width > 1e-8 * max(1.0, abs(beta)):
        grid = beta + width * np.linspace(-1, 1, 21)
        beta, width = float(grid[int(np.argmin(fit.losses(grid)))]), width / 8
    se = fit.error(beta)
    if se is None:
        return {"reason": "ill_conditioned", "n": len(rows)}
    return {"beta": beta, "se": se, "low": beta - 1.96 * se, "high": beta + 1.96 * se, "n": len(rows), "rms": float(np.sqrt(fit.losses(np.array([beta]))[0])) * fit.scale, "bound": bound}
