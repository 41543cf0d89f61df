"""Two-component normal mixture of a binned sample (at most 4,096 rows)."""

from __future__ import annotations

import math

import numpy as np

# Start quantiles here; below the weights 0.70 and 0.30, the floors, tolerances,
# the width factor 2.354820045 and the names of the reasons.
_STARTS = np.array([(0.20, 0.75), (0.35, 0.85), (0.10, 0.65)])
_EMPTY = {
    "threshold": None, "threshold_log": None, "peak": None, "sigma": None, "mean0": None, "mean1": None, "var0": None,
    "var1": None, "weight0": None, "weight1": None, "separation": None, "posterior": None, "converged": False,
    "iterations": 0, "reasons": [], "qc_pass": False,
}


def _log_density(x, mean, var, weight):
    return np.log(np.maximum(weight, 1e-12)) - 0.5 * (np.log(2 * np.pi * var) + (x - mean) ** 2 / var)


def _fit(x: np.ndarray, n: np.ndarray, rounds: int = 300):
    """Best of the deterministic starts, all iterated side by side."""
    total = n.sum()
    mean = (n * x).sum() / total
    spread = (n * (x - mean) ** 2).sum() / total
    floor = max(spread * 1e-6, 1e-10)
    at = np.searchsorted(np.cumsum(n), _STARTS * total, side="left").clip(max=len(x) - 1)
    mu = x[at]
    mu = mu[mu[:, 1] > mu[:, 0]]
    if not len(mu):
        return None
    upper = np.abs(x[None] - mu[:, 1:]) < np.abs(x[None] - mu[:, :1])
    share = (upper * n).sum(axis=1) / total
    w = np.stack([1 - share, share], axis=1)
    w[(w <= 0).any(axis=1)] = (0.70, 0.30)
    var = np.full_like(mu, spread)
    score = np.full(len(mu), -np.inf)
    steps, live, good = np.zeros(len(mu), int), np.ones(len(mu), bool), np.zeros(len(mu), bool)
    for step in range(1, rounds + 1):
        if not live.any():
            break
        ld = _log_density(x[None, :, None], mu[:, None], np.maximum(var, floor)[:, None], w[:, None])
        norm = np.logaddexp(ld[..., 0], ld[..., 1])
        r0 = np.exp(ld[..., 0] - norm)
        resp = np.stack([r0, 1 - r0], axis=-1) * n[None, :, None]
        mass = resp.sum(axis=1)
        live &= ~(mass <= max(1e-8 * total, 1e-6)).any(axis=1)
        new_mu = (resp * x[None, :, None]).sum(axis=1) / mass
        new_var = np.maximum((resp * (x[None, :, None] - new_mu[:, None]) ** 2).sum(axis=1) / mass, floor)
        ll = (n * norm).sum(axis=1)
        flat = live & (step >= 5) & (np.abs(ll - score) <= 1e-9 * (1 + np.abs(score)))
        mu[live], var[live], w[live] = new_mu[live], new_var[live], (mass / total)[live]
        score[live], steps[live] = ll[live], step
        good |= flat
        live &= ~flat
    if not np.isfinite(score).any():
        return None
    i = int(np.nanargmax(np.where(np.isfinite(score), score, -np.inf)))
    order = np.argsort(mu[i], kind="stable")
    return mu[i][order], var[i][order], w[i][order], bool(good[i]), int(steps[i])


def _crossing(mu, var, w):
    """The only background-to-signal root of equal posteriors between the means."""
    # log odds = a x^2 + b x + c
    a, b = (1 / var[0] - 1 / var[1]) / 2, mu[1] / var[1] - mu[0] / var[0]
    c = (mu[0] ** 2 / var[0] - mu[1] ** 2 / var[1]) / 2 + math.log(w[1] / w[0] * math.sqrt(var[0] / var[1]))
    if abs(a) <= 1e-12 * max(0.5 / var[0], 0.5 / var[1], 1.0):
        roots = [-c / b] if b else []
    else:
        disc = b * b - 4 * a * c
        if disc < -1e-12 * max(b * b, abs(4 * a * c), 1.0):
            return None
        half = math.sqrt(max(disc, 0.0))
        roots = [(-b - half) / (2 * a), (-b + half) / (2 * a)]
    tol = 1e-10 * max(abs(mu[0]), abs(mu[1]), 1.0)
    inside = [r for r in roots if mu[0] + tol < r < mu[1] - tol]
    if len(inside) != 1:
        return None
    return inside[0] if 2 * a * inside[0] + b > 0 else None


def _background_peak(x, n, upper, bins=512):
    """Low-intensity mode and its FWHM sigma on a smoothed 512-bin histogram."""
    h, edges = np.histogram(x, bins=bins, range=(x[0], x[-1]), weights=n)
    mid = (edges[1:] + edges[:-1]) / 2
    k = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
    smooth = np.convolve(np.pad(h.astype(float), 8, mode="symmetric"), k / k.sum(), mode="valid")
    low = mid < upper
    if low.sum() < 3:
        return None
    top = int(np.argmax(np.where(low, smooth, -np.inf)))
    base = smooth[low].min()
    if smooth[top] <= base:
        return None
    under = smooth <= base + (smooth[top] - base) / 2
    left = np.nonzero(under[:top])[0]
    right = np.nonzero(under[top + 1 :])[0]
    lw = mid[top] - mid[left[-1] if len(left) else 0]
    rw = mid[top + 1 + right[0] if len(right) else -1] - mid[top]
    width = lw + rw if lw > 0 and rw > 0 else 2 * max(lw, rw)
    if width <= 0:
        return None
    return float(mid[top]), float(max(width / 2.354820045, mid[1] - mid[0]))


def fit_histogram(x: np.ndarray, n: np.ndarray, clip_low: float, clip_high: float) -> dict:
    """Threshold, model and ordered quality reasons of one histogram of log values."""
    bounds = {"clip_low": clip_low, "clip_high": clip_high}
    if n.sum() < 200 or len(x) < 4 or not clip_high > clip_low:
        return {**_EMPTY, **bounds, "error": "too_few_values"}
    fit = _fit(x, n)
    if fit is None:
        return {**_EMPTY, **bounds, "error": "no_start_converged"}
    mu, var, w, converged, steps = fit
    model = {
        "mean0": mu[0], "mean1": mu[1], "var0": var[0], "var1": var[1], "weight0": w[0], "weight1": w[1],
        "converged": converged, "iterations": steps,
    }
    cut = _crossing(mu, var, w) if mu[1] > mu[0] else None
    if cut is None:
        return {**_EMPTY, **bounds, **model, "error": "no_unique_crossing"}
    peak = _background_peak(x, n, cut)
    if peak is None:
        return {**_EMPTY, **bounds, **model, "error": "no_background_peak"}
    separation = math.sqrt(2.0) * (mu[1] - mu[0]) / math.sqrt(var.sum())
    ld = _log_density(cut, mu, var, w)
    posterior = math.exp(ld[1] - np.logaddexp(*ld))
    raw = math.expm1(cut)
    checks = {
        "gmm_not_converged": not converged,
        "component_weight_below_0.005": w.min() < 0.005,
        "component_separation_below_1.0": separation < 1.0,
        "posterior_intersection_outside_means": not mu[0] < cut < mu[1],
        "posterior_intersection_not_above_background_noise": cut <= peak[0] + 0.25 * peak[1],
        "posterior_intersection_numerically_inaccurate": abs(posterior - 0.5) > 1e-6,
        "posterior_threshold_outside_clipped_range": not clip_low <= raw <= clip_high,
    }
    failed = [name for name, bad in checks.items() if bad]
    return {
        **model, **bounds, "threshold": raw, "threshold_log": cut, "peak": peak[0], "sigma": peak[1], "separation": separation,
        "posterior": posterior, "error": None, "reasons": failed, "qc_pass": not failed,
    }
