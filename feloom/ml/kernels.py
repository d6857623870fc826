"""Numerical kernels on numpy arrays."""

from __future__ import annotations

import numpy as np


def digitize(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many ascending edges are at or below each value."""
    return np.searchsorted(edges, x, side="right")


def percentile(x: np.ndarray, percents: np.ndarray) -> np.ndarray:
    return np.percentile(x, percents)


def histogram(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Counts between ascending edges; the last interval includes its end."""
    return np.histogram(x, edges)[0]


def pchip_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Derivatives of the monotone cubic interpolant: weighted harmonic means inside, one-sided three-point rule at the ends."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    if len(d) == 1:
        return np.array([d[0], d[0]])
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    flat = (np.sign(d[1:]) != np.sign(d[:-1])) | (d[1:] == 0) | (d[:-1] == 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = np.where(flat, 0.0, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]))

    def end(h0: float, h1: float, d0: float, d1: float) -> float:
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if np.sign(s) != np.sign(d0):
            return 0.0
        return 3 * d0 if np.sign(d0) != np.sign(d1) and abs(s) > 3 * abs(d0) else s

    return np.concatenate([[end(h[0], h[1], d[0], d[1])], inner, [end(h[-1], h[-2], d[-1], d[-2])]])


def bernstein(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cubic Bernstein coefficients (4 x intervals) of the interpolant."""
    h, s = np.diff(x), pchip_slopes(x, y)
    return np.stack([y[:-1], y[:-1] + h * s[:-1] / 3, y[1:] - h * s[1:] / 3, y[1:]])


def evaluate(at: np.ndarray, x: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    """Values of a piecewise cubic; beyond the ends the outer pieces go on."""
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    t = (at - x[i]) / (x[i + 1] - x[i])
    a, b, c, d = coefficients[:, i]
    u = 1 - t
    return a * u**3 + 3 * b * t * u**2 + 3 * c * t**2 * u + d * t**3


def log_sum_exp(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[:, 0]
