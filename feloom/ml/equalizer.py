"""Score equalisation: a monotone cubic approximation of a sample's distribution function."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import kernels


@dataclass
class EqualizerModel:
    minval: float
    maxval: float
    noise: float = 1e-4
    eps: float = 1e-3
    random_value: float | None = None
    intervals: np.ndarray | None = None
    coefficients: np.ndarray | None = None

    def normal(self, x: np.ndarray) -> np.ndarray:
        """To the unit scale, onto a grid of noise, edges stretched."""
        x = (x - self.minval) / (self.maxval - self.minval)
        if self.noise > 0:
            r = np.random.random(len(x)) if self.random_value is None else self.random_value
            x = self.noise * np.floor(x / self.noise + 0.5) + (self.noise * r - self.noise / 2)
        return stretch(x, self.eps)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan)
        good = ~np.isnan(x)
        out[good] = kernels.evaluate(self.normal(x[good]), np.asarray(self.intervals), np.asarray(self.coefficients))
        return out


def stretch(x: np.ndarray, eps: float) -> np.ndarray:
    """Map the line to (0, 1): almost linear inside, roots near the ends of [0, 1], arc tangents beyond.

    Fixed formula: results must agree with those of other implementations.
    """
    delta = eps / (2 * (1 - 3 * eps))
    low, high = delta, 1 - delta
    with np.errstate(invalid="ignore"):
        return np.select(
            [x < 0, x <= low, x < high, x <= 1, x > 1],
            [
                eps * (1 - 2 * np.arctan(np.sqrt(np.maximum(0, -x))) / np.pi),
                eps * (np.sqrt(np.maximum(0, x) / delta) + 1),
                ((1 - 4 * eps) * x + 2 * eps * (low + high) - low) / (high - low),
                1 - eps * (1 + np.sqrt(np.maximum(0, 1 - x) / delta)),
                1 + eps * (2 * np.arctan(np.sqrt(np.maximum(0, x - 1))) / np.pi - 1),
            ],
            np.nan,
        )


def fit(x: np.ndarray, noise: float = 1e-4, eps: float = 1e-3, random_value: float | None = None, num_bins: int = 10_000, min_size: int = 1) -> tuple[str, EqualizerModel | None]:
    """A message (empty if all is well) and the model, None if there are too few values."""
    if len(x) < min_size or not len(x):
        return f"too few values to estimate a distribution: {len(x)}", None
    lo, hi = float(x.min()), float(x.max())
    message = ""
    if lo >= hi:
        lo, hi, message = 0.0, 1.0, "a single unique value can't be equalised properly"
    model = EqualizerModel(lo, hi, noise, eps, random_value)
    z = model.normal(x)
    unique = np.unique(z)
    step = -(-len(unique) // num_bins)
    top = unique[-1]
    picked = unique[: len(unique) - step + 1 : step]
    edges = np.unique(np.concatenate([[0.0], picked, [top + min((1 - top) / 2, 1e-12), 1.0]]))
    counts = kernels.histogram(z, edges)
    model.intervals = edges
    model.coefficients = kernels.bernstein(edges, np.concatenate([[0.0], np.cumsum(counts) / counts.sum()]))
    return message, model
