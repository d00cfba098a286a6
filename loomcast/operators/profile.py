"""The likelihood of mean scale * (mu_i + alpha * x_it) + offset as a profile over alpha, in numpy.

At a given alpha each cell's mu is a problem of its own, so cells can be handled in batches wherever they lie; a batch gives a few
sums for every decay rate whose excitation it holds. Poisson, or negative binomial with dispersion k.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa

TINY = 1e-12


class Cells:
    """Counts y of n cells as flat arrays: cell, excitation at each rate, and the steps that a row stands for."""

    def __init__(self, n: int, who: np.ndarray, y: np.ndarray, x: np.ndarray, weight: np.ndarray) -> None:
        self.n, self.who, self.y, self.x, self.weight = n, who, y, x, weight

    @classmethod
    def of_panel(cls, y: np.ndarray, x: np.ndarray) -> Cells:
        """Of arrays (cells, steps)."""
        n, steps = y.shape
        return cls(n, np.repeat(np.arange(n), steps), y.ravel().astype(float), x.reshape(-1, 1), np.ones(y.size))

    @classmethod
    def of_lists(cls, batch: pa.RecordBatch, rates: int) -> Cells:
        """Of rows ``n0, ys, xs``; a row of y = 0 and x = 0 stands for each cell's n0 idle steps."""
        n0 = batch.column("n0").to_numpy()
        n, who = len(n0), np.repeat(np.arange(len(n0)), batch.column("ys").value_lengths().fill_null(0).to_numpy())
        ys, xs = batch.column("ys").flatten().to_numpy(), batch.column("xs").flatten().to_numpy().reshape(-1, rates)
        return cls(n, np.concatenate([who, np.arange(n)]), np.concatenate([ys, np.zeros(n)]), np.concatenate([xs, np.zeros((n, rates))]), np.concatenate([np.ones(len(ys)), n0]))

    def total(self, v: np.ndarray) -> np.ndarray:
        """Sums by cell of a column for each rate."""
        return np.column_stack([np.bincount(self.who, self.weight * c, self.n) for c in v.T])

    def mean(self, mu: np.ndarray, alpha: np.ndarray, scale: float, offset: float) -> np.ndarray:
        return scale * np.maximum(mu[self.who] + alpha * self.x, TINY) + offset

    def best_mu(self, alpha: np.ndarray, scale: float, offset: float, k: float | None) -> np.ndarray:
        """Every cell's mu at each rate: scoring steps, within the bracket that the slope's sign leaves below the largest count."""
        top = np.zeros(self.n)
        np.maximum.at(top, self.who, self.y)
        lo, hi = np.zeros((self.n, len(alpha))), np.repeat(top[:, None] / scale + TINY, len(alpha), 1)
        y, mu = self.y[:, None], lo
        for step in range(80):
            lam = self.mean(mu, alpha, scale, offset)
            grown = lam * (1 if k is None else 1 + lam / k)
            slope, info = scale * self.total((y - lam) / grown), scale**2 * self.total(1 / grown)
            if not step:
                idle = slope <= 0
            up = slope > 0
            lo, hi = np.where(up, np.maximum(mu, lo), lo), np.where(up, hi, np.minimum(mu, hi))
            fresh = mu + slope / np.maximum(info, TINY)
            fresh = np.where((fresh > lo) & (fresh < hi), fresh, (lo + hi) / 2)
            fresh = np.where(idle, 0.0, fresh)
            if (np.abs(fresh - mu) <= 1e-13 * (1e-3 + fresh)).all():
                break
            mu = fresh
        return fresh


def slope_at(y: np.ndarray, lam: np.ndarray, k: float | None) -> np.ndarray:
    return (y - lam) / (lam * (1 if k is None else 1 + lam / k))


def value_at(y: np.ndarray, lam: np.ndarray, k: float | None) -> np.ndarray:
    """Log-likelihood without the terms that depend on y (and the dispersion) alone."""
    return y * np.log(lam) - lam if k is None else y * (np.log(lam) - np.log(k + lam)) + k * (math.log(k) - np.log(k + lam))


def evaluate(c: Cells, alpha: np.ndarray, scale: float, offset: float, k: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, slope and information of the profile over alpha, for each rate."""
    mu = c.best_mu(alpha, scale, offset, k)
    lam = c.mean(mu, alpha, scale, offset)
    y, w = c.y[:, None], scale**2 / (lam * (1 if k is None else 1 + lam / k))
    a, b = c.total(w * c.x), c.total(w)
    info = c.total(w * c.x**2) - np.where(mu > 0, a * a / np.maximum(b, TINY), 0)
    return c.total(value_at(y, lam, k)).sum(0), scale * c.total(slope_at(y, lam, k) * c.x).sum(0), info.sum(0)


def climb(at: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], alpha: np.ndarray, steps: int, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(alpha, value, converged, passes) of each rate: a scoring step, then secant steps, kept within the bracket that the slopes' signs leave."""
    rates = len(alpha)
    lo, hi, done, value = np.zeros(rates), np.full(rates, np.inf), np.zeros(rates, bool), np.full(rates, -np.inf)
    best, used, before = alpha.copy(), 0, None
    for used in range(1, steps + 1):
        now, slope, info = at(alpha)
        info = np.maximum(info, 1e-10)
        curve = info
        if before is not None:
            moved = np.where(alpha == before[0], 1.0, alpha - before[0])
            secant = np.where(alpha == before[0], 0.0, (before[1] - slope) / moved)
            curve = np.where(secant > 0.05 * info, secant, info)
        before = alpha, slope
        better = now > value
        best, value = np.where(better, alpha, best), np.where(better, now, value)
        done |= ((alpha <= 0) & (slope <= 0)) | (slope**2 / info <= 2 * tol * (1 + np.abs(now))) | (hi - lo <= 1e-9 * (1e-6 + lo))
        if done.all():
            break
        lo, hi = np.where(slope > 0, np.maximum(lo, alpha), lo), np.where(slope > 0, hi, np.minimum(hi, alpha))
        step = alpha + slope / curve
        middle = np.where(np.isfinite(hi), (lo + np.where(np.isfinite(hi), hi, 0)) / 2, 2 * alpha + 0.1)
        # zero itself may be the maximum
        step = np.where((step <= 0) & (lo == 0), np.where(alpha > 1e-6, alpha / 8, 0.0), np.where((step > lo) & (step < hi), step, middle))
        alpha = np.where(done, alpha, np.minimum(step, 10 * alpha + 1))
    return best, value, done, used
