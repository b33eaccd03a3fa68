"""Numeric kernels Spark lacks: two-sided t probabilities and step cadence."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

#: Fixed values of the cadence search: least samples, energy and correlation, and the range of cadences in Hz.
MIN_SAMPLES, MIN_ENERGY, MIN_CORRELATION, CADENCE_HZ = 8, 1e-4, 0.4, (0.5, 4.0)


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: float) -> np.ndarray:
    """Regularised incomplete beta function by Lentz's continued fraction, on arrays."""
    x, a = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q = np.where(flip, b, a), np.where(flip, a, b)
    z = np.clip(np.where(flip, 1 - x, x), 0, 1)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(z), 1 / safe(1 - (p + q) * z / (p + 1))
    f = d.copy()
    for m in range(1, 300):
        for k in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / safe(1 + k * d), safe(1 + k / c)
            f = f * c * d
        if np.nanmax(np.abs(c * d - 1), initial=0) < 1e-15:
            break
    out = np.where(z <= 0, 0.0, front * f)
    return np.where(flip, 1 - out, out)


def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Probability of a t as far from 0, with df degrees of freedom."""
    t, df = t.to_numpy(float), df.to_numpy(float)
    return pd.Series(np.clip(incomplete_beta(df / (df + t * t), df / 2, 0.5), 0, 1))


def cadence(magnitudes: np.ndarray, rate_hz: float) -> tuple[int, float]:
    """M3: (steps, Hz) of the strongest repetition of acceleration magnitudes at walking cadences; (0, 0) without one."""
    n = len(magnitudes)
    x = magnitudes - magnitudes.mean() if n else magnitudes
    energy = float((x * x).sum())
    if n < MIN_SAMPLES or energy < MIN_ENERGY:
        return 0, 0.0
    lo, hi = max(2, math.floor(rate_hz / CADENCE_HZ[1] + 0.5)), min(n - 1, math.floor(rate_hz / CADENCE_HZ[0] + 0.5))
    if hi <= lo:
        return 0, 0.0
    r = np.array([(x[:-k] * x[k:]).sum() for k in range(lo, hi + 1)]) / energy
    best = int(r.argmax())
    if r[best] < MIN_CORRELATION:
        return 0, 0.0
    hz = rate_hz / (lo + best)
    return max(0, math.floor(hz * n / rate_hz + 0.5)), hz
