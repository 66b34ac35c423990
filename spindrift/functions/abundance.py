"""Coverage: distance of two fragments' depth distributions, and correlation over samples."""

from __future__ import annotations

import math

import numpy as np

MIN_CV = 1.0

# The complementary error function by Taylor's formula from the nearest of evenly spaced points.
_FROM, _TO, _PER = -6, 27, 512
_POINTS = np.arange(_FROM * _PER, _TO * _PER + 1) / _PER
_VALUES = np.array([math.erfc(x) for x in _POINTS])
_SLOPES = -2 / math.sqrt(math.pi) * np.exp(-_POINTS * _POINTS)


def erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function, within 4e-16 of its value."""
    x = np.clip(x, _FROM, _TO)
    at = np.rint((x - _FROM) * _PER).astype(np.int64)
    p = _POINTS[at]
    h, pp = x - p, p * p
    # derivatives are the slope times 1, -2p, 4pp - 2, 12p - 8ppp
    series = 1 + h * (-p + h * ((2 * pp - 1) / 3 + h * (p * (3 - 2 * pp) / 6)))
    return _VALUES[at] + _SLOPES[at] * h * series


def normal_cdf(mean, sd, x) -> np.ndarray:
    return 0.5 * erfc((mean - x) / (sd * math.sqrt(2)))


def distance(m1, v1, m2, v2) -> np.ndarray:
    """Share of two normal distributions that does not overlap, between their one or two crossing points.

    The densities cross at centre - half and centre + half (once, midway, if the variances are
    equal). Between crossings one curve lies above the other, so the share is how much the gap of
    the two distribution functions changes from the first crossing to the last.
    """
    m1, m2, v1, v2 = np.maximum(m1, 1e-6), np.maximum(m2, 1e-6), np.maximum(v1, 1.0), np.maximum(v2, 1.0)
    wider = v1 - v2
    once = np.abs(wider) < 1e-4
    by = np.where(once, 1.0, wider)
    centre = np.where(once, (m1 + m2) / 2, (m2 * v1 - m1 * v2) / by)
    half = np.sqrt(np.maximum(v1 * v2 * ((m1 - m2) ** 2 + wider * np.log(v1 / v2)), 0)) / np.abs(by)
    s1, s2 = np.sqrt(v1), np.sqrt(v2)

    def gap(x):
        return normal_cdf(m1, s1, x) - normal_cdf(m2, s2, x)

    share = np.abs(np.where(once, gap(centre), gap(centre + half) - gap(centre - half)))
    return np.clip(np.where(m1 == m2, 0.0, share), 1e-6, 1 - 1e-6)


def all_samples(m1, v1, m2, v2, min_cv: float = MIN_CV) -> tuple[np.ndarray, np.ndarray]:
    """(mean distance over the samples with signal, 1 if there is none; number of such samples) of pairs; columns are samples."""
    nz = (m1 > min_cv) | (m2 > min_cv)
    d = distance(m1, v1, m2, v2) if m1.size else np.zeros(m1.shape)
    n = nz.sum(axis=1)
    return np.where(n > 0, (d * nz).sum(axis=1) / np.maximum(n, 1), 1.0), n


def correlation(m1, m2) -> np.ndarray:
    """Pearson correlation over samples; NaN where one side is constant."""
    a, b = m1 - m1.mean(axis=1, keepdims=True), m2 - m2.mean(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
