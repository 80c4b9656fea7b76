"""Recursions over one series in numpy, without Spark: each output depends on the output before it.

Conventions: float arrays in, float arrays out, NaN where the value is not yet defined.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _smoothed(x: np.ndarray, first: int, seed: float, alpha: float) -> np.ndarray:
    """NaN before ``first``, ``seed`` there, then y += alpha * (x - y)."""
    out = np.full(len(x), np.nan)
    if first >= len(x):
        return out
    y = out[first] = seed
    for i in range(first + 1, len(x)):
        y += alpha * (x[i] - y)
        out[i] = y
    return out


def ema(x: np.ndarray, n: int, first: int | None = None) -> np.ndarray:
    """Exponential mean, seeded by the mean of the n values ending at ``first`` (the n-th by default)."""
    first = n - 1 if first is None else first
    if len(x) <= first or first < n - 1:
        return np.full(len(x), np.nan)
    return _smoothed(x, first, float(x[first - n + 1 : first + 1].mean()), 2 / (n + 1))


def wilder(x: np.ndarray, n: int, first: int) -> np.ndarray:
    """Wilder's mean of x, seeded by the mean of the n values ending at ``first``."""
    if len(x) <= first:
        return np.full(len(x), np.nan)
    return _smoothed(x, first, float(x[first - n + 1 : first + 1].mean()), 1 / n)


def rsi(close: np.ndarray, n: int = 14) -> np.ndarray:
    d = np.diff(close, prepend=np.nan)
    up, down = wilder(np.maximum(d, 0), n, n), wilder(np.maximum(-d, 0), n, n)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(np.isnan(up), np.nan, np.where(up + down == 0, 0.0, 100 * up / (up + down)))


def macd(close: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, signal, histogram), all from the bar where the signal is first defined."""
    line = ema(close, fast, slow - 1) - ema(close, slow)
    sig = np.full(len(close), np.nan)
    if len(close) >= slow:
        sig[slow - 1 :] = ema(line[slow - 1 :], signal)
    known = ~np.isnan(sig)
    return np.where(known, line, np.nan), sig, np.where(known, line - sig, np.nan)


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    out = np.full(len(close), np.nan)
    out[1:] = np.maximum(high[1:] - low[1:], np.maximum(abs(high[1:] - close[:-1]), abs(low[1:] - close[:-1])))
    return out


def atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> np.ndarray:
    return wilder(true_range(high, low, close), n, n)


def adx(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> np.ndarray:
    """Sums of directional moves and ranges start over n - 1 bars and then decay by a part in n."""
    size = len(close)
    out = np.full(size, np.nan)
    if size < 2 * n:
        return out
    up, down = np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan)
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    tr = true_range(high, low, close)
    p, m, t = (float(x[1:n].sum()) for x in (plus, minus, tr))
    dx = []
    for i in range(n, size):
        p, m, t = p - p / n + plus[i], m - m / n + minus[i], t - t / n + tr[i]
        a, b = (100 * p / t, 100 * m / t) if t else (0.0, 0.0)
        now = 100 * abs(a - b) / (a + b) if a + b else (dx[-1] if dx else 0.0)
        dx.append(now)
        if len(dx) == n:
            out[i] = sum(dx) / n
        elif len(dx) > n:
            out[i] = (out[i - 1] * (n - 1) + now) / n
    return out


def sar(high: np.ndarray, low: np.ndarray, step: float = 0.02, most: float = 0.2) -> np.ndarray:
    """Parabolic stop and reverse, from the second bar on."""
    size = len(high)
    out = np.full(size, np.nan)
    if size < 2:
        return out
    down_move, up_move = low[0] - low[1], high[1] - high[0]
    rising = not (down_move > up_move and down_move > 0)
    stop, extreme, pace = (low[0], high[1], step) if rising else (high[0], low[1], step)
    before_hi, before_lo = high[1], low[1]
    for i in range(1, size):
        hi0, lo0, before_hi, before_lo = before_hi, before_lo, high[i], low[i]
        if (low[i] <= stop) if rising else (high[i] >= stop):
            rising = not rising
            stop = min(extreme, lo0, low[i]) if rising else max(extreme, hi0, high[i])
            out[i] = stop
            pace, extreme = step, (high[i] if rising else low[i])
        else:
            out[i] = stop
            if (high[i] > extreme) if rising else (low[i] < extreme):
                extreme, pace = (high[i] if rising else low[i]), min(most, pace + step)
        stop += pace * (extreme - stop)
        stop = min(stop, lo0, low[i]) if rising else max(stop, hi0, high[i])
    return out


@dataclass(frozen=True)
class Turn:
    """A confirmed swing point."""

    kind: str  # "high" or "low"
    idx: int
    value: float
    confirmed: int
    size: float  # the magnitude at its bar


def turns(high: np.ndarray, low: np.ndarray, threshold: np.ndarray, magnitude: np.ndarray | None = None) -> list[Turn]:
    """Zigzag: a candidate extreme is confirmed once price has moved its own bar's threshold away from it,
    on a later bar; kinds alternate.  A candidate without a threshold is never confirmed."""
    magnitude = threshold if magnitude is None else magnitude
    out: list[Turn] = []
    if not len(high):
        return out
    top = bottom = 0
    seek = ""
    for i in range(1, len(high)):
        top = i if high[i] > high[top] else top
        bottom = i if low[i] < low[bottom] else bottom
        fell = top < i and high[top] - low[i] >= threshold[top]
        rose = bottom < i and high[i] - low[bottom] >= threshold[bottom]
        if fell and seek != "low":
            out.append(Turn("high", top, float(high[top]), i, float(magnitude[top])))
            seek, bottom = "low", i
        elif rose and seek != "high":
            out.append(Turn("low", bottom, float(low[bottom]), i, float(magnitude[bottom])))
            seek, top = "high", i
    return out


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) by least squares."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    d = x - x.mean()
    ss = float(d @ d)
    slope = float(d @ (y - y.mean())) / ss if ss else 0.0
    return slope, float(y.mean() - slope * x.mean())


def r_squared(y: np.ndarray, fitted: np.ndarray) -> float:
    total = float(((y - y.mean()) ** 2).sum())
    return 1.0 if total == 0 else 1 - float(((y - fitted) ** 2).sum()) / total


def apex(upper: tuple[float, float], lower: tuple[float, float]) -> float | None:
    """The bar at which two lines (slope, intercept) meet; None if parallel."""
    gap = upper[0] - lower[0]
    return None if gap == 0 else (lower[1] - upper[1]) / gap


def roundness(y: np.ndarray) -> float:
    """R squared of a parabola through a path."""
    if len(y) < 3:
        return 0.0
    x = np.linspace(-1, 1, len(y))
    return r_squared(y, np.polyval(np.polyfit(x, y, 2), x))


def touches(high: np.ndarray, low: np.ndarray, level: np.ndarray, tolerance: np.ndarray) -> int:
    """Bars whose high or low lies within the tolerance of the level; bars without one don't count."""
    with np.errstate(invalid="ignore"):
        return int(((abs(high - level) <= tolerance) | (abs(low - level) <= tolerance)).sum())


def student_t_two_sided(t: float, df: int) -> float:
    """Two-sided p-value of Student's t, by the continued fraction of the incomplete beta function."""
    import math

    if df <= 0:
        return float("nan")
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 1.0
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out
