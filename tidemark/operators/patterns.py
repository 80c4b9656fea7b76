"""Chart patterns: detectors propose shapes, one lifecycle follows them, one score grades them.

A shape is data: its turns, the lines whose crossing completes it (upwards, downwards or either), what each
side would aim for and give up at, what spoils it before, and when it lapses.  A new detector is a function from
a :class:`Chart` to shapes; ``scan`` takes any list of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.functions import kernels
from tidemark.functions.kernels import Turn
from tidemark.operators.bars import arrays

#: Weights of the score's parts.
WEIGHTS = {"geometric_cleanliness": 0.30, "volume_signature": 0.25, "duration_fit": 0.15, "prior_trend": 0.15, "breakout_strength": 0.15}
TURN_ATR, FINE_ATR, MIN_BARS = 2.5, 1.0, 100
TREND_PCT, TREND_CAP, CUP_TREND_PCT = 15.0, 30.0, 30.0
TOUCH_ATR, TOUCH_PCT, TOUCHES = 0.5, 0.005, 2
VOLUME_BARS, VOLUME_MULT, VOLUME_CAP = 50, 1.4, 1.8
BUFFER, LIFESPANS, RECLAIM, STRENGTH_ATR = 0.001, 2.0, 5, 1.0
DOUBLE_PCT, SHOULDER_PCT, LEG_BARS, NECK_PCT = 8.0, 15.0, 5, 10.0
WINDOW, FLAT_ATR = 6, 0.05
RIM_PCT, DEPTH_PCT, ROUND, CUP_TURNS, RETRACE_PCT = 5.0, (5.0, 60.0), 0.5, 12, 50.0
CONTRACTIONS, VIOLATIONS, TIGHT, NEAR_HIGH_PCT = (2, 6), 1, 1.0, 25.0
TYPICAL = {"double": (10, 120), "shoulders": (20, 180), "triangle": (15, 90), "cup": (25, 150), "vcp": (15, 90)}


@dataclass(frozen=True)
class Spans:
    """Bar counts that differ between daily and weekly charts."""

    trend: int = 20
    averages: tuple[int, int, int] = (50, 150, 200)
    atrs: tuple[int, int] = (10, 50)
    rising: int = 20
    year: int = 252


DAILY, WEEKLY = Spans(), Spans(4, (10, 30, 40), (2, 10), 4, 52)

Line = tuple[float, float]  # slope, intercept


def at(line: Line, i: float) -> float:
    return line[0] * i + line[1]


@dataclass
class Shape:
    name: str
    family: str
    bias: str  # bullish, bearish or neutral
    turns: list[Turn]
    levels: dict[str, float]
    clean: float
    trend: float
    up: tuple[Line, float, float] | None = None  # trigger line, target, stop
    down: tuple[Line, float, float] | None = None
    lines: dict[str, Line] = field(default_factory=dict)
    spoiled: np.ndarray | None = None  # by bar, before a breakout
    lapses: int | None = None

    @property
    def length(self) -> int:
        return self.turns[-1].idx - self.turns[0].idx


class Chart:
    """One series' arrays, with averages worked out when a detector asks."""

    def __init__(self, pdf: pd.DataFrame, spans: Spans = DAILY):
        self.spans = spans
        self.high, self.low, self.close = arrays(pdf)
        self.volume = pdf["volume"].to_numpy(float)
        self.n = len(pdf)

    @cached_property
    def atr(self) -> np.ndarray:
        return self.atr_of(14)

    @cached_property
    def turns(self) -> list[Turn]:
        return kernels.turns(self.high, self.low, TURN_ATR * self.atr)

    @cached_property
    def fine_turns(self) -> list[Turn]:
        return kernels.turns(self.high, self.low, FINE_ATR * self.atr)

    @cached_property
    def rel_volume(self) -> np.ndarray:
        mean = self.mean(self.volume, VOLUME_BARS)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(mean > 0, self.volume / mean, np.nan)

    def atr_of(self, n: int) -> np.ndarray:
        return kernels.atr(self.high, self.low, self.close, n)

    @staticmethod
    def mean(x: np.ndarray, n: int) -> np.ndarray:
        return pd.Series(x).rolling(n).mean().to_numpy()

    def prior(self, t: Turn, way: str) -> float | None:
        """Move into a turn, in % from the opposite extreme of the bars before it; None without enough of them."""
        first = max(0, t.idx - 3 * self.spans.trend)
        if t.idx + 1 - first < self.spans.trend + 1:
            return None
        ref = float(self.low[first : t.idx + 1].min() if way == "up" else self.high[first : t.idx + 1].max())
        return None if ref <= 0 else (t.value - ref if way == "up" else ref - t.value) / ref * 100


def _symmetry(a: float, b: float, scale: float | None = None) -> float:
    scale = (a + b) / 2 if scale is None else scale
    return float(np.clip(1 - abs(a - b) / scale, 0, 1)) if scale > 0 else 0.0


def _shrinking(x: list[float]) -> float:
    return sum(b <= a for a, b in zip(x, x[1:], strict=False)) / (len(x) - 1) if len(x) > 1 else 1.0


def double_extremes(c: Chart) -> Iterator[Shape]:
    for p, t, q in zip(c.turns, c.turns[1:], c.turns[2:], strict=False):
        top = p.kind == "high"
        trend = c.prior(p, "up" if top else "down")
        if p.value <= 0 or abs(p.value - q.value) / p.value * 100 > DOUBLE_PCT or trend is None or trend < TREND_PCT:
            continue
        far = max(p.value, q.value) if top else min(p.value, q.value)
        side = ((0.0, t.value), 2 * t.value - (p.value + q.value) / 2, far)
        yield Shape("double_top" if top else "double_bottom", "double", "bearish" if top else "bullish", [p, t, q], {"p1": p.value, "neckline": t.value, "p2": q.value}, _symmetry(p.value, q.value), trend, None if top else side, side if top else None, spoiled=c.high > far if top else c.low < far)


def shoulders(c: Chart) -> Iterator[Shape]:
    for five in zip(*(c.turns[k:] for k in range(5)), strict=False):
        p, t, head, u, q = five
        top, sign = p.kind == "high", 1 if p.kind == "high" else -1
        legs = [b.idx - a.idx for a, b in zip(five, five[1:], strict=False)]
        if head.value <= 0 or sign * (head.value - p.value) <= 0 or sign * (head.value - q.value) <= 0 or abs(p.value - q.value) / head.value * 100 > SHOULDER_PCT or min(legs) < LEG_BARS:
            continue
        trend = c.prior(p, "up" if top else "down")
        if trend is None or trend < TREND_PCT:
            continue
        neck = kernels.fit(np.array([t.idx, u.idx]), np.array([t.value, u.value]))
        base = at(neck, t.idx)
        if base <= 0 or abs(neck[0] * (u.idx - t.idx)) / base * 100 > NECK_PCT:
            continue
        aim = at(neck, q.idx) - sign * abs(head.value - at(neck, head.idx))
        clean = (_symmetry(p.value, q.value, head.value) + _symmetry(head.idx - p.idx, q.idx - head.idx, q.idx - p.idx)) / 2
        side = (neck, aim, head.value)
        names = ("left_shoulder", "neckline_t1", "head", "neckline_t2", "right_shoulder")
        yield Shape("head_and_shoulders" if top else "inverse_head_and_shoulders", "shoulders", "bearish" if top else "bullish", list(five), dict(zip(names, (x.value for x in five), strict=True)), clean, trend, None if top else side, side if top else None, {"neckline": neck}, c.high > head.value if top else c.low < head.value)


def _wedge(up: float, down: float) -> tuple[str, str] | None:
    """(shape, bias) by the slopes of the upper and lower line in ATRs a bar."""
    if abs(up) < FLAT_ATR and down > FLAT_ATR:
        return "ascending_triangle", "bullish"
    if abs(down) < FLAT_ATR and up < -FLAT_ATR:
        return "descending_triangle", "bearish"
    if up < -FLAT_ATR and down > FLAT_ATR:
        return "symmetric_triangle", "neutral"
    if up > FLAT_ATR and down > FLAT_ATR:
        return "rising_wedge", "bearish"
    if up < -FLAT_ATR and down < -FLAT_ATR:
        return "falling_wedge", "bullish"
    return None


def triangles(c: Chart) -> Iterator[Shape]:
    for k in range(len(c.turns) - WINDOW + 1):
        w = c.turns[k : k + WINDOW]
        first, last = w[0].idx, w[-1].idx
        sides = [[t for t in w if t.kind == kind] for kind in ("high", "low")]
        if min(map(len, sides)) < TOUCHES:
            continue
        xy = [(np.array([t.idx for t in s], float), np.array([t.value for t in s])) for s in sides]
        upper, lower = (kernels.fit(x, y) for x, y in xy)
        a = c.atr[last]
        if upper[0] >= lower[0] or not a > 0:
            continue
        kind, end = _wedge(upper[0] / a, lower[0] / a), kernels.apex(upper, lower)
        if kind is None or end is None or end <= last:
            continue
        i = np.arange(first, last + 1)
        span = slice(first, last + 1)
        met = []
        for line in (upper, lower):
            level = at(line, i)
            met.append(kernels.touches(c.high[span], c.low[span], level, np.where(np.isnan(c.atr[span]), np.nan, np.maximum(TOUCH_ATR * c.atr[span], TOUCH_PCT * level))))
        if min(met) < TOUCHES:
            continue
        height = at(upper, first) - at(lower, first)
        hi, lo = at(upper, last), at(lower, last)
        fits = np.mean([np.clip(kernels.r_squared(y, at(line, x)), 0, 1) for (x, y), line in zip(xy, (upper, lower), strict=True)])
        closing = (_shrinking([abs(b.value - x.value) for x, b in zip(w, w[1:], strict=False)]) + float(np.clip((last - first) / (end - first), 0, 1))) / 2
        clean = 0.4 * float(fits) + 0.2 * float(np.mean([min(m / TOUCHES, 1) for m in met])) + 0.4 * closing
        levels = {"upper_start": at(upper, first), "upper_end": hi, "lower_start": at(lower, first), "lower_end": lo, "apex_price": at(upper, end), "upper_target": hi + height, "lower_target": lo - height, "upper_stop": lo, "lower_stop": hi}
        lapses = min(last + int(LIFESPANS * (last - first)), math.ceil(round(end, 6)))
        trend = max(c.prior(w[0], "up") or 0.0, c.prior(w[0], "down") or 0.0)
        yield Shape(kind[0], "triangle", kind[1], w, levels, clean, trend, (upper, hi + height, lo), (lower, lo - height, hi), {"upper": upper, "lower": lower}, None, lapses)


def cups(c: Chart) -> Iterator[Shape]:
    for i, rim in enumerate(c.turns):
        cup, sign = rim.kind == "high", 1 if rim.kind == "high" else -1
        trend = c.prior(rim, "up" if cup else "down")
        if rim.value <= 0 or trend is None or trend < CUP_TREND_PCT:
            continue
        for j in range(i + 2, min(len(c.turns) - 2, i + CUP_TURNS) + 1, 2):
            right, handle = c.turns[j], c.turns[j + 1]
            path = c.close[rim.idx : right.idx + 1]
            if sign * (right.value - rim.value * (1 - sign * RIM_PCT / 100)) < 0 or len(path) < 3:
                continue
            deep = float(path.min() if cup else path.max())
            advance, given = sign * (right.value - deep), sign * (right.value - handle.value)
            if not DEPTH_PCT[0] <= abs(rim.value - deep) / rim.value * 100 <= DEPTH_PCT[1] or sign * (handle.value - (right.value + deep) / 2) < 0 or advance <= 0 or not 0 <= given / advance * 100 <= RETRACE_PCT:
                continue
            fit = kernels.roundness(path)
            if fit < ROUND:
                continue
            side = ((0.0, right.value), right.value + sign * abs(right.value - deep), deep)
            clean = 0.7 * float(np.clip(fit, 0, 1)) + 0.3 * _symmetry(rim.value, right.value)
            levels = {"left_rim": rim.value, "cup_extreme": deep, "right_rim": right.value, "handle": handle.value, "neckline": right.value}
            yield Shape("cup_and_handle" if cup else "inverse_cup_and_handle", "cup", "bullish" if cup else "bearish", c.turns[i : j + 2], levels, clean, trend, side if cup else None, None if cup else side, spoiled=c.low < deep if cup else c.high > deep)


def contractions(c: Chart) -> Iterator[Shape]:
    short, medium, long = (c.mean(c.close, n) for n in c.spans.averages)
    fast, slow = (c.atr_of(n) for n in c.spans.atrs)
    year = pd.Series(c.high).rolling(c.spans.year).max().to_numpy()
    back = c.spans.rising
    was = lambda x: np.concatenate([np.full(min(back, c.n), np.nan), x[: max(0, c.n - back)]])
    with np.errstate(invalid="ignore"):
        strong = (medium > was(medium)) & (long > was(long)) & (c.close > medium) & (c.close > long) & (short > medium) & (short > long) & (year > 0) & ((year - c.close) / year * 100 <= NEAR_HIGH_PCT)
    for i, t in enumerate(c.fine_turns):
        if t.kind != "high" or not strong[t.idx]:
            continue
        for n in range(CONTRACTIONS[0], CONTRACTIONS[1] + 1):
            w = c.fine_turns[i : i + 2 * n]
            if len(w) < 2 * n:
                break
            highs, lows = w[0::2], w[1::2]
            depths = [(h.value - x.value) / h.value * 100 if h.value > 0 else 0.0 for h, x in zip(highs, lows, strict=True)]
            end = lows[-1].idx
            if min(depths) <= 0 or sum(b >= a for a, b in zip(depths, depths[1:], strict=False)) > VIOLATIONS or any(b.value <= a.value for a, b in zip(lows, lows[1:], strict=False)) or not slow[end] > 0 or not fast[end] / slow[end] <= TIGHT:
                continue
            base, edge = min(x.value for x in lows), highs[-1].value
            clean = 0.5 * _shrinking(depths) + 0.5 * float(np.clip(1 - fast[end] / slow[end] / TIGHT, 0, 1))
            with np.errstate(invalid="ignore"):
                spoiled = (c.low < base) | (c.close < medium)
            yield Shape("vcp", "vcp", "bullish", w, {"pivot_price": edge, "base_low": base, **{f"contraction_{k}_depth_pct": d for k, d in enumerate(depths)}}, clean, c.prior(t, "up") or 0.0, ((0.0, edge), 2 * edge - base, base), spoiled=spoiled)


DETECTORS: tuple[Callable[[Chart], Iterator[Shape]], ...] = (double_extremes, shoulders, triangles, cups, contractions)


def follow(c: Chart, s: Shape) -> dict:
    """What became of a shape: status, direction, target, stop, and the breakout if there was one."""
    end = s.turns[-1].idx
    lapses = end + int(LIFESPANS * s.length) if s.lapses is None else s.lapses
    i = np.arange(end + 1, c.n)
    fixed = (s.up or s.down) if not (s.up and s.down) else None
    out = {"direction": s.bias, "target": fixed[1] if fixed else None, "stop": fixed[2] if fixed else None, "breakout": None, "entry": None, "volume_confirmed": None}
    above = c.close[i] > at(s.up[0], i) * (1 + BUFFER) if s.up else np.zeros(len(i), bool)
    below = c.close[i] < at(s.down[0], i) * (1 - BUFFER) if s.down else np.zeros(len(i), bool)
    spoiled = s.spoiled[i] if s.spoiled is not None else np.zeros(len(i), bool)
    # whichever comes first; on one bar lapsing goes before a breakout, and that before being spoiled
    stops = np.flatnonzero((i > lapses) | above | below | spoiled)
    if not len(stops):
        return out | {"status": "pending"}
    k = int(stops[0])
    if i[k] > lapses:
        return out | {"status": "expired"}
    if not (above[k] or below[k]):
        return out | {"status": "invalidated"}
    rising, b = bool(above[k]), int(i[k])
    line, target, stop = s.up if rising else s.down
    rel = c.rel_volume[b]
    out |= {"direction": "bullish" if rising else "bearish", "target": target, "stop": stop, "breakout": b, "entry": float(c.close[b]), "volume_confirmed": bool(rel >= VOLUME_MULT)}
    j = np.arange(b + 1, c.n)
    if not len(j):
        return out | {"status": "confirmed"}
    hit = c.high[j] >= target if rising else c.low[j] <= target
    back = (c.close[j] < at(line, j) * (1 - BUFFER) if rising else c.close[j] > at(line, j) * (1 + BUFFER)) & (j <= b + RECLAIM)
    first = np.flatnonzero(hit | back)
    return out | {"status": "active" if not len(first) else "hit_target" if hit[first[0]] else "invalidated_failed_breakout"}


def grade(c: Chart, s: Shape, life: dict) -> dict[str, float]:
    lo, hi = TYPICAL[s.family]
    parts = {"geometric_cleanliness": s.clean, "duration_fit": 1.0, "prior_trend": float(np.clip(s.trend / TREND_CAP, 0, 1)), "volume_signature": 0.0, "breakout_strength": 0.0}
    if s.length < lo:
        parts["duration_fit"] = s.length / lo
    elif s.length > hi:
        parts["duration_fit"] = max(0.3, min(1.0, 1 - (s.length - hi) / hi))
    b = life["breakout"]
    if b is not None:
        rising = life["direction"] == "bullish"
        move = (c.close[b] - at((s.up if rising else s.down)[0], b)) * (1 if rising else -1)
        if c.atr[b] > 0:
            parts["breakout_strength"] = float(np.clip(move / c.atr[b] / STRENGTH_ATR, 0, 1))
        if c.rel_volume[b] > 1:
            parts["volume_signature"] = float(np.clip((c.rel_volume[b] - 1) / (VOLUME_CAP - 1), 0, 1))
    return parts


MATCH = "ticker string, pattern string, direction string, status string, formation_start date, formation_end date, start_idx int, end_idx int, target double, stop double, entry double, breakout_idx int, breakout_date date, volume_confirmed boolean, confidence double, notes array<string>, key_levels map<string,double>, trendlines map<string,struct<slope:double,intercept:double>>, turns array<struct<kind:string,idx:int,value:double>>"


def scan(bars: DataFrame, detectors: tuple[Callable[[Chart], Iterator[Shape]], ...] = DETECTORS, spans: Spans = DAILY, as_of: str | None = None) -> DataFrame:
    """All shapes of all series; a series with fewer than ``MIN_BARS`` bars gives none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = ["ticker", "pattern", "direction", "status", "formation_start", "formation_end", "start_idx", "end_idx", "target", "stop", "entry", "breakout_idx", "breakout_date", "volume_confirmed", "confidence", "notes", "key_levels", "trendlines", "turns"]
        pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        rows = []
        if len(pdf) >= MIN_BARS:
            c, ts = Chart(pdf, spans), pdf["ts"].tolist()
            for s in (s for d in detectors for s in d(c)):
                life = follow(c, s)
                parts = grade(c, s, life)
                b, first, last = life["breakout"], s.turns[0].idx, s.turns[-1].idx
                rows.append((pdf["ticker"].iloc[0], s.name, life["direction"], life["status"], ts[first], ts[last], first, last, life["target"], life["stop"], life["entry"], b, None if b is None else ts[b], life["volume_confirmed"], min(1.0, max(0.0, sum(WEIGHTS[k] * v for k, v in parts.items()))), [f"{k}: {parts[k]:.2f}" for k in sorted(parts)], {k: float(v) for k, v in s.levels.items()}, {k: {"slope": v[0], "intercept": v[1]} for k, v in s.lines.items()}, [{"kind": t.kind, "idx": t.idx, "value": t.value} for t in s.turns]))
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"breakout_idx": "Int32", "volume_confirmed": "boolean"}) if rows else out

    found = bars.groupBy("ticker").applyInPandas(run, MATCH)
    return found.filter(found["formation_end"] <= as_of) if as_of else found
