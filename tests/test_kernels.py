"""Recursions and state machines against hand-worked numbers."""

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import kernels as k
from tidemark.functions.sides import encounters
from tidemark.operators import levels, patterns, structures


def test_ema_is_seeded_by_the_mean():
    assert k.ema(np.array([1.0, 2, 3, 4, 5]), 3)[2:].tolist() == [2.0, 3.0, 4.0]
    assert np.isnan(k.ema(np.array([1.0, 2]), 3)).all()


def test_rsi_extremes():
    assert k.rsi(np.arange(30.0))[14:].tolist() == [100.0] * 16
    assert k.rsi(np.full(30, 5.0))[14:].tolist() == [0.0] * 16


def test_macd_begins_with_its_signal():
    line, signal, hist = k.macd(np.cumsum(np.ones(60)))
    assert np.isnan(line[32]) and not np.isnan(line[33]) and hist[40] == pytest.approx(line[40] - signal[40])


def test_atr_of_constant_range():
    n = 30
    assert k.atr(np.full(n, 11.0), np.full(n, 10.0), np.full(n, 10.5), 14)[14:].tolist() == [1.0] * 16


def test_adx_of_a_steady_trend():
    x = np.arange(80.0) + 100
    assert np.isnan(k.adx(x + 1, x - 1, x, 14)[26]) and k.adx(x + 1, x - 1, x, 14)[27] == pytest.approx(100)


def test_sar_trails_a_trend():
    x = np.arange(40.0) + 100
    out = k.sar(x + 1, x - 1)
    assert np.isnan(out[0]) and (out[1:] < x[1:]).all()


def test_zigzag_fixture():
    high = np.repeat([10.0, 30, 5, 25], 3)
    low = np.repeat([9.0, 28, 3, 23], 3)
    found = k.turns(high, low, np.full(12, 10.0))
    assert [(t.kind, t.value, t.idx) for t in found] == [("low", 9.0, 0), ("high", 30.0, 3), ("low", 3.0, 6)]
    assert all(t.confirmed > t.idx for t in found)
    assert k.turns(high, low, np.full(12, np.nan)) == []


def test_zigzag_needs_no_later_bars():
    rng = np.random.default_rng(1)
    x = 100 + np.cumsum(rng.normal(0, 1, 400))
    whole = k.turns(x + 1, x - 1, np.full(400, 6.0))
    for cut in (50, 200, 399):
        assert k.turns(x[:cut] + 1, x[:cut] - 1, np.full(cut, 6.0)) == [t for t in whole if t.confirmed < cut]


def test_lines():
    assert k.fit(np.array([0, 1, 2]), np.array([1, 3, 5])) == (2.0, 1.0)
    assert k.apex((0.0, 150.0), (1.0, 106.0)) == 44 and k.apex((1.0, 0.0), (1.0, 5.0)) is None
    assert k.roundness((np.arange(21) - 10.0) ** 2) == pytest.approx(1)


def test_student_t():
    assert k.student_t_two_sided(0.0, 10) == pytest.approx(1)
    assert k.student_t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert k.student_t_two_sided(12.706204736, 1) == pytest.approx(0.05, abs=1e-8)


def _walk_by_hand(high, low, close, lo, hi, wait):
    """The side machine bar by bar, as a check on the jumping one."""
    out, side, first, pending = [], 0, 0, None
    for i in range(len(close)):
        now = 1 if close[i] > hi[i] else -1 if close[i] < lo[i] else 0
        if pending is not None:
            if now == side:
                out.append(("return", pending, i, side))
                pending = None
            elif i - pending >= wait:
                out.append(("break", pending, i, side))
                side, pending = -side, None
            continue
        if side == 0:
            side = first = now
        elif now == side:
            if low[i] <= hi[i] and high[i] >= lo[i]:
                out.append(("meet", i, i, side))
        elif now:
            pending = i
    if pending is not None:
        out.append(("open", pending, len(close) - 1, side))
    return out, first


def test_encounters_match_a_bar_by_bar_walk():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        close = 100 + np.cumsum(rng.normal(0, 1, n))
        high, low = close + rng.random(n) * 2, close - rng.random(n) * 2
        mid, half, wait = 100 + rng.normal(0, 2), rng.random() * 2, int(rng.integers(1, 7))
        lo, hi = np.full(n, mid - half), np.full(n, mid + half)
        got, first = encounters(high, low, close, lo, hi, wait)
        assert ([(e.kind, e.start, e.end, e.side) for e in got], first) == _walk_by_hand(high, low, close, lo, hi, wait)


def chain(*segments):
    close = np.concatenate([np.linspace(a, b, n) for a, b, n in segments])
    return pd.DataFrame({"open": close, "high": close + 0.3, "low": close - 0.3, "close": close, "volume": 1000.0})


def chart(bars, turns, monkeypatch):
    for name, value in (("VOLUME_BARS", 5), ("RECLAIM", 3), ("TREND_PCT", 10.0)):
        monkeypatch.setattr(patterns, name, value)
    c = patterns.Chart(bars, patterns.Spans(trend=5))
    c.__dict__["turns"] = [k.Turn(kind, i, v, i, 1.0) for kind, i, v in turns]
    c.__dict__["atr"] = c.atr_of(3)
    return c


def test_double_top(monkeypatch):
    bars = chain((100, 130, 10), (128, 121, 5), (123, 129, 5), (127, 100, 10))
    bars.loc[23, "volume"] = 1600.0
    c = chart(bars, [("high", 9, 130.0), ("low", 14, 121.0), ("high", 19, 129.0)], monkeypatch)
    (s,) = patterns.double_extremes(c)
    life = patterns.follow(c, s)
    assert (s.name, life["direction"], life["target"], life["stop"], life["breakout"], life["volume_confirmed"], life["status"]) == ("double_top", "bearish", 112.5, 130.0, 23, True, "hit_target")
    assert s.levels == {"p1": 130.0, "neckline": 121.0, "p2": 129.0} and all(0 <= v <= 1 for v in patterns.grade(c, s, life).values())


def test_ascending_triangle(monkeypatch):
    bars = chain((100, 150, 10), (148, 120, 5), (122, 150, 5), (148, 130, 5), (132, 150, 5), (148, 140, 5), (152, 152, 3), (155, 200, 10))
    bars.loc[35, "volume"] = 1600.0
    c = chart(bars, [("high", 9, 150.0), ("low", 14, 120.0), ("high", 19, 150.0), ("low", 24, 130.0), ("high", 29, 150.0), ("low", 34, 140.0)], monkeypatch)
    (s,) = patterns.triangles(c)
    life = patterns.follow(c, s)
    assert s.name == "ascending_triangle" and s.lines["upper"] == pytest.approx((0, 150)) and s.lines["lower"] == pytest.approx((1, 106))
    assert (life["direction"], life["breakout"], life["status"], life["volume_confirmed"]) == ("bullish", 35, "hit_target", True)
    assert (life["target"], life["stop"]) == pytest.approx((185, 140))


def test_support_touch():
    n = 12
    close = np.full(n, 105.0)
    low, high = close - 1, close + 1
    low[5] = 100.5
    bars = pd.DataFrame({"ts": pd.bdate_range("2020-01-01", periods=n), "open": close, "high": high, "low": low, "close": close, "volume": 1000.0})
    sr = levels.Series(bars, levels.Settings())
    events, began = sr.events(levels.Zone(1.0, 0, 100.0))
    assert began == 1 and [(e.kind, e.start, e.side) for e in events] == [("touch", 5, 1)]


def test_break_then_flip():
    events = [levels.Event("break", 5, 10, 1, 1.0), levels.Event("touch", 20, 20, -1, 0.2), levels.Event("break", 30, 35, -1, 1.0)]
    state, broke, confirmed = levels.status(events)
    assert state == "flipped" and broke.start == 30 and confirmed.start == 20
    assert [(b.start, c and c.start) for b, c in levels.reclaims(events)] == [(5, 20), (30, None)]


def test_pairing_is_greedy_and_exclusive():
    t = lambda i, v=1.0: k.Turn("high", i, v, i + 1, 1.0)
    got = structures.paired([t(10), t(12)], [t(11, 5.0), t(13, 6.0)])
    assert {i: x.idx for i, x in got.items()} == {10: 11, 12: 13}
