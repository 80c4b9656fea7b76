"""A price and a zone: which side the close is on, and what happens when they meet.

``encounters`` walks the closes of one series past a zone given for each bar and reports, in order:

* ``meet``: the close stays on its side while the bar's range reaches the zone;
* ``return``: a close beyond the zone came back to its side before the wait was over;
* ``break``: it did not, and the other side is the new one;
* ``open``: the data end while this is undecided.

An encounter gives the bars it began and ended on and the side it came from (1 above, -1 below).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Encounter:
    kind: str
    start: int
    end: int
    side: int


def close_sides(close: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return np.where(close > hi, 1, np.where(close < lo, -1, 0))


def encounters(high: np.ndarray, low: np.ndarray, close: np.ndarray, lo: np.ndarray, hi: np.ndarray, wait: int) -> tuple[list[Encounter], int]:
    """(encounters, the first side taken; 0 if none).  Bars that close inside the zone decide nothing,
    so only the others are visited one by one, but for the wait, which counts all bars."""
    where = close_sides(close, lo, hi)
    out: list[Encounter] = []
    outside = np.flatnonzero(where)
    if not len(outside):
        return out, 0
    side = first = int(where[outside[0]])
    i, n = int(outside[0]) + 1, len(close)
    reaches = (low <= hi) & (high >= lo)
    matters = np.flatnonzero((where != 0) & (reaches | (np.concatenate([[0], where[:-1]]) != where)))
    while i < n:
        at = np.searchsorted(matters, i)
        # between entries of ``matters`` closes keep the side of the bar before them and stay clear of the zone
        nxt = int(matters[at]) if at < len(matters) else n
        run = int(where[i]) if i < nxt else 0
        if run and run != side:
            nxt = i
        i = nxt
        if i >= n:
            break
        if where[i] == side:
            if reaches[i]:
                out.append(Encounter("meet", i, i, side))
            i += 1
            continue
        start, last = i, min(i + wait, n - 1)
        back = np.flatnonzero(where[start + 1 : last + 1] == side)
        if len(back):
            end = start + 1 + int(back[0])
            out.append(Encounter("return", start, end, side))
        elif start + wait <= n - 1:
            end = max(start + wait, start + 1)
            out.append(Encounter("break", start, min(end, n - 1), side))
            side = -side
        else:
            out.append(Encounter("open", start, n - 1, side))
            break
        i = end + 1
    return out, first


def reaction(high: np.ndarray, low: np.ndarray, close: np.ndarray, atr: np.ndarray, i: int, side: int, reach: int) -> float | None:
    """Largest move away from the zone within ``reach`` bars after bar i, in that bar's ATR; None without bars or ATR."""
    end = min(i + 1 + reach, len(close))
    if i + 1 >= end or not atr[i] > 0:
        return None
    move = high[i + 1 : end].max() - close[i] if side > 0 else close[i] - low[i + 1 : end].min()
    return max(0.0, float(move / atr[i]))
