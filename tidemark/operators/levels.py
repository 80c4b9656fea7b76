"""Support and resistance: candidate zones from turns, their history of encounters, scores, merging.

One series is one kernel call; within it everything is array work over its turns and bars.  Horizontal zones
live in prices, diagonal ones in log prices.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import kernels
from tidemark.functions.sides import encounters, reaction
from tidemark.operators.bars import arrays


@dataclass(frozen=True)
class Settings:
    years: float = 3.0
    turn_atr: float = 2.0
    zone_atr: float = 0.4
    least_turns: int = 2
    diagonals: bool = False
    diagonal_share: float = 0.65
    steepest: float = 0.35
    apart: int = 20
    least_inliers: int = 3
    least_drift: float = 1.0
    most_diagonals: int = 300
    wait: int = 5
    reach: int = 10
    regime_years: float = 1.0
    top: int = 10
    overlap: float = 0.6
    half_life_years: float | None = None
    weights: tuple[float, float, float, float] = (0.35, 0.20, 0.15, 0.20)  # touches, duration, resilience, reversal

    @property
    def half_life_days(self) -> float:
        return 365.25 * (self.years * 0.25 if self.half_life_years is None else self.half_life_years)


MEDIUM, LONG = Settings(), Settings(years=8.0, turn_atr=3.0)
MEDIUM_WEEKLY = replace(MEDIUM, wait=1, reach=2, apart=4, steepest=1.75)
LONG_WEEKLY = replace(LONG, wait=1, reach=2, apart=4, steepest=1.75)

#: Fixed values of the scoring.
REACTION_CAP, PROXIMITY_SCALE, PENALTY_CAP, IN_PLAY_ATRS = 5.0, 5.0, 0.3, 3.0
WICK_CREDIT, BODY_CREDIT, SLOWEST_RECLAIM = 0.15, 0.35, 0.3
VOLUME_FLOOR, VOLUME_CEILING, VOLUME_CAP = 0.7, 1.3, 2.0
FULL_TOUCHES, FULL_RECENT, FULL_EVENTS, TREND_EVENTS = 6, 3, 4, 4
MERGE_BARS, VOLUME_BARS = 3, 20


@dataclass
class Zone:
    """A candidate: centre (or log-price line) with its half width and the turns it was made of."""

    half: float
    first: int
    center: float = 0.0
    slope: float | None = None
    intercept: float = 0.0
    origin: int = 0
    rms: float = 0.0
    members: np.ndarray = field(default_factory=lambda: np.empty(0, int))

    def middle(self, i: np.ndarray | int) -> np.ndarray | float:
        return np.exp(self.intercept + self.slope * (np.asarray(i) - self.origin)) if self.slope is not None else np.full(np.shape(i), self.center)

    def edges(self, i: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        mid = self.middle(i)
        return (mid * math.exp(-self.half), mid * math.exp(self.half)) if self.slope is not None else (mid - self.half, mid + self.half)


@dataclass
class Event:
    kind: str  # touch, body_touch, wick_fake, body_fake, break
    start: int
    end: int
    side: int
    depth: float
    reaction: float = 0.0
    volume: float | None = None
    pending: bool = False
    reclaimed: int | None = None  # bars to the reclaim

    @property
    def confirms(self) -> bool:
        return self.kind in ("touch", "body_touch", "wick_fake") or (self.kind == "body_fake" and not self.pending)


def horizontal(turns: list[kernels.Turn], s: Settings) -> list[Zone]:
    """Turns by price, each joining the running group if it lies within the group's own zone width of its mean."""
    at = sorted(range(len(turns)), key=lambda k: turns[k].value)
    value = np.array([turns[k].value for k in at])
    share = np.array([turns[k].size for k in at]) / value if at else value
    out, begin = [], 0
    for k in range(1, len(at) + 1):
        group = slice(begin, k)
        if k < len(at):
            mean = value[group].mean()
            if value[k] - mean <= s.zone_atr * np.median(share[group]) * mean:
                continue
        if k - begin >= s.least_turns:
            center = float(value[group].mean())
            out.append(Zone(float(s.zone_atr * np.median(share[group]) * center / 2), min(turns[j].idx for j in at[group]), center))
        begin = k
    return out


def similar(a: float, b: float) -> bool:
    lo, hi = sorted((abs(a), abs(b)))
    return (a > 0) == (b > 0) and (hi == 0 or lo / hi >= 0.5)


def diagonal(turns: list[kernels.Turn], s: Settings) -> list[Zone]:
    """Every pair of turns of one kind far enough apart seeds a line in log prices, refitted on the turns near it.

    All seeds of a turn are tested against all turns at once; near-copies go, keeping lines with most turns.
    """
    found: list[Zone] = []
    for kind in ("high", "low"):
        own = [t for t in turns if t.kind == kind]
        if len(own) < s.least_inliers:
            continue
        x, price, atr = (np.array([getattr(t, c) for t in own], float) for c in ("idx", "value", "size"))
        y, near = np.log(price), s.zone_atr * atr / price
        for i in range(len(own) - 1):
            later = np.flatnonzero(x - x[i] >= s.apart)
            later = later[later > i]
            slope = (y[later] - y[i]) / (x[later] - x[i])
            with np.errstate(invalid="ignore", divide="ignore"):
                pace = np.where(atr[later] > 0, price[later] * np.expm1(slope) / atr[later], 0.0)
            slope = slope[np.abs(pace) <= s.steepest]
            inside = np.abs(y - (y[i] + slope[:, None] * (x - x[i]))) <= near
            for row in inside[inside.sum(axis=1) >= s.least_inliers]:
                m = np.flatnonzero(row)
                b, a = kernels.fit(x[m], y[m])
                half = float(np.median(near[m]) / 2)
                if half > 0 and abs(b) * (x[m[-1]] - x[m[0]]) < s.least_drift * half:
                    continue
                rms = float(np.sqrt(np.mean(((y[m] - (a + b * x[m])) / near[m]) ** 2)))
                found.append(Zone(half, int(x[m[0]]), slope=b, intercept=a + b * x[m[0]], origin=int(x[m[0]]), rms=rms, members=x[m].astype(int)))
    found.sort(key=lambda z: -len(z.members))
    ref = max((t.idx for t in turns), default=0)
    # kept lines as columns, so a newcomer is compared with all of them in one expression
    kept: list[Zone] = []
    cols = np.empty((5, len(found)))  # slope, intercept at 0, half width, first turn, unused
    for z in found:
        k = cols[:, : len(kept)]
        base = z.intercept - z.slope * z.origin
        lo, hi = np.minimum(np.abs(k[0]), abs(z.slope)), np.maximum(np.abs(k[0]), abs(z.slope))
        alike = ((k[0] > 0) == (z.slope > 0)) & ((hi == 0) | (lo >= 0.5 * hi))
        apart = lambda at, k=k, z=z, base=base: np.abs(base + z.slope * at - k[1] - k[0] * at)
        wide = s.overlap * (z.half + k[2])
        if (alike & (apart(np.maximum(z.first, k[3])) <= wide) & (apart(ref) <= wide)).any():
            continue
        cols[:, len(kept)] = (z.slope, base, z.half, z.first, 0)
        kept.append(z)
    return kept if len(kept) <= s.most_diagonals else sorted(kept, key=lambda z: z.rms)[: s.most_diagonals]


class Series:
    """One series' arrays and what zones ask of them."""

    def __init__(self, pdf: pd.DataFrame, s: Settings):
        self.s, self.days = s, pd.to_datetime(pdf["ts"]).to_numpy().astype("datetime64[D]").astype(int)
        self.open, self.volume = (pdf[c].to_numpy(float) for c in ("open", "volume"))
        self.high, self.low, self.close = arrays(pdf)
        self.atr = kernels.atr(self.high, self.low, self.close)
        self.n = len(pdf)

    def _in_atr(self, x: float, i: int) -> float:
        return float(x / self.atr[i]) if self.atr[i] == self.atr[i] and self.atr[i] != 0 else 0.0

    def events(self, z: Zone, first: int | None = None) -> tuple[list[Event], int]:
        """The zone's history from its first turn on, near events of one kind merged, and the side it began on."""
        f = z.first if first is None else first
        if self.n - f < 2:
            return [], 0
        lo, hi = z.edges(np.arange(f, self.n))
        o, h, lw, c, a = (v[f:] for v in (self.open, self.high, self.low, self.close, self.atr))
        mean = pd.Series(self.volume[f:]).rolling(VOLUME_BARS).mean().to_numpy()
        out: list[Event] = []
        found, began = encounters(h, lw, c, lo, hi, self.s.wait)
        for x in found:
            i, up = x.start, x.side > 0
            volume = float(self.volume[f + i] / mean[i]) if mean[i] > 0 else None
            if x.kind == "meet":
                far = lw[i] < lo[i] if up else h[i] > hi[i]
                depth = (lo[i] - lw[i] if far else hi[i] - lw[i]) if up else (h[i] - hi[i] if far else h[i] - lo[i])
                body = max(o[i], c[i]) >= lo[i] and min(o[i], c[i]) <= hi[i]
                kind = "wick_fake" if far else "body_touch" if body else "touch"
                e = Event(kind, f + i, f + i, x.side, self._in_atr(depth, f + i), reaction(h, lw, c, a, i, x.side, self.s.reach) or 0.0, volume)
            else:
                depth = lo[i] - c[i] if up else c[i] - hi[i]
                e = Event("break" if x.kind == "break" else "body_fake", f + i, f + x.end, x.side, self._in_atr(depth, f + i), 0.0, volume, x.kind == "open", x.end - i if x.kind == "return" else None)
            if out and out[-1].kind == e.kind and e.start - out[-1].end <= MERGE_BARS:
                p = out[-1]
                volumes = [v for v in (p.volume, e.volume) if v is not None]
                out[-1] = Event(e.kind, p.start, e.end, p.side, max(p.depth, e.depth), max(p.reaction, e.reaction), max(volumes, default=None), e.pending, e.reclaimed)
            else:
                out.append(e)
        return out, began

    def regime(self, events: list[Event], since: int | None = None) -> int:
        """The day the current regime began: after the last lull longer than the regime gap."""
        ordered = sorted(events, key=lambda e: e.start)
        start = end = self.days[ordered[0].start] if since is None else since
        for e in ordered:
            if self.days[e.start] - end > self.s.regime_years * 365.25:
                start = self.days[e.start]
            end = max(end, self.days[e.end])
        return int(start)


def status(events: list[Event]) -> tuple[str, Event | None, Event | None]:
    """(active, broken or flipped; the last break; the event that confirmed the flip)."""
    broke = confirmed = None
    for e in sorted(events, key=lambda e: (e.start, e.end)):
        if e.kind == "break":
            broke = e
        elif broke and not confirmed and e.confirms:
            confirmed = e
    return ("flipped" if confirmed else "broken" if broke else "active"), broke, confirmed


def reclaims(events: list[Event]) -> list[tuple[Event, Event | None]]:
    """Each break with the first confirmation before the next break."""
    out: list[tuple[Event, Event | None]] = []
    for e in sorted(events, key=lambda e: (e.start, e.end)):
        if e.kind == "break":
            out.append((e, None))
        elif out and out[-1][1] is None and e.confirms:
            out[-1] = (out[-1][0], e)
    return out


def _reclaim_credit(e: Event, wait: int) -> float:
    return 1 - (1 - SLOWEST_RECLAIM) * (min(e.reclaimed / wait, 1.0) if wait > 0 else 1.0)


def score(sr: Series, z: Zone, events: list[Event]) -> dict[str, float]:
    """The parts of a line's score and their product."""
    s, now, last_i = sr.s, int(sr.days[-1]), sr.n - 1
    state, broke, _ = status(events)
    until = int(sr.days[broke.start]) if state == "broken" else now
    fade = lambda day, ref: 0.5 ** (max(ref - day, 0) / s.half_life_days) if s.half_life_days > 0 else 1.0
    heft = lambda v: 1.0 if v is None else VOLUME_FLOOR + (VOLUME_CEILING - VOLUME_FLOOR) * min(v, VOLUME_CAP) / VOLUME_CAP
    latest = lambda es, k: sorted(es, key=lambda e: (e.end, e.start))[-k:] if len(es) > k else es

    def quality(es: list[Event]) -> float:
        total = 0.0
        for e in es:
            if e.kind in ("touch", "body_touch", "wick_fake"):
                worth = min(e.reaction, REACTION_CAP) / REACTION_CAP
            elif e.kind == "body_fake" and not e.pending:
                worth = _reclaim_credit(e, s.wait)
            else:
                continue
            total += worth * heft(e.volume) * fade(int(sr.days[e.end]), until)
        return total

    began = sr.regime(events) if events else now
    here = [e for e in events if sr.days[e.start] >= began]
    touch = min(quality(latest([e for e in here if e.kind in ("touch", "body_touch")], FULL_TOUCHES)) / FULL_TOUCHES, 1.0)
    duration = in_play = 0.0
    if len(events) >= 2:
        days = max(int(sr.days[max(e.end for e in events)] - sr.days[min(e.start for e in events)]), 1)
        duration = min(days / (s.years / 3 * 365.25), 1.0) * min(len(events) / FULL_EVENTS, 1.0)
        i = np.flatnonzero((sr.days >= began) & (sr.days <= sr.days[max(e.end for e in events)]))
        if len(i):
            with np.errstate(invalid="ignore", divide="ignore"):
                in_play = float((np.abs(sr.close[i] - z.middle(i)) / np.where(sr.atr[i] == 0, np.nan, sr.atr[i]) <= IN_PLAY_ATRS).mean())
    fakes = latest([e for e in here if e.kind in ("wick_fake", "body_fake") and not e.pending], FULL_RECENT)
    resilience = min(sum((WICK_CREDIT if e.kind == "wick_fake" else BODY_CREDIT * _reclaim_credit(e, s.wait)) * heft(e.volume) * fade(int(sr.days[e.end]), until) for e in fakes), 1.0)
    after, seen = [], False
    for e in sorted(here, key=lambda e: (e.start, e.end)):
        seen = seen or e.kind == "break"
        if seen and e.kind != "break" and e.confirms:
            after.append(e)
    reversal = min(quality(latest(after, FULL_RECENT)) / FULL_RECENT, 1.0)
    away = abs(sr.close[-1] - float(z.middle(last_i)))
    proximity = 1 / (1 + away / sr.atr[-1] / PROXIMITY_SCALE) if sr.atr[-1] == sr.atr[-1] and sr.atr[-1] != 0 else 0.0
    recency = fade(int(sr.days[max(e.end for e in events)]), now) if events else 1.0
    penalty, share = (min(z.rms, PENALTY_CAP), s.diagonal_share) if z.slope is not None else (0.0, 1.0)
    parts = (touch, duration, resilience, reversal)
    inner = float(np.dot(s.weights, parts) / sum(s.weights)) if sum(s.weights) > 0 else 0.0
    total = max(0.0, inner - penalty) * share * proximity * recency * in_play
    return {"touch_quality": touch, "duration_density": duration, "resilience": resilience, "role_reversal": reversal, "proximity": proximity, "relevance": proximity * recency, "in_play": in_play, "diagonal_penalty": penalty, "strength": total}


@dataclass
class Line:
    zone: Zone
    events: list[Event]
    began: int
    scores: dict[str, float]


def lines(sr: Series, turns: list[kernels.Turn]) -> list[Line]:
    """Scored lines, strongest first, near ones merged into the stronger, cut to the top."""
    made = []
    for z in horizontal(turns, sr.s) + (diagonal(turns, sr.s) if sr.s.diagonals else []):
        events, began = sr.events(z)
        made.append(Line(z, events, began, score(sr, z, events)))
    kept: list[Line] = []
    for line in sorted(made, key=lambda x: -x.scores["strength"]):
        host = next((k for k in kept if _overlaps(k.zone, line.zone, sr)), None)
        if host is None:
            kept.append(line)
            continue
        if host.zone.slope is None:
            host.zone.first = min(host.zone.first, line.zone.first)
            host.events = sorted(host.events + line.events, key=lambda e: (e.start, e.end))
        else:
            host.events = sr.events(host.zone)[0]
        host.scores = score(sr, host.zone, host.events)
    return sorted(kept, key=lambda x: -x.scores["strength"])[: sr.s.top]


def _overlaps(a: Zone, b: Zone, sr: Series) -> bool:
    if (a.slope is None) != (b.slope is None) or (a.slope is not None and not similar(a.slope, b.slope)):
        return False
    (lo1, hi1), (lo2, hi2) = (tuple(map(float, z.edges(sr.n - 1))) for z in (a, b))
    width = (hi1 - lo1 + hi2 - lo2) / 2
    return width > 0 and max(lo1, lo2) - min(hi1, hi2) < sr.s.overlap * width


EVENT = "struct<kind:string,start:date,end:date,side:string,penetration_atr:double,reaction_atr:double,volume_ratio:double,pending:boolean,bars_to_reclaim:int>"
SCORES = ("touch_quality", "duration_density", "resilience", "role_reversal", "proximity", "relevance", "in_play", "diagonal_penalty", "strength")
COUNTS = ("touches", "body_touches", "wick_fakes", "reclaims", "held_above", "held_below", "breaks", "breaks_reclaimed", "breaks_above", "breaks_below")
MEANS = ("mean_bars_to_reclaim", "mean_bars_to_reclaim_break", "penetration_first", "penetration_second", "penetration_trend", "mean_reaction_touch", "mean_volume_touch", "mean_volume_break")
LINE = "ticker string, rank int, kind string, role string, state string, center double, half_width double, slope double, intercept double, origin_idx int, slope_atr double, fit_rms double, first_touch date, regime_start date, last_event date, broken_at date, flipped_at date, age_days int, regime_days int, idle_days int, " + ", ".join([*(f"{c} double" for c in (*SCORES, *MEANS)), *(f"{c} int" for c in COUNTS)]) + f", events array<{EVENT}>"


def _mean(xs) -> float | None:
    xs = [x for x in xs if x is not None]
    return float(np.mean(xs)) if xs else None


def describe(sr: Series, line: Line) -> dict:
    """What a line's events say about it: state, counts over its whole life, means over its current regime."""
    z, events = line.zone, sorted(line.events, key=lambda e: (e.start, e.end))
    state, broke, confirmed = status(events)
    start = int(sr.days[z.first])
    regime = sr.regime(events, start) if events else start
    here = [e for e in events if sr.days[e.start] >= regime]
    met = [e for e in here if e.kind in ("touch", "body_touch", "wick_fake")]
    deep = sorted((e for e in here if e.kind != "break"), key=lambda e: (e.start, e.end))
    first = second = None
    if len(deep) >= TREND_EVENTS:
        mid = len(deep) // 2
        first, second = _mean(e.depth for e in deep[:mid]), _mean(e.depth for e in deep[mid:])
    back = reclaims(events)
    held = [e for e in events if e.confirms]
    returned = [e for e in events if e.kind == "body_fake" and not e.pending]
    count = lambda kind: sum(e.kind == kind for e in events)
    role = "flipped" if state == "flipped" else "resistance" if line.began < 0 else "support"
    last = int(sr.days[max((e.end for e in events), default=z.first)])
    now = int(sr.days[-1])
    slope_atr = None
    if z.slope is not None:
        slope_atr = float(z.middle(sr.n - 1) * math.expm1(z.slope) / sr.atr[-1]) if sr.atr[-1] > 0 else 0.0
    return {
        "kind": "horizontal" if z.slope is None else "diagonal", "role": role, "state": state, "center": z.center if z.slope is None else None, "half_width": z.half, "slope": z.slope,
        "intercept": None if z.slope is None else z.intercept, "origin_idx": None if z.slope is None else z.origin, "slope_atr": slope_atr, "fit_rms": z.rms, "first_touch": start, "regime_start": regime, "last_event": last,
        "broken_at": None if broke is None else int(sr.days[broke.start]), "flipped_at": None if confirmed is None else int(sr.days[confirmed.start]), "age_days": now - start, "regime_days": now - regime, "idle_days": now - last, **line.scores,
        "mean_bars_to_reclaim": _mean(e.reclaimed for e in returned), "mean_bars_to_reclaim_break": _mean(c.start - b.start for b, c in back if c), "penetration_first": first, "penetration_second": second, "penetration_trend": None if first is None else second - first,
        "mean_reaction_touch": _mean(e.reaction for e in met), "mean_volume_touch": _mean(e.volume for e in met), "mean_volume_break": _mean(e.volume for e in here if e.kind == "break"),
        "touches": count("touch"), "body_touches": count("body_touch"), "wick_fakes": count("wick_fake"), "reclaims": len(returned), "held_above": sum(e.side > 0 for e in held), "held_below": sum(e.side < 0 for e in held),
        "breaks": len(back), "breaks_reclaimed": sum(c is not None for _, c in back), "breaks_above": sum(b.side > 0 for b, _ in back), "breaks_below": sum(b.side < 0 for b, _ in back),
    }


DATES = ("first_touch", "regime_start", "last_event", "broken_at", "flipped_at")


def detect(bars: DataFrame, settings: Settings = MEDIUM) -> DataFrame:
    """The strongest support and resistance lines of each series over the last ``years`` of its bars."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in LINE.split(", ") if not c.startswith("events")] + ["events"]
        pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        sr = Series(pdf, settings)
        found = kernels.turns(sr.high, sr.low, settings.turn_atr * sr.atr, sr.atr)
        day = lambda d: None if d is None else np.datetime64(int(d), "D").astype(object)
        rows = []
        for rank, line in enumerate(lines(sr, found), 1):
            row = {"ticker": pdf["ticker"].iloc[0], "rank": rank, **describe(sr, line)}
            row |= {c: day(row[c]) for c in DATES}
            row["events"] = [{"kind": e.kind, "start": day(sr.days[e.start]), "end": day(sr.days[e.end]), "side": "above" if e.side > 0 else "below", "penetration_atr": e.depth, "reaction_atr": e.reaction, "volume_ratio": e.volume, "pending": e.pending, "bars_to_reclaim": e.reclaimed} for e in line.events]
            rows.append(row)
        out = pd.DataFrame(rows, columns=names)
        return out.astype({c: "Int32" for c in ("origin_idx", *COUNTS)}) if rows else out

    last = F.max("ts").over(Window.partitionBy("ticker"))
    recent = bars.withColumn("_last", last).filter(F.col("ts") >= F.add_months("_last", -int(12 * settings.years))).drop("_last")
    return recent.groupBy("ticker").applyInPandas(run, LINE)
