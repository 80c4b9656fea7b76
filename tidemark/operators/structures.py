"""Divergences, Fibonacci sets and anchored average prices, one series at a time or natively where frames allow.

All kernels sort their bars themselves, emit plain rows and leave missing values null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import kernels
from tidemark.functions.scalar import clip, interpolated
from tidemark.functions.sides import encounters, reaction
from tidemark.operators.bars import arrays
from tidemark.operators.joins import islands

WARM_UP, MIN_BARS = 50, 150


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values("ts", kind="stable").reset_index(drop=True)


def _consistent(a: float, b: float, most: float = 10.0) -> bool:
    return bool(a > 0 and b > 0 and max(a, b) <= most * min(a, b))


def _rolling(x: np.ndarray, n: int, how: str) -> np.ndarray:
    return getattr(pd.Series(x).rolling(n), how)().to_numpy()


#: Fixed values of this module: spans, shares, weights and ratios that results depend on.
# Divergences ------------------------------------------------------------------------------------

PAIRING, SPAN, STD_BARS, RSI_POINTS, OUTCOME_BARS = 3, 5, 100, 5.0, 20
GAP_CAP, MOVE_CAP, SPAN_CAP = 3.0, 6.0, 60.0
DIVERGENCE = "ticker string, indicator string, direction string, p1_date date, p2_date date, p1_price double, p2_price double, i1_value double, i2_value double, strength double, duration_bars int, price_move_atr double, indicator_gap double, appeared_at date, confirmed_at date, p2_idx int, max_favorable_move_atr double, bars_to_max int, invalidated boolean, invalidated_at date"


def indicator(name: str, pdf: pd.DataFrame) -> np.ndarray:
    close, volume = pdf["close"].to_numpy(float), pdf["volume"].to_numpy(float)
    if name == "rsi":
        return kernels.rsi(close)
    if name == "macd_hist":
        return kernels.macd(close)[2]
    if name == "obv":
        return np.cumsum(np.concatenate([volume[:1], np.sign(np.diff(close)) * volume[1:]]))
    if name == "volume":
        return _rolling(np.log(np.maximum(volume, 1e-9)), 5, "mean")
    raise ValueError(f"unknown indicator {name!r}")


def paired(prices: list[kernels.Turn], others: list[kernels.Turn], window: int = PAIRING) -> dict[int, kernels.Turn]:
    """Each price turn, in order, takes the nearest free turn of its kind within ``window`` bars, the earlier on a tie."""
    free, out = dict(enumerate(others)), {}
    for p in prices:
        near = [(abs(o.idx - p.idx), o.idx, k) for k, o in free.items() if o.kind == p.kind and abs(o.idx - p.idx) <= window]
        if near:
            out[p.idx] = free.pop(min(near)[2])
    return out


def divergences(bars: DataFrame, indicators: tuple[str, ...] = ("rsi", "macd_hist", "obv"), as_of: str | None = None) -> DataFrame:
    """Price and an indicator turning apart between two successive turns of one kind, with what followed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _ordered(pdf)
        ticker, ts = pdf["ticker"].iloc[0], pdf["ts"].tolist()
        high, low, close = arrays(pdf)
        atr_all = kernels.atr(high, low, close)
        rows = []
        for name in indicators if len(pdf) >= MIN_BARS else ():
            values = indicator(name, pdf)
            start = WARM_UP if name == "rsi" else max(WARM_UP, STD_BARS)
            size = np.full(len(pdf), RSI_POINTS) if name == "rsi" else _rolling(values, STD_BARS, "std")
            v, a, c, m = values[start:], atr_all[start:], close[start:], size[start:]
            prices = kernels.turns(c, c, 2 * a)
            match = paired(prices, kernels.turns(v, v, m))
            for kind, way in (("high", "bearish"), ("low", "bullish")):
                same, up = [p for p in prices if p.kind == kind], 1 if kind == "high" else -1
                for p1, p2 in zip(same, same[1:], strict=False):
                    i1, i2 = match.get(p1.idx), match.get(p2.idx)
                    if p2.idx - p1.idx < SPAN or i1 is None or i2 is None or not _consistent(a[p1.idx], a[p2.idx]):
                        continue
                    if not (up * (p2.value - p1.value) > 0 and up * (i2.value - i1.value) < 0):
                        continue
                    gap = abs(i2.value - i1.value) / m[p2.idx] if _consistent(m[p1.idx], m[p2.idx]) else None
                    move, span = abs(p2.value - p1.value) / a[p2.idx], p2.idx - p1.idx
                    strength = 0.5 * min((gap or 0.0) / GAP_CAP, 1) + 0.3 * min(move / MOVE_CAP, 1) + 0.2 * min(span / SPAN_CAP, 1)
                    seen = start + max(p2.confirmed, i2.confirmed)
                    rows.append((ticker, name, way, ts[start + p1.idx], ts[start + p2.idx], p1.value, p2.value, i1.value, i2.value, strength, span, move, gap, ts[start + p2.idx], ts[seen], start + p2.idx, *_outcome(high, low, atr_all, ts, seen, p2.value, -up)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in DIVERGENCE.split(", ")])

    out = bars.groupBy("ticker").applyInPandas(run, DIVERGENCE)
    return out.filter(F.col("confirmed_at") <= F.lit(as_of).cast("date")) if as_of else out


def _outcome(high: np.ndarray, low: np.ndarray, atr: np.ndarray, ts: list, seen: int, ref: float, up: int) -> tuple:
    """(largest favourable move in each bar's ATR, bars to it, invalidated, when) within the bars after ``seen``."""
    best, when, known, broken = 0.0, None, False, None
    for i in range(seen + 1, min(seen + 1 + OUTCOME_BARS, len(ts))):
        if not atr[i] > 0:
            continue
        known = True
        if broken is None and (low[i] < ref if up > 0 else high[i] > ref):
            broken = ts[i]
        move = (high[i] - ref if up > 0 else ref - low[i]) / atr[i]
        if move > best:
            best, when = move, i - seen
    return best if known else None, when, broken is not None, broken


def confluence(found: DataFrame, window: int = PAIRING) -> DataFrame:
    """Each divergence with the number and names of indicators that diverged with it: runs along the second turn's bar."""
    runs = islands(found, ["ticker", "direction"], "p2_idx", window)
    together = runs.groupBy("ticker", "direction", "island").agg(F.array_sort(F.collect_set("indicator")).alias("names"))
    return runs.join(together, ["ticker", "direction", "island"]).withColumn("confluence", F.size("names")).withColumn("confluent", F.array_join("names", ",")).drop("island", "names")


# Fibonacci sets ---------------------------------------------------------------------------------

SCALES, MIN_SWING, MAX_SETS, NEAR = (2.0, 4.0, 8.0), 8.0, 6, 3
RETRACEMENTS, EXTENSIONS = (0.236, 0.382, 0.5, 0.618, 0.786), (1.272, 1.618, 2.0, 2.618)
TOUCH_ATR, RECLAIM, REACH, HALF_LIFE = 0.3, 5, 10, 250
SWING = "ticker string, scale double, direction string, origin_date date, origin_price double, origin_idx int, end_date date, end_price double, end_idx int, magnitude_atr double, duration_bars int, confirmed_at date, age_bars int"


def swings(bars: DataFrame) -> DataFrame:
    """Swings between successive turns of closes at three scales; a smaller scale's swing whose both ends lie within
    ``NEAR`` bars of a larger scale's is the same swing and goes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _ordered(pdf)
        rows, kept = [], []
        if len(pdf) >= MIN_BARS:
            ts, (high, low, close) = pdf["ts"].tolist(), arrays(pdf)
            a, c = kernels.atr(high, low, close)[WARM_UP:], close[WARM_UP:]
            for scale in sorted(SCALES, reverse=True):
                found = kernels.turns(c, c, scale * a)
                for o, e in zip(found, found[1:], strict=False):
                    if not _consistent(a[o.idx], a[e.idx]) or abs(e.value - o.value) / a[e.idx] < MIN_SWING:
                        continue
                    if any(abs(o.idx - x) <= NEAR and abs(e.idx - y) <= NEAR for x, y in kept):
                        continue
                    kept.append((o.idx, e.idx))
                    rows.append((pdf["ticker"].iloc[0], scale, "up" if o.kind == "low" else "down", ts[WARM_UP + o.idx], o.value, WARM_UP + o.idx, ts[WARM_UP + e.idx], e.value, WARM_UP + e.idx, abs(e.value - o.value) / a[e.idx], e.idx - o.idx, ts[WARM_UP + e.confirmed], len(c) - 1 - e.idx))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in SWING.split(", ")])

    return bars.groupBy("ticker").applyInPandas(run, SWING)


def fib_sets(found: DataFrame, bars: DataFrame, most: int = MAX_SETS, log: bool = False) -> DataFrame:
    """The weightiest swings of each series with status and levels (an array of ratio, kind, price)."""
    weight = 0.5 * clip(F.col("magnitude_atr") / 40, 0, 1) + 0.2 * clip(F.col("duration_bars") / 250, 0, 1) + 0.3 * F.pow(F.lit(0.5), F.col("age_bars") / HALF_LIFE)
    level = lambda r, kind, a, b: F.struct(F.lit(r).alias("ratio"), F.lit(kind).alias("kind"), interpolated(a, b, F.lit(r), log).alias("price"))
    o, e = F.col("origin_price"), F.col("end_price")
    levels = F.array(*[level(r, "retracement", e, o) for r in RETRACEMENTS], *[level(r, "extension", o, e) for r in EXTENSIONS])
    ranked = Window.partitionBy("ticker").orderBy(F.col("weight").desc(), "origin_idx", "end_idx")
    best = found.withColumn("weight", weight).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= most).withColumn("levels", levels)
    # the first close beyond the origin: the few chosen swings of a series meet its later bars
    closes = bars.select(F.col("ticker").alias("_t"), F.col("ts").alias("_d"), "close")
    beyond = F.when(F.col("direction") == "up", F.col("close") < F.col("origin_price")).otherwise(F.col("close") > F.col("origin_price"))
    broken = best.join(closes, (F.col("ticker") == F.col("_t")) & (F.col("_d") > F.col("end_date")) & beyond).groupBy("ticker", "rank").agg(F.min("_d").alias("invalidated_at"))
    return best.join(broken, ["ticker", "rank"], "left").withColumn("status", F.when(F.col("invalidated_at").isNotNull(), "invalidated").otherwise("active"))


TOUCH = "ticker string, origin_idx int, end_idx int, ratio double, kind string, price double, n_touches int, n_violations int, first_touch_date date, last_touch_date date, avg_reaction_atr double, respected boolean"


def level_touches(sets: DataFrame, bars: DataFrame) -> DataFrame:
    """How each level of the chosen sets was met after its swing ended."""

    def run(own: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _ordered(pdf)
        high, low, close = arrays(pdf)
        atr, ts = kernels.atr(high, low, close), pdf["ts"].tolist()
        rows = []
        for s in own.itertuples(index=False):
            f = s.end_idx + 1
            h, lo, c, a = high[f:], low[f:], close[f:], atr[f:]
            half = np.where(a > 0, TOUCH_ATR * a, 0.0) / 2
            for lv in s.levels:
                found, _ = encounters(h, lo, c, lv["price"] - half, lv["price"] + half, RECLAIM)
                met = [x for x in found if x.kind in ("meet", "return")]
                broke = sum(x.kind == "break" for x in found)
                moves = [reaction(h, lo, c, a, x.start, x.side, REACH) or 0.0 for x in met]
                rows.append((s.ticker, s.origin_idx, s.end_idx, lv["ratio"], lv["kind"], lv["price"], len(met), broke, ts[f + met[0].start] if met else None, ts[f + met[-1].end] if met else None, float(np.mean(moves)) if moves else None, bool(met) and not broke))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in TOUCH.split(", ")])

    return sets.select("ticker", "origin_idx", "end_idx", "levels").groupBy("ticker").cogroup(bars.select("ticker", "ts", "high", "low", "close").groupBy("ticker")).applyInPandas(run, TOUCH)


# Anchored average prices ------------------------------------------------------------------------

CYCLE_ATRS, CYCLE_ANCHORS, MAX_ANCHORS, TRAILING, BAND = 8.0, 4, 8, 252, 0.3


#: How senior a role is, the most senior first; cycle turns come last.
SENIORITY = {"ath": 0, "atl": 0, "52w_high": 1, "52w_low": 1, "cycle_high": 2, "cycle_low": 2}


def seniority(roles: Column) -> Column:
    """The seniority of an anchor: that of its most senior role; null without a known one."""
    rank = F.create_map(*[F.lit(x) for pair in SENIORITY.items() for x in pair])
    return F.array_min(F.transform(roles, lambda r: rank[r]))


def only_cycle(roles: Column) -> Column:
    return F.forall(roles, lambda r: r.startswith("cycle_"))


def anchors(bars: DataFrame, turns: DataFrame, previous: DataFrame | None = None, trailing: int = TRAILING, most: int = MAX_ANCHORS) -> DataFrame:
    """(ticker, anchor_date, roles, status): all-time and trailing extremes and the latest cycle turns.

    A previous anchor without a role now is stale and keeps its roles; if too many are active, the oldest that are
    only cycle turns go stale, extremes never.
    """
    first = lambda x, sign: F.max_by("ts", F.struct(sign * F.col(x), -F.col("idx")))
    back = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("idx").desc()))
    ever = bars.groupBy("ticker").agg(first("high", 1).alias("ath"), first("low", -1).alias("atl"))
    late = bars.withColumn("_b", back).filter(F.col("_b") <= trailing).groupBy("ticker").agg(first("high", 1).alias("52w_high"), first("low", -1).alias("52w_low"))
    wide = ever.join(late, "ticker").unpivot(["ticker"], ["ath", "atl", "52w_high", "52w_low"], "role", "anchor_date")
    latest = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("ts").desc()))
    cycle = turns.withColumn("_n", latest).filter(F.col("_n") <= CYCLE_ANCHORS).select("ticker", F.concat(F.lit("cycle_"), "kind").alias("role"), F.col("ts").alias("anchor_date"))
    now = wide.unionByName(cycle).groupBy("ticker", "anchor_date").agg(F.array_sort(F.collect_set("role")).alias("roles")).withColumn("status", F.lit("active"))
    if previous is not None:
        gone = previous.select("ticker", "anchor_date", "roles").join(now, ["ticker", "anchor_date"], "left_anti").withColumn("status", F.lit("stale"))
        now = now.unionByName(gone)
    minor = only_cycle(F.col("roles"))
    w = Window.partitionBy("ticker")
    over = F.greatest(F.sum((F.col("status") == "active").cast("int")).over(w) - most, F.lit(0))
    age = F.row_number().over(Window.partitionBy("ticker", "_minor").orderBy("anchor_date"))
    marked = now.withColumn("_minor", minor & (F.col("status") == "active")).withColumn("_over", over).withColumn("_age", age)
    return marked.withColumn("status", F.when(F.col("_minor") & (F.col("_age") <= F.col("_over")), "stale").otherwise(F.col("status"))).drop("_minor", "_over", "_age")


def anchored(bars: DataFrame, at: DataFrame) -> DataFrame:
    """Each anchor's bars from its date on, with the volume-weighted typical price since."""
    w = Window.partitionBy("ticker", "anchor_date").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    met = bars.join(at.select("ticker", "anchor_date"), "ticker").filter(F.col("ts") >= F.col("anchor_date"))
    price = (F.col("high") + F.col("low") + F.col("close")) / 3
    return met.withColumn("avwap", F.try_divide(F.sum(price * F.col("volume")).over(w), F.sum("volume").over(w)))


def interactions(line: DataFrame, reach: int = REACH, band: float = BAND) -> DataFrame:
    """Per anchor: latest value and distance, crossings with hysteresis, time above and below, mean reaction on touch.

    ``line``: rows of :func:`anchored` with ``atr``.
    """
    w = Window.partitionBy("ticker", "anchor_date").orderBy("ts")
    known = line.filter(F.col("avwap").isNotNull() & F.col("close").isNotNull())
    gap, edge = F.col("close") - F.col("avwap"), F.when(F.col("atr") > 0, band * F.col("atr")).otherwise(F.lit(0.0))
    raw = F.when(gap > edge, 1).when(gap < -edge, -1)
    sided = known.withColumn("raw", raw).withColumn("side", F.last("raw", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    crossed = (F.col("raw") != F.lag("side").over(w)).cast("int")
    above = F.when(F.col("side").isNotNull(), F.col("side") == 1).otherwise(gap >= 0)
    ahead = w.rowsBetween(1, reach)
    move = F.when(above, F.max("high").over(ahead) - F.col("close")).otherwise(F.col("close") - F.min("low").over(ahead))
    touch = F.when(F.col("raw").isNull() & (F.col("atr") > 0), F.greatest(F.lit(0.0), move / F.col("atr")) + move * 0)
    marked = sided.select("*", F.coalesce(crossed, F.lit(0)).alias("crossed"), above.alias("above"), touch.alias("touch"))
    last = lambda c: F.max_by(c, "ts")
    return marked.groupBy("ticker", "anchor_date").agg(
        last("avwap").alias("current_value"), F.max("ts").alias("updated_through"), last(F.when(F.col("atr") > 0, gap / F.col("atr"))).alias("distance_atr"), F.sum("crossed").alias("n_crosses"),
        F.avg(F.col("above").cast("double")).alias("pct_bars_above"), F.max(F.when(F.col("crossed") == 1, F.col("ts"))).alias("last_cross_date"), F.avg("touch").alias("avg_reaction_atr_on_touch"),
    ).withColumn("pct_bars_below", 1 - F.col("pct_bars_above"))


def turn_pairs(turns: DataFrame) -> DataFrame:
    """Each turn with the next of its kind: what divergence tests compare."""
    w = Window.partitionBy("ticker", "kind").orderBy("idx")
    return turns.select("ticker", "kind", "idx", "value", F.lead("idx").over(w).alias("next_idx"), F.lead("value").over(w).alias("next_value")).filter("next_idx is not null")

