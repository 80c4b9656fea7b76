"""Indicators that a fixed frame, a running sum or a shift can express: all plain window expressions.

Every function takes the window that orders one series (``series()`` by default).  Rolling results
are null until their frame is full.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def series(*keys: str, order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*(keys or ("ticker",))).orderBy(order)


def _rows(n: int, w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def _full(value: Column, x: Column, n: int, w: WindowSpec) -> Column:
    return F.when(F.count(x).over(_rows(n, w)) == n, value)


def sma(x: Column, n: int, w: WindowSpec) -> Column:
    return _full(F.avg(x).over(_rows(n, w)), x, n, w)


def running_sum(x: Column, w: WindowSpec) -> Column:
    """Sum over ``w``'s frame without the error that one rounding a row adds up to over a long series.

    Multiples of 2^-40 are summed exactly up to 8192; what is left of each row is so small that its sum's error vanishes.
    """
    coarse = F.rint(x * F.lit(2.0**40)) * F.lit(2.0**-40)
    return F.sum(coarse).over(w) + F.sum(x - coarse).over(w)


def rolling_std(x: Column, n: int, w: WindowSpec) -> Column:
    """Sample deviation."""
    return _full(F.stddev_samp(x).over(_rows(n, w)), x, n, w)


def rolling_max(x: Column, n: int, w: WindowSpec) -> Column:
    return _full(F.max(x).over(_rows(n, w)), x, n, w)


def rolling_min(x: Column, n: int, w: WindowSpec) -> Column:
    return _full(F.min(x).over(_rows(n, w)), x, n, w)


def bollinger(x: Column, n: int, up: float, down: float, w: WindowSpec) -> tuple[Column, Column, Column]:
    """(upper, middle, lower) around the mean, by the population deviation."""
    mid, dev = sma(x, n, w), _full(F.stddev_pop(x).over(_rows(n, w)), x, n, w)
    return mid + up * dev, mid, mid - down * dev


def true_range(w: WindowSpec) -> Column:
    prior = F.lag("close").over(w)
    return F.when(prior.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prior), F.abs(F.col("low") - prior)))


def fast_k(n: int, w: WindowSpec) -> Column:
    """Raw stochastic; 0 where the range is flat."""
    hi, lo = rolling_max(F.col("high"), n, w), rolling_min(F.col("low"), n, w)
    return F.when(hi == lo, 0.0).otherwise(100 * F.try_divide(F.col("close") - lo, hi - lo))


def williams_r(n: int, w: WindowSpec) -> Column:
    hi, lo = rolling_max(F.col("high"), n, w), rolling_min(F.col("low"), n, w)
    return F.when(hi == lo, 0.0).otherwise(-100 * F.try_divide(hi - F.col("close"), hi - lo))


def roc(x: Column, n: int, w: WindowSpec) -> Column:
    return F.try_divide(x, F.lag(x, n).over(w)) * 100 - 100


def cci(n: int, w: WindowSpec) -> Column:
    """Mean deviation needs the frame's own mean, so the frame is folded as an array."""
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    mean, frame = sma(tp, n, w), F.collect_list(tp).over(_rows(n, w))
    deviation = F.aggregate(F.transform(frame, lambda x: F.abs(x - mean)), F.lit(0.0), lambda a, x: a + x) / n
    return F.when(mean.isNotNull(), F.when(deviation == 0, 0.0).otherwise(F.try_divide(tp - mean, 0.015 * deviation)))


def obv(w: WindowSpec) -> Column:
    move = F.col("close") - F.lag("close").over(w)
    signed = F.when(move.isNull() | (move > 0), F.col("volume")).when(move < 0, -F.col("volume")).otherwise(0.0)
    return signed  # callers sum it, as a window cannot be nested in another


def mfi_flows(w: WindowSpec) -> tuple[Column, Column]:
    """(positive, negative) money flow of each bar; the first has none."""
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    before = F.lag(tp).over(w)
    flow = tp * F.col("volume")
    known = before.isNotNull()
    return F.when(known, F.when(tp > before, flow).otherwise(0.0)), F.when(known, F.when(tp < before, flow).otherwise(0.0))


def mfi(positive: str, negative: str, n: int, w: WindowSpec) -> Column:
    up, down = (F.sum(c).over(_rows(n, w)) for c in (positive, negative))
    return _full(F.when(up + down < 1, 0.0).otherwise(100 * F.try_divide(up, up + down)), F.col(positive), n, w)


def percentile_rank(x: str, *keys: str) -> Column:
    """Average-tie rank as a share of the non-null rows of a group, in hundredths; null stays null."""
    group, same = Window.partitionBy(*keys), Window.partitionBy(*keys, x)
    below = F.rank().over(group.orderBy(F.col(x).asc_nulls_last()))
    ties = F.count(F.lit(1)).over(same)
    return F.when(F.col(x).isNotNull(), (below + (ties - 1) / F.lit(2.0)) / F.count(x).over(group) * 100)


def weighted_return(x: Column, spans: tuple[int, ...], weights: tuple[float, ...], w: WindowSpec) -> Column:
    if len(spans) != len(weights):
        raise ValueError("spans and weights differ in length")
    parts = [weight * (F.try_divide(x, F.lag(x, n).over(w)) - 1) for n, weight in zip(spans, weights, strict=True)]
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return out


def forward_max(x: Column, n: int, w: WindowSpec) -> Column:
    return F.max(x).over(w.rowsBetween(1, n))


def forward_min(x: Column, n: int, w: WindowSpec) -> Column:
    return F.min(x).over(w.rowsBetween(1, n))


def prior_trend(kind: str, least: int, w: WindowSpec) -> Column:
    """Rise of the high above the lowest low (``up``), or fall of the low from the highest high, over the
    last 3 * least bars; null without least + 1 of them."""
    frame = w.rowsBetween(-3 * least, 0)
    many = F.count(F.lit(1)).over(frame) >= least + 1
    if kind == "up":
        low = F.min("low").over(frame)
        return F.when(many, F.try_divide(F.col("high") - low, low))
    high = F.max("high").over(frame)
    return F.when(many, F.try_divide(high - F.col("low"), high))
