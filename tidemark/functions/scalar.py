"""Column functions without state: ratios, geometry, clipping, tolerance, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def quotient(a: Column, b: Column) -> Column:
    """a / b as floating-point numbers divide: by 0 infinite, or NaN for 0 / 0; null only where a or b is null."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(F.try_divide(a, b))


def ln(x: Column) -> Column:
    """Natural logarithm, minus infinity at 0; null below."""
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.log(x))


def band_width(upper: Column, lower: Column, middle: Column) -> Column:
    return ratio(upper - lower, middle) * 100


def band_width_atr(upper: Column, lower: Column, atr: Column) -> Column:
    return ratio(upper - lower, atr)


def clip(x: Column, lo: float, hi: float) -> Column:
    """x held to [lo, hi]; null stays null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def scale_consistent(a: Column, b: Column, most: float = 10.0) -> Column:
    """Whether two positive magnitudes are within a factor ``most``; never null."""
    return F.coalesce((a > 0) & (b > 0) & (F.greatest(a, b) <= most * F.least(a, b)), F.lit(False))


def typical_price(kind: str = "hlc3") -> Column:
    if kind == "hlc3":
        return (F.col("high") + F.col("low") + F.col("close")) / 3
    if kind == "close":
        return F.col("close")
    raise ValueError(f"unknown price {kind!r}")


def interpolated(a: Column, b: Column, share: Column, log: bool = False) -> Column:
    """The point at ``share`` of the way from a to b, in prices or in log prices."""
    if log:
        return F.exp(ln(a) + share * (ln(b) - ln(a)))
    return a + share * (b - a)


def slope_in_atr(slope: Column, price: Column, atr: Column) -> Column:
    """A log-price slope as ATRs a bar at a price; 0 without an ATR."""
    return F.when(F.coalesce(atr, F.lit(0.0)) != 0, price * F.expm1(slope) / atr).otherwise(F.lit(0.0))


def slopes_similar(a: Column, b: Column, least: float = 0.5) -> Column:
    flat = (a == 0) & (b == 0)
    return flat | (((a > 0) == (b > 0)) & (F.least(F.abs(a), F.abs(b)) >= least * F.greatest(F.abs(a), F.abs(b))))


def relative_volume(volume: Column, average: Column) -> Column:
    return F.when(average > 0, volume / average)


def level_tolerance(atr: Column, price: Column, atr_share: float, price_share: float) -> Column:
    return F.greatest(F.lit(atr_share) * atr, F.lit(price_share) * price)


def line_at(slope: Column, intercept: Column, idx: Column, origin: Column | None = None, log: bool = False) -> Column:
    """A line's value at a bar: slope * (idx - origin) + intercept, exponentiated for lines in log prices."""
    x = slope * (idx if origin is None else idx - origin) + intercept
    return F.exp(x) if log else x


def last_weekday(day: Column) -> Column:
    """The day itself, or the Friday before it on a weekend."""
    return F.date_sub(day, F.greatest(F.lit(0), F.weekday(day) - 4))


def partial_on(ts: Column, as_of: str) -> Column:
    return F.to_date(ts) >= F.to_date(F.lit(as_of))


def share_class_symbol(symbol: Column) -> Column:
    """A dotted share class as the other vendor writes it: BRK.B, BRK-B."""
    return F.translate(symbol, ".", "-")


def dotted_symbol(symbol: Column) -> Column:
    """The way back from :func:`share_class_symbol`: BRK-B, BRK.B."""
    return F.translate(symbol, "-", ".")
