"""Bars: derivation from ticks, loading, validation, resampling, applying kernels.

A bar frame has ticker, ts (date or timestamp), open, high, low, close, volume, and optionally source and
is_partial.  Order is never implied: ``indexed`` adds ``idx``, the bar's number within its series.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import kernels
from tidemark.functions.scalar import last_weekday
from tidemark.functions.windows import series

PRICES = ("open", "high", "low", "close")
#: Closes outside this range of the close before them, and ranges beyond this many ATRs, are flagged.
JUMP_LOW, JUMP_HIGH, RANGE_ATRS = 1 / 3, 3.0, 3.0
#: More dropped rows than this share makes a series unreliable.
UNRELIABLE = 0.005


def from_ticks(ticks: DataFrame, *order: str) -> DataFrame:
    """Daily bars of (ticker, ts, price, volume) ticks; ``order`` breaks ties within a day."""
    key = F.struct(*order, F.col("price").alias("p"))
    return ticks.groupBy("ticker", F.to_date("ts").alias("ts")).agg(
        F.min(key)["p"].alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(key)["p"].alias("close"), F.sum("volume").alias("volume")
    )


def indexed(bars: DataFrame, *keys: str) -> DataFrame:
    return bars.withColumn("idx", F.row_number().over(series(*keys)) - 1)


def sound(with_volume: bool = True) -> Column:
    """Prices positive and consistent; a null fails.  Storage checks prices only, analysis also volume."""
    ok = (F.col("low") > 0) & (F.col("open") > 0) & (F.col("close") > 0) & (F.col("high") >= F.col("low"))
    for c in ("open", "close"):
        ok = ok & F.col(c).between(F.col("low"), F.col("high"))
    if with_volume:
        ok = ok & (F.col("volume") >= 0)
    return F.coalesce(ok, F.lit(False))


def one_source(bars: DataFrame) -> DataFrame:
    """The frame itself, failing at run time if a series mixes sources."""
    w = Window.partitionBy("ticker")
    mixed = F.min("source").over(w) != F.max("source").over(w)
    return bars.withColumn("source", F.when(mixed, F.raise_error(F.lit("a series mixes sources"))).otherwise(F.col("source")))


def keep_last(bars: DataFrame, *order: str) -> DataFrame:
    """One bar for each ticker and ts: the last by ``order``."""
    w = Window.partitionBy("ticker", "ts").orderBy(*[F.col(c).desc() for c in order])
    return bars.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def load(bars: DataFrame, *, as_of: str | None = None, start: str | None = None, source: str | None = None, weekly: bool = False) -> DataFrame:
    """Bars for analysis: one source (named, or the only one, else an error), nothing after ``as_of`` and nothing unfinished.

    The filters stand below every window, so no later bar can colour an earlier result.  Weekly bars are made
    from the daily ones and judged complete against each series' own last bar.
    """
    out = bars
    if "source" in out.columns:
        out = out.filter(F.col("source") == source) if source else one_source(out)
    if as_of:
        out = out.filter(F.col("ts") <= F.lit(as_of).cast("date"))
    if start:
        out = out.filter(F.col("ts") >= F.lit(start).cast("date"))
    if "is_partial" in out.columns:
        out = out.filter(~F.coalesce(F.col("is_partial").cast("boolean"), F.lit(False))).drop("is_partial")
    if weekly:
        out = resample(out, "week").filter(~F.col("is_partial")).drop("is_partial")
    return out


def validated(bars: DataFrame, with_volume: bool = True) -> DataFrame:
    return bars.filter(sound(with_volume))


def quality(bars: DataFrame) -> DataFrame:
    """Per series: loaded, dropped, drop_rate, unreliable."""
    return bars.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("loaded"), F.sum((~sound()).cast("long")).alias("dropped")
    ).withColumn("drop_rate", F.coalesce(F.try_divide(F.col("dropped").cast("double"), F.col("loaded").cast("double")), F.lit(0.0))).withColumn("unreliable", F.col("drop_rate") > UNRELIABLE)


def suspicious(bars: DataFrame) -> DataFrame:
    """Bars that valid data should rarely show: (ticker, ts, jump, wide).  Needs ``atr``; nothing is dropped."""
    w = series()
    move = F.try_divide(F.col("close"), F.lag("close").over(w))
    prior = F.lag("atr").over(w)
    jump = F.coalesce((move < JUMP_LOW) | (move > JUMP_HIGH), F.lit(False))
    wide = F.coalesce((prior > 0) & ((F.col("high") - F.col("low")) > RANGE_ATRS * prior), F.lit(False))
    return bars.select("ticker", "ts", jump.alias("jump"), wide.alias("wide")).filter("jump or wide")


def enough(bars: DataFrame, least: int) -> DataFrame:
    """Series with at least ``least`` bars."""
    return bars.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("ticker"))).filter(F.col("_n") >= least).drop("_n")


def skipped(bars: DataFrame, least: int) -> DataFrame:
    return bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("bars")).filter(F.col("bars") < least).withColumn("reason", F.format_string("only %d of %d bars", F.col("bars"), F.lit(least)))


def resample(bars: DataFrame, period: str, as_of: str | None = None) -> DataFrame:
    """Weekly (labelled Monday) or monthly (labelled the first) bars of all series in one aggregate.

    A period is partial unless ``as_of`` (by default the series' last bar) lies beyond its last weekday, or
    if any bar in it is.
    """
    day = F.col("ts").cast("date")
    label = F.date_trunc("week", day).cast("date") if period == "week" else F.trunc(day, "MM")
    partial = F.coalesce(F.col("is_partial").cast("boolean"), F.lit(False)) if "is_partial" in bars.columns else F.lit(False)
    out = bars.groupBy("ticker", label.alias("period")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.bool_or(partial).alias("_partial"), F.max(day).alias("_last"),
    )
    end = F.date_add("period", 6) if period == "week" else F.last_day("period")
    now = F.lit(as_of).cast("date") if as_of else F.max("_last").over(Window.partitionBy("ticker"))
    return out.select("ticker", F.col("period").alias("ts"), "open", "high", "low", "close", "volume", (F.col("_partial") | ~(now > last_weekday(end))).alias("is_partial"))


def with_kernel(bars: DataFrame, columns: dict[str, Callable[[pd.DataFrame], np.ndarray]], *keys: str) -> DataFrame:
    """Append recursive indicators: each function sees one series in order and gives one array."""
    keys = keys or ("ticker",)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema] + [f"{c} double" for c in columns])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        return pdf.assign(**{c: pd.Series(fn(pdf), index=pdf.index, dtype="float64") for c, fn in columns.items()})

    made = bars.groupBy(*keys).applyInPandas(run, schema)
    return made.select(*bars.columns, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns])


def arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    return tuple(pdf[c].to_numpy(float) for c in ("high", "low", "close"))


def with_atr(bars: DataFrame, n: int = 14, name: str = "atr") -> DataFrame:
    return with_kernel(bars, {name: lambda p: kernels.atr(*arrays(p), n)})


def with_turns(bars: DataFrame, size: float, price: str = "range") -> DataFrame:
    """Zigzag turns at ``size`` ATRs, of highs and lows or of closes: ticker, kind, ts, value, confirmed_at, threshold, idx, confirmed_idx."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        high, low, close = arrays(pdf)
        a = kernels.atr(high, low, close, 14) * size
        hi, lo = (high, low) if price == "range" else (close, close)
        found = kernels.turns(hi, lo, a)
        ts = pdf["ts"].tolist()
        rows = [(pdf["ticker"].iloc[0], t.kind, ts[t.idx], t.value, ts[t.confirmed], t.size, t.idx, t.confirmed) for t in found]
        return pd.DataFrame(rows, columns=["ticker", "kind", "ts", "value", "confirmed_at", "threshold", "idx", "confirmed_idx"])

    return bars.groupBy("ticker").applyInPandas(run, "ticker string, kind string, ts date, value double, confirmed_at date, threshold double, idx int, confirmed_idx int")
