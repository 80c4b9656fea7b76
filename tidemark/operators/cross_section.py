"""Cross-sections by date: market capitalisation, breadth and relative strength."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import kernels
from tidemark.functions.scalar import ratio
from tidemark.functions.windows import percentile_rank, series, sma, weighted_return
from tidemark.operators.bars import resample, with_kernel
from tidemark.operators.joins import as_of, later_product, within

#: A filing's tolerance, the spans and weights of the weighted return, weeks of the oscillator.
FILING_TOLERANCE = 1.2
RETURN_SPANS, RETURN_WEIGHTS = (63, 126, 189, 252), (0.4, 0.2, 0.2, 0.2)
MANSFIELD_WEEKS = 52
#: The sector funds that stand for the eleven sectors.
SECTOR_FUNDS = {
    "Technology": "XLK", "Financial Services": "XLF", "Healthcare": "XLV", "Consumer Cyclical": "XLY", "Consumer Defensive": "XLP", "Energy": "XLE",
    "Industrials": "XLI", "Basic Materials": "XLB", "Utilities": "XLU", "Real Estate": "XLRE", "Communication Services": "XLC",
}


def bridged_shares(shares: DataFrame, splits: DataFrame, tolerance: float = FILING_TOLERANCE) -> DataFrame:
    """Share counts whose filings lag a split, scaled by it until a filing departs from the old count.

    Each correction builds on those before it, so a ticker's (few) filings are walked in one group.
    """

    def run(filed: pd.DataFrame, split: pd.DataFrame) -> pd.DataFrame:
        filed = filed.dropna(subset=["shares_outstanding"]).sort_values("ts").reset_index(drop=True)
        days, held = filed["ts"].tolist(), filed["shares_outstanding"].astype(float).tolist()
        for day, factor in split.sort_values("execution_date")[["execution_date", "ratio"]].itertuples(index=False):
            first = sum(d < day for d in days)
            if not first:
                continue
            base = held[first - 1]
            for i in range(first, len(days)):
                lo, hi = sorted((held[i], base))
                if lo <= 0 or hi > tolerance * lo:
                    break
                held[i] = base * factor
        return filed.assign(shares_outstanding=held)[["ticker", "ts", "shares_outstanding"]]

    left = shares.select("ticker", "ts", "shares_outstanding").groupBy("ticker")
    return left.cogroup(splits.select("ticker", "execution_date", "ratio").groupBy("ticker")).applyInPandas(run, "ticker string, ts date, shares_outstanding double")


def market_caps(prices: DataFrame, shares: DataFrame, splits: DataFrame) -> DataFrame:
    """(ticker, ts, close, market_cap, shares_outstanding, split_ratio): split-adjusted prices scaled back
    up by the splits still to come, times the last filed share count; tickers that never filed have no rows."""
    filed = bridged_shares(shares, splits)
    known = prices.filter(F.col("close").isNotNull()).join(filed.select("ticker").distinct(), "ticker", "left_semi").select("ticker", "ts", "close")
    counted = as_of(known, filed, ["shares_outstanding"], by=["ticker"], on="ts")
    out = later_product(counted, splits)
    return out.withColumn("market_cap", F.col("close") * F.col("split_ratio") * F.col("shares_outstanding"))


def constituent_counts(days: DataFrame, membership: DataFrame) -> DataFrame:
    """(ts, n_constituents): intervals open on each day, by a sweep over starts and ends."""
    start = membership.groupBy(F.col("start_date").alias("ts")).agg(F.count(F.lit(1)).alias("d"))
    end = membership.filter("end_date is not null").groupBy(F.date_add("end_date", 1).alias("ts")).agg((-F.count(F.lit(1))).alias("d"))
    swept = days.select("ts", F.lit(0).cast("long").alias("d"), F.lit(1).alias("asked")).unionByName(start.unionByName(end).select("ts", "d", F.lit(0).alias("asked")))
    w = Window.orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    # the calendar is one series: as many rows as there are days
    return swept.groupBy("ts").agg(F.sum("d").alias("d"), F.max("asked").alias("asked")).withColumn("n_constituents", F.sum("d").over(w)).filter("asked = 1").select("ts", "n_constituents")


def weighted_share(cond: Column, valid: Column, weight: Column) -> Column:
    """Weighted share of ``cond`` among valid weighted rows; null if they weigh nothing."""
    ok = valid & weight.isNotNull()
    return F.try_divide(F.sum(F.when(ok, F.coalesce(cond, F.lit(False)).cast("double") * weight).otherwise(0.0)), F.nullif(F.sum(F.when(ok, weight).otherwise(0.0)), F.lit(0.0)))


def weighted_sum(cond: Column, valid: Column, weight: Column) -> Column:
    return F.sum(F.when(valid & weight.isNotNull(), F.coalesce(cond, F.lit(False)).cast("double") * weight).otherwise(0.0))


def breadth(prices: DataFrame, membership: DataFrame, *, sma_periods: tuple[int, ...] = (50, 200), ema_periods: tuple[int, ...] = (8, 21), weighting: str = "equal", shares: DataFrame | None = None, splits: DataFrame | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Per day: how much of an index's members of the day stands above its averages, and how much advances.

    Averages and prior closes run over each ticker's whole history; membership is applied after, and
    the [start, end] trim last.  ``prices``: (ticker, ts, close) of one source; ``membership``: one index.
    """
    if weighting not in ("equal", "cap"):
        raise ValueError(f"unknown weighting {weighting!r}")
    closes = prices.join(membership.select("ticker").distinct(), "ticker", "left_semi").select("ticker", "ts", "close")
    marked = with_kernel(closes, {f"ema{n}": lambda p, n=n: kernels.ema(p["close"].to_numpy(float), n) for n in ema_periods}) if ema_periods else closes
    w = series()
    marked = marked.select("*", *[sma(F.col("close"), n, w).alias(f"sma{n}") for n in sma_periods], F.lag("close").over(w).alias("prior_close"))
    members = within(marked, membership)
    if weighting == "cap":
        caps = market_caps(closes, shares, splits).select("ticker", "ts", F.col("market_cap").alias("weight"))
        members = members.join(caps, ["ticker", "ts"], "left")
    else:
        members = members.withColumn("weight", F.lit(1.0))
    weight, close, prior = F.col("weight"), F.col("close"), F.col("prior_close")
    shares_above = [weighted_share(close > F.col(c), F.col(c).isNotNull(), weight).alias(f"pct_above_{c}") for c in [*(f"sma{n}" for n in sma_periods), *(f"ema{n}" for n in ema_periods)]]
    golden = weighted_share(F.col("sma50") > F.col("sma200"), F.col("sma50").isNotNull() & F.col("sma200").isNotNull(), weight) if {50, 200} <= set(sma_periods) else F.max(F.lit(None).cast("double"))
    moved = prior.isNotNull()
    daily = members.groupBy("ts").agg(F.count(F.lit(1)).alias("n_with_data"), *shares_above, golden.alias("pct_golden_cross"), weighted_sum(close > prior, moved, weight).alias("n_advancing"), weighted_sum(close < prior, moved, weight).alias("n_declining"))
    spine = closes.select("ts").distinct()
    out = constituent_counts(spine, membership).join(daily, "ts", "left")
    out = out.fillna(0, subset=["n_with_data"]).fillna(0.0, subset=["n_advancing", "n_declining"])
    out = out.withColumn("net_advances", F.col("n_advancing") - F.col("n_declining")).withColumn("ad_ratio", F.try_divide(F.col("n_advancing"), F.nullif(F.col("n_declining"), F.lit(0.0))))
    if start:
        out = out.filter(F.col("ts") >= F.lit(start).cast("date"))
    if end:
        out = out.filter(F.col("ts") <= F.lit(end).cast("date"))
    return out


def advance_decline_line(daily: DataFrame) -> DataFrame:
    """Running net advances over a breadth result's own days."""
    return daily.select("ts", F.sum("net_advances").over(Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)).alias("ad_line"))


def strength(targets: DataFrame, benchmark: DataFrame, *, rank_by: tuple[str, ...] = ("ts",), membership: DataFrame | None = None, bench_key: str | None = None, period: int = MANSFIELD_WEEKS, spans: tuple[int, ...] = RETURN_SPANS, weights: tuple[float, ...] = RETURN_WEIGHTS) -> DataFrame:
    """Ratio to a benchmark, its weekly oscillator carried onto days, and a percentile of weighted return.

    ``targets`` and ``benchmark`` are daily bars (ticker, ts, open .. volume); with ``bench_key`` each target meets
    the benchmark whose ticker that column of ``targets`` names, else the only one.  Weekly values carry
    the label of their week's first day and hold from then on.
    """
    keep = [c for c in targets.columns if c not in ("open", "high", "low", "volume")]
    bench = benchmark.select(F.col("ticker").alias("benchmark"), "ts", F.col("close").alias("bench_close"))
    week = lambda df: resample(df, "week").filter(~F.col("is_partial")).select("ticker", "ts", "close")
    weekly_bench = week(benchmark).select(F.col("ticker").alias("benchmark"), "ts", F.col("close").alias("bench_close"))
    if bench_key:
        pairs = targets.select("ticker", F.col(bench_key).alias("benchmark")).distinct()
        own = targets.withColumn("benchmark", F.col(bench_key))
        daily = own.select(*keep, "benchmark").join(bench, ["benchmark", "ts"])
        weekly = week(targets).join(pairs, "ticker").join(weekly_bench, ["benchmark", "ts"])
    else:
        daily = targets.select(*keep).join(bench, "ts")
        weekly = week(targets).join(weekly_bench, "ts")
    line = ratio(F.col("close"), F.col("bench_close"))
    oscillator = weekly.withColumn("r", line).withColumn("m", sma(F.col("r"), period, series())).select("ticker", "ts", ((F.try_divide(F.col("r"), F.col("m")) - 1) * 100).alias("rs_mansfield"))
    returns = targets.select("ticker", "ts", weighted_return(F.col("close"), spans, weights, series()).alias("weighted_return"))
    joined = daily.withColumn("rs_ratio", line).join(returns, ["ticker", "ts"])
    carried = as_of(joined, oscillator, ["rs_mansfield"], by=["ticker"], on="ts")
    if membership is not None:
        carried = within(carried, membership)
    return carried.withColumn("rs_rating", percentile_rank("weighted_return", *rank_by))
