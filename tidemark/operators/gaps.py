"""Price gaps and how they fill, over bars that carry ``idx`` and ``atr``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalar import quotient
from tidemark.functions.windows import series, sma
from tidemark.operators.joins import islands

LEAST_ATR, SOFT, WARM_UP, REACH, BRIDGE = 0.3, 80.0, 50, 10, 3
STUDY_HORIZONS = (5, 10, 20, 60)


def detect(bars: DataFrame, least: float = LEAST_ATR, warm_up: int = WARM_UP) -> DataFrame:
    """(ticker, kind, direction, created_at, created_idx, zone_bottom, zone_top, size_atr, related).

    ``classic``: between a bar and the one before; ``fvg``: between a bar and the second before.
    ``related`` marks a fair-value gap on the same bar and side as a classic one.
    """
    w = series()
    shifted = bars.select("*", *[F.lag(c, n).over(w).alias(f"{c}{n}") for c in ("high", "low") for n in (1, 2)]).filter(F.col("idx") >= max(2, warm_up))
    shape = lambda kind, way, bottom, top: F.struct(F.lit(kind).alias("kind"), F.lit(way).alias("direction"), F.col(bottom).alias("zone_bottom"), F.col(top).alias("zone_top"))
    kinds = F.array(shape("classic", "bullish", "high1", "low"), shape("classic", "bearish", "high", "low1"), shape("fvg", "bullish", "high2", "low"), shape("fvg", "bearish", "high", "low2"))
    # each bar has four candidates at most, so this multiplies rows by a constant before the filter
    found = shifted.select("ticker", F.col("ts").alias("created_at"), F.col("idx").alias("created_idx"), "atr", F.explode(kinds).alias("g")).select("ticker", "created_at", "created_idx", "g.*", F.when(F.col("atr") > 0, (F.col("g.zone_top") - F.col("g.zone_bottom")) / F.col("atr")).alias("size_atr"))
    kept = found.filter((F.col("zone_top") > F.col("zone_bottom")) & (F.col("size_atr") >= least))
    same = Window.partitionBy("ticker", "created_idx", "direction")
    return kept.withColumn("related", (F.col("kind") == "fvg") & (F.min("kind").over(same) == "classic"))


GAP = ["ticker", "kind", "direction", "created_idx"]


FILL = "ticker string, kind string, direction string, created_idx int, zone_bottom double, zone_top double, idx int, ts date, pct double, max_pct double"


def fills(gaps: DataFrame, bars: DataFrame, by: str = "wick") -> DataFrame:
    """Each gap's later bars with pct and its running maximum, up to the bar that fills it.

    A join of gaps with all later bars would be quadratic in a series' length before anything is cut, so
    one series' gaps and bars meet in a kernel: each gap reads ahead in growing blocks until it is full, and
    only its open life comes out.
    """

    def run(own: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable")
        lo, hi = (pdf["low"], pdf["high"]) if by == "wick" else (pdf[["open", "close"]].min(axis=1), pdf[["open", "close"]].max(axis=1))
        lo, hi, idx, ts = lo.to_numpy(float), hi.to_numpy(float), pdf["idx"].to_numpy(), pdf["ts"].to_numpy()
        begin, found = [], []
        for far, near, made, rising in zip(*(own[c].to_numpy() for c in ("zone_top", "zone_bottom", "created_idx")), (own["direction"] == "bullish").to_numpy(), strict=True):
            start = at = int(np.searchsorted(idx, made, side="right"))
            parts, block = [np.empty(0)], 32
            while at < len(idx):
                reach = far - lo[at : at + block] if rising else hi[at : at + block] - near
                pct = np.clip(reach / (far - near) * 100, 0, 100)
                full = np.flatnonzero(pct >= 100)
                parts.append(pct[: full[0] + 1] if len(full) else pct)
                if len(full):
                    break
                at, block = at + block, block * 2
            begin.append(start)
            found.append(np.concatenate(parts))
        sizes = np.array([len(x) for x in found], dtype=int)
        of = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(np.array(begin, dtype=int), sizes)
        out = own.iloc[of].reset_index(drop=True)
        return out.assign(idx=idx[place], ts=ts[place], pct=np.concatenate([np.empty(0), *found]), max_pct=np.concatenate([np.empty(0), *map(np.maximum.accumulate, found)]))

    left = gaps.select(*GAP, "zone_bottom", "zone_top").groupBy("ticker")
    return left.cogroup(bars.select("ticker", "idx", "ts", "open", "high", "low", "close").groupBy("ticker")).applyInPandas(run, FILL)


def lifecycle(gaps: DataFrame, bars: DataFrame, by: str = "wick", soft: float = SOFT, walked: DataFrame | None = None) -> DataFrame:
    """Gaps with status, dates and bar counts of their first touch, soft close and close, approaches and volume.

    ``walked``: the gaps' :func:`fills`, where the caller has them.
    """
    walked = fills(gaps, bars, by) if walked is None else walked
    first = lambda cond, name: [F.min(F.when(cond, F.col("ts"))).alias(f"{name}_date"), F.min(F.when(cond, F.col("idx") - F.col("created_idx"))).alias(f"bars_to_{name}")]
    life = walked.groupBy(*GAP).agg(F.max("pct").alias("max_fill_pct"), *first(F.col("pct") > 0, "first_touch"), *first(F.col("max_pct") >= soft, "soft_closed"), *first(F.col("max_pct") >= 100, "closed"))
    seen = approaches(walked)
    volume = bars.select(F.col("ticker").alias("_t"), F.col("idx").alias("_i"), F.try_divide(F.col("volume"), sma(F.col("volume"), 20, series())).alias("volume_ratio_at_creation"))
    out = gaps.join(life, GAP, "left").join(seen, GAP, "left").join(volume, (F.col("ticker") == F.col("_t")) & (F.col("created_idx") == F.col("_i")), "left").drop("_t", "_i")
    out = out.fillna(0.0, subset=["max_fill_pct"]).fillna(0, subset=["n_approaches"])
    status = F.when(F.col("max_fill_pct") >= 100, "closed").when(F.col("max_fill_pct") >= soft, "soft_closed").when(F.col("max_fill_pct") > 0, "partial").otherwise("open")
    return out.withColumn("status", status)


def approaches(walked: DataFrame, bridge: int = BRIDGE) -> DataFrame:
    """Separate approaches before the close: touching bars with at most ``bridge`` idle bars between count as one."""
    return islands(walked.filter("pct > 0"), GAP, "idx", bridge + 1).groupBy(*GAP).agg(F.countDistinct("island").alias("n_approaches"))


def reactions(life: DataFrame, bars: DataFrame, reach: int = REACH) -> DataFrame:
    """For closed gaps: the largest move in the gap's direction within ``reach`` bars of the close, each bar's
    move in that bar's ATR, and when it came."""
    at_close = bars.select(F.col("ticker").alias("_t"), F.col("ts").alias("_d"), F.col("idx").alias("closed_idx"), F.col("close").alias("ref"))
    closed = life.filter("status = 'closed'").join(at_close, (F.col("ticker") == F.col("_t")) & (F.col("closed_date") == F.col("_d"))).drop("_t", "_d")
    steps = closed.select(*GAP, "ref", "closed_idx", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("step")).withColumn("idx", F.col("closed_idx") + F.col("step"))
    ahead = steps.join(bars.select("ticker", "idx", "high", "low", "atr"), ["ticker", "idx"]).filter("atr > 0")
    move = F.greatest(F.lit(0.0), F.when(F.col("direction") == "bullish", F.col("high") - F.col("ref")).otherwise(F.col("ref") - F.col("low")) / F.col("atr"))
    best = ahead.withColumn("move", move).groupBy(*GAP).agg(F.max("move").alias("reaction_atr_after_close"), F.min_by("step", F.struct(-F.col("move"), F.col("step"))).alias("_step"))
    return best.withColumn("bars_to_reaction_peak", F.when(F.col("reaction_atr_after_close") > 0, F.col("_step"))).drop("_step")


def study(life: DataFrame, walked: DataFrame, bars: DataFrame, threshold: float = SOFT, horizons: tuple[int, ...] = STUDY_HORIZONS) -> DataFrame:
    """Per gap: its peak fill, when that and the threshold came, and signed returns (in %) after creation and peak;
    from a price of 0 they are infinite or NaN."""
    peak = walked.groupBy(*GAP).agg(F.max("pct").alias("peak_fill"), F.min_by("idx", F.struct(-F.col("pct"), F.col("idx"))).alias("peak_idx"), F.min(F.when(F.col("max_pct") >= threshold, F.col("idx") - F.col("created_idx"))).alias("bars_to_threshold"))
    w = series()
    ahead = bars.select("ticker", "idx", *[((quotient(F.lead("close", h).over(w), F.col("close")) - 1) * 100).alias(f"f{h}") for h in horizons])
    out = life.select(*GAP, (F.col("status") == "closed").alias("closed")).join(peak, GAP)
    sign = F.when(F.col("direction") == "bullish", 1.0).otherwise(-1.0)
    for at, name in (("created_idx", "created"), ("peak_idx", "peak")):
        named = ahead.select(F.col("ticker").alias("_t"), F.col("idx").alias("_i"), *[F.col(f"f{h}").alias(f"_f{h}") for h in horizons])
        out = out.join(named, (F.col("ticker") == F.col("_t")) & (F.col(at) == F.col("_i")), "left").withColumns({f"return_{h}_from_{name}": sign * F.col(f"_f{h}") for h in horizons}).drop("_t", "_i", *[f"_f{h}" for h in horizons])
    return out.withColumn("bars_to_peak", F.col("peak_idx") - F.col("created_idx")).drop("peak_idx")
