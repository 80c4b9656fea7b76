"""Streams: bars and sessions from ticks with watermarks, and swing points as they are confirmed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_bars(ticks: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Bars of (ticker, ts, price, volume) ticks; ticks later than ``late`` behind the newest are left out."""
    return ticks.withWatermark("ts", late).groupBy("ticker", F.window("ts", width).alias("w")).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("volume").alias("volume")
    ).select("ticker", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def sessions(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a key's events no further apart than ``gap``."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


TURN = "ticker string, kind string, value double, at timestamp, confirmed_at timestamp"
STATE = "top double, top_at timestamp, bottom double, bottom_at timestamp, seek string"


def zigzag(bars: DataFrame, share: float = 0.05) -> DataFrame:
    """Swing points of a stream of bars (ticker, ts, high, low): an extreme is confirmed when price has left it by
    ``share`` of its value.  A ticker's state is its two candidates, whatever its history."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else None
        rows = []
        for b in pd.concat(list(batches)).sort_values("ts", kind="stable").itertuples(index=False):
            if held is None:
                held = [b.high, b.ts, b.low, b.ts, ""]
                continue
            top, top_at, bottom, bottom_at, seek = held
            if b.high > top:
                top, top_at = b.high, b.ts
            if b.low < bottom:
                bottom, bottom_at = b.low, b.ts
            if seek != "low" and top_at < b.ts and top - b.low >= share * top:
                rows.append((key[0], "high", top, top_at, b.ts))
                seek, bottom, bottom_at = "low", b.low, b.ts
            elif seek != "high" and bottom_at < b.ts and b.high - bottom >= share * bottom:
                rows.append((key[0], "low", bottom, bottom_at, b.ts))
                seek, top, top_at = "high", b.high, b.ts
            held = [top, top_at, bottom, bottom_at, seek]
        if held is not None:
            state.update(tuple(held))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in TURN.split(", ")])

    return bars.select("ticker", F.col("ts").cast("timestamp").alias("ts"), "high", "low").groupBy("ticker").applyInPandasWithState(step, TURN, STATE, "append", GroupStateTimeout.NoTimeout)
