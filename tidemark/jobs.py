"""Jobs over a store: ``python -m tidemark.jobs NAME --store URI [options]``, or through spark-submit.

One job covers all tickers at once; ``--ticker`` narrows it.  Detectors log a run and upsert what they
find; a series that has too few bars, or none, gives nothing and stops nothing.
"""

from __future__ import annotations

import argparse
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as br
from tidemark.operators import cross_section as xs
from tidemark.operators import gaps as gp
from tidemark.operators import levels as lv
from tidemark.operators import patterns as pt
from tidemark.operators import structures as st
from tidemark.operators.joins import differing, presence_intervals
from tidemark.sources.store import Store

#: Series that a run's warning names at most.
WORST = 10
DETECTORS = ("gaps", "divergences", "fib_sets", "anchors", "sr_lines", "patterns")


def series_bars(store: Store, a: argparse.Namespace, timeframe: str) -> tuple[DataFrame, DataFrame]:
    """(validated bars of one source as analysis wants them: finished, not after ``--as-of``; their quality by series)."""
    raw = store.bars(source=a.source, end=a.as_of, ticker=a.ticker or None, ordered=False).withColumn("ts", F.col("ts").cast("date"))
    if "ticker" not in raw.columns:  # pinned to one
        raw = raw.withColumn("ticker", F.lit(a.ticker))
    ready = br.load(raw, as_of=a.as_of, weekly=timeframe == "weekly")
    names = ["ticker", "ts", "open", "high", "low", "close", "volume"]
    return br.validated(ready).select(*names), br.quality(ready)


def verdict(report: DataFrame) -> tuple[int, str | None]:
    """(rows dropped, a warning that names the least reliable series, if any is unreliable) of a quality report."""
    dropped, many = report.agg(F.coalesce(F.sum("dropped"), F.lit(0)), F.count(F.when(F.col("unreliable"), 1))).first()
    if not many:
        return dropped, None
    worst = report.filter("unreliable").orderBy(F.col("drop_rate").desc(), "ticker").limit(WORST).collect()
    return dropped, f"{many} unreliable series: " + ", ".join(f"{r['ticker']} ({r['drop_rate']:.1%} dropped)" for r in worst)


def detect(name: str, bars: DataFrame, timeframe: str, store: Store, as_of: str | None = None) -> DataFrame:
    weekly = timeframe == "weekly"
    if name == "gaps":
        b = br.with_atr(br.indexed(br.enough(bars, st.MIN_BARS)))
        found = gp.detect(b)
        life = gp.lifecycle(found, b)
        return life.join(gp.reactions(life, b), gp.GAP, "left")
    if name == "divergences":
        return st.divergences(bars, as_of=as_of)
    if name == "fib_sets":
        return st.fib_sets(st.swings(bars), bars)
    if name == "anchors":
        b = br.indexed(br.enough(bars, st.MIN_BARS))
        before = store.read("anchors").filter(F.col("timeframe") == timeframe)
        at = st.anchors(b, br.with_turns(b.filter(F.col("idx") >= st.WARM_UP), st.CYCLE_ATRS, "close"), before, 52 if weekly else st.TRAILING)
        return at.join(st.interactions(st.anchored(br.with_atr(b), at)), ["ticker", "anchor_date"], "left")
    if name == "sr_lines":
        out = lv.detect(bars, lv.LONG_WEEKLY if weekly else lv.MEDIUM)
        return out.withColumn("geometry", F.round(F.coalesce("center", "slope"), 2))
    return pt.scan(bars, spans=pt.WEEKLY if weekly else pt.DAILY, as_of=as_of)


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    """Carry out a job; the frame it is about, if any."""
    store = Store(spark, a.store)
    if a.job == "resample":
        daily = store.read("bars_1d").withColumn("ts", F.col("ts").cast("date"))
        for period, table in (("week", "bars_1w"), ("month", "bars_1mo")):
            # a series is a ticker of one source: sources never mix
            keyed = daily.withColumn("ticker", F.concat_ws("\u0001", "ticker", "source"))
            made = br.resample(keyed, period, a.as_of).withColumn("_k", F.split("ticker", "\u0001"))
            store.upsert(table, made.withColumn("source", F.col("_k")[1]).withColumn("ticker", F.col("_k")[0]).withColumn("ts", F.col("ts").cast("timestamp_ntz")))
        return store.read("bars_1w")
    if a.job == "breadth":
        prices = store.bars(source=a.source, ordered=False).withColumn("ts", F.col("ts").cast("date"))
        shares, splits = store.read("shares_outstanding"), store.read("splits")
        out = xs.breadth(prices, store.members(a.index), weighting=a.weighting, shares=shares, splits=splits, start=a.start, end=a.end)
        out = out.withColumn("index_name", F.lit(a.index)).withColumn("weighting", F.lit(a.weighting))
        store.upsert("breadth", out)
        return out
    if a.job == "strength":
        bars = store.bars(source=a.source, ordered=False).withColumn("ts", F.col("ts").cast("date"))
        members = store.members(a.index)
        funds = spark.createDataFrame(list(xs.SECTOR_FUNDS.items()), "sector string, fund string")
        bench = bars.filter(F.col("ticker") == a.benchmark)
        if a.tier == "stock_vs_market":
            out = xs.strength(bars.join(members.select("ticker").distinct(), "ticker", "left_semi"), bench, membership=members)
        elif a.tier == "stock_vs_sector":
            sector = store.read("ticker_sector").join(F.broadcast(funds), "sector").select("ticker", "sector", "fund")
            own = bars.join(members.select("ticker").distinct(), "ticker", "left_semi").join(sector, "ticker")
            out = xs.strength(own, bars.join(F.broadcast(funds.select(F.col("fund").alias("ticker"))), "ticker", "left_semi"), bench_key="fund", rank_by=("ts", "sector"), membership=members)
        else:
            out = xs.strength(bars.join(F.broadcast(funds.select(F.col("fund").alias("ticker"))), "ticker", "left_semi"), bench)
        out = out.withColumn("comparison", F.lit(a.tier))
        store.upsert("relative_strength", out)
        return out
    if a.job == "membership":
        # snapshots (index_name, ticker, snapshot) at change dates, or intervals that come as such
        landed = spark.read.csv(a.landed, header=True)
        if "snapshot" in landed.columns:
            landed = presence_intervals(landed.select("index_name", "ticker", F.col("snapshot").cast("date").alias("snapshot")))
        store.replace("index_membership", landed.select(F.coalesce("index_name", F.lit(a.index)).alias("index_name"), "ticker", F.col("start_date").cast("date").alias("start_date"), F.col("end_date").cast("date").alias("end_date")), [a.index])
        return store.members(a.index)
    if a.job == "compare":
        daily = store.read("bars_1d")
        return differing(*(daily.filter(F.col("source") == s) for s in a.sources))
    if a.job == "market_cap":
        prices = store.bars(source=a.source, ordered=False).withColumn("ts", F.col("ts").cast("date"))
        return xs.market_caps(prices, store.read("shares_outstanding"), store.read("splits"))
    for timeframe in ("daily", "weekly") if a.timeframe == "both" else (a.timeframe,):
        bars, report = series_bars(store, a, timeframe)
        config = {"as_of": a.as_of, "source": a.source, "timeframe": timeframe}
        if a.job == "sr_lines":
            config |= asdict(replace(lv.LONG_WEEKLY if timeframe == "weekly" else lv.MEDIUM))
        run_id = store.record_run(a.job, ",".join(a.ticker or ["*"]), timeframe, config, a.as_of, *verdict(report))
        store.save_results(a.job, detect(a.job, bars, timeframe, store, a.as_of), run_id, timeframe)
    return store.read(a.job)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("job", choices=["resample", "breadth", "strength", "compare", "market_cap", "membership", *DETECTORS])
    p.add_argument("--store", required=True)
    p.add_argument("--ticker", nargs="*")
    p.add_argument("--timeframe", choices=["daily", "weekly", "both"], default="daily")
    p.add_argument("--as-of")
    p.add_argument("--source", default="yfinance")
    p.add_argument("--sources", nargs=2, default=["yfinance", "polygon"])
    p.add_argument("--index", default="sp500")
    p.add_argument("--weighting", choices=["equal", "cap"], default="equal")
    p.add_argument("--tier", choices=["stock_vs_market", "stock_vs_sector", "sector_vs_market"], default="stock_vs_market")
    p.add_argument("--benchmark", default="SPY")
    p.add_argument("--start")
    p.add_argument("--end")
    p.add_argument("--landed", help="CSV files a job reads: for membership (index_name, ticker, snapshot) or intervals")
    p.add_argument("--csv", help="folder to write the result to as CSV, columns of plain types only")
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName(f"tidemark-{a.job}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = run(spark, a)
    if out is not None and a.csv:
        plain = [f.name for f in out.schema if not f.dataType.simpleString().startswith(("array", "map", "struct"))]
        out.select(*plain).write.csv(a.csv, header=True)


if __name__ == "__main__":
    main()
