"""Operators on small frames with hand-worked results."""

import json
import math
import time
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import windows as wd
from tidemark.operators import bars as br
from tidemark.operators import cross_section as xs
from tidemark.operators import gaps as gp
from tidemark.operators import joins as jn
from tidemark.operators import portfolio as pf
from tidemark.operators import structures as st
from tidemark.sources import vendors
from tidemark.sources.config import load
from tidemark.sources.store import Store
from tidemark.streaming import bars as stream

D = date


def frame(spark, rows, ticker="T", start=D(2024, 1, 1)):
    """(open, high, low, close, volume) rows on consecutive weekdays."""
    days, d = [], start
    while len(days) < len(rows):
        if d.weekday() < 5:
            days.append(d)
        d += timedelta(1)
    return spark.createDataFrame([(ticker, t, *map(float, r)) for t, r in zip(days, rows, strict=True)], "ticker string, ts date, open double, high double, low double, close double, volume double")


def closes(spark, values, **kw):
    return frame(spark, [(c, c + 0.5, c - 0.5, c, 1000) for c in values], **kw)


def test_weekly_bars_and_closure(spark):
    b = frame(spark, [(100, 103, 99, 101, 10), (101, 105, 100, 102, 10), (102, 104, 98, 103, 10), (103, 106, 101, 104, 10), (104, 107, 100, 101, 10)])
    (w,) = br.resample(b, "week", as_of="2024-02-01").collect()
    assert (w["ts"], w["open"], w["high"], w["low"], w["close"], w["volume"], w["is_partial"]) == (D(2024, 1, 1), 100, 107, 98, 101, 50, False)
    assert br.resample(b, "week").first()["is_partial"]  # its own Friday does not close it
    assert br.resample(b.withColumn("is_partial", F.col("ts") == "2024-01-03"), "week", as_of="2024-02-01").first()["is_partial"]
    empty = br.resample(b.withColumn("volume", F.lit(None).cast("double")), "week", as_of="2024-02-01").first()
    assert empty["volume"] is None


def test_rank_and_obv(spark):
    for values, want in (([10, 20, 30, 40], [25, 50, 75, 100]), ([10, 10, 30], [50, 50, 100]), ([10, None, 30], [50, None, 100])):
        df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i int, v double").withColumn("g", F.lit(1))
        got = {r["i"]: r["p"] for r in df.select("i", wd.percentile_rank("v", "g").alias("p")).collect()}
        assert [got[i] if got[i] is None else round(got[i], 9) for i in range(len(values))] == want
    b = frame(spark, [(c, c, c, c, v) for c, v in zip((10, 11, 10.5, 10.5, 12), (100, 200, 150, 120, 300), strict=True)])
    w = wd.series()
    out = b.withColumn("s", wd.obv(w)).select("ts", F.sum("s").over(w).alias("obv")).orderBy("ts").collect()
    assert [r["obv"] for r in out] == [100, 300, 150, 150, 450]


def test_macro_as_of(spark):
    rows = [("CPI", D(2023, 12, 1), 10.0, D(2024, 1, 5), 10.0), ("CPI", D(2024, 1, 1), 20.0, D(2024, 2, 5), 20.0), ("CPI", D(2024, 2, 1), 9.0, None, None)]
    macro = spark.createDataFrame(rows, "series_id string, date date, value double, published_at date, first_published_value double")
    days = spark.createDataFrame([(D(2024, 1, 4),), (D(2024, 1, 5),), (D(2024, 1, 20),), (D(2024, 2, 4),), (D(2024, 2, 5),), (D(2024, 3, 1),)], "ts date")
    assert [r["macro_value"] for r in jn.published_as_of(days, macro).orderBy("ts").collect()] == [None, 10, 10, 10, 20, 20]


def test_market_cap_across_a_split(spark):
    prices = closes(spark, [200, 205, 210, 215, 220]).select("ticker", "ts", "close")
    days = [r["ts"] for r in prices.orderBy("ts").collect()]
    shares = spark.createDataFrame([("T", d, float(n)) for d, n in zip(days, (100, 100, 100, 400, 400), strict=True)], "ticker string, ts date, shares_outstanding double")
    splits = spark.createDataFrame([("T", days[3], 4.0)], "ticker string, execution_date date, ratio double")
    got = xs.market_caps(prices, shares, splits).orderBy("ts").collect()
    assert [r["market_cap"] for r in got] == [80000, 82000, 84000, 86000, 88000] and [r["split_ratio"] for r in got] == [4, 4, 4, 1, 1]


def test_filing_lag(spark):
    days = [D(2024, 1, d) for d in (2, 10, 11, 12, 15)]
    shares = spark.createDataFrame([("T", d, float(n)) for d, n in zip(days, (100, 101, 99, 100, 405), strict=True)], "ticker string, ts date, shares_outstanding double")
    splits = spark.createDataFrame([("T", D(2024, 1, 10), 4.0)], "ticker string, execution_date date, ratio double")
    assert [r["shares_outstanding"] for r in xs.bridged_shares(shares, splits).orderBy("ts").collect()] == [100, 400, 400, 400, 405]


def test_breadth_by_cap_and_membership(spark):
    prices = closes(spark, [10, 11, 12], ticker="AAA").union(closes(spark, [20, 18, 16], ticker="BBB")).union(closes(spark, [5, 5, 5], ticker="CCC")).select("ticker", "ts", "close")
    member = spark.createDataFrame([("I", t, D(2020, 1, 1), None) for t in ("AAA", "BBB", "CCC")], "index_name string, ticker string, start_date date, end_date date")
    out = xs.breadth(prices, member, sma_periods=(3,), ema_periods=()).orderBy("ts").collect()
    assert [r["pct_above_sma3"] for r in out] == [None, None, pytest.approx(1 / 3)] and [r["n_advancing"] for r in out] == [0, 1, 1]
    shares = spark.createDataFrame([("AAA", D(2023, 12, 1), 100.0), ("BBB", D(2023, 12, 1), 10000.0)], "ticker string, ts date, shares_outstanding double")
    splits = spark.createDataFrame([], "ticker string, execution_date date, ratio double")
    cap = xs.breadth(prices.filter("ticker <> 'CCC'"), member, sma_periods=(3,), ema_periods=(), weighting="cap", shares=shares, splits=splits).orderBy("ts").collect()
    assert cap[2]["pct_above_sma3"] == pytest.approx(1200 / 161200) and (cap[1]["n_advancing"], cap[1]["n_declining"]) == (1100, 180000)
    with pytest.raises(ValueError):
        xs.breadth(prices, member, weighting="price")


def test_presence_intervals(spark):
    snaps = {D(2015, 1, 1): ["AAPL"], D(2016, 1, 1): ["AAPL", "MSFT"], D(2020, 1, 1): ["AAPL", "MSFT"], D(2020, 6, 1): ["AAPL"]}
    rows = spark.createDataFrame([("N", t, d) for d, ts in snaps.items() for t in ts], "index_name string, ticker string, snapshot date")
    got = {(r["ticker"], r["start_date"], r["end_date"]) for r in jn.presence_intervals(rows).collect()}
    assert got == {("AAPL", D(2015, 1, 1), None), ("MSFT", D(2016, 1, 1), D(2020, 5, 31))}


def with_atr(b, value=1.0):
    return br.indexed(b).withColumn("atr", F.lit(value))


def test_gap_life(spark):
    flat = [(100, 101, 99, 100, 1000)] * 55
    b = with_atr(frame(spark, [*flat, (112, 113, 110, 112, 1000)]))
    (g,) = gp.detect(b).filter("kind = 'classic'").collect()
    assert (g["direction"], g["zone_bottom"], g["zone_top"]) == ("bullish", 101, 110)
    life = gp.lifecycle(gp.detect(b), b).filter("kind = 'classic'").first()
    assert life["status"] == "open" and life["max_fill_pct"] == 0
    lows = [95, 91, 89, 80]
    later = with_atr(frame(spark, [*[(88, 90, 86, 88, 1000)] * 55, (104, 106, 100, 104, 1000), *[(104, 105, x, 104, 1000) for x in lows]]))
    series = gp.fills(gp.detect(later).filter("kind = 'classic'"), later).orderBy("idx").collect()
    assert [r["pct"] for r in series] == [50, 90, 100]
    done = gp.lifecycle(gp.detect(later).filter("kind = 'classic'"), later).first()
    assert (done["status"], done["bars_to_first_touch"], done["bars_to_soft_closed"], done["bars_to_closed"], done["n_approaches"]) == ("closed", 1, 2, 3, 1)


def test_gaps_look_at_nothing_later(spark):
    rng = np.random.default_rng(5)
    x = 100 + np.cumsum(rng.normal(0, 2, 160))
    b = frame(spark, [(c, c + 0.4, c - 0.4, c, 1000) for c in x])
    cut = b.orderBy("ts").collect()[119]["ts"]
    key = lambda df: {tuple(r) for r in df.filter(F.col("created_at") <= cut).select("created_at", "kind", "direction").collect()}
    whole, part = (br.with_atr(br.indexed(d)) for d in (b, b.filter(F.col("ts") <= cut)))
    assert key(gp.detect(whole)) == key(gp.detect(part))


def test_anchored_price(spark):
    b = frame(spark, [(10, 11, 9, 10, 100), (12, 13, 11, 12, 200), (12, 13, 11, 12, 50)])
    at = spark.createDataFrame([("T", D(2024, 1, 1))], "ticker string, anchor_date date")
    assert [r["avwap"] for r in st.anchored(b, at).orderBy("ts").collect()] == pytest.approx([10, 3400 / 300, 4000 / 350])


def test_fib_levels(spark):
    swing = spark.createDataFrame([("T", 2.0, "up", D(2024, 1, 1), 100.0, 0, D(2024, 1, 10), 200.0, 7, 20.0, 7, D(2024, 1, 12), 5)], st.SWING)
    got = {(x["kind"], x["ratio"]): x["price"] for x in st.fib_sets(swing, closes(spark, [150.0] * 9)).first()["levels"]}
    assert got["retracement", 0.5] == 150 and got["retracement", 0.618] == pytest.approx(138.2) and got["extension", 1.618] == pytest.approx(261.8) and got["extension", 2.0] == 300


def test_anchor_cap_spares_extremes(spark):
    b = br.indexed(closes(spark, [100 + i for i in range(20)]))
    turns = spark.createDataFrame([("T", "high", D(2024, 1, 3)), ("T", "low", D(2024, 1, 5))], "ticker string, kind string, ts date")
    old = spark.createDataFrame([("T", D(2023, 1, 2), ["cycle_low"])], "ticker string, anchor_date date, roles array<string>")
    got = {r["anchor_date"]: (r["roles"], r["status"]) for r in st.anchors(b, turns, old, most=3).collect()}
    assert got[D(2023, 1, 2)][1] == "stale" and got[D(2024, 1, 3)][1] == "stale" and got[D(2024, 1, 5)][1] == "active"
    assert got[D(2024, 1, 1)] == (["52w_low", "atl"], "active")


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    bars = lambda rows: spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, source string, open double, high double, low double, close double, volume double")
    day = datetime(2024, 1, 2)
    assert s.upsert("bars_1d", bars([("A", day, "p", 1.0, 2.0, 1.0, 1.5, 5.0), ("B", day, "y", 1.0, 2.0, 1.0, 1.9, 5.0), ("C", day, "y", 0.0, 2.0, 1.0, 1.5, 5.0)])) == 2
    s.upsert("bars_1d", bars([("A", day, "p", 1.0, 2.0, 1.0, 1.7, None)]))
    s.upsert("bars_1d", bars([("B", day, "y", 1.0, 2.0, 1.0, 1.2, 5.0), ("D", day, "y", 1.0, 2.0, 1.0, 1.1, 5.0)]))
    assert {(r["ticker"], r["close"]) for r in s.read("bars_1d").collect()} == {("A", 1.7), ("B", 1.2), ("D", 1.1)}
    assert s.bars(ticker="A", source="p", start="2024-01-02", end="2024-01-02").columns[0] == "ts" and s.bars(ticker=["B", "D"]).count() == 2
    with pytest.raises(ValueError):
        s.read("nothing")
    run = s.record_run("gaps", "A", "daily", {"fill_by": "wick"})
    gap = [("A", "classic", "bullish", D(2024, 1, 2), 1.0, 2.0, "open")]
    make = lambda rows: spark.createDataFrame(rows, "ticker string, kind string, direction string, created_at date, zone_bottom double, zone_top double, status string")
    s.save_results("gaps", make(gap), run, "daily")
    first = s.read("gaps").first()
    s.save_results("gaps", make([(*gap[0][:5], 9.0, "closed")]), run, "daily")
    (again,) = s.read("gaps").collect()
    assert again["id"] == first["id"] and again["zone_top"] == 2.0 and again["status"] == "closed"
    assert s.with_config(s.read("gaps")).first()["fill_by"] == "wick"
    jobs = lambda rows: spark.createDataFrame(rows, "job_type string, key string, status string, last_error string")
    s.record_jobs(jobs([("d", "a", "failed", "x"), ("d", "b", "success", None)]))
    s.record_jobs(jobs([("d", "a", "failed", "y")]))
    keys = spark.createDataFrame([("c", 0), ("b", 1), ("a", 2)], "key string, pos int")
    assert [r["key"] for r in s.pending("d", keys).collect()] == ["c", "a"]
    assert {(r["key"], r["attempts"]) for r in s.read("fetch_jobs").collect()} == {("a", 2), ("b", 1)}


def test_vendors(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"ticker": "A", "results": [{"t": 1704153600000, "o": 1, "h": 2, "l": 1, "c": 1.5, "v": 3}]}))
    (tmp_path / "b.json").write_text(json.dumps({"results": None}))
    (tmp_path / "day.json").write_text(json.dumps({"results": [{"T": "B", "t": 1704153600500, "c": 2.5}]}))
    got = sorted((r["ticker"], r["ts"], r["close"], r["open"]) for r in vendors.landed_bars(spark, f"file://{tmp_path}/*.json").collect())
    assert got == [("A", datetime(2024, 1, 2), 1.5, 1.0), ("B", datetime(2024, 1, 2, 0, 0, 0, 500_000), 2.5, None)]
    values = vendors.observations(spark.createDataFrame([("CPI", "2024-01-01", "3.5"), ("CPI", "2024-02-01", "."), ("DGS10", "2024-01-01", "4")], "series_id string, date string, value string"))
    first = spark.createDataFrame([("CPI", D(2024, 1, 1), D(2024, 2, 13), 3.4)], "series_id string, date date, published_at date, first_published_value double")
    got = {r["series_id"]: (r["published_at"], r["first_published_value"]) for r in vendors.with_publication(values, first).collect()}
    assert got == {"CPI": (D(2024, 2, 13), 3.4), "DGS10": (D(2024, 1, 1), 4.0)}
    pages = spark.createDataFrame([("A", "old", "CS", False, "2020-01-01"), ("A", "new", "CS", True, None), ("B", "b1", "CS", False, "2019-01-01"), ("B", "b2", "CS", False, "2021-01-01"), (None, "x", "CS", True, None)], "ticker string, name string, type string, active boolean, delisted_utc string")
    assert {(r["ticker"], r["name"], r["active"]) for r in vendors.tickers(pages).collect()} == {("A", "new", True), ("B", "b2", False)}
    body = json.dumps({"results": {"ticker": "A", "market_cap": 5.0, "total_employees": 7}})
    (m,) = vendors.metadata(spark.createDataFrame([(body,), ("{}",)], "body string")).collect()
    assert (m["ticker"], m["market_cap"], m["total_employees"], m["sic_code"]) == ("A", 5.0, 7, None)
    assert [tuple(r) for r in vendors.sectors(spark.createDataFrame([("A", " Tech ", ""), ("B", "", None)], "ticker string, sector string, industry string")).collect()] == [("A", "Tech", None)]
    assert vendors.source_age(spark, f"file://{tmp_path}/a.json") == 0 and vendors.source_age(spark, f"file://{tmp_path}/a.json", time.time() + 95 * 86_400) == 95
    naps, now = [], [0.0]
    limit = vendors.RateLimiter(2, 60, lambda: now[0], naps.append)
    for _ in range(3):
        limit.wait()
    assert naps == [60.0]
    assert vendors.attempt(lambda: 1 / 0)[1] == "division by zero" and vendors.stale_source(91) and not vendors.stale_source(90)
    (tmp_path / "c.yaml").write_text("data_paths:\n  raw: a\n  processed: b\n  derived: c # x\n  external: d\n  charts: e\n")
    assert load(str(tmp_path / "c.yaml")).derived == "c"
    with pytest.raises(FileNotFoundError):
        load(str(tmp_path / "none.yaml"))


def test_portfolio(spark):
    stats = pd.DataFrame({"ticker": list("abc"), "cumulative": [1.0, 3.0, 2.0]})
    corr = pd.DataFrame({"a": ["a", "a", "b"], "b": ["b", "c", "c"], "corr": [0.9, 0.1, 0.2]})
    assert pf.select(stats, corr, 2) == ["b", "c"] and pf.select(stats, corr, 3, "min") == ["a", "c", "b"]
    rng = np.random.default_rng(0)
    gross = 1 + np.stack([rng.normal(0.001, 0.01, 300), rng.normal(-0.001, 0.02, 300)], axis=1)
    w = pf.evolve(gross)
    assert w.sum() == pytest.approx(1) and w[0] > 0.7 and (w == pf.evolve(gross)).all()
    now = spark.createDataFrame([("A",), ("B",)], "ticker string")
    log = spark.createDataFrame([("B", "added", D(2024, 5, 1)), ("C", "removed", D(2024, 5, 1)), ("D", "removed", D(2023, 1, 1))], "ticker string, action string, date date")
    assert {r["ticker"] for r in pf.constituents_on(now, log, "2024-01-01").collect()} == {"A", "C"}


def test_streams(spark, tmp_path):
    ticks = [("A", datetime(2024, 1, 1, h), float(p), 1.0) for h, p in ((9, 10), (10, 12), (11, 8))] + [("A", datetime(2024, 1, 2, 9), 20.0, 1.0), ("A", datetime(2024, 1, 4, 9), 21.0, 1.0)]
    spark.createDataFrame(ticks, "ticker string, ts timestamp, price double, volume double").write.parquet(f"{tmp_path}/ticks")
    live = spark.readStream.schema("ticker string, ts timestamp, price double, volume double").parquet(f"{tmp_path}/ticks")
    q = stream.tumbling_bars(live).writeStream.outputMode("append").format("memory").queryName("tumbled").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    first = spark.sql("SELECT * FROM tumbled ORDER BY ts").first()
    assert (first["open"], first["high"], first["low"], first["close"], first["volume"]) == (10, 12, 8, 8, 3)
    path = [100, 110, 120, 112, 105, 100, 111, 125]
    rows = [("A", datetime(2024, 1, 1 + i), p + 0.5, p - 0.5) for i, p in enumerate(path)]
    spark.createDataFrame(rows, "ticker string, ts timestamp, high double, low double").write.parquet(f"{tmp_path}/bars")
    moving = spark.readStream.schema("ticker string, ts timestamp, high double, low double").parquet(f"{tmp_path}/bars")
    q = stream.zigzag(moving).writeStream.outputMode("append").format("memory").queryName("turned").option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT kind, value FROM turned ORDER BY confirmed_at").collect()
    assert [tuple(r) for r in got] == [("low", 99.5), ("high", 120.5), ("low", 99.5)]


def test_walk_prices_keep_their_digits_over_long_series(spark, tmp_path):
    """A running sum that has been large and is small again has lost nothing."""
    from tidemark.plans import inputs as inp

    discounts = [5000.05] + [0.0513] * 4000 + [-4999.95 + 100.0 - 0.52]
    rows = [(i, 1, 1, 1, 1.0, 1.0, d, "A", "F", pd.Timestamp("1996-01-01") + pd.Timedelta(days=i)) for i, d in enumerate(discounts)]
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"]
    pd.DataFrame(rows, columns=names).to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us")
    last = inp.walk_bars(spark, str(tmp_path)).orderBy(F.col("ts").desc()).first()
    want = 100 * math.exp(math.fsum((d - 0.05) * 0.1 for d in discounts))
    assert 1e6 < want < 1e8 and abs(last["close"] - want) < 2e-6


def test_returns_from_a_price_of_zero_are_not_dropped(spark):
    """Floating-point division, as the SQL divides: infinite, or NaN for 0 / 0."""
    from tidemark.functions import scalar

    rows = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (6.0, 3.0), (None, 0.0)], "a double, b double")
    got = [r[0] for r in rows.select(scalar.quotient(F.col("a"), F.col("b"))).collect()]
    assert got[0] == math.inf and math.isnan(got[1]) and got[2:] == [2.0, None]
    n = 80
    b = spark.createDataFrame([("A", i, D(2020, 1, 1) + timedelta(days=i), 0.0 if i == 2 else 1.0) for i in range(n)], "ticker string, idx int, ts date, close double")
    life = spark.createDataFrame([("A", "fvg", "bearish", 2, "open")], "ticker string, kind string, direction string, created_idx int, status string")
    walked = spark.createDataFrame([("A", "fvg", "bearish", 2, 3, 10.0, 10.0)], "ticker string, kind string, direction string, created_idx int, idx int, pct double, max_pct double")
    assert gp.study(life, walked, b).first()["return_5_from_created"] == -math.inf


def test_logarithms_of_prices_of_zero(spark):
    from tidemark.functions import scalar

    rows = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "a double, b double")
    got = [tuple(r) for r in rows.select(scalar.ln(F.col("a")), scalar.interpolated(F.col("a"), F.col("b"), F.lit(0.5), True)).collect()]
    assert got[0][0] == -math.inf and math.isnan(got[0][1]) and got[1] == (0.0, 1.0)
