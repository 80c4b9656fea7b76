"""Every query with SQL beside it gives the same rows in both engines."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars as br
from tidemark.operators import levels as lv
from tidemark.operators import patterns as pt
from tidemark.operators import portfolio as pf
from tidemark.plans import core, more, stores, structures, wide  # noqa: F401
from tidemark.plans import inputs as inp

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v.date()) if callable(getattr(v, "date", None)) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = core.QUERIES[name](spark, SF).toPandas(), duck.execute(core.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


WITHOUT_SQL = {"gap_corr_p", "portfolio_walk_forward", "portfolio_grid", "sr_lines", "sr_lines_diagonal", "sr_lines_weekly", "sr_events", "patterns", "pattern_counts", "wide_lines", "wide_pattern_counts"}


def test_what_has_no_sql_is_checked_below():
    assert set(core.QUERIES) - set(core.ORACLES) == WITHOUT_SQL


def t_tail(t: float, df: int) -> float:
    """Two-sided tail of Student's t by integrating its density over [0, |t|] with Simpson's rule."""
    x = np.linspace(0, abs(t), 20_001)
    log_density = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * np.log1p(x * x / df)
    y = np.exp(log_density)
    return 1 - 2 * (x[1] / 3) * float(y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())


def test_gap_corr_p(spark):
    got = core.QUERIES["gap_corr_p"](spark, SF).toPandas()
    assert {(r.signal, r.target) for r in got.itertuples()} == {(s, t) for s in structures.SIGNALS for t in structures.RETURNS}
    study = core.QUERIES["gap_fill_signals"](spark, SF).toPandas()
    for r in got.itertuples():
        both = study[[r.signal, r.target]].astype(float).dropna()
        assert r.n == len(both) and abs(r.pearson_r - both[r.signal].corr(both[r.target])) < 1e-4
        for c, p in ((r.pearson_r, r.pearson_p), (r.spearman_rho, r.spearman_p)):
            assert abs(p - t_tail(c * math.sqrt((r.n - 2) / (1 - c * c)), r.n - 2)) < 1e-6


def test_portfolio_walk_forward(spark):
    got = core.QUERIES["portfolio_walk_forward"](spark, SF).toPandas()
    returns = pf.gross_returns(inp.brand(spark, SF)).toPandas()
    assert len(got) == 8 and set(got["year"]) == set(more.YEARS)
    for r in got.itertuples():
        assert abs(sum(r.weights) - 1) < 1e-9 and min(r.weights) >= 0
        year = pd.to_datetime(returns["ts"]).dt.year
        wide = returns[year <= r.year].pivot(index="ts", columns="ticker", values="gross").sort_index().fillna(1.0)[list(r.tickers)]
        test = wide[pd.to_datetime(wide.index).year == r.year].to_numpy() @ np.array(r.weights)
        assert abs(test.prod() / r.cumulative - 1) < 1e-9 and abs((test.mean() - 1) / (test.std(ddof=1) + 1e-9) * math.sqrt(252) - r.sharpe) < 1e-6


def test_portfolio_grid(spark):
    """Members as of the year's start alone, chosen one by one on the days up to it."""
    got = core.QUERIES["portfolio_grid"](spark, SF).toPandas()
    assert len(got) == len(more.YEARS) * len(pf.SIZES) * len(pf.PIVOTS) * 2
    returns, members = pf.gross_returns(inp.brand(spark, SF)).toPandas(), inp.membership(spark).toPandas()
    returns["ts"] = pd.to_datetime(returns["ts"])
    for (year, size, pivot), own in got.groupby(["year", "size", "pivot"]):
        day = pd.Timestamp(f"{year}-01-01")
        start, end = pd.to_datetime(members["start_date"]), pd.to_datetime(members["end_date"])
        there = set(members.loc[(start <= day) & (end.isna() | (end >= day)), "ticker"])
        wide = returns[returns["ticker"].isin(there) & (returns["ts"].dt.year <= year)].pivot(index="ts", columns="ticker", values="gross").sort_index().fillna(1.0)
        past = wide[wide.index <= day]
        order = past.prod().sort_index().sort_values(kind="stable").index.tolist()
        chosen, corr = [{"max": order[-1], "min": order[0], "median": order[len(order) // 2]}[pivot]], past.corr().abs().fillna(0.0)
        while len(chosen) < min(size, len(order)):
            chosen.append(min(sorted(set(order) - set(chosen)), key=lambda t: (corr.loc[t, chosen].max(), t)))
        assert all(sorted(chosen) == list(t) for t in own["tickers"])
        assert all(abs(sum(w) - 1) < 1e-9 and min(w) >= 0 for w in own["weights"])


@pytest.mark.parametrize("name", ["sr_lines", "sr_lines_diagonal", "sr_lines_weekly"])
def test_lines_hold_what_their_events_say(spark, name):
    """Each line's rank, counts and state, worked out again from its events (which it may have from lines it absorbed)."""
    frame = inp.walk_bars(spark, SF)
    if name == "sr_lines_weekly":
        frame = br.load(frame, weekly=True)
    bars = {t: g.sort_values("ts").reset_index(drop=True) for t, g in frame.toPandas().groupby("ticker")}
    got = core.QUERIES[name](spark, SF).toPandas()
    assert len(got) and not got.duplicated(["ticker", "rank"]).any()
    met = 0
    for ticker, own in got.groupby("ticker"):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, len(own) + 1)) and (own["strength"].diff().dropna() <= 1e-12).all()
        days = set(bars[ticker]["ts"])
        for r in own.itertuples():
            kinds = [e["kind"] for e in r.events]
            assert (kinds.count("touch"), kinds.count("body_touch"), kinds.count("wick_fake"), kinds.count("break")) == (r.touches, r.body_touches, r.wick_fakes, r.breaks)
            state, broke = "active", False
            for e in sorted(r.events, key=lambda e: (e["start"], e["end"])):
                if e["kind"] == "break":
                    state, broke = ("broken" if state == "active" else state), True
                elif broke and (e["kind"] in ("touch", "body_touch", "wick_fake") or (e["kind"] == "body_fake" and not e["pending"])):
                    state = "flipped"
            assert r.state == state
            assert all(e["start"] in days and e["start"] <= e["end"] and e["penetration_atr"] >= 0 and e["reaction_atr"] >= 0 for e in r.events)
            assert r.first_touch <= r.regime_start <= max(days) and r.idle_days == (max(days) - r.last_event).days and r.age_days == (max(days) - r.first_touch).days
            met += len(kinds)
    assert met > 50


def test_a_series_result_does_not_depend_on_the_others(spark):
    """Lines and patterns of one supplier alone are those it has among all."""
    bars = inp.supplier_bars(spark, SF)
    lines, counts = (core.QUERIES[n](spark, SF).toPandas() for n in ("wide_lines", "wide_pattern_counts"))
    ticker = lines["ticker"].min()
    alone = bars.filter(F.col("ticker") == ticker)
    own = lv.detect(alone, lv.MEDIUM).toPandas()
    assert own.sort_values("rank")["strength"].tolist() == lines[lines["ticker"] == ticker].sort_values("rank")["strength"].tolist()
    found = pt.scan(alone).toPandas().groupby("pattern").size().to_dict()
    assert found == {r.pattern: r.n for r in counts[counts["ticker"] == ticker].itertuples()}


def test_events_and_counts_follow_their_sources(spark):
    lines, events = (core.QUERIES[n](spark, SF).toPandas() for n in ("sr_lines", "sr_events"))
    assert sorted((t, r, e["kind"], e["start"]) for t, r, es in zip(lines["ticker"], lines["rank"], lines["events"], strict=True) for e in es) == sorted(zip(events["ticker"], events["rank"], events["kind"], events["start"], strict=True))
    found, counts = (core.QUERIES[n](spark, SF).toPandas() for n in ("patterns", "pattern_counts"))
    assert found.groupby(["pattern", "status"]).size().to_dict() == {(r.pattern, r.status): r.n for r in counts.itertuples()}


def test_patterns_break_out_where_they_say(spark):
    bars = {t: g.sort_values("ts").reset_index(drop=True) for t, g in inp.walk_bars(spark, SF).toPandas().groupby("ticker")}
    got = core.QUERIES["patterns"](spark, SF).toPandas()
    assert len(got) and got["confidence"].between(0, 1).all() and (got["formation_start"] < got["formation_end"]).all()
    for r in got.itertuples():
        b = bars[r.ticker]
        assert b["ts"][r.start_idx] == r.formation_start and b["ts"][r.end_idx] == r.formation_end
        assert [t["idx"] for t in r.turns] == sorted(t["idx"] for t in r.turns)
        for t in r.turns:
            assert abs(b["high" if t["kind"] == "high" else "low"][t["idx"]] - t["value"]) < 1e-9 or abs(b["close"][t["idx"]] - t["value"]) < 1e-9
        if not pd.isna(r.breakout_idx):
            assert r.breakout_idx > r.end_idx and b["ts"][int(r.breakout_idx)] == r.breakout_date
        if r.status in ("confirmed", "target", "target_hit") and r.entry == r.entry:
            assert (r.target > r.stop) == (r.direction == "bullish")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
