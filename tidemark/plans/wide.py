"""Queries over very many short series, one for each supplier: what scales with the number of tickers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as br
from tidemark.operators import levels as lv
from tidemark.operators import patterns as pt
from tidemark.plans import inputs as inp
from tidemark.plans.core import OHLC, query, rounded, zigzag_sql

HEAD = "WITH RECURSIVE " + inp.SUPPLIER_SQL
ATR_HEAD = HEAD + ", " + inp.ATR_SQL


@query("wide_weekly", HEAD + """ SELECT ticker, CAST(date_trunc('week', ts) AS DATE) AS ts, round(arg_min(open, ts), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(arg_max("close", ts), 6) AS "close", sum(volume) AS volume FROM walk GROUP BY 1, 2""")
def wide_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(br.resample(inp.supplier_bars(spark, sf_dir), "week").drop("is_partial"), *OHLC)


@query("wide_turns", ATR_HEAD + zigzag_sql(2.0) + " SELECT ticker, kind, ts, round(value, 6) AS value, confirmed_at FROM turns")
def wide_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(br.with_turns(inp.supplier_bars(spark, sf_dir), 2.0).select("ticker", "kind", "ts", "value", "confirmed_at"), "value")


@query("wide_skipped", HEAD + " SELECT ticker, count(*) AS bars FROM walk GROUP BY 1 HAVING count(*) < 450")
def wide_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return br.skipped(inp.supplier_bars(spark, sf_dir), 450).select("ticker", "bars")


@query("wide_lines")
def wide_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support and resistance of every supplier's series."""
    return lv.detect(inp.supplier_bars(spark, sf_dir), lv.MEDIUM).select("ticker", "rank", "kind", "state", "center", "strength")


@query("wide_pattern_counts")
def wide_pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.scan(inp.supplier_bars(spark, sf_dir)).groupBy("ticker", "pattern").agg(F.count(F.lit(1)).alias("n"))
