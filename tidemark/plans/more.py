"""Queries over membership, ledgers, portfolios and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import bars as br
from tidemark.operators import joins as jn
from tidemark.operators import portfolio as pf
from tidemark.plans import inputs as inp
from tidemark.plans.core import BRANDS, query, rounded
from tidemark.streaming import bars as streams


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten most traded brands of each month, as a snapshot on its first day."""
    b = inp.brand(spark, sf_dir).groupBy(F.trunc("ts", "MM").alias("snapshot"), "ticker").agg(F.sum("volume").alias("v"))
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("snapshot").orderBy(F.col("v").desc(), "ticker"))
    return b.withColumn("n", n).filter("n <= 10").select(F.lit("TOP").alias("index_name"), "ticker", "snapshot")


@query("presence_intervals", BRANDS + """, v AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS snapshot, ticker, sum(volume) AS v FROM brand GROUP BY 1, 2), s AS (SELECT ticker, snapshot FROM (SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY v DESC, ticker) AS n FROM v) WHERE n <= 10),
 d AS (SELECT snapshot, row_number() OVER (ORDER BY snapshot) AS k, lead(snapshot) OVER (ORDER BY snapshot) AS nxt FROM (SELECT DISTINCT snapshot FROM s)), r AS (SELECT s.ticker, s.snapshot, nxt, k - row_number() OVER (PARTITION BY ticker ORDER BY k) AS g FROM s JOIN d USING (snapshot))
 SELECT 'TOP' AS index_name, ticker, min(snapshot) AS start_date, CAST(CASE WHEN bool_or(nxt IS NULL) THEN NULL ELSE max(nxt) - 1 END AS DATE) AS end_date FROM r GROUP BY ticker, g""")
def presence_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.presence_intervals(_monthly(spark, sf_dir))


@query("last_weekday", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS day, CAST(CAST(l_shipdate AS DATE) - CAST(greatest(0, isodow(l_shipdate) - 5) AS INTEGER) AS DATE) AS weekday FROM lineitem")
def last_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    return inp.table(spark, sf_dir, "lineitem").select(day.alias("day"), scalar.last_weekday(day).alias("weekday")).distinct()


RETURNS_SQL = BRANDS + ", f AS (SELECT ticker FROM brand GROUP BY 1), ret AS (SELECT ticker, ts, coalesce(\"close\" / lag(\"close\") OVER (PARTITION BY ticker ORDER BY ts), 1.0) AS gross FROM brand)"


@query("portfolio_performance", RETURNS_SQL + " SELECT ticker, round(product(gross), 6) AS cumulative, round(avg(gross), 9) AS mean, round(stddev_samp(gross), 9) AS deviation, round((avg(gross) - 1) / stddev_samp(gross) * sqrt(252), 6) AS sharpe FROM ret GROUP BY 1")
def portfolio_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pf.performance(pf.gross_returns(inp.brand(spark, sf_dir)))
    return rounded(rounded(out, "cumulative", "sharpe"), "mean", "deviation", digits=9)


@query("correlation_matrix", RETURNS_SQL + " SELECT a.ticker AS a, b.ticker AS b, round(abs(corr(a.gross, b.gross)), 6) AS corr FROM ret a JOIN ret b ON a.ts = b.ts AND a.ticker < b.ticker GROUP BY 1, 2")
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pf.correlation(pf.gross_returns(inp.brand(spark, sf_dir))), "corr")


def _selection_sql(size: int) -> str:
    """Tickers by number in the order of their names; each step takes the free one whose largest correlation with those chosen is least."""
    return RETURNS_SQL + f""", perf AS (SELECT ticker, product(gross) AS cumulative FROM ret GROUP BY 1), nm AS (SELECT ticker, cumulative, CAST(row_number() OVER (ORDER BY ticker) AS INTEGER) AS i FROM perf),
 co AS (SELECT a.ticker AS a, b.ticker AS b, coalesce(abs(corr(a.gross, b.gross)), 0) AS c FROM ret a JOIN ret b ON a.ts = b.ts AND a.ticker <> b.ticker GROUP BY 1, 2),
 line AS (SELECT n.i, n.ticker, n.cumulative, list(CASE WHEN m.i = n.i THEN 0 ELSE coalesce(c, 0) END ORDER BY m.i) AS cs FROM nm n CROSS JOIN nm m LEFT JOIN co ON co.a = n.ticker AND co.b = m.ticker GROUP BY 1, 2, 3),
 pick AS (SELECT 1 AS pos, [i] AS chosen, cs AS worst FROM (SELECT * FROM line ORDER BY cumulative DESC, ticker DESC LIMIT 1)
 UNION ALL SELECT pos + 1, list_append(chosen, l.i), list_transform(list_zip(worst, l.cs), lambda z: greatest(z[1], z[2])) FROM
  (SELECT *, list_position(free, list_min(free)) AS nxt FROM (SELECT *, list_transform(worst, lambda x, i: CASE WHEN list_contains(chosen, i) THEN NULL ELSE x END) AS free FROM pick WHERE pos < {size})) q JOIN line l ON l.i = q.nxt)
 SELECT pos, l.ticker FROM pick JOIN line l ON l.i = chosen[-1]"""


@query("portfolio_selection", _selection_sql(8))
def portfolio_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = pf.gross_returns(inp.brand(spark, sf_dir))
    chosen = pf.select(pf.performance(returns).toPandas(), pf.correlation(returns).toPandas(), 8)
    return spark.createDataFrame(list(enumerate(chosen, 1)), "pos int, ticker string")


@query("portfolio_walk_forward")
def portfolio_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.walk_forward(pf.gross_returns(inp.brand(spark, sf_dir)), YEARS)


YEARS = list(range(1997, 2001))


@query("portfolio_grid")
def portfolio_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk-forward study over all sizes and pivots, among the index's members as of each year's start."""
    grid = tuple((size, pivot) for size in pf.SIZES for pivot in pf.PIVOTS)
    return pf.walk_forward(pf.gross_returns(inp.brand(spark, sf_dir)), YEARS, configurations=grid, membership=inp.membership(spark))


@query("portfolio_uniform", RETURNS_SQL + f""", y AS (SELECT unnest({YEARS}) AS year), p AS (SELECT DISTINCT y.year, r.ticker FROM ret r JOIN y ON year(r.ts) <= y.year), d AS (SELECT DISTINCT y.year, r.ts FROM ret r JOIN y ON year(r.ts) = y.year),
 u AS (SELECT d.year, d.ts, avg(coalesce(r.gross, 1.0)) AS g FROM d JOIN p USING (year) LEFT JOIN ret r ON r.ticker = p.ticker AND r.ts = d.ts GROUP BY 1, 2)
 SELECT CAST(year AS INTEGER) AS year, o.objective, round(log10(product(g)), 6) AS uniform_log_cumulative, round((avg(g) - 1) / (stddev_samp(g) + 1e-9) * sqrt(252), 6) AS uniform_sharpe FROM u CROSS JOIN (VALUES ('sharpe'), ('return')) AS o(objective) GROUP BY 1, 2""")
def portfolio_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk-forward study's yardstick: equal weights in each test year."""
    out = pf.walk_forward(pf.gross_returns(inp.brand(spark, sf_dir)), YEARS)
    return rounded(out.select("year", "objective", F.log10("uniform_cumulative").alias("uniform_log_cumulative"), "uniform_sharpe"), "uniform_log_cumulative", "uniform_sharpe")


@query("portfolio_single_period", BRANDS + """, m AS (SELECT ticker, CAST(date_trunc('month', ts) AS DATE) AS ts, arg_max("close", ts) AS c FROM brand WHERE ts BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 1, 2),
 full_ AS (SELECT ticker FROM m GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT ts) FROM m)), g AS (SELECT ticker, ts, coalesce(c / lag(c) OVER (PARTITION BY ticker ORDER BY ts), 1.0) AS gross FROM m WHERE ticker IN (SELECT ticker FROM full_))
 SELECT ticker, round(product(gross), 6) AS cumulative, round(avg(gross), 9) AS mean, round(stddev_samp(gross), 9) AS deviation, round((avg(gross) - 1) / stddev_samp(gross) * sqrt(252), 6) AS sharpe FROM g GROUP BY 1""")
def portfolio_single_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One period's statistics of the tickers that have a close in all of it."""
    b = inp.brand(spark, sf_dir).filter(F.col("ts").between(F.lit("1996-01-01").cast("date"), F.lit("1999-12-31").cast("date")))
    out = pf.performance(pf.gross_returns(pf.complete(br.resample(b, "month").select("ticker", "ts", "close"))))
    return rounded(rounded(out, "cumulative", "sharpe"), "mean", "deviation", digits=9)


@query("tumbling_bars", "SELECT event_type AS ticker, CAST(date_trunc('day', ts) AS DATE) AS ts, round(max(value), 6) AS high, round(min(value), 6) AS low, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's bars over a table as one batch."""
    e = inp.table(spark, sf_dir, "events")
    out = streams.tumbling_bars(e.select(F.col("event_type").alias("ticker"), "ts", F.col("value").alias("price"), F.lit(1).alias("volume")))
    return rounded(out.select("ticker", F.col("ts").cast("date").alias("ts"), "high", "low", F.col("volume").alias("n")), "high", "low")


@query("sessions", """WITH s AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
 SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, k""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's sessions over a table as one batch."""
    return rounded(streams.sessions(inp.table(spark, sf_dir, "events")).select("user_id", "n", "total"), "total", digits=4)
