"""Bar frames and small dimension tables over the test tables, in Spark and as SQL text.

``walk`` bars: a random walk for each return flag and line status.  ``brand`` bars: one series for each part
brand, with sector funds and a market over the same lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.windows import running_sum
from tidemark.operators.bars import from_ticks, indexed

TIES = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def walk_bars(spark: SparkSession, sf_dir: str, ticker: Column | None = None) -> DataFrame:
    """A random walk for each ``ticker``: by default for each return flag and line status, few long series."""
    lines = table(spark, sf_dir, "lineitem").withColumn("ticker", F.concat("l_returnflag", "l_linestatus") if ticker is None else ticker)
    w = Window.partitionBy("ticker").orderBy("l_shipdate", *TIES).rowsBetween(Window.unboundedPreceding, 0)
    ticks = lines.select("ticker", F.col("l_shipdate").alias("ts"), *TIES, F.col("l_quantity").alias("volume"), F.round(100 * F.exp(running_sum((F.col("l_discount") - 0.05) * 0.1, w)), 6).alias("price"))
    return from_ticks(ticks, *TIES)


def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(walk_bars(spark, sf_dir))


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk for each supplier: as many series as the data have, so work spreads as they grow."""
    return walk_bars(spark, sf_dir, F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))


def walk_sql(ticker: str = "l_returnflag || l_linestatus") -> str:
    order = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount"
    return f"""ticks AS (
  SELECT {ticker} AS ticker, CAST(l_shipdate AS DATE) AS ts, l_quantity AS volume,
    round(100 * exp(sum((l_discount - 0.05) * 0.1) OVER (PARTITION BY {ticker} ORDER BY {order} ROWS UNBOUNDED PRECEDING)), 6) AS price,
    row_number() OVER (PARTITION BY {ticker} ORDER BY {order}) AS n
  FROM lineitem
), walk AS (
  SELECT ticker, ts, min_by(price, n) AS open, max(price) AS high, min(price) AS low, max_by(price, n) AS "close", sum(volume) AS volume,
    row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS idx
  FROM ticks GROUP BY ticker, ts
)"""


WALK_SQL = walk_sql()
SUPPLIER_SQL = walk_sql("'S' || l_suppkey")


def atr_sql(source: str = "walk", out: str = "bars", first: int = 0) -> str:
    """``out``: the bars of ``source`` from number ``first`` on, with an ATR that starts there."""
    own = f"tr{first or ''}", f"atrs{first or ''}"
    return f"""{own[0]} AS (
  SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM (SELECT *, lag("close") OVER (PARTITION BY ticker ORDER BY ts) AS pc FROM {source} WHERE idx >= {first})
), {own[1]} AS (
  SELECT ticker, {first + 14} AS idx, avg(tr) AS atr FROM {own[0]} WHERE idx BETWEEN {first + 1} AND {first + 14} GROUP BY ticker HAVING count(*) = 14
  UNION ALL SELECT t.ticker, t.idx, a.atr + (t.tr - a.atr) / 14 FROM {own[1]} a JOIN {own[0]} t ON t.ticker = a.ticker AND t.idx = a.idx + 1
), {out} AS (SELECT w.*, a.atr FROM {source} w LEFT JOIN {own[1]} a USING (ticker, idx) WHERE idx >= {first})"""


ATR_SQL = atr_sql()


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 0").join(part, "l_partkey")
    sector = F.concat(F.lit("S"), F.regexp_extract("brand", r"(\d+)$", 1).cast("int") % 5)
    return lines.select("brand", sector.alias("sector"), F.col("l_shipdate").alias("ts"), *TIES, F.col("l_quantity").alias("volume"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


def brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of brands, with their sector."""
    lines = _lines(spark, sf_dir)
    bars = from_ticks(lines.withColumn("ticker", F.col("brand")), *TIES)
    return bars.withColumn("sector", F.concat(F.lit("S"), F.regexp_extract("ticker", r"(\d+)$", 1).cast("int") % 5))


def sector_funds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_ticks(_lines(spark, sf_dir).withColumn("ticker", F.col("sector")), *TIES)


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_ticks(_lines(spark, sf_dir).withColumn("ticker", F.lit("MKT")), *TIES)


def _bars_sql(name: str, key: str) -> str:
    return f"""{name} AS (SELECT {key} AS ticker, ts, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS "close", sum(volume) AS volume FROM lines GROUP BY 1, 2)"""


LINES_SQL = """lines AS (
  SELECT p_brand AS brand, 'S' || CAST(CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) % 5 AS VARCHAR) AS sector, CAST(l_shipdate AS DATE) AS ts, l_quantity AS volume,
    l_extendedprice / l_quantity AS price, {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey, 'e': l_extendedprice, 'f': l_discount, 'g': l_extendedprice / l_quantity} AS k
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0
)"""
BRAND_SQL = LINES_SQL + ", " + _bars_sql("brand0", "brand") + ", brand AS (SELECT *, 'S' || CAST(CAST(regexp_extract(ticker, '(\\d+)$', 1) AS INTEGER) % 5 AS VARCHAR) AS sector FROM brand0)"
FUNDS_SQL = _bars_sql("funds", "sector")
MARKET_SQL = _bars_sql("market", "'MKT'")

#: Fixed small dimensions, the same rows in both engines.
MEMBERSHIP = [("IDX", f"Brand#{i}", f"{1992 + i % 3}-0{1 + i % 9}-15", None if i % 4 else f"{1996 + i % 2}-06-30") for i in range(1, 21)] + [("IDX", "Brand#4", "1997-03-01", None)]
SPLITS = [("Brand#1", "1994-05-02", 4.0), ("Brand#2", "1995-03-10", 2.0), ("Brand#2", "1996-09-16", 3.0), ("Brand#5", "1997-01-20", 0.5), ("Brand#9", "1993-07-01", 10.0)]
SHARES = [(f"Brand#{i}", f"{y}-{1 + (i + y) % 12:02d}-20", 1000.0 * i + (y - 1992) * 3) for i in range(1, 16) for y in range(1993, 1999)]
MACRO = [("CPI", f"{y}-{m:02d}-01", float(100 + (y - 1992) * 12 + m), f"{y + (m == 12)}-{m % 12 + 1:02d}-{10 + m % 5:02d}" if m % 7 else None, float(100 + (y - 1992) * 12 + m) - 0.25) for y in range(1992, 1999) for m in range(1, 13)]


def _frame(spark: SparkSession, rows: list[tuple], schema: str, dates: tuple[str, ...]) -> DataFrame:
    out = spark.createDataFrame(rows, schema)
    return out.withColumns({c: F.col(c).cast("date") for c in dates})


def membership(spark: SparkSession) -> DataFrame:
    return _frame(spark, MEMBERSHIP, "index_name string, ticker string, start_date string, end_date string", ("start_date", "end_date"))


def splits(spark: SparkSession) -> DataFrame:
    return _frame(spark, SPLITS, "ticker string, execution_date string, ratio double", ("execution_date",))


def shares(spark: SparkSession) -> DataFrame:
    return _frame(spark, SHARES, "ticker string, ts string, shares_outstanding double", ("ts",))


def macro(spark: SparkSession) -> DataFrame:
    return _frame(spark, MACRO, "series_id string, date string, value double, published_at string, first_published_value double", ("date", "published_at"))


def values_sql(name: str, rows: list[tuple], columns: list[tuple[str, str]]) -> str:
    quoted = lambda v: "NULL" if v is None else repr(v)
    body = ", ".join("(" + ", ".join(quoted(v) for v in r) + ")" for r in rows)
    names = ", ".join(c for c, _ in columns)
    return f"{name} AS (SELECT {', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in columns)} FROM (VALUES {body}) AS v({names}))"


MEMBERSHIP_SQL = values_sql("membership", MEMBERSHIP, [("index_name", "VARCHAR"), ("ticker", "VARCHAR"), ("start_date", "DATE"), ("end_date", "DATE")])
SPLITS_SQL = values_sql("splits", SPLITS, [("ticker", "VARCHAR"), ("execution_date", "DATE"), ("ratio", "DOUBLE")])
SHARES_SQL = values_sql("shares", SHARES, [("ticker", "VARCHAR"), ("ts", "DATE"), ("shares_outstanding", "DOUBLE")])
MACRO_SQL = values_sql("macro", MACRO, [("series_id", "VARCHAR"), ("date", "DATE"), ("value", "DOUBLE"), ("published_at", "DATE"), ("first_published_value", "DOUBLE")])
