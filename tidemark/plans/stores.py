"""Queries that go through a store: what they write to it they read back.

Each builds a store of its own in the shared folder, so a query changes nothing that another sees.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import jobs
from tidemark.functions import scalar
from tidemark.functions import windows as wd
from tidemark.operators import bars as br
from tidemark.operators import portfolio as pf
from tidemark.operators.joins import as_of
from tidemark.plans import inputs as inp
from tidemark.plans.core import ATR_HEAD, BRANDS, BREADTH_SQL, HEAD, OHLC, OVER, PCT, frame, query, rounded, sma_sql
from tidemark.plans.structures import FILLS_SQL, GAPS_SQL, KEY, LIFE_SQL
from tidemark.sources import vendors
from tidemark.sources.shared import shared_folder
from tidemark.sources.store import Store


def opened(spark: SparkSession) -> Store:
    return Store(spark, shared_folder(spark, "store"))


def stored_bars(df: DataFrame, source: str = "yfinance") -> DataFrame:
    return df.select("ticker", F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit(source).alias("source"), *OHLC, "volume")


def walk_store(spark: SparkSession, sf_dir: str) -> Store:
    store = opened(spark)
    store.upsert("bars_1d", stored_bars(inp.walk_bars(spark, sf_dir)))
    return store


def brand_store(spark: SparkSession, sf_dir: str) -> Store:
    store = opened(spark)
    store.upsert("bars_1d", stored_bars(inp.brand(spark, sf_dir)))
    store.replace("index_membership", inp.membership(spark))
    return store


def job(store: Store, *args: str) -> DataFrame:
    return jobs.run(store.spark, jobs.parser().parse_args([*args, "--store", store.root]))


ROUND_OHLC = ", ".join(f'round("{c}", 6) AS "{c}"' for c in OHLC)


@query("store_upsert_bars", HEAD + f""", b AS (SELECT ticker, ts, open, high, low, CASE WHEN idx % 7 = 3 THEN low ELSE "close" END AS "close", volume, CASE WHEN idx % 7 = 3 THEN 2 ELSE 1 END AS version FROM walk)
 SELECT ticker, ts, {ROUND_OHLC}, volume, version FROM b""")
def store_upsert_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars in two upserts: the second corrects closes of some, and brings unsound ones, which stay out."""
    store = walk_store(spark, sf_dir)
    b = inp.walk(spark, sf_dir)
    corrected = b.filter("idx % 7 = 3").withColumn("close", F.col("low"))
    unsound = b.filter("idx % 7 = 5").withColumn("close", F.lit(-1.0))
    store.upsert("bars_1d", stored_bars(corrected.unionByName(unsound)))
    day = F.col("ts").cast("date")
    got = store.read("bars_1d").select("ticker", day.alias("ts"), *OHLC, "volume")
    touched = b.filter("idx % 7 = 3").select("ticker", "ts", F.lit(2).alias("_v"))
    return rounded(got.join(touched, ["ticker", "ts"], "left").withColumn("version", F.coalesce("_v", F.lit(1))).drop("_v"), *OHLC)


@query("store_read_bars", HEAD + f" SELECT ts, {ROUND_OHLC}, volume FROM walk WHERE ticker = 'AF' AND ts BETWEEN DATE '1996-02-03' AND DATE '1997-08-09'")
def store_read_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ticker of one source between two days, both included; pinned columns are gone."""
    got = walk_store(spark, sf_dir).bars(ticker="AF", source="yfinance", start="1996-02-03", end="1997-08-09")
    return rounded(got.select(F.col("ts").cast("date").alias("ts"), *OHLC, "volume"), *OHLC)


@query("store_tickers", "SELECT 'S' || s_suppkey AS ticker, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'ETF' ELSE 'CS' END AS type, s_suppkey % 4 <> 0 AS active FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 0")
def store_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active common stock, after an upsert that renamed nothing and switched some off."""
    s = inp.table(spark, sf_dir, "supplier")
    rows = s.select(F.concat(F.lit("S"), "s_suppkey").alias("ticker"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "ETF").otherwise("CS").alias("type"), F.lit(True).alias("active"), F.col("s_suppkey").alias("k"))
    store = opened(spark)
    store.upsert("tickers", rows)
    store.upsert("tickers", rows.filter("k % 4 = 0").withColumn("active", F.lit(False)))
    return store.tickers("CS", True).select("ticker", "name", "type", "active")


@query("store_metadata", "SELECT 'C' || c_custkey AS ticker, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS market_cap, c_mktsegment AS sic_description, CASE WHEN c_custkey % 5 = 0 THEN 'new' END AS primary_exchange FROM customer")
def store_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inp.table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("ticker"), F.col("c_acctbal").alias("market_cap"), F.col("c_mktsegment").alias("sic_description"), F.col("c_custkey").alias("k"))
    store = opened(spark)
    store.upsert("ticker_metadata", c)
    store.upsert("ticker_metadata", c.filter("k % 5 = 0").withColumn("market_cap", F.col("market_cap") * 2).withColumn("primary_exchange", F.lit("new")))
    return store.read("ticker_metadata").select("ticker", "market_cap", "sic_description", "primary_exchange")


@query("store_sector", "SELECT 'N' || n_nationkey AS ticker, r_name AS sector, n_name AS industry FROM nation JOIN region ON n_regionkey = r_regionkey")
def store_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = inp.table(spark, sf_dir, "nation").join(inp.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.select(F.concat(F.lit("N"), "n_nationkey").alias("ticker"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"))
    store = opened(spark)
    store.upsert("ticker_sector", rows.withColumn("sector", F.lit("?")))
    store.upsert("ticker_sector", rows)
    return store.read("ticker_sector")


@query("store_shares", "WITH " + inp.SHARES_SQL + " SELECT ticker, ts, CASE WHEN year(ts) >= 1997 THEN shares_outstanding + 1 ELSE shares_outstanding END AS shares_outstanding, 'x' AS source FROM shares")
def store_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inp.shares(spark).withColumn("source", F.lit("x"))
    store = opened(spark)
    store.upsert("shares_outstanding", rows)
    store.upsert("shares_outstanding", rows.filter(F.year("ts") >= 1997).withColumn("shares_outstanding", F.col("shares_outstanding") + 1))
    return store.read("shares_outstanding")


@query("store_splits", "WITH " + inp.SPLITS_SQL + " SELECT ticker, execution_date, 1.0 AS split_from, ratio AS split_to, ratio, 'x' AS source FROM splits")
def store_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits as a vendor lists them, with their ratio worked out, stored twice."""
    landed = inp.splits(spark).select("ticker", F.col("execution_date").cast("string"), F.lit(1).alias("split_from"), F.col("ratio").alias("split_to"))
    store = opened(spark)
    for _ in range(2):
        store.upsert("splits", vendors.splits(landed).withColumn("source", F.lit("x")))
    return store.read("splits")


@query("store_macro", "WITH " + inp.MACRO_SQL + " SELECT series_id, date, value, 'x' AS source, published_at, first_published_value FROM macro UNION ALL SELECT 'DFF', date, value, 'x', date, value FROM macro")
def store_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with their first publication; a series quoted daily counts as published on its own date."""
    macro = inp.macro(spark)
    first = macro.select("series_id", "date", "published_at", "first_published_value")
    raw = macro.select("series_id", F.col("date").cast("string").alias("date"), F.col("value").cast("string").alias("value"))
    gone = raw.limit(3).withColumn("value", F.lit(".")).withColumn("date", F.lit("1980-01-01"))  # the vendor's missing values
    values = vendors.observations(raw.unionByName(gone).unionByName(raw.withColumn("series_id", F.lit("DFF"))))
    store = opened(spark)
    store.upsert("macro_series", vendors.with_publication(values, first).withColumn("source", F.lit("x")))
    return store.read("macro_series")


@query("store_members", "WITH " + inp.MEMBERSHIP_SQL + " SELECT index_name, ticker, start_date, end_date FROM membership WHERE start_date <= DATE '1996-12-31' AND (end_date IS NULL OR end_date >= DATE '1996-12-31')")
def store_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of an index on a day, after its membership was replaced twice and another's was emptied."""
    store, rows = opened(spark), inp.membership(spark)
    store.replace("index_membership", rows.limit(3).unionByName(rows.withColumn("index_name", F.lit("OLD"))))
    store.replace("index_membership", rows, ["OLD"])
    return store.read("index_membership").filter("index_name = 'OLD'").unionByName(store.members("IDX", "1996-12-31"))


@query("universe_tickers", "WITH " + inp.MEMBERSHIP_SQL + " SELECT DISTINCT ticker FROM membership WHERE index_name IN ('IDX')")
def universe_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = opened(spark)
    store.replace("index_membership", inp.membership(spark))
    return store.universe(["IDX"])


@query("pending_keys", "SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE coalesce((SELECT arg_max(o_orderstatus, {'d': o_orderdate, 'k': o_orderkey}) FROM orders WHERE o_custkey = c_custkey) <> 'F', true)")
def pending_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose last order is no success, by the ledger."""
    o = inp.table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed")
    results = o.select(F.lit("fetch").alias("job_type"), F.col("o_custkey").cast("string").alias("key"), status.alias("status"), F.lit(None).cast("string").alias("last_error"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    store = opened(spark)
    store.record_jobs(results, "at")
    keys = inp.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_custkey").alias("pos"))
    return store.pending("fetch", keys).select("key")


@query("store_job_ledger", "SELECT o_custkey AS key, arg_max(o_orderstatus, {'d': o_orderdate, 'k': o_orderkey}) AS status, 2 * count(*) AS attempts FROM orders GROUP BY 1")
def store_job_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes logged twice: the last one by date stays, attempts add up."""
    o = inp.table(spark, sf_dir, "orders")
    results = o.select(F.lit("fetch").alias("job_type"), F.col("o_custkey").cast("string").alias("key"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("last_error"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    store = opened(spark)
    for _ in range(2):
        store.record_jobs(results, "at")
    return store.read("fetch_jobs").select(F.col("key").cast("long").alias("key"), "status", F.col("attempts").cast("long").alias("attempts"))


@query("landed_bars", HEAD + f" SELECT ticker, ts, {ROUND_OHLC}, volume FROM walk")
def landed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as a vendor's payloads, one file a ticker, and read back."""
    folder = shared_folder(spark, "landed")
    b = inp.walk_bars(spark, sf_dir)
    entry = F.struct((F.unix_timestamp(F.col("ts").cast("timestamp")) * 1000).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"))
    b.select("ticker", F.year("ts").alias("y"), entry.alias("r")).groupBy("ticker", "y").agg(F.collect_list("r").alias("results")).drop("y").write.json(folder)
    got = vendors.landed_bars(spark, folder)
    return rounded(got.select("ticker", F.col("ts").cast("date").alias("ts"), *OHLC, "volume"), *OHLC)


@query("batch_unstacked", HEAD + """ SELECT ticker, ts, round("close", 6) AS "close", volume FROM walk WHERE ticker IN ('AF', 'NO')""")
def batch_unstacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that came as one wide row a day, as rows again; tickers without values on a day have none."""
    b = inp.walk_bars(spark, sf_dir).filter("ticker in ('AF', 'NO')")
    pick = lambda t, c: F.max(F.when(F.col("ticker") == t, F.col(c))).alias(f"{t}_{c}")
    wide = b.groupBy("ts").agg(*[pick(t, c) for t in ("AF", "NO") for c in ("close", "volume")])
    return rounded(vendors.unstacked(wide, ["AF", "NO"], ("close", "volume")), "close")


@query("shares_latest_each_day", "SELECT 'C' || o_custkey AS ticker, CAST(o_orderdate AS DATE) AS ts, arg_max(o_totalprice, {'k': o_orderkey}) AS shares_outstanding FROM orders GROUP BY 1, 2")
def shares_latest_each_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = inp.table(spark, sf_dir, "orders")
    moment = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("o_orderkey") / F.lit(1_000_000))
    return vendors.latest_each_day(o.select(F.concat(F.lit("C"), "o_custkey").alias("ticker"), moment.alias("moment"), F.col("o_totalprice").alias("shares_outstanding")))


@query("resample_stored", HEAD + f""", p AS (SELECT ticker, g.k AS period, CASE g.k WHEN 'week' THEN CAST(date_trunc('week', ts) AS DATE) ELSE CAST(date_trunc('month', ts) AS DATE) END AS label, ts, open, high, low, "close", volume FROM walk, (VALUES ('week'), ('month')) AS g(k))
 SELECT ticker, period, label AS ts, {", ".join(f'round({x}, 6) AS "{c}"' for c, x in (("open", "arg_min(open, ts)"), ("high", "max(high)"), ("low", "min(low)"), ("close", 'arg_max("close", ts)')))}, sum(volume) AS volume FROM p GROUP BY 1, 2, 3""")
def resample_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly and monthly bars as the job stores them, run twice."""
    store = walk_store(spark, sf_dir)
    for _ in range(2):
        job(store, "resample")
    both = store.read("bars_1w").withColumn("period", F.lit("week")).unionByName(store.read("bars_1mo").withColumn("period", F.lit("month")))
    return rounded(both.select("ticker", "period", F.col("ts").cast("date").alias("ts"), *OHLC, "volume"), *OHLC)


GAPS_STORED = ["ticker", "kind", "direction", "created_at", "zone_bottom", "zone_top", "size_atr", "status", "max_fill_pct", "first_touch_date", "closed_date", "n_approaches", "reaction_atr_after_close", "linked"]
ROUND_GAPS = ("zone_bottom", "zone_top", "size_atr", "max_fill_pct", "reaction_atr_after_close")


def _gaps_stored_sql() -> str:
    moves = f"""c AS (SELECT l.ticker, l.kind, l.direction, l.created_idx, b.idx AS ci, b."close" AS ref FROM lifecycle l JOIN bars b ON b.ticker = l.ticker AND b.ts = l.closed_date WHERE status = 'closed'),
 m AS (SELECT c.ticker, c.kind, c.direction, c.created_idx, max(greatest(0, CASE WHEN c.direction = 'bullish' THEN b.high - ref ELSE ref - b.low END / b.atr)) AS reaction_atr_after_close FROM c JOIN bars b ON b.ticker = c.ticker AND b.idx BETWEEN ci + 1 AND ci + 10 WHERE b.atr > 0 GROUP BY 1, 2, 3, 4),
 linked AS (SELECT l.*, m.reaction_atr_after_close, l.kind = 'fvg' AND bool_or(l.kind = 'classic') OVER (PARTITION BY l.ticker, l.created_idx, l.direction) AS linked FROM lifecycle l LEFT JOIN m USING ({KEY}))"""
    return LIFE_SQL + ", " + moves + " SELECT " + ", ".join(f"round({c}, 6) AS {c}" if c in ROUND_GAPS else c for c in GAPS_STORED) + " FROM linked"


@query("gaps_stored", _gaps_stored_sql())
def gaps_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps as the job stores them, run twice; ``linked``: a fair-value gap whose related_id is a stored classic gap's id."""
    store = walk_store(spark, sf_dir)
    for _ in range(2):
        job(store, "gaps")
    gaps = store.read("gaps")
    classic = gaps.filter("kind = 'classic'").select(F.col("id").alias("related_id"), F.lit(True).alias("_known"))
    linked = gaps.join(classic, "related_id", "left").withColumn("linked", F.coalesce("_known", F.lit(False)))
    return rounded(linked.select(*GAPS_STORED), *ROUND_GAPS)


@query("gaps_with_config", GAPS_SQL + " SELECT ticker, kind, direction, created_at, 'wick' AS fill_by FROM gaps")
def gaps_with_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored gaps joined with a field of the configuration their run was logged with."""
    store = opened(spark)
    b = br.with_atr(inp.walk(spark, sf_dir))
    from tidemark.operators import gaps as gp

    run_id = store.record_run("gaps", "*", "daily", {"fill_by": "wick", "other": 1}, None, 3, "odd")
    store.save_results("gaps", gp.detect(b), run_id, "daily")
    return store.with_config(store.read("gaps")).select("ticker", "kind", "direction", "created_at", "fill_by")


@query("runs_ledger", HEAD + """ SELECT 'patterns' AS module, '*' AS ticker, 'daily' AS timeframe, '1996-06-30' AS as_of, CAST(0 AS BIGINT) AS rows_dropped, CAST(NULL AS VARCHAR) AS quality_warning
 UNION ALL SELECT 'fib_sets', 'AF,NO', 'weekly', NULL, 0, NULL""")
def runs_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = walk_store(spark, sf_dir)
    job(store, "patterns", "--as-of", "1996-06-30")
    job(store, "fib_sets", "--timeframe", "weekly", "--ticker", "AF", "NO")
    return store.read("runs").select("module", "ticker", "timeframe", "as_of", "rows_dropped", "quality_warning")


@query("breadth_stored", BREADTH_SQL + " SELECT 'IDX' AS index_name, 'equal' AS weighting, * FROM breadth WHERE ts BETWEEN DATE '1994-01-01' AND DATE '1997-12-31'")
def breadth_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth as the job stores it, run twice, trimmed to a range after its warm-up."""
    store = brand_store(spark, sf_dir)
    for _ in range(2):
        job(store, "breadth", "--index", "IDX", "--start", "1994-01-01", "--end", "1997-12-31")
    return rounded(store.read("breadth"), *PCT, digits=9)


@query("source_validation", BRANDS + """, o AS (SELECT ticker, ts, CASE WHEN dayofyear(ts) % 40 = 0 THEN "close" * 1.05 ELSE "close" END AS "close" FROM brand)
 SELECT b.ticker, b.ts, round(b."close", 6) AS close_a, round(o."close", 6) AS close_b FROM brand b JOIN o USING (ticker, ts) WHERE abs(b."close" - o."close") / o."close" > 0.01""")
def source_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources' stored bars compared by the job."""
    store, b = opened(spark), inp.brand(spark, sf_dir)
    store.upsert("bars_1d", stored_bars(b))
    up = F.when(F.dayofyear("ts") % 40 == 0, 1.05).otherwise(1.0)
    store.upsert("bars_1d", stored_bars(b.withColumns({c: F.col(c) * up for c in OHLC}), "polygon"))
    return rounded(job(store, "compare").select("ticker", F.col("ts").cast("date").alias("ts"), "close_a", "close_b"), "close_a", "close_b")


SCALARS = ("width_atr", "consistent", "hlc3", "close_price", "fib", "fib_log", "clipped", "slope_atr", "similar", "rel_volume", "confirmed", "tolerance", "touches")


@query("scalar_functions", ATR_HEAD + f""", s AS (SELECT *, lag(atr) {OVER} AS atr0, lag("close") {OVER} AS c0, lag("close", 2) {OVER} AS c1, {sma_sql('volume', 20)} AS v20, {sma_sql('"close"', 20)} AS mid, CASE WHEN count("close") {frame(20)} = 20 THEN stddev_pop("close") {frame(20)} END AS dev FROM bars),
 l AS (SELECT *, ln("close" / c0) AS slope, ln(c0 / c1) AS slope0, greatest(0.3 * atr, 0.001 * "close") AS tol FROM s)
 SELECT ticker, ts, round(CASE WHEN atr <> 0 THEN 4 * dev / atr END, 5) AS width_atr, coalesce(atr > 0 AND atr0 > 0 AND greatest(atr, atr0) <= 1.05 * least(atr, atr0), false) AS consistent, round((high + low + "close") / 3, 6) AS hlc3, round("close", 6) AS close_price,
 round(low + 0.618 * (high - low), 6) AS fib, round(exp(ln(low) + 0.618 * (ln(high) - ln(low))), 6) AS fib_log, round(CASE WHEN slope IS NOT NULL THEN greatest(-0.01, least(0.01, slope)) END, 7) AS clipped,
 round(CASE WHEN coalesce(atr, 0) <> 0 THEN "close" * (exp(slope) - 1) / atr ELSE 0 END, 6) AS slope_atr, (slope = 0 AND slope0 = 0) OR ((slope > 0) = (slope0 > 0) AND least(abs(slope), abs(slope0)) >= 0.5 * greatest(abs(slope), abs(slope0))) AS similar,
 round(CASE WHEN v20 > 0 THEN volume / v20 END, 6) AS rel_volume, coalesce(volume / nullif(v20, 0) >= 1.5, false) AS confirmed, round(tol, 6) AS tolerance, coalesce(abs(high - c0) <= tol OR abs(low - c0) <= tol, false) AS touches FROM l""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios, geometry, tolerance: each column function over every bar."""
    w = wd.series()
    b = br.with_atr(inp.walk(spark, sf_dir))
    last = w.rowsBetween(-19, 0)
    dev = F.when(F.count("close").over(last) == 20, F.stddev_pop("close").over(last))
    b = b.select("*", F.lag("atr").over(w).alias("atr0"), F.lag("close").over(w).alias("c0"), F.lag("close", 2).over(w).alias("c1"), wd.sma(F.col("volume"), 20, w).alias("v20"), wd.sma(F.col("close"), 20, w).alias("mid"), dev.alias("dev"))
    c, atr, slope, slope0 = F.col("close"), F.col("atr"), scalar.ln(scalar.quotient(F.col("close"), F.col("c0"))), scalar.ln(scalar.quotient(F.col("c0"), F.col("c1")))
    rel = scalar.relative_volume(F.col("volume"), F.col("v20"))
    tol = scalar.level_tolerance(atr, c, 0.3, 0.001)
    met = (F.abs(F.col("high") - F.col("c0")) <= tol) | (F.abs(F.col("low") - F.col("c0")) <= tol)
    made = dict(
        width_atr=scalar.band_width_atr(F.col("mid") + 2 * F.col("dev"), F.col("mid") - 2 * F.col("dev"), atr), consistent=scalar.scale_consistent(atr, F.col("atr0"), 1.05),
        hlc3=scalar.typical_price("hlc3"), close_price=scalar.typical_price("close"), fib=scalar.interpolated(F.col("low"), F.col("high"), F.lit(0.618)), fib_log=scalar.interpolated(F.col("low"), F.col("high"), F.lit(0.618), True),
        clipped=scalar.clip(slope, -0.01, 0.01), slope_atr=scalar.slope_in_atr(slope, c, atr), similar=scalar.slopes_similar(slope, slope0), rel_volume=rel, confirmed=F.coalesce(rel >= 1.5, F.lit(False)), tolerance=tol, touches=F.coalesce(met, F.lit(False)),
    )
    out = b.select("ticker", "ts", *[made[n].alias(n) for n in SCALARS])
    return rounded(rounded(rounded(out, "width_atr", digits=5), "clipped", digits=7), "hlc3", "close_price", "fib", "fib_log", "slope_atr", "rel_volume", "tolerance")


@query("symbols_and_partials", "SELECT DISTINCT replace(replace(p_brand, '#', '.'), '.', '-') AS symbol, replace(p_brand, '#', '.') AS original FROM part")
def symbols_and_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share classes as one vendor writes them, translated, and back."""
    dotted = inp.table(spark, sf_dir, "part").select(F.translate("p_brand", "#", ".").alias("dotted")).distinct()
    there = dotted.select(scalar.share_class_symbol(F.col("dotted")).alias("symbol"))
    return there.select("symbol", scalar.dotted_symbol(F.col("symbol")).alias("original"))


@query("partial_marks", HEAD + " SELECT ticker, ts, ts >= DATE '1998-01-01' AS is_partial FROM walk")
def partial_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.walk_bars(spark, sf_dir).select("ticker", "ts", scalar.partial_on(F.col("ts"), "1998-01-01").alias("is_partial"))


@query("dedup_keep_last", "SELECT l_orderkey AS ticker, l_linenumber AS ts, arg_max(l_extendedprice, {'a': l_shipdate, 'b': l_partkey, 'c': l_suppkey, 'd': l_extendedprice}) AS price FROM lineitem GROUP BY 1, 2")
def dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inp.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ticker"), F.col("l_linenumber").alias("ts"), "l_shipdate", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("price"))
    return br.keep_last(rows, "l_shipdate", "l_partkey", "l_suppkey", "price").select("ticker", "ts", "price")


#: Changes to an index, the same rows in both engines: who was added and removed when.
CHANGES = [(f"Brand#{i}", f"{1993 + i % 5}-0{1 + i % 9}-10", "added" if i % 2 else "removed") for i in range(1, 26)] + [("Brand#3", "1997-11-10", "removed"), ("Brand#3", "1998-02-10", "added"), ("Brand#77", "1995-05-05", "removed")]
CHANGES_SQL = inp.values_sql("changes", CHANGES, [("ticker", "VARCHAR"), ("date", "DATE"), ("action", "VARCHAR")])


@query("constituents_on", "WITH " + CHANGES_SQL + """, now AS (SELECT DISTINCT p_brand AS ticker FROM part), later AS (SELECT ticker, arg_min(action, {'d': date, 'a': action}) AS action FROM changes WHERE date > DATE '1995-01-01' GROUP BY 1)
 SELECT ticker FROM now WHERE ticker NOT IN (SELECT ticker FROM later) UNION SELECT ticker FROM later WHERE action = 'removed'""")
def constituents_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members on a past day, from today's and the log of changes since."""
    now = inp.table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct()
    changes = spark.createDataFrame([(t, date.fromisoformat(d), a) for t, d, a in CHANGES], "ticker string, date date, action string")
    return pf.constituents_on(now, changes, "1995-01-01")


@query("market_cap_filed", "WITH " + inp.SHARES_SQL + """, d AS (SELECT DISTINCT 'Brand#' || (1 + s_suppkey % 15) AS ticker, DATE '1994-01-01' + CAST(s_suppkey % 1500 AS INTEGER) AS ts FROM supplier)
 SELECT d.ticker, d.ts, s.shares_outstanding FROM d ASOF LEFT JOIN shares s ON s.ticker = d.ticker AND s.ts <= d.ts""")
def market_cap_filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last filed share count on arbitrary days, from the store."""
    store = opened(spark)
    store.upsert("shares_outstanding", inp.shares(spark).withColumn("source", F.lit("x")))
    k = F.col("s_suppkey")
    days = inp.table(spark, sf_dir, "supplier").select(F.concat(F.lit("Brand#"), (1 + k % 15)).alias("ticker"), F.date_add(F.lit("1994-01-01").cast("date"), (k % 1500).cast("int")).alias("ts")).distinct()
    return as_of(days, store.read("shares_outstanding"), ["shares_outstanding"], by=["ticker"], on="ts")
