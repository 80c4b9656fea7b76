"""Queries over bars, indicators, joins and cross-sections, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import kernels, scalar
from tidemark.functions import windows as wd
from tidemark.operators import bars as br
from tidemark.operators import cross_section as xs
from tidemark.operators import joins as jn
from tidemark.plans import inputs as inp

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})  # adding 0 makes a negative zero plain


HEAD = "WITH RECURSIVE " + inp.WALK_SQL
ATR_HEAD = HEAD + ", " + inp.ATR_SQL
OVER = "OVER (PARTITION BY ticker ORDER BY ts)"


def frame(n: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def sma_sql(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {frame(n)} = {n} THEN avg({x}) {frame(n)} END"


OHLC = ("open", "high", "low", "close")


@query("bars_daily", HEAD + ' SELECT ticker, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round("close", 6) AS "close", volume FROM walk')
def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inp.walk_bars(spark, sf_dir), *OHLC)


def _periods_sql(label: str, last: str) -> str:
    return HEAD + f""", p AS (SELECT ticker, {label} AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max("close", ts) AS "close", sum(volume) AS volume FROM walk GROUP BY 1, 2),
 q AS (SELECT p.*, m.last_ts, {last} AS period_end FROM p JOIN (SELECT ticker, max(ts) AS last_ts FROM walk GROUP BY 1) m USING (ticker))
 SELECT ticker, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round("close", 6) AS "close", volume,
 NOT (last_ts > CAST(period_end - CAST(greatest(0, isodow(period_end) - 5) AS INTEGER) AS DATE)) AS is_partial FROM q"""


@query("bars_weekly", _periods_sql("CAST(date_trunc('week', ts) AS DATE)", "p.ts + 6"))
def bars_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(br.resample(inp.walk_bars(spark, sf_dir), "week"), *OHLC)


@query("bars_monthly", _periods_sql("CAST(date_trunc('month', ts) AS DATE)", "last_day(p.ts)"))
def bars_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(br.resample(inp.walk_bars(spark, sf_dir), "month"), *OHLC)


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk bars some of which are damaged, by rule."""
    b = inp.walk(spark, sf_dir)
    b = b.withColumn("high", F.when(F.col("idx") % 211 == 7, F.col("low") * 0.5).otherwise(F.col("high"))).withColumn("open", F.when(F.col("idx") % 307 == 11, F.lit(None)).otherwise(F.col("open")))
    return b.withColumn("volume", F.when(F.col("idx") % 401 == 13, F.lit(-1.0)).otherwise(F.col("volume"))).withColumn("close", F.when(F.col("idx") % 503 == 17, F.lit(0.0)).otherwise(F.col("close")))


DIRTY_SQL = ", dirty AS (SELECT ticker, ts, idx, CASE WHEN idx % 307 = 11 THEN NULL ELSE open END AS open, CASE WHEN idx % 211 = 7 THEN low * 0.5 ELSE high END AS high, low, CASE WHEN idx % 503 = 17 THEN 0.0 ELSE \"close\" END AS \"close\", CASE WHEN idx % 401 = 13 THEN -1.0 ELSE volume END AS volume FROM walk)"
SOUND_SQL = 'low > 0 AND open > 0 AND "close" > 0 AND high >= low AND open BETWEEN low AND high AND "close" BETWEEN low AND high'


@query("validate_bars", HEAD + DIRTY_SQL + f' SELECT ticker, ts, round("close", 6) AS "close", volume FROM dirty WHERE {SOUND_SQL} AND volume >= 0')
def validate_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(br.validated(_dirty(spark, sf_dir)).select("ticker", "ts", "close", "volume"), "close")


@query("write_gate", HEAD + DIRTY_SQL + f" SELECT ticker, count(*) AS n FROM dirty WHERE {SOUND_SQL} GROUP BY 1")
def write_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return br.validated(_dirty(spark, sf_dir), with_volume=False).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query("quality_report", HEAD + DIRTY_SQL + f", g AS (SELECT ticker, count(*) AS loaded, CAST(sum(CASE WHEN coalesce({SOUND_SQL} AND volume >= 0, false) THEN 0 ELSE 1 END) AS BIGINT) AS dropped FROM dirty GROUP BY 1) SELECT *, round(dropped / loaded, 9) AS drop_rate, dropped / loaded > 0.005 AS unreliable FROM g")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(br.quality(_dirty(spark, sf_dir)), "drop_rate", digits=9)


@query("suspicious_bars", ATR_HEAD + f""", s AS (SELECT ticker, ts, coalesce("close" / lag("close") {OVER} < 1/3 OR "close" / lag("close") {OVER} > 3, false) AS jump,
 coalesce(lag(atr) {OVER} > 0 AND high - low > 3 * lag(atr) {OVER}, false) AS wide FROM bars) SELECT * FROM s WHERE jump OR wide""")
def suspicious_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return br.suspicious(br.with_atr(inp.walk(spark, sf_dir)))


@query("min_bars_skip", HEAD + " SELECT ticker, count(*) AS bars, 'only ' || count(*) || ' of 2452 bars' AS reason FROM walk GROUP BY 1 HAVING count(*) < 2452")
def min_bars_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return br.skipped(inp.walk_bars(spark, sf_dir), 2452)


@query("load_as_of", HEAD + " SELECT ticker, ts, round(\"close\", 6) AS \"close\" FROM walk WHERE ts <= DATE '1996-06-30' AND ts >= DATE '1993-01-01'")
def load_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(br.load(inp.walk_bars(spark, sf_dir), as_of="1996-06-30", start="1993-01-01").select("ticker", "ts", "close"), "close")


@query("ratios", HEAD + f" SELECT ticker, ts, round(high / open, 9) AS high_open, round(low / open, 9) AS low_open, round(\"close\" / open, 9) AS close_open, round(open / lag(\"close\") {OVER} - 1, 9) + 0.0 AS overnight_gap FROM walk")
def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, o = inp.walk_bars(spark, sf_dir), F.col("open")
    out = b.select("ticker", "ts", scalar.ratio(F.col("high"), o).alias("high_open"), scalar.ratio(F.col("low"), o).alias("low_open"), scalar.ratio(F.col("close"), o).alias("close_open"), (scalar.ratio(o, F.lag("close").over(wd.series())) - 1).alias("overnight_gap"))
    return rounded(out, "high_open", "low_open", "close_open", "overnight_gap", digits=9)


@query("sma", HEAD + f' SELECT ticker, ts, round({sma_sql(chr(34) + "close" + chr(34), 50)}, 6) AS sma50, round({sma_sql(chr(34) + "close" + chr(34), 200)}, 6) AS sma200, round({sma_sql("volume", 20)}, 6) AS volume20 FROM walk')
def sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = inp.walk_bars(spark, sf_dir)
    return rounded(b.select("ticker", "ts", wd.sma(F.col("close"), 50, wd.series()).alias("sma50"), wd.sma(F.col("close"), 200, wd.series()).alias("sma200"), wd.sma(F.col("volume"), 20, wd.series()).alias("volume20")), "sma50", "sma200", "volume20")


@query("bollinger", HEAD + f""", b AS (SELECT ticker, ts, {sma_sql('"close"', 20)} AS mid, CASE WHEN count("close") {frame(20)} = 20 THEN stddev_pop("close") {frame(20)} END AS dev FROM walk)
 SELECT ticker, ts, round(mid + 2 * dev, 5) AS upper, round(mid, 5) AS middle, round(mid - 2 * dev, 5) AS lower, round(4 * dev / mid * 100, 5) AS width FROM b""")
def bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    up, mid, low = wd.bollinger(F.col("close"), 20, 2, 2, wd.series())
    out = inp.walk_bars(spark, sf_dir).select("ticker", "ts", up.alias("upper"), mid.alias("middle"), low.alias("lower"))
    return rounded(out.withColumn("width", scalar.band_width(F.col("upper"), F.col("lower"), F.col("middle"))), "upper", "middle", "lower", "width", digits=5)


@query("stochastic", HEAD + f""", k AS (SELECT ticker, ts, CASE WHEN count(*) {frame(14)} = 14 THEN CASE WHEN max(high) {frame(14)} = min(low) {frame(14)} THEN 0 ELSE 100 * ("close" - min(low) {frame(14)}) / (max(high) {frame(14)} - min(low) {frame(14)}) END END AS k FROM walk),
 s AS (SELECT ticker, ts, {sma_sql('k', 3)} AS sk FROM k), d AS (SELECT ticker, ts, sk, {sma_sql('sk', 3)} AS sd FROM s)
 SELECT ticker, ts, round(CASE WHEN sd IS NOT NULL THEN sk END, 6) AS slow_k, round(sd, 6) AS slow_d FROM d""")
def stochastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = inp.walk_bars(spark, sf_dir).withColumn("k", wd.fast_k(14, wd.series())).withColumn("sk", wd.sma(F.col("k"), 3, wd.series())).withColumn("slow_d", wd.sma(F.col("sk"), 3, wd.series()))
    return rounded(b.select("ticker", "ts", F.when(F.col("slow_d").isNotNull(), F.col("sk")).alias("slow_k"), "slow_d"), "slow_k", "slow_d")


@query("momentum", HEAD + f""" SELECT ticker, ts, round(("close" / lag("close", 10) {OVER} - 1) * 100, 6) + 0.0 AS roc10,
 round(CASE WHEN count(*) {frame(14)} = 14 THEN CASE WHEN max(high) {frame(14)} = min(low) {frame(14)} THEN 0 ELSE -100 * (max(high) {frame(14)} - "close") / (max(high) {frame(14)} - min(low) {frame(14)}) END END, 6) + 0.0 AS williams14 FROM walk""")
def momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rounded(inp.walk_bars(spark, sf_dir).select("ticker", "ts", wd.roc(F.col("close"), 10, wd.series()).alias("roc10"), wd.williams_r(14, wd.series()).alias("williams14")), "roc10", "williams14")
    return out


@query("cci", HEAD + f""", t AS (SELECT ticker, ts, idx, (high + low + "close") / 3 AS tp FROM walk), m AS (SELECT *, {sma_sql('tp', 20)} AS mean FROM t),
 d AS (SELECT a.ticker, a.ts, a.tp, a.mean, avg(abs(b.tp - a.mean)) AS dev FROM m a JOIN t b ON a.ticker = b.ticker AND b.idx BETWEEN a.idx - 19 AND a.idx GROUP BY ALL)
 SELECT ticker, ts, round(CASE WHEN mean IS NOT NULL THEN CASE WHEN dev = 0 THEN 0 ELSE (tp - mean) / (0.015 * dev) END END, 4) AS cci20 FROM d""")
def cci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inp.walk_bars(spark, sf_dir).select("ticker", "ts", wd.cci(20, wd.series()).alias("cci20")), "cci20", digits=4)


@query("volume_flow", HEAD + f""", f AS (SELECT *, (high + low + "close") / 3 AS tp, lag((high + low + "close") / 3) {OVER} AS ptp, "close" - lag("close") {OVER} AS move FROM walk),
 g AS (SELECT ticker, ts, CASE WHEN move IS NULL OR move > 0 THEN volume WHEN move < 0 THEN -volume ELSE 0 END AS signed, CASE WHEN ptp IS NOT NULL THEN CASE WHEN tp > ptp THEN tp * volume ELSE 0 END END AS pos, CASE WHEN ptp IS NOT NULL THEN CASE WHEN tp < ptp THEN tp * volume ELSE 0 END END AS neg FROM f)
 SELECT ticker, ts, sum(signed) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING) AS obv,
 round(CASE WHEN count(pos) {frame(14)} = 14 THEN CASE WHEN sum(pos) {frame(14)} + sum(neg) {frame(14)} < 1 THEN 0 ELSE 100 * sum(pos) {frame(14)} / (sum(pos) {frame(14)} + sum(neg) {frame(14)}) END END, 5) AS mfi14 FROM g""")
def volume_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    up, down = wd.mfi_flows(wd.series())
    b = inp.walk_bars(spark, sf_dir).withColumns({"signed": wd.obv(wd.series()), "pos": up, "neg": down})
    return rounded(b.select("ticker", "ts", F.sum("signed").over(wd.series().rowsBetween(Window.unboundedPreceding, 0)).alias("obv"), wd.mfi("pos", "neg", 14, wd.series()).alias("mfi14")), "mfi14", digits=5)


def _ema_sql(x: str, n: int) -> str:
    return f"""e{n} AS (SELECT ticker, {n - 1} AS idx, avg({x}) AS e FROM walk WHERE idx < {n} GROUP BY ticker HAVING count(*) = {n}
 UNION ALL SELECT w.ticker, w.idx, e.e + 2.0 / {n + 1} * (w.{x} - e.e) FROM e{n} e JOIN walk w ON w.ticker = e.ticker AND w.idx = e.idx + 1)"""


@query("ema", HEAD + ", " + _ema_sql('"close"', 8) + ", " + _ema_sql('"close"', 21) + " SELECT ticker, ts, round(e8.e, 6) AS ema8, round(e21.e, 6) AS ema21 FROM walk LEFT JOIN e8 USING (ticker, idx) LEFT JOIN e21 USING (ticker, idx)")
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = br.with_kernel(inp.walk(spark, sf_dir), {f"ema{n}": lambda p, n=n: kernels.ema(p["close"].to_numpy(float), n) for n in (8, 21)})
    return rounded(out.select("ticker", "ts", "ema8", "ema21"), "ema8", "ema21")


@query("atr", ATR_HEAD + ' SELECT ticker, ts, round(atr, 6) AS atr, round(atr / "close" * 100, 6) AS atr_pct FROM bars')
def atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = br.with_atr(inp.walk(spark, sf_dir))
    return rounded(out.select("ticker", "ts", "atr", (scalar.ratio(F.col("atr"), F.col("close")) * 100).alias("atr_pct")), "atr", "atr_pct")


RSI_SQL = f""", d AS (SELECT ticker, ts, idx, greatest("close" - lag("close") {OVER}, 0) AS up, greatest(lag("close") {OVER} - "close", 0) AS down FROM walk),
 r AS (SELECT ticker, 14 AS idx, avg(up) AS g, avg(down) AS l FROM d WHERE idx BETWEEN 1 AND 14 GROUP BY ticker HAVING count(*) = 14
 UNION ALL SELECT d.ticker, d.idx, r.g + (d.up - r.g) / 14, r.l + (d.down - r.l) / 14 FROM r JOIN d ON d.ticker = r.ticker AND d.idx = r.idx + 1)"""


@query("rsi", HEAD + RSI_SQL + """ SELECT ticker, ts, round(CASE WHEN g + l = 0 THEN 0 ELSE 100 * g / (g + l) END, 6) AS rsi14 FROM d LEFT JOIN r USING (ticker, idx)""")
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = br.with_kernel(inp.walk(spark, sf_dir), {"rsi14": lambda p: kernels.rsi(p["close"].to_numpy(float), 14)})
    return rounded(out.select("ticker", "ts", "rsi14"), "rsi14")


MACD_SQL = """, f AS (SELECT ticker, 25 AS idx, avg("close") FILTER (idx BETWEEN 14 AND 25) AS f, avg("close") FILTER (idx < 26) AS s FROM walk GROUP BY ticker HAVING max(idx) >= 25
 UNION ALL SELECT w.ticker, w.idx, f.f + 2.0 / 13 * (w."close" - f.f), f.s + 2.0 / 27 * (w."close" - f.s) FROM f JOIN walk w ON w.ticker = f.ticker AND w.idx = f.idx + 1),
 g AS (SELECT ticker, 33 AS idx, avg(f - s) AS e FROM f WHERE idx BETWEEN 25 AND 33 GROUP BY ticker HAVING count(*) = 9
 UNION ALL SELECT f.ticker, f.idx, g.e + 2.0 / 10 * (f.f - f.s - g.e) FROM g JOIN f ON f.ticker = g.ticker AND f.idx = g.idx + 1)"""


@query("macd", HEAD + MACD_SQL + """ SELECT ticker, ts, round(CASE WHEN e IS NOT NULL THEN f - s END, 6) AS macd, round(e, 6) AS macd_signal, round(f - s - e, 6) AS macd_hist FROM walk LEFT JOIN f USING (ticker, idx) LEFT JOIN g USING (ticker, idx)""")
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda i: lambda p: kernels.macd(p["close"].to_numpy(float))[i]
    out = br.with_kernel(inp.walk(spark, sf_dir), {"macd": part(0), "macd_signal": part(1), "macd_hist": part(2)})
    return rounded(out.select("ticker", "ts", "macd", "macd_signal", "macd_hist"), "macd", "macd_signal", "macd_hist")


def adx_sql(n: int) -> str:
    """``adx``: sums of directional moves and ranges from bar n on, their index, and its smoothed mean."""
    return f""", dm AS (SELECT ticker, idx, tr, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS plus, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS minus
  FROM (SELECT *, high - lag(high) {OVER} AS up, lag(low) {OVER} - low AS down FROM tr)),
 ds AS (SELECT ticker, {n - 1} AS idx, sum(plus) AS p, sum(minus) AS m, sum(tr) AS t, CAST(0 AS DOUBLE) AS dx FROM dm WHERE idx BETWEEN 1 AND {n - 1} GROUP BY ticker HAVING count(*) = {n - 1}
 UNION ALL SELECT ticker, idx, p, m, t, CASE WHEN t > 0 AND p + m > 0 THEN 100 * abs(p - m) / (p + m) ELSE dx END FROM
  (SELECT d.ticker, d.idx, s.p - s.p / {n} + d.plus AS p, s.m - s.m / {n} + d.minus AS m, s.t - s.t / {n} + d.tr AS t, s.dx FROM ds s JOIN dm d ON d.ticker = s.ticker AND d.idx = s.idx + 1)),
 adx AS (SELECT ticker, {2 * n - 1} AS idx, avg(dx) AS adx FROM ds WHERE idx BETWEEN {n} AND {2 * n - 1} GROUP BY ticker HAVING count(*) = {n}
 UNION ALL SELECT s.ticker, s.idx, (a.adx * {n - 1} + s.dx) / {n} FROM adx a JOIN ds s ON s.ticker = a.ticker AND s.idx = a.idx + 1)"""


#: Each bar turns the state of the one before (side, stop, extreme point, pace) into its own; ``got`` is the bar's stop.
SAR_SQL = f""", hl AS (SELECT ticker, idx, high, low, lag(high) {OVER} AS h0, lag(low) {OVER} AS l0 FROM walk),
 sar AS (SELECT ticker, 0 AS idx, side, CASE WHEN side THEN l0 ELSE h0 END AS stop, CASE WHEN side THEN high ELSE low END AS extreme, CAST(0.02 AS DOUBLE) AS pace, CAST(NULL AS DOUBLE) AS got, high AS before_h, low AS before_l
   FROM (SELECT *, NOT (l0 - low > high - h0 AND l0 - low > 0) AS side FROM hl WHERE idx = 1)
 UNION ALL SELECT ticker, idx, side, CASE WHEN side THEN least(moved, before_l, low) ELSE greatest(moved, before_h, high) END, extreme, pace, got, high, low FROM
  (SELECT *, got + pace * (extreme - got) AS moved FROM
   (SELECT ticker, idx, high, low, before_h, before_l, side <> hit AS side,
     CASE WHEN NOT hit THEN stop WHEN side THEN greatest(extreme, before_h, high) ELSE least(extreme, before_l, low) END AS got,
     CASE WHEN hit THEN CAST(0.02 AS DOUBLE) WHEN CASE WHEN side THEN high > extreme ELSE low < extreme END THEN least(CAST(0.2 AS DOUBLE), pace + CAST(0.02 AS DOUBLE)) ELSE pace END AS pace,
     CASE WHEN hit THEN CASE WHEN side THEN low ELSE high END WHEN side THEN greatest(extreme, high) ELSE least(extreme, low) END AS extreme
    FROM (SELECT b.ticker, b.idx, b.high, b.low, s.side, s.stop, s.extreme, s.pace, s.before_h, s.before_l, CASE WHEN s.side THEN b.low <= s.stop ELSE b.high >= s.stop END AS hit
      FROM sar s JOIN hl b ON b.ticker = s.ticker AND b.idx = s.idx + 1))))"""


@query("adx_sar", ATR_HEAD + adx_sql(20) + SAR_SQL + " SELECT w.ticker, w.ts, round(adx, 6) AS adx20, round(got, 6) AS sar FROM walk w LEFT JOIN adx USING (ticker, idx) LEFT JOIN sar USING (ticker, idx)")
def adx_sar(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = br.with_kernel(inp.walk(spark, sf_dir), {"adx20": lambda p: kernels.adx(*br.arrays(p), 20), "sar": lambda p: kernels.sar(*br.arrays(p)[:2])})
    return rounded(out.select("ticker", "ts", "adx20", "sar"), "adx20", "sar")


def zigzag_sql(size: float, high: str = "high", low: str = "low", *, tag: str = "", source: str = "bars", first: int = 0) -> str:
    """``turns`` (named with ``tag``) of the bars of ``source``, whose first has the number ``first``."""
    b, z, turns = f"b{tag}", f"z{tag}", f"turns{tag}"
    return f""", {b} AS (SELECT ticker, ts, idx, {high} AS h, {low} AS l, atr * {size} AS thr, atr FROM {source} WHERE idx >= {first}),
 {z} AS (SELECT ticker, {first} AS idx, h AS ch, {first} AS chi, thr AS cht, l AS cl, {first} AS cli, thr AS clt, '' AS seek, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS INTEGER) AS at FROM {b} WHERE idx = {first}
 UNION ALL
 SELECT ticker, idx, CASE WHEN kind = 'low' THEN h ELSE ch END, CASE WHEN kind = 'low' THEN idx ELSE chi END, CASE WHEN kind = 'low' THEN thr ELSE cht END,
  CASE WHEN kind = 'high' THEN l ELSE cl END, CASE WHEN kind = 'high' THEN idx ELSE cli END, CASE WHEN kind = 'high' THEN thr ELSE clt END,
  CASE kind WHEN 'high' THEN 'low' WHEN 'low' THEN 'high' ELSE seek END, kind, CASE kind WHEN 'high' THEN ch WHEN 'low' THEN cl END, CASE kind WHEN 'high' THEN chi WHEN 'low' THEN cli END
 FROM (SELECT *, CASE WHEN seek <> 'low' AND chi < idx AND ch - l >= cht THEN 'high' WHEN seek <> 'high' AND cli < idx AND h - cl >= clt THEN 'low' END AS kind FROM (
  SELECT b.ticker, CAST(b.idx AS INTEGER) AS idx, b.h, b.l, b.thr, z.seek, CASE WHEN b.h > z.ch THEN b.h ELSE z.ch END AS ch, CASE WHEN b.h > z.ch THEN CAST(b.idx AS INTEGER) ELSE z.chi END AS chi, CASE WHEN b.h > z.ch THEN b.thr ELSE z.cht END AS cht,
   CASE WHEN b.l < z.cl THEN b.l ELSE z.cl END AS cl, CASE WHEN b.l < z.cl THEN CAST(b.idx AS INTEGER) ELSE z.cli END AS cli, CASE WHEN b.l < z.cl THEN b.thr ELSE z.clt END AS clt
  FROM {z} z JOIN {b} b ON b.ticker = z.ticker AND b.idx = z.idx + 1) s) t),
 {turns} AS (SELECT z.ticker, z.kind, p.ts, z.value, c.ts AS confirmed_at, p.thr AS threshold, p.atr, z.at AS idx, z.idx AS confirmed_idx FROM {z} z JOIN {b} p ON p.ticker = z.ticker AND p.idx = z.at JOIN {b} c ON c.ticker = z.ticker AND c.idx = z.idx WHERE z.kind IS NOT NULL)"""


@query("zigzag_turns", ATR_HEAD + zigzag_sql(2.0) + " SELECT ticker, kind, ts, round(value, 6) AS value, confirmed_at, round(threshold, 6) AS threshold, idx, confirmed_idx FROM turns")
def zigzag_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(br.with_turns(inp.walk(spark, sf_dir), 2.0), "value", "threshold")


BRANDS = "WITH RECURSIVE " + inp.BRAND_SQL


@query("membership_asof", BRANDS + ", " + inp.MEMBERSHIP_SQL + ' SELECT b.ticker, b.ts, round("close", 6) AS "close" FROM brand b JOIN membership m ON b.ticker = m.ticker AND b.ts >= m.start_date AND (m.end_date IS NULL OR b.ts <= m.end_date)')
def membership_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(jn.within(inp.brand(spark, sf_dir).select("ticker", "ts", "close"), F.broadcast(inp.membership(spark))), "close")


@query("constituent_counts", BRANDS + ", " + inp.MEMBERSHIP_SQL + ", d AS (SELECT DISTINCT ts FROM brand) SELECT d.ts, count(m.ticker) AS n_constituents FROM d LEFT JOIN membership m ON d.ts >= m.start_date AND (m.end_date IS NULL OR d.ts <= m.end_date) GROUP BY 1")
def constituent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xs.constituent_counts(inp.brand(spark, sf_dir).select("ts").distinct(), inp.membership(spark))


#: Splits are applied one after the other to a ticker's list of filed counts: counts that still look like the last one
#: before the split, up to the first that doesn't, become that count times the split's ratio.
CAPS_SQL = ", " + inp.SPLITS_SQL + ", " + inp.SHARES_SQL + """, sp AS (SELECT ticker, execution_date, ratio, row_number() OVER (PARTITION BY ticker ORDER BY execution_date) AS k FROM splits),
 bridged AS (SELECT ticker, CAST(0 AS BIGINT) AS k, list(ts ORDER BY ts) AS days, list(shares_outstanding ORDER BY ts) AS held FROM shares WHERE shares_outstanding IS NOT NULL GROUP BY 1
 UNION ALL SELECT ticker, k, days, CASE WHEN n = 0 THEN held ELSE list_transform(held, lambda x, i: CASE WHEN i > n AND i < stop THEN held[n] * ratio ELSE x END) END FROM
  (SELECT *, coalesce(list_min(list_filter(range(n + 1, len(held) + 1), lambda i: NOT (least(held[i], held[n]) > 0 AND greatest(held[i], held[n]) <= 1.2 * least(held[i], held[n])))), len(held) + 1) AS stop FROM
   (SELECT b.ticker, s.k, b.days, b.held, s.ratio, len(list_filter(b.days, lambda d: d < s.execution_date)) AS n FROM bridged b JOIN sp s ON s.ticker = b.ticker AND s.k = b.k + 1))),
 filed AS (SELECT ticker, unnest(days) AS ts, unnest(held) AS shares_outstanding FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY k DESC) AS last FROM bridged) WHERE last = 1),
 later AS (SELECT b.ticker, b.ts, coalesce(product(s.ratio), 1.0) AS split_ratio FROM brand b LEFT JOIN splits s ON s.ticker = b.ticker AND s.execution_date > b.ts GROUP BY 1, 2),
 caps AS (SELECT b.ticker, b.ts, b."close", f.shares_outstanding, l.split_ratio, b."close" * l.split_ratio * f.shares_outstanding AS market_cap FROM brand b JOIN later l USING (ticker, ts) ASOF LEFT JOIN filed f ON f.ticker = b.ticker AND f.ts <= b.ts WHERE b.ticker IN (SELECT ticker FROM filed))"""


@query("market_cap", BRANDS + CAPS_SQL + ' SELECT ticker, ts, round("close", 6) AS "close", round(market_cap, 6) AS market_cap, shares_outstanding, split_ratio FROM caps')
def market_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = xs.market_caps(inp.brand(spark, sf_dir), inp.shares(spark), inp.splits(spark))
    return rounded(out, "close", "market_cap")


@query("split_ratio", BRANDS + ", " + inp.SPLITS_SQL + " SELECT b.ticker, b.ts, coalesce(product(s.ratio), 1.0) AS split_ratio FROM brand b LEFT JOIN splits s ON s.ticker = b.ticker AND s.execution_date > b.ts GROUP BY 1, 2")
def split_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.later_product(inp.brand(spark, sf_dir).select("ticker", "ts"), inp.splits(spark))


@query("shares_asof", BRANDS + ", " + inp.SHARES_SQL + " SELECT b.ticker, b.ts, s.shares_outstanding FROM brand b ASOF LEFT JOIN shares s ON s.ticker = b.ticker AND s.ts <= b.ts")
def shares_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.as_of(inp.brand(spark, sf_dir).select("ticker", "ts"), inp.shares(spark), ["shares_outstanding"], by=["ticker"], on="ts")


@query("macro_asof", BRANDS + ", " + inp.MACRO_SQL + ", k AS (SELECT published_at, arg_max(first_published_value, date) AS v FROM macro WHERE published_at IS NOT NULL GROUP BY 1), d AS (SELECT DISTINCT ts FROM brand) SELECT d.ts, k.v AS macro_value FROM d ASOF LEFT JOIN k ON k.published_at <= d.ts")
def macro_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.published_as_of(inp.brand(spark, sf_dir).select("ts").distinct(), inp.macro(spark))


def _ema_brand_sql(n: int) -> str:
    return f"""x{n} AS (SELECT ticker, {n - 1} AS idx, avg("close") AS e FROM ib WHERE idx < {n} GROUP BY ticker HAVING count(*) = {n}
 UNION ALL SELECT w.ticker, w.idx, e.e + 2.0 / {n + 1} * (w."close" - e.e) FROM x{n} e JOIN ib w ON w.ticker = e.ticker AND w.idx = e.idx + 1)"""


BREADTH_SQL = BRANDS + ", " + inp.MEMBERSHIP_SQL + ", ib AS (SELECT ticker, ts, \"close\", row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS idx FROM brand WHERE ticker IN (SELECT ticker FROM membership)), " + _ema_brand_sql(8) + ", " + _ema_brand_sql(21) + f""",
 m AS (SELECT ib.ticker, ib.ts, "close", x8.e AS ema8, x21.e AS ema21, {sma_sql('"close"', 50)} AS sma50, {sma_sql('"close"', 200)} AS sma200, lag("close") {OVER} AS pc FROM ib LEFT JOIN x8 USING (ticker, idx) LEFT JOIN x21 USING (ticker, idx)),
 k AS (SELECT m.* FROM m JOIN membership i ON i.ticker = m.ticker AND m.ts >= i.start_date AND (i.end_date IS NULL OR m.ts <= i.end_date)),
 g AS (SELECT ts, count(*) AS n_with_data, avg(CASE WHEN sma50 IS NOT NULL THEN CAST("close" > sma50 AS INTEGER) END) AS pct_above_sma50, avg(CASE WHEN sma200 IS NOT NULL THEN CAST("close" > sma200 AS INTEGER) END) AS pct_above_sma200,
 avg(CASE WHEN ema8 IS NOT NULL THEN CAST("close" > ema8 AS INTEGER) END) AS pct_above_ema8, avg(CASE WHEN ema21 IS NOT NULL THEN CAST("close" > ema21 AS INTEGER) END) AS pct_above_ema21, avg(CASE WHEN sma50 IS NOT NULL AND sma200 IS NOT NULL THEN CAST(sma50 > sma200 AS INTEGER) END) AS pct_golden_cross,
 CAST(count(*) FILTER ("close" > pc) AS DOUBLE) AS n_advancing, CAST(count(*) FILTER ("close" < pc) AS DOUBLE) AS n_declining FROM k GROUP BY 1),
 c AS (SELECT d.ts, count(i.ticker) AS n_constituents FROM (SELECT DISTINCT ts FROM ib) d LEFT JOIN membership i ON d.ts >= i.start_date AND (i.end_date IS NULL OR d.ts <= i.end_date) GROUP BY 1),
 breadth AS (SELECT ts, n_constituents, coalesce(n_with_data, 0) AS n_with_data, round(pct_above_sma50, 9) AS pct_above_sma50, round(pct_above_sma200, 9) AS pct_above_sma200, round(pct_above_ema8, 9) AS pct_above_ema8, round(pct_above_ema21, 9) AS pct_above_ema21, round(pct_golden_cross, 9) AS pct_golden_cross,
 coalesce(n_advancing, 0) AS n_advancing, coalesce(n_declining, 0) AS n_declining, coalesce(n_advancing, 0) - coalesce(n_declining, 0) AS net_advances, round(coalesce(n_advancing, 0) / nullif(coalesce(n_declining, 0), 0), 9) AS ad_ratio FROM c LEFT JOIN g USING (ts))"""
PCT = ("pct_above_sma50", "pct_above_sma200", "pct_above_ema8", "pct_above_ema21", "pct_golden_cross", "ad_ratio")


@query("breadth_equal", BREADTH_SQL + " SELECT * FROM breadth")
def breadth_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(xs.breadth(inp.brand(spark, sf_dir), inp.membership(spark)), *PCT, digits=9)


def _weighted_sql(name: str, cond: str, valid: str) -> str:
    ok = f"{valid} AND w IS NOT NULL"
    return f"sum(CASE WHEN {ok} THEN CAST({cond} AS INTEGER) * w ELSE 0 END) / nullif(sum(CASE WHEN {ok} THEN w ELSE 0 END), 0) AS {name}"


def _breadth_cap_sql() -> str:
    """The equal-weighted SQL with each member's market capitalisation in place of 1."""
    head, rest = BREADTH_SQL.split(",\n g AS (")
    tail = rest[rest.index(",\n c AS (") :]
    above = ", ".join(_weighted_sql(f"pct_above_{c}", f'"close" > {c}', f"{c} IS NOT NULL") for c in ("sma50", "sma200", "ema8", "ema21"))
    golden = _weighted_sql("pct_golden_cross", "sma50 > sma200", "sma50 IS NOT NULL AND sma200 IS NOT NULL")
    moved = ", ".join(f'coalesce(sum(w) FILTER ("close" {sign} pc), 0.0) AS {name}' for sign, name in ((">", "n_advancing"), ("<", "n_declining")))
    weighed = ", wk AS (SELECT k.*, caps.market_cap AS w FROM k LEFT JOIN caps ON caps.ticker = k.ticker AND caps.ts = k.ts)"
    return head + CAPS_SQL + weighed + f", g AS (SELECT ts, count(*) AS n_with_data, {above}, {golden}, {moved} FROM wk GROUP BY 1)" + tail


MOVED = ("n_advancing", "n_declining", "net_advances")


@query("breadth_cap", _breadth_cap_sql() + " SELECT * REPLACE (" + ", ".join(f"round({c}, 2) AS {c}" for c in MOVED) + ") FROM breadth")
def breadth_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = xs.breadth(inp.brand(spark, sf_dir), inp.membership(spark), weighting="cap", shares=inp.shares(spark), splits=inp.splits(spark))
    return rounded(rounded(out, *PCT, digits=9), *MOVED, digits=2)


@query("ad_line", BREADTH_SQL + " SELECT ts, sum(net_advances) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS ad_line FROM breadth")
def ad_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xs.advance_decline_line(xs.breadth(inp.brand(spark, sf_dir), inp.membership(spark)))


@query("percentile_rank", BRANDS + ', r AS (SELECT ticker, ts, volume, rank() OVER (PARTITION BY ts ORDER BY volume) AS k, count(*) OVER (PARTITION BY ts, volume) AS t, count(volume) OVER (PARTITION BY ts) AS n FROM brand) SELECT ticker, ts, round((k + (t - 1) / 2.0) / n * 100, 6) AS pct FROM r')
def percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inp.brand(spark, sf_dir).select("ticker", "ts", wd.percentile_rank("volume", "ts").alias("pct")), "pct")


def _strength_sql(targets: str, bench: str, pair: str, rank: str, member: bool) -> str:
    """``pair``: the benchmark ticker of a target row t."""
    week = lambda name, src: f"{name} AS (SELECT x.ticker, CAST(date_trunc('week', x.ts) AS DATE) AS ts, arg_max(\"close\", x.ts) AS c FROM {src} x JOIN (SELECT ticker, max(ts) AS last_ts FROM {src} GROUP BY 1) m ON m.ticker = x.ticker GROUP BY x.ticker, 2, last_ts HAVING last_ts > CAST(date_trunc('week', x.ts) AS DATE) + 4)"
    inner = f"""wt AS (SELECT t.ticker, t.ts, t.c / b.c AS r FROM tw t JOIN (SELECT DISTINCT ticker, {pair} AS bench FROM {targets} t) p ON p.ticker = t.ticker JOIN bw b ON b.ticker = p.bench AND b.ts = t.ts),
 osc AS (SELECT ticker, ts, (r / ({sma_sql('r', 52)}) - 1) * 100 AS rs_mansfield FROM wt),
 ret AS (SELECT ticker, ts, 0.4 * ("close" / lag("close", 63) {OVER} - 1) + 0.2 * ("close" / lag("close", 126) {OVER} - 1) + 0.2 * ("close" / lag("close", 189) {OVER} - 1) + 0.2 * ("close" / lag("close", 252) {OVER} - 1) AS weighted_return FROM {targets}),
 d AS (SELECT t.ticker, t.ts, {rank.replace('ts, ', '').replace('ts', '0')} AS grp, b.ticker AS benchmark, t."close" / b."close" AS rs_ratio, ret.weighted_return FROM {targets} t JOIN {bench} b ON b.ticker = {pair} AND b.ts = t.ts JOIN ret ON ret.ticker = t.ticker AND ret.ts = t.ts),
 e AS (SELECT d.*, osc.rs_mansfield FROM d ASOF LEFT JOIN osc ON osc.ticker = d.ticker AND osc.ts <= d.ts),
 f AS (SELECT e.* FROM e {'JOIN membership i ON i.ticker = e.ticker AND e.ts >= i.start_date AND (i.end_date IS NULL OR e.ts <= i.end_date)' if member else ''})
 SELECT ticker, ts, benchmark, round(rs_ratio, 6) AS rs_ratio, round(rs_mansfield, 5) AS rs_mansfield, round(weighted_return, 6) AS weighted_return,
 round(CASE WHEN weighted_return IS NOT NULL THEN (rank() OVER (PARTITION BY ts, grp ORDER BY weighted_return NULLS LAST) + (count(*) OVER (PARTITION BY ts, grp, weighted_return) - 1) / 2.0) / count(weighted_return) OVER (PARTITION BY ts, grp) * 100 END, 6) AS rs_rating FROM f"""
    return BRANDS + ", " + inp.FUNDS_SQL + ", " + inp.MARKET_SQL + ", " + inp.MEMBERSHIP_SQL + ", " + week("tw", targets) + ", " + week("bw", bench) + ", " + inner


STRENGTH = ["ticker", "ts", "benchmark", "rs_ratio", "rs_mansfield", "weighted_return", "rs_rating"]


def _strength(df: DataFrame) -> DataFrame:
    return rounded(rounded(df.select(*STRENGTH), "rs_ratio", "weighted_return", "rs_rating"), "rs_mansfield", digits=5)


@query("rs_stock_vs_market", _strength_sql("brand", "market", "'MKT'", "ts", True))
def rs_stock_vs_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strength(xs.strength(inp.brand(spark, sf_dir), inp.market(spark, sf_dir), membership=inp.membership(spark)))


@query("rs_stock_vs_sector", _strength_sql("brand", "funds", "t.sector", "ts, t.sector", True))
def rs_stock_vs_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strength(xs.strength(inp.brand(spark, sf_dir), inp.sector_funds(spark, sf_dir), bench_key="sector", rank_by=("ts", "sector"), membership=inp.membership(spark)))


@query("rs_sector_vs_market", _strength_sql("funds", "market", "'MKT'", "ts", False))
def rs_sector_vs_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strength(xs.strength(inp.sector_funds(spark, sf_dir), inp.market(spark, sf_dir)))


@query("compare_sources", BRANDS + """, b AS (SELECT ticker, ts, "close", row_number() OVER (PARTITION BY ticker ORDER BY ts) AS n FROM brand), o AS (SELECT ticker, ts, CASE WHEN n % 50 = 0 THEN "close" * 1.05 ELSE "close" END AS "close" FROM b WHERE n % 9 <> 0)
 SELECT b.ticker, b.ts, round(b."close", 6) AS close_a, round(o."close", 6) AS close_b, round(abs(b."close" - o."close") / o."close", 6) AS pct_diff FROM b JOIN o USING (ticker, ts) WHERE abs(b."close" - o."close") / o."close" > 0.01""")
def compare_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = inp.brand(spark, sf_dir).select("ticker", "ts", "close")
    n = F.row_number().over(wd.series())
    other = b.withColumn("n", n).filter("n % 9 <> 0").withColumn("close", F.when(F.col("n") % 50 == 0, F.col("close") * 1.05).otherwise(F.col("close")))
    return rounded(jn.differing(b, other), "close_a", "close_b", "pct_diff")
