"""Queries over gaps, turns and the structures built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as br
from tidemark.operators import gaps as gp
from tidemark.operators import levels as lv
from tidemark.operators import patterns as pt
from tidemark.operators import structures as st
from tidemark.operators import study as sy
from tidemark.plans import inputs as inp
from tidemark.plans.core import ATR_HEAD, MACD_SQL, OVER, RSI_SQL, frame, query, rounded, sma_sql, zigzag_sql
from tidemark.sources.shared import written


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return br.with_atr(inp.walk(spark, sf_dir))


GAPS_SQL = ATR_HEAD + f""", s AS (SELECT *, lag(high, 1) {OVER} AS h1, lag(low, 1) {OVER} AS l1, lag(high, 2) {OVER} AS h2, lag(low, 2) {OVER} AS l2 FROM bars),
 g0 AS (SELECT ticker, 'classic' AS kind, 'bullish' AS direction, ts AS created_at, idx AS created_idx, atr, h1 AS zone_bottom, low AS zone_top FROM s WHERE idx >= 50 AND low > h1
 UNION ALL SELECT ticker, 'classic', 'bearish', ts, idx, atr, high, l1 FROM s WHERE idx >= 50 AND high < l1
 UNION ALL SELECT ticker, 'fvg', 'bullish', ts, idx, atr, h2, low FROM s WHERE idx >= 50 AND h2 < low
 UNION ALL SELECT ticker, 'fvg', 'bearish', ts, idx, atr, high, l2 FROM s WHERE idx >= 50 AND l2 > high),
 gaps AS (SELECT *, (zone_top - zone_bottom) / atr AS size_atr FROM g0 WHERE atr > 0 AND (zone_top - zone_bottom) / atr >= 0.3)"""


@query("gaps_detect", GAPS_SQL + """ SELECT g.ticker, g.kind, g.direction, g.created_at, g.created_idx, round(zone_bottom, 6) AS zone_bottom, round(zone_top, 6) AS zone_top, round(size_atr, 6) AS size_atr,
 g.kind = 'fvg' AND bool_or(g.kind = 'classic') OVER (PARTITION BY g.ticker, g.created_idx, g.direction) AS related FROM gaps g""")
def gaps_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gp.detect(bars(spark, sf_dir)).drop("atr"), "zone_bottom", "zone_top", "size_atr")


FILLS_SQL = GAPS_SQL + """, met AS (SELECT g.ticker, g.kind, g.direction, g.created_idx, g.zone_bottom, g.zone_top, b.idx, b.ts, b.high, b.low, b."close", b.atr AS bar_atr,
 greatest(0, least(100, CASE WHEN g.direction = 'bullish' THEN g.zone_top - b.low ELSE b.high - g.zone_bottom END / (g.zone_top - g.zone_bottom) * 100)) AS pct FROM gaps g JOIN bars b ON b.ticker = g.ticker AND b.idx > g.created_idx),
 run AS (SELECT *, max(pct) OVER (PARTITION BY ticker, kind, direction, created_idx ORDER BY idx ROWS UNBOUNDED PRECEDING) AS max_pct, max(pct) OVER (PARTITION BY ticker, kind, direction, created_idx ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM met),
 fills AS (SELECT * FROM run WHERE coalesce(before, 0) < 100)"""
KEY = "ticker, kind, direction, created_idx"


@query("gap_fill_series", FILLS_SQL + f" SELECT {KEY}, idx, round(pct, 6) AS pct, round(max_pct, 6) AS max_pct FROM fills")
def gap_fill_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return rounded(gp.fills(gp.detect(b), b).select(*gp.GAP, "idx", "pct", "max_pct"), "pct", "max_pct")


LIFE_SQL = FILLS_SQL + f""", life AS (SELECT {KEY}, max(pct) AS max_fill_pct, min(ts) FILTER (pct > 0) AS first_touch_date, min(idx - created_idx) FILTER (pct > 0) AS bars_to_first_touch, min(ts) FILTER (max_pct >= 80) AS soft_closed_date, min(idx - created_idx) FILTER (max_pct >= 80) AS bars_to_soft_closed, min(ts) FILTER (max_pct >= 100) AS closed_date, min(idx - created_idx) FILTER (max_pct >= 100) AS bars_to_closed FROM fills GROUP BY ALL),
 isl AS (SELECT {KEY}, count(*) FILTER (p IS NULL OR idx - p > 4) AS n_approaches FROM (SELECT *, lag(idx) OVER (PARTITION BY {KEY} ORDER BY idx) AS p FROM fills WHERE pct > 0) GROUP BY ALL),
 vol AS (SELECT ticker, idx AS created_idx, volume / ({sma_sql('volume', 20)}) AS vr FROM bars),
 lifecycle AS (SELECT g.*, coalesce(max_fill_pct, 0) AS max_fill_pct, first_touch_date, bars_to_first_touch, soft_closed_date, bars_to_soft_closed, closed_date, bars_to_closed, coalesce(n_approaches, 0) AS n_approaches, vr AS volume_ratio_at_creation,
 CASE WHEN coalesce(max_fill_pct, 0) >= 100 THEN 'closed' WHEN max_fill_pct >= 80 THEN 'soft_closed' WHEN max_fill_pct > 0 THEN 'partial' ELSE 'open' END AS status FROM gaps g LEFT JOIN life USING ({KEY}) LEFT JOIN isl USING ({KEY}) LEFT JOIN vol USING (ticker, created_idx))"""
LIFE = [*gp.GAP, "status", "max_fill_pct", "first_touch_date", "bars_to_first_touch", "soft_closed_date", "bars_to_soft_closed", "closed_date", "bars_to_closed", "n_approaches", "volume_ratio_at_creation"]


@query("gaps_lifecycle", LIFE_SQL + " SELECT " + ", ".join(f"round({c}, 6) AS {c}" if c in ("max_fill_pct", "volume_ratio_at_creation") else c for c in LIFE) + " FROM lifecycle")
def gaps_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return rounded(gp.lifecycle(gp.detect(b), b).select(*LIFE), "max_fill_pct", "volume_ratio_at_creation")


@query("gap_status_counts", LIFE_SQL + " SELECT kind, status, count(*) AS n FROM lifecycle GROUP BY 1, 2")
def gap_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return gp.lifecycle(gp.detect(b), b).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


@query("gap_reaction", LIFE_SQL + f""", c AS (SELECT l.ticker, l.kind, l.direction, l.created_idx, b.idx AS ci, b."close" AS ref FROM lifecycle l JOIN bars b ON b.ticker = l.ticker AND b.ts = l.closed_date WHERE status = 'closed'),
 m AS (SELECT c.ticker, c.kind, c.direction, c.created_idx, b.idx - ci AS step, greatest(0, CASE WHEN c.direction = 'bullish' THEN b.high - ref ELSE ref - b.low END / b.atr) AS move FROM c JOIN bars b ON b.ticker = c.ticker AND b.idx BETWEEN ci + 1 AND ci + 10 WHERE b.atr > 0)
 SELECT {KEY}, round(max(move), 6) AS reaction_atr_after_close, CASE WHEN max(move) > 0 THEN min(step) FILTER (move = mx) END AS bars_to_reaction_peak FROM (SELECT *, max(move) OVER (PARTITION BY {KEY}) AS mx FROM m) GROUP BY ALL""")
def gap_reaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return rounded(gp.reactions(gp.lifecycle(gp.detect(b), b), b), "reaction_atr_after_close")


def _studied(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = written(bars(spark, sf_dir), "study-bars")
    found = gp.detect(b)
    walked = written(gp.fills(found, b), "study-fills")
    return gp.study(gp.lifecycle(found, b, walked=walked), walked, b)


STUDY_SQL = LIFE_SQL + f""", peak AS (SELECT {KEY}, max(pct) AS peak_fill, min(idx) FILTER (pct = mx) AS peak_idx, min(idx - created_idx) FILTER (max_pct >= 80) AS bars_to_threshold FROM (SELECT *, max(pct) OVER (PARTITION BY {KEY}) AS mx FROM fills) GROUP BY ALL),
 fwd AS (SELECT ticker, idx, {', '.join(f'(lead("close", {h}) {OVER} / "close" - 1) * 100 AS f{h}' for h in gp.STUDY_HORIZONS)} FROM bars),
 study AS (SELECT l.ticker, l.kind, l.direction, l.created_idx, l.status = 'closed' AS closed, peak_fill, bars_to_threshold, peak_idx - l.created_idx AS bars_to_peak, {', '.join(f"CASE l.direction WHEN 'bullish' THEN 1 ELSE -1 END * {t}.f{h} AS return_{h}_from_{n}" for t, n in (('a', 'created'), ('b', 'peak')) for h in gp.STUDY_HORIZONS)}
 FROM lifecycle l JOIN peak p ON p.ticker = l.ticker AND p.kind = l.kind AND p.direction = l.direction AND p.created_idx = l.created_idx LEFT JOIN fwd a ON a.ticker = l.ticker AND a.idx = l.created_idx LEFT JOIN fwd b ON b.ticker = l.ticker AND b.idx = peak_idx)"""
RETURNS = [f"return_{h}_from_{n}" for n in ("created", "peak") for h in gp.STUDY_HORIZONS]


@query("gap_fill_signals", STUDY_SQL + f" SELECT {KEY}, closed, round(peak_fill, 6) AS peak_fill, bars_to_threshold, bars_to_peak, " + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in RETURNS) + " FROM study")
def gap_fill_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(_studied(spark, sf_dir), "peak_fill"), *RETURNS, digits=5)


@query("gap_study_summary", STUDY_SQL + " SELECT ticker, kind, direction, count(*) AS n, count(*) FILTER (closed) AS n_closed, count(bars_to_threshold) AS n_threshold, round(avg(peak_fill), 6) AS mean_peak_fill, round(median(peak_fill), 6) AS median_peak_fill FROM study GROUP BY 1, 2, 3")
def gap_study_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sy.summary(_studied(spark, sf_dir)), "mean_peak_fill", "median_peak_fill")


SIGNALS = ("peak_fill", "closed", "bars_to_threshold", "bars_to_peak")


def _corr_sql(signal: str, target: str) -> str:
    rank = lambda x: f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0"
    kept = f"SELECT round(CAST({signal} AS DOUBLE), 9) AS x, round({target}, 9) AS y FROM study WHERE {signal} IS NOT NULL AND {target} IS NOT NULL"
    return f"SELECT '{signal}' AS signal, '{target}' AS target, count(*) AS n, min(x) < max(x) AND min(y) < max(y) AND count(*) >= 3 AS varied, corr(x, y) AS r, corr(rx, ry) AS rho FROM (SELECT x, y, {rank('x')} AS rx, {rank('y')} AS ry FROM ({kept}))"


@query("gap_corr", STUDY_SQL + " SELECT signal, target, n, CASE WHEN varied THEN round(r, 6) END AS pearson_r, CASE WHEN varied THEN round(rho, 6) END AS spearman_rho FROM (" + " UNION ALL ".join(_corr_sql(s, t) for s in SIGNALS for t in RETURNS) + ")")
def gap_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [(s, t) for s in SIGNALS for t in RETURNS]
    found = sy.correlations(rounded(_studied(spark, sf_dir), "peak_fill", *RETURNS, digits=9), pairs)
    return rounded(found.select("signal", "target", "n", "pearson_r", "spearman_rho"), "pearson_r", "spearman_rho")


@query("gap_corr_p")
def gap_corr_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sy.correlations(_studied(spark, sf_dir), [(s, t) for s in SIGNALS for t in RETURNS])


@query("price_pivot_pairs", ATR_HEAD + zigzag_sql(2.0) + " SELECT * FROM (SELECT ticker, kind, idx, round(value, 6) AS value, lead(idx) OVER (PARTITION BY ticker, kind ORDER BY idx) AS next_idx, round(lead(value) OVER (PARTITION BY ticker, kind ORDER BY idx), 6) AS next_value FROM turns) WHERE next_idx IS NOT NULL")
def price_pivot_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.turn_pairs(br.with_turns(inp.walk(spark, sf_dir), 2.0)), "value", "next_value")


#: Each indicator's value by bar, and the bar its study begins at.
INDICATORS = {
    "rsi": ("SELECT w.ticker, w.ts, w.idx, CASE WHEN g + l = 0 THEN 0 ELSE 100 * g / (g + l) END AS v FROM walk w LEFT JOIN r USING (ticker, idx)", st.WARM_UP),
    "macd_hist": ("SELECT w.ticker, w.ts, w.idx, f.f - f.s - g.e AS v FROM walk w LEFT JOIN f USING (ticker, idx) LEFT JOIN g USING (ticker, idx)", st.STD_BARS),
    "obv": (f'SELECT ticker, ts, idx, sum(CASE WHEN p IS NULL THEN volume ELSE sign("close" - p) * volume END) {OVER} AS v FROM (SELECT *, lag("close") {OVER} AS p FROM walk)', st.STD_BARS),
    "volume": (f"SELECT ticker, ts, idx, {sma_sql('lv', 5)} AS v FROM (SELECT *, ln(greatest(volume, 1e-9)) AS lv FROM walk)", st.STD_BARS),
}


def _diverging_sql(name: str) -> str:
    """``div_NAME``: pairs of successive price turns of one kind between which the indicator turned the other way.

    Price turns take their indicator turns one after the other, each the nearest that no earlier one took.
    """
    values, first = INDICATORS[name]
    scale = f"CAST({st.RSI_POINTS} AS DOUBLE)" if name == "rsi" else f"CASE WHEN count(v) {frame(st.STD_BARS)} = {st.STD_BARS} THEN stddev_samp(v) {frame(st.STD_BARS)} END"
    own = f", ind_{name} AS (SELECT *, {scale} AS atr FROM ({values}))" + zigzag_sql(1.0, "v", "v", tag=f"_{name}", source=f"ind_{name}", first=first)
    span = "PARTITION BY ticker, kind ORDER BY idx"
    both = ", ".join(f"{c} AS {c}1, lead({c}) OVER w AS {c}2" for c in ("ts", "value", "idx", "atr", "took", "i_value", "scale", "confirmed_idx", "i_confirmed"))
    alike = lambda a, b: f"coalesce({a} > 0 AND {b} > 0 AND greatest({a}, {b}) <= 10 * least({a}, {b}), false)"
    return own + f""", pt_{name} AS (SELECT t.*, row_number() OVER (PARTITION BY ticker ORDER BY idx) AS k, (SELECT list(2 * o.idx + CAST(o.kind = 'high' AS INTEGER) ORDER BY abs(o.idx - t.idx), o.idx) FROM turns_{name} o WHERE o.ticker = t.ticker AND o.kind = t.kind AND abs(o.idx - t.idx) <= {st.PAIRING}) AS near FROM turns_p{first} t),
 pair_{name} AS (SELECT DISTINCT ticker, CAST(0 AS BIGINT) AS k, CAST([] AS INTEGER[]) AS gone, CAST(NULL AS INTEGER) AS took FROM pt_{name}
 UNION ALL SELECT ticker, k, CASE WHEN took IS NULL THEN gone ELSE list_append(gone, took) END, took FROM (SELECT p.ticker, p.k, q.gone, list_filter(coalesce(p.near, CAST([] AS INTEGER[])), lambda c: NOT list_contains(q.gone, c))[1] AS took FROM pair_{name} q JOIN pt_{name} p ON p.ticker = q.ticker AND p.k = q.k + 1)),
 mt_{name} AS (SELECT p.*, q.took, o.value AS i_value, o.confirmed_idx AS i_confirmed, m.atr AS scale FROM pt_{name} p JOIN pair_{name} q USING (ticker, k) LEFT JOIN turns_{name} o ON o.ticker = p.ticker AND o.kind = p.kind AND 2 * o.idx + CAST(o.kind = 'high' AS INTEGER) = q.took LEFT JOIN ind_{name} m ON m.ticker = p.ticker AND m.idx = p.idx),
 div_{name} AS (SELECT ticker, '{name}' AS indicator, CASE kind WHEN 'high' THEN 'bearish' ELSE 'bullish' END AS direction, ts1, ts2, value1, value2, i_value1, i_value2, idx2, idx2 - idx1 AS span, abs(value2 - value1) / atr2 AS move, greatest(confirmed_idx2, i_confirmed2) AS seen,
   CASE WHEN {alike('scale1', 'scale2')} THEN abs(i_value2 - i_value1) / scale2 END AS gap
  FROM (SELECT ticker, kind, {both} FROM mt_{name} WINDOW w AS ({span})) WHERE idx2 - idx1 >= {st.SPAN} AND took1 IS NOT NULL AND took2 IS NOT NULL AND {alike('atr1', 'atr2')}
   AND CASE kind WHEN 'high' THEN value2 > value1 AND i_value2 < i_value1 ELSE value2 < value1 AND i_value2 > i_value1 END)"""


def _divergences_sql(names: tuple[str, ...]) -> str:
    prices = "".join(zigzag_sql(2.0, '"close"', '"close"', tag=f"_p{n}", first=n) for n in sorted({INDICATORS[x][1] for x in names}))
    every = " UNION ALL ".join(f"SELECT * FROM div_{x}" for x in names)
    return ATR_HEAD + RSI_SQL + MACD_SQL + prices + "".join(map(_diverging_sql, names)) + f""", dv AS (SELECT d.*, b.ts AS confirmed_at FROM ({every}) d JOIN bars b ON b.ticker = d.ticker AND b.idx = d.seen),
 ahead AS (SELECT d.ticker, indicator, direction, idx2, b.ts, b.idx - seen AS step, CASE direction WHEN 'bullish' THEN b.low < value2 ELSE b.high > value2 END AS broke, greatest(0, CASE direction WHEN 'bullish' THEN b.high - value2 ELSE value2 - b.low END / b.atr) AS gain
  FROM dv d JOIN bars b ON b.ticker = d.ticker AND b.idx BETWEEN seen + 1 AND seen + {st.OUTCOME_BARS} WHERE b.atr > 0),
 after AS (SELECT ticker, indicator, direction, idx2, max(gain) AS best, CASE WHEN max(gain) > 0 THEN arg_min(step, {{'g': -gain, 's': step}}) END AS bars_to_max, min(ts) FILTER (broke) AS invalidated_at FROM ahead GROUP BY 1, 2, 3, 4),
 found AS (SELECT dv.*, 0.5 * least(coalesce(gap, 0) / {st.GAP_CAP}, 1) + 0.3 * least(move / {st.MOVE_CAP}, 1) + 0.2 * least(span / {st.SPAN_CAP}, 1) AS strength, a.best, a.bars_to_max, a.invalidated_at FROM dv LEFT JOIN after a USING (ticker, indicator, direction, idx2))"""


DIVERGENCE_SQL = """ticker, indicator, direction, ts1 AS p1_date, ts2 AS p2_date, round(value1, 6) AS p1_price, round(value2, 6) AS p2_price, round(i_value1, 5) AS i1_value, round(i_value2, 5) AS i2_value, round(strength, 6) AS strength, span AS duration_bars, round(move, 6) AS price_move_atr, round(gap, 5) AS indicator_gap,
 ts2 AS appeared_at, confirmed_at, idx2 AS p2_idx, round(best, 6) AS max_favorable_move_atr, bars_to_max, invalidated_at IS NOT NULL AS invalidated, invalidated_at"""


def _divergence_rounded(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, "p1_price", "p2_price", "strength", "price_move_atr", "max_favorable_move_atr"), "i1_value", "i2_value", "indicator_gap", digits=5)


@query("divergences", _divergences_sql(("rsi", "macd_hist", "obv", "volume")) + " SELECT " + DIVERGENCE_SQL + " FROM found")
def divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _divergence_rounded(st.divergences(inp.walk_bars(spark, sf_dir), ("rsi", "macd_hist", "obv", "volume")))


@query("divergence_confluence", _divergences_sql(("rsi", "macd_hist", "obv")) + f""", runs AS (SELECT *, sum(fresh) OVER (PARTITION BY ticker, direction ORDER BY idx2 RANGE UNBOUNDED PRECEDING) AS run FROM
  (SELECT *, CASE WHEN idx2 - lag(idx2) OVER (PARTITION BY ticker, direction ORDER BY idx2) <= {st.PAIRING} THEN 0 ELSE 1 END AS fresh FROM found)),
 named AS (SELECT ticker, direction, run, string_agg(indicator, ',' ORDER BY indicator) AS confluent, count(*) AS confluence FROM (SELECT DISTINCT ticker, direction, run, indicator FROM runs) GROUP BY 1, 2, 3)
 SELECT ticker, indicator, direction, idx2 AS p2_idx, confluence, confluent FROM runs JOIN named USING (ticker, direction, run)""")
def divergence_confluence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.confluence(st.divergences(inp.walk_bars(spark, sf_dir))).select("ticker", "indicator", "direction", "p2_idx", "confluence", "confluent")


def _swings_sql() -> str:
    """Swings of closes between successive turns at each scale; of a smaller scale those that no larger scale has."""
    out, larger = "", []
    for scale in sorted(st.SCALES, reverse=True):
        tag = f"_{scale:.0f}"
        near = " AND ".join(f"NOT EXISTS (SELECT 1 FROM s{x} o WHERE o.ticker = q.ticker AND abs(o.origin_idx - q.origin_idx) <= {st.NEAR} AND abs(o.end_idx - q.end_idx) <= {st.NEAR})" for x in larger) or "true"
        out += zigzag_sql(scale, '"close"', '"close"', tag=tag, first=st.WARM_UP)
        out += f""", s{tag} AS (SELECT * FROM (SELECT ticker, CAST({scale} AS DOUBLE) AS scale, CASE kind WHEN 'low' THEN 'up' ELSE 'down' END AS direction, ts AS origin_date, value AS origin_price, idx AS origin_idx,
  lead(ts) OVER w AS end_date, lead(value) OVER w AS end_price, lead(idx) OVER w AS end_idx, abs(lead(value) OVER w - value) / lead(atr) OVER w AS magnitude_atr, lead(idx) OVER w - idx AS duration_bars, lead(confirmed_at) OVER w AS confirmed_at,
  atr > 0 AND lead(atr) OVER w > 0 AND greatest(atr, lead(atr) OVER w) <= 10 * least(atr, lead(atr) OVER w) AS consistent FROM turns{tag} WINDOW w AS (PARTITION BY ticker ORDER BY idx)) q
  WHERE consistent AND magnitude_atr >= {st.MIN_SWING} AND {near})"""
        larger.append(tag)
    return out + ", long_enough AS (SELECT ticker, max(idx) AS last_idx FROM walk GROUP BY 1 HAVING count(*) >= 150), swings AS (SELECT q.* EXCLUDE (consistent), CAST(last_idx - end_idx AS INTEGER) AS age_bars FROM (" + " UNION ALL ".join(f"SELECT * FROM s{x}" for x in larger) + ") q JOIN long_enough USING (ticker))"


FIB_SQL = ATR_HEAD + _swings_sql() + f""", weighed AS (SELECT *, 0.5 * greatest(0, least(1, magnitude_atr / 40)) + 0.2 * greatest(0, least(1, duration_bars / 250)) + 0.3 * pow(0.5, age_bars / {st.HALF_LIFE}) AS weight FROM swings),
 ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY ticker ORDER BY weight DESC, origin_idx, end_idx) AS INTEGER) AS rank FROM weighed),
 sets AS (SELECT r.*, (SELECT min(b.ts) FROM walk b WHERE b.ticker = r.ticker AND b.ts > r.end_date AND CASE r.direction WHEN 'up' THEN b."close" < r.origin_price ELSE b."close" > r.origin_price END) AS invalidated_at FROM ranked r WHERE rank <= {st.MAX_SETS})"""
FIB = ["ticker", "scale", "direction", "origin_date", "origin_price", "origin_idx", "end_date", "end_price", "end_idx", "magnitude_atr", "duration_bars", "confirmed_at", "age_bars", "weight", "invalidated_at", "status", "rank"]


@query("fib_sets", FIB_SQL + " SELECT " + ", ".join(f"round({c}, 6) AS {c}" if c in ("origin_price", "end_price", "magnitude_atr", "weight") else "CASE WHEN invalidated_at IS NULL THEN 'active' ELSE 'invalidated' END AS status" if c == "status" else c for c in FIB) + " FROM sets")
def fib_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = inp.walk_bars(spark, sf_dir)
    return rounded(st.fib_sets(st.swings(b), b).select(*FIB), "origin_price", "end_price", "magnitude_atr", "weight")


def _levels_sql() -> str:
    level = lambda r, kind, a, b: f"{{'ratio': CAST({r} AS DOUBLE), 'kind': '{kind}', 'price': {a} + {r} * ({b} - {a})}}"
    return ", ".join([*(level(r, "retracement", "end_price", "origin_price") for r in st.RETRACEMENTS), *(level(r, "extension", "origin_price", "end_price") for r in st.EXTENSIONS)])


@query("fib_levels", FIB_SQL + f" SELECT ticker, origin_idx, end_idx, l.ratio AS ratio, l.kind AS kind, round(l.price, 6) AS price FROM (SELECT ticker, origin_idx, end_idx, unnest([{_levels_sql()}]) AS l FROM sets)")
def fib_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = inp.walk_bars(spark, sf_dir)
    return rounded(st.fib_sets(st.swings(b), b).select("ticker", "origin_idx", "end_idx", F.explode("levels").alias("l")).select("ticker", "origin_idx", "end_idx", "l.*"), "price")


#: Every level walks the bars after its swing: the side of the close it came from, and since which bar a close beyond is undecided.
TOUCH_SQL = FIB_SQL + f""", lv AS (SELECT ticker, origin_idx, end_idx, l.ratio AS ratio, l.kind AS kind, l.price AS price FROM (SELECT ticker, origin_idx, end_idx, unnest([{_levels_sql()}]) AS l FROM sets)),
 e AS (SELECT *, end_idx AS idx, 0 AS side, CAST(NULL AS INTEGER) AS since, CAST(NULL AS VARCHAR) AS event, CAST(NULL AS INTEGER) AS began, 0 AS came FROM lv
 UNION ALL SELECT ticker, origin_idx, end_idx, ratio, kind, price, idx, CASE WHEN side = 0 THEN here WHEN event = 'break' THEN -side ELSE side END,
   CASE WHEN side = 0 OR event IS NOT NULL THEN NULL WHEN since IS NOT NULL THEN since WHEN here = -side THEN idx END, event, CASE WHEN event IS NOT NULL THEN coalesce(since, idx) END, side FROM
  (SELECT *, CASE WHEN side = 0 THEN NULL WHEN since IS NULL THEN CASE WHEN here = side AND met THEN 'meet' END WHEN here = side THEN 'return' WHEN idx = since + {st.RECLAIM} THEN 'break' END AS event FROM
   (SELECT e.ticker, e.origin_idx, e.end_idx, e.ratio, e.kind, e.price, CAST(b.idx AS INTEGER) AS idx, e.side, e.since, CASE WHEN b."close" > e.price + half THEN 1 WHEN b."close" < e.price - half THEN -1 ELSE 0 END AS here, b.low <= e.price + half AND b.high >= e.price - half AS met
    FROM e JOIN (SELECT *, CASE WHEN atr > 0 THEN {st.TOUCH_ATR} * atr ELSE 0 END / 2 AS half FROM bars) b ON b.ticker = e.ticker AND b.idx = e.idx + 1))),
 ahead AS (SELECT ticker, idx, atr, "close", max(high) OVER w AS hh, min(low) OVER w AS ll FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND {st.REACH} FOLLOWING)),
 met AS (SELECT e.*, CASE WHEN e.event = 'break' THEN NULL WHEN a.atr > 0 AND a.hh IS NOT NULL THEN greatest(0, CASE WHEN came > 0 THEN a.hh - a."close" ELSE a."close" - a.ll END / a.atr) ELSE 0 END AS move FROM e JOIN ahead a ON a.ticker = e.ticker AND a.idx = e.began WHERE event IS NOT NULL),
 touched AS (SELECT ticker, origin_idx, end_idx, ratio, kind, count(*) FILTER (event <> 'break') AS n_touches, count(*) FILTER (event = 'break') AS n_violations, min(began) FILTER (event <> 'break') AS first_idx, max(idx) FILTER (event <> 'break') AS last_idx, avg(move) AS avg_reaction_atr FROM met GROUP BY ALL)"""


@query("fib_level_touches", TOUCH_SQL + """ SELECT l.ticker, l.origin_idx, l.end_idx, l.ratio, l.kind, round(l.price, 6) AS price, coalesce(n_touches, 0) AS n_touches, coalesce(n_violations, 0) AS n_violations, f.ts AS first_touch_date, t.ts AS last_touch_date,
 round(avg_reaction_atr, 6) AS avg_reaction_atr, coalesce(n_touches, 0) > 0 AND coalesce(n_violations, 0) = 0 AS respected FROM lv l LEFT JOIN touched USING (ticker, origin_idx, end_idx, ratio, kind) LEFT JOIN walk f ON f.ticker = l.ticker AND f.idx = first_idx LEFT JOIN walk t ON t.ticker = l.ticker AND t.idx = last_idx""")
def fib_level_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = inp.walk_bars(spark, sf_dir)
    return rounded(st.level_touches(st.fib_sets(st.swings(b), b), b), "price", "avg_reaction_atr")


ANCHOR_SQL = ATR_HEAD + """, anchors AS (SELECT ticker, arg_max(ts, {'h': high, 'i': -idx}) AS anchor_date FROM bars GROUP BY 1 UNION SELECT ticker, arg_max(ts, {'l': -low, 'i': -idx}) FROM bars GROUP BY 1),
 line AS (SELECT b.*, a.anchor_date, sum((high + low + "close") / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0) AS avwap FROM bars b JOIN anchors a ON a.ticker = b.ticker AND b.ts >= a.anchor_date WINDOW w AS (PARTITION BY b.ticker, a.anchor_date ORDER BY b.ts ROWS UNBOUNDED PRECEDING))"""


def _extremes(b: DataFrame) -> DataFrame:
    first = lambda x, sign: F.max_by("ts", F.struct(sign * F.col(x), -F.col("idx")))
    return b.groupBy("ticker").agg(first("high", 1).alias("hi"), first("low", -1).alias("lo")).select("ticker", F.explode(F.array_distinct(F.array("hi", "lo"))).alias("anchor_date"))


@query("avwap_series", ANCHOR_SQL + " SELECT ticker, anchor_date, ts, round(avwap, 6) AS avwap FROM line")
def avwap_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return rounded(st.anchored(b, _extremes(b)).select("ticker", "anchor_date", "ts", "avwap"), "avwap")


@query("avwap_interactions", ANCHOR_SQL + """, k AS (SELECT *, "close" - avwap AS gap, CASE WHEN atr > 0 THEN 0.3 * atr ELSE 0 END AS edge FROM line WHERE avwap IS NOT NULL),
 r AS (SELECT *, CASE WHEN gap > edge THEN 1 WHEN gap < -edge THEN -1 END AS raw FROM k), s AS (SELECT *, last_value(raw IGNORE NULLS) OVER (PARTITION BY ticker, anchor_date ORDER BY ts ROWS UNBOUNDED PRECEDING) AS side FROM r),
 t AS (SELECT *, coalesce(CAST(raw <> lag(side) OVER (PARTITION BY ticker, anchor_date ORDER BY ts) AS INTEGER), 0) AS crossed, CASE WHEN side IS NOT NULL THEN side = 1 ELSE gap >= 0 END AS above,
 max(high) OVER (PARTITION BY ticker, anchor_date ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS hh, min(low) OVER (PARTITION BY ticker, anchor_date ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS ll FROM s)
 SELECT ticker, anchor_date, round(arg_max(avwap, ts), 6) AS current_value, max(ts) AS updated_through, round(arg_max(gap / atr, ts), 5) AS distance_atr, CAST(sum(crossed) AS BIGINT) AS n_crosses, round(avg(CAST(above AS INTEGER)), 6) AS pct_bars_above, max(ts) FILTER (crossed = 1) AS last_cross_date,
 round(avg(CASE WHEN raw IS NULL AND atr > 0 AND hh IS NOT NULL THEN greatest(0, CASE WHEN above THEN hh - "close" ELSE "close" - ll END / atr) END), 5) AS avg_reaction_atr_on_touch, round(1 - avg(CAST(above AS INTEGER)), 6) AS pct_bars_below FROM t GROUP BY 1, 2""")
def avwap_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return rounded(rounded(st.interactions(st.anchored(b, _extremes(b))), "current_value", "pct_bars_above", "pct_bars_below"), "distance_atr", "avg_reaction_atr_on_touch", digits=5)


ANCHORS_SQL = ATR_HEAD + ", " + inp.atr_sql(out="late_bars", first=st.WARM_UP) + zigzag_sql(st.CYCLE_ATRS, '"close"', '"close"', tag="_c", source="late_bars", first=st.WARM_UP) + f""", back AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY idx DESC) AS b FROM walk),
 roles AS (SELECT ticker, 'ath' AS role, arg_max(ts, {{'h': high, 'i': -idx}}) AS anchor_date FROM walk GROUP BY 1 UNION ALL SELECT ticker, 'atl', arg_max(ts, {{'l': -low, 'i': -idx}}) FROM walk GROUP BY 1
 UNION ALL SELECT ticker, '52w_high', arg_max(ts, {{'h': high, 'i': -idx}}) FROM back WHERE b <= {st.TRAILING} GROUP BY 1 UNION ALL SELECT ticker, '52w_low', arg_max(ts, {{'l': -low, 'i': -idx}}) FROM back WHERE b <= {st.TRAILING} GROUP BY 1
 UNION ALL SELECT ticker, 'cycle_' || kind, ts FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS n FROM turns_c) WHERE n <= {st.CYCLE_ANCHORS})"""


@query("avwap_anchors", ANCHORS_SQL + " SELECT ticker, anchor_date, string_agg(role, ',' ORDER BY role) AS roles, 'active' AS status, min(CASE WHEN role IN ('ath', 'atl') THEN 0 WHEN role LIKE '52w%' THEN 1 ELSE 2 END) AS seniority, bool_and(role LIKE 'cycle%') AS only_cycle FROM (SELECT DISTINCT * FROM roles) GROUP BY 1, 2")
def avwap_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = inp.walk(spark, sf_dir)
    found = st.anchors(b, br.with_turns(b.filter(F.col("idx") >= st.WARM_UP), st.CYCLE_ATRS, "close"))
    return found.withColumn("seniority", st.seniority(F.col("roles"))).withColumn("only_cycle", st.only_cycle(F.col("roles"))).withColumn("roles", F.array_join("roles", ","))


@query("sr_lines")
def sr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lv.detect(inp.walk_bars(spark, sf_dir), lv.MEDIUM)


@query("sr_lines_diagonal")
def sr_lines_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    return lv.detect(inp.walk_bars(spark, sf_dir), replace(lv.LONG, diagonals=True))


@query("sr_lines_weekly")
def sr_lines_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lv.detect(br.load(inp.walk_bars(spark, sf_dir), weekly=True), lv.LONG_WEEKLY)


@query("sr_events")
def sr_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sr_lines(spark, sf_dir).select("ticker", "rank", F.explode("events").alias("e")).select("ticker", "rank", "e.*")


@query("patterns")
def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.scan(inp.walk_bars(spark, sf_dir))


@query("pattern_counts")
def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns(spark, sf_dir).groupBy("pattern", "status").agg(F.count(F.lit(1)).alias("n"))
