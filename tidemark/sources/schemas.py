"""Tables of the raw and derived stores: columns, keys and partitioning."""

from __future__ import annotations

from dataclasses import dataclass

from tidemark.operators.levels import COUNTS, EVENT, MEANS, SCORES


@dataclass(frozen=True)
class Table:
    columns: str  # DDL
    key: tuple[str, ...]
    partition: tuple[str, ...] = ()  # columns, or SQL expressions over them
    fixed: tuple[str, ...] = ()  # columns an upsert keeps from the first time a key was seen

    @property
    def names(self) -> list[str]:
        return [c.split()[0] for c in self.columns.split(", ")]


_BARS = Table("ticker string, ts timestamp_ntz, source string, open double, high double, low double, close double, volume double, is_partial boolean", ("ticker", "ts", "source"), ("source", "year(ts)"))

RAW: dict[str, Table] = {
    "bars_1d": _BARS, "bars_1w": _BARS, "bars_1mo": _BARS, "bars_1h": _BARS,
    "tickers": Table("ticker string, name string, type string, active boolean, delisted_utc string", ("ticker",)),
    "fetch_jobs": Table("job_type string, key string, status string, attempts int, last_error string", ("job_type", "key"), ("job_type",)),
    "ticker_metadata": Table("ticker string, market_cap double, sic_code string, sic_description string, share_class_shares_outstanding double, weighted_shares_outstanding double, total_employees bigint, primary_exchange string, list_date string", ("ticker",)),
    "ticker_sector": Table("ticker string, sector string, industry string", ("ticker",)),
    "index_membership": Table("index_name string, ticker string, start_date date, end_date date", ("index_name", "ticker", "start_date"), ("index_name",)),
    "shares_outstanding": Table("ticker string, ts date, shares_outstanding double, source string", ("ticker", "ts", "source"), ("source",)),
    "splits": Table("ticker string, execution_date date, split_from double, split_to double, ratio double, source string", ("ticker", "execution_date", "source"), ("source",)),
    "macro_series": Table("series_id string, date date, value double, source string, published_at date, first_published_value double", ("series_id", "date", "source"), ("source",)),
}

_SCORED = ", ".join([*(f"{c} double" for c in (*SCORES, *MEANS)), *(f"{c} int" for c in COUNTS)])
_RUN = "id string, run_id string, ticker string, timeframe string"
DERIVED: dict[str, Table] = {
    "runs": Table("id string, module string, ticker string, timeframe string, as_of string, config_json string, rows_dropped bigint, quality_warning string", ("id",)),
    "gaps": Table(f"{_RUN}, kind string, direction string, created_at date, zone_bottom double, zone_top double, size_atr double, related_id string, status string, max_fill_pct double, first_touch_date date, bars_to_first_touch int, soft_closed_date date, bars_to_soft_closed int, closed_date date, bars_to_closed int, n_approaches bigint, volume_ratio_at_creation double, reaction_atr_after_close double, bars_to_reaction_peak int", ("ticker", "timeframe", "kind", "created_at", "direction"), ("timeframe",), ("id", "zone_bottom", "zone_top", "size_atr")),
    "divergences": Table(f"{_RUN}, indicator string, direction string, p1_date date, p2_date date, p1_price double, p2_price double, strength double, confirmed_at date, max_favorable_move_atr double, invalidated boolean", ("ticker", "timeframe", "indicator", "direction", "p2_date"), ("timeframe",), ("id",)),
    "fib_sets": Table(f"{_RUN}, direction string, origin_date date, end_date date, origin_price double, end_price double, scale double, weight double, status string, invalidated_at date, levels array<struct<ratio:double,kind:string,price:double>>", ("ticker", "timeframe", "origin_date", "end_date"), ("timeframe",), ("id",)),
    "anchors": Table(f"{_RUN}, anchor_date date, roles array<string>, status string, current_value double, updated_through date, distance_atr double, n_crosses bigint, pct_bars_above double, pct_bars_below double, last_cross_date date, avg_reaction_atr_on_touch double", ("ticker", "timeframe", "anchor_date"), ("timeframe",), ("id",)),
    "sr_lines": Table(f"{_RUN}, kind string, geometry double, first_touch date, role string, state string, center double, half_width double, slope double, intercept double, slope_atr double, fit_rms double, regime_start date, last_event date, broken_at date, flipped_at date, age_days int, regime_days int, idle_days int, {_SCORED}, events array<{EVENT}>", ("ticker", "timeframe", "kind", "geometry", "first_touch"), ("timeframe",), ("id",)),
    "patterns": Table(f"{_RUN}, pattern string, formation_start date, formation_end date, direction string, target double, stop double, entry double, status string, breakout_date date, volume_confirmed boolean, confidence double, notes array<string>, key_levels map<string,double>, trendlines map<string,struct<slope:double,intercept:double>>, turns array<struct<kind:string,idx:int,value:double>>", ("ticker", "timeframe", "pattern", "formation_start", "formation_end"), ("timeframe",), ("id", "direction", "target", "stop")),
    "breadth": Table("index_name string, ts date, weighting string, n_constituents bigint, n_with_data bigint, pct_above_sma50 double, pct_above_sma200 double, pct_above_ema8 double, pct_above_ema21 double, pct_golden_cross double, n_advancing double, n_declining double, net_advances double, ad_ratio double", ("index_name", "ts", "weighting"), ("index_name",)),
    "relative_strength": Table("ticker string, ts date, comparison string, benchmark string, rs_ratio double, rs_mansfield double, rs_rating double", ("ticker", "ts", "comparison"), ("comparison",)),
    "pattern_labels": Table("pattern_id string, label string, note string", ("pattern_id",)),
}
