"""Portfolio selection and walk-forward evaluation over daily closes.

Per-ticker statistics and the correlation matrix are Spark aggregates; what runs on the driver works
on the small matrix of candidate tickers only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

YEAR = 252


def complete(closes: DataFrame) -> DataFrame:
    """Tickers with a close on every day that any ticker has one."""
    days = closes.agg(F.countDistinct("ts").alias("n"))
    full = closes.filter("close is not null").groupBy("ticker").agg(F.countDistinct("ts").alias("n")).join(F.broadcast(days), "n").select("ticker")
    return closes.join(full, "ticker", "left_semi")


def gross_returns(closes: DataFrame) -> DataFrame:
    """(ticker, ts, gross): close over the close before it, 1 on the first day."""
    w = Window.partitionBy("ticker").orderBy("ts")
    return closes.select("ticker", "ts", F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(w)), F.lit(1.0)).alias("gross"))


def performance(returns: DataFrame, guard: float = 0.0) -> DataFrame:
    """Per ticker: cumulative return, mean, deviation and annual Sharpe ratio."""
    mean, dev = F.avg("gross"), F.stddev_samp("gross")
    return returns.groupBy("ticker").agg(F.product("gross").alias("cumulative"), mean.alias("mean"), dev.alias("deviation"), (F.try_divide(mean - 1, dev + guard) * np.sqrt(YEAR)).alias("sharpe"))


def correlation(returns: DataFrame) -> DataFrame:
    """(a, b, corr): absolute correlations of every two tickers' gross returns, by day.

    Both orders of a pair are equal, so a < b is enough.  Tickers are a universe chosen beforehand; the join is by
    day, and partial sums leave each task as one row a pair.
    """
    a, b = (returns.select(F.col("ticker").alias(x), "ts", F.col("gross").alias(f"g{x}")) for x in "ab")
    return a.join(b, "ts").filter(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.abs(F.corr("ga", "gb")).alias("corr"))


def select(stats: pd.DataFrame, corr: pd.DataFrame, size: int, start: str = "max", quantile: float = 0.5) -> list[str]:
    """Greedy choice of tickers that move apart: from a first one by cumulative return, always the ticker
    whose largest absolute correlation with those chosen is smallest."""
    order = stats.sort_values(["cumulative", "ticker"])["ticker"].tolist()
    if not order:
        return []
    place = {"max": len(order) - 1, "min": 0, "median": len(order) // 2, "quantile": int(quantile * (len(order) - 1))}[start]
    names = sorted(order)
    at = {t: i for i, t in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for a, b, c in corr[["a", "b", "corr"]].itertuples(index=False):
        m[at[a], at[b]] = m[at[b], at[a]] = 0.0 if c is None or c != c else c
    chosen = [at[order[place]]]
    worst = m[chosen[0]].copy()
    while len(chosen) < min(size, len(names)):
        free = np.setdiff1d(np.arange(len(names)), chosen)
        chosen.append(int(free[np.argmin(worst[free])]))
        worst = np.maximum(worst, m[chosen[-1]])
    return [names[i] for i in chosen]


def evolve(gross: np.ndarray, objective: str = "sharpe", seed: int = 0, population: int = 60, rounds: int = 80) -> np.ndarray:
    """Long-only weights that sum to 1, by a seeded evolutionary search.  ``gross``: (days, tickers)."""
    rng = np.random.default_rng(seed)
    k = gross.shape[1]
    pool = np.concatenate([np.full((1, k), 1 / k), rng.dirichlet(np.ones(k), population - 1)])

    def worth(w: np.ndarray) -> np.ndarray:
        r = gross @ w.T
        return np.log(r).sum(axis=0) if objective == "return" else (r.mean(axis=0) - 1) / (r.std(axis=0, ddof=1) + 1e-9)

    for r in range(rounds):
        best = pool[np.argsort(-worth(pool), kind="stable")[: population // 4]]
        pairs = rng.integers(0, len(best), (population - len(best), 2))
        mix = rng.random((len(pairs), 1))
        child = mix * best[pairs[:, 0]] + (1 - mix) * best[pairs[:, 1]]
        child = np.abs(child + rng.normal(0, 0.1 * 0.97**r, child.shape))
        pool = np.concatenate([best, child / child.sum(axis=1, keepdims=True)])
    return pool[int(np.argmax(worth(pool)))]


def random_baseline(gross: np.ndarray, many: int = 1000, seed: int = 0) -> np.ndarray:
    """Sharpe ratios of portfolios with random weights."""
    w = np.random.default_rng(seed).dirichlet(np.ones(gross.shape[1]), many)
    r = gross @ w.T
    return (r.mean(axis=0) - 1) / r.std(axis=0, ddof=1) * np.sqrt(YEAR)


#: How many tickers a configuration selects (null: all) and where the selection begins.
SIZES, PIVOTS = (5, 10, 15, 20), ("max", "min", "median")
WALK = "year int, objective string, size int, pivot string, tickers array<string>, weights array<double>, cumulative double, sharpe double, uniform_cumulative double, uniform_sharpe double"


def correlations_of(gross: np.ndarray) -> np.ndarray:
    """Absolute correlations of columns; 0 where one doesn't vary."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num(np.abs(np.corrcoef(gross, rowvar=False))).reshape(gross.shape[1], gross.shape[1])


def chosen_on(past: np.ndarray, names: list[str], size: int | None, pivot: str) -> list[int]:
    """Columns of a configuration: :func:`select` on the training days alone."""
    if size is None:
        return list(range(len(names)))
    stats = pd.DataFrame({"ticker": names, "cumulative": past.prod(axis=0)})
    m = correlations_of(past)
    pairs = pd.DataFrame([(names[i], names[j], m[i, j]) for i in range(len(names)) for j in range(i + 1, len(names))], columns=["a", "b", "corr"])
    at = {t: i for i, t in enumerate(names)}
    return [at[t] for t in select(stats, pairs, size, pivot)]


def walk_forward(returns: DataFrame, years: list[int], objectives: tuple[str, ...] = ("sharpe", "return"), seed: int = 0, *, configurations: tuple[tuple[int | None, str], ...] = ((None, "max"),), membership: DataFrame | None = None) -> DataFrame:
    """Weights fitted on all days up to a year's start (included), judged on the year.

    Each (size, pivot) configuration selects its tickers anew on each training window; with ``membership``
    (ticker, start_date, end_date) only among the members on its last day.  One task a year has that year's history once and works off
    the configurations; the same tickers under one objective get the same weights.
    """
    # a fit needs its whole history: rows go out once for each year at or after them
    dealt = returns.select("ticker", "ts", "gross", F.explode(F.array(*map(F.lit, years))).alias("year")).filter(F.year("ts") <= F.col("year"))
    if membership is not None:
        day = F.make_date("year", F.lit(1), F.lit(1))
        held = membership.select(F.col("ticker").alias("_t"), "start_date", "end_date")
        inside = (F.col("ticker") == F.col("_t")) & (F.col("start_date") <= day) & (F.col("end_date").isNull() | (F.col("end_date") >= day))
        dealt = dealt.join(held, inside, "left_semi")
    columns = [c.split()[0] for c in WALK.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        year = int(pdf["year"].iloc[0])
        wide = pdf.pivot_table(index="ts", columns="ticker", values="gross").sort_index().fillna(1.0)
        begin = np.datetime64(f"{year}-01-01")
        days = pd.to_datetime(wide.index).to_numpy()
        past, test, names = wide.to_numpy()[days <= begin], wide.to_numpy()[days >= begin], list(wide.columns)
        if len(past) < 3 or len(test) < 3:
            return pd.DataFrame(columns=columns)
        rows, fitted = [], {}
        for size, pivot in configurations:
            own = chosen_on(past, names, size, pivot)
            for objective in objectives:
                key = (tuple(sorted(own)), objective)
                if key not in fitted:
                    fitted[key] = evolve(past[:, list(key[0])], objective, seed + year)
                w, judged, out = fitted[key], test[:, list(key[0])], []
                for x in (w, np.full(len(w), 1 / len(w))):
                    r = judged @ x
                    out += [float(r.prod()), float((r.mean() - 1) / (r.std(ddof=1) + 1e-9) * np.sqrt(YEAR))]
                rows.append((year, objective, size, pivot, [names[i] for i in key[0]], w.tolist(), *out))
        return pd.DataFrame(rows, columns=columns).astype({"size": "Int32"})

    return dealt.groupBy("year").applyInPandas(run, WALK)


def constituents_on(current: DataFrame, changes: DataFrame, day: str) -> DataFrame:
    """Members on a past day: today's, without what was added after it, with what was removed after it.

    Of several changes to one ticker after the day the first decides: added first, it was not a member; removed first, it was.
    """
    later = changes.filter(F.col("date") > F.lit(day).cast("date"))
    first = later.groupBy("ticker").agg(F.min_by("action", F.struct("date", "action")).alias("action"))
    kept = current.select("ticker").join(first, "ticker", "left_anti")
    return kept.unionByName(first.filter("action = 'removed'").select("ticker")).distinct()
