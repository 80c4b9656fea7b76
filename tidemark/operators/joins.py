"""Joins over time: as-of, interval membership, products of later events, date alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(left: DataFrame, right: DataFrame, values: list[str], *, by: list[str], on: str) -> DataFrame:
    """``left`` with the ``values`` of the last right row at or before it, by key; null before the first.

    Both sides are laid into one stream and the last right row is carried along a running window: one
    shuffle by key, no row is compared with more than its predecessor.  Right rows on the same
    moment count in the order they sort as values; a right row's nulls are carried as they are.
    """
    name = "_seen"
    whole = F.struct(*left.columns)
    old = right.groupBy(*by, on).agg(F.max(F.struct(*values)).alias(name))
    seen_type, row_type = old.schema[name].dataType, left.select(whole.alias("r")).schema["r"].dataType
    facts = old.select(*by, F.col(on).alias("_on"), F.lit(0).alias("_side"), name, F.lit(None).cast(row_type).alias("_row"))
    asked = left.select(*by, F.col(on).alias("_on"), F.lit(1).alias("_side"), F.lit(None).cast(seen_type).alias(name), whole.alias("_row"))
    # without keys the stream is one series in time: left and right are then a calendar, not a fact table
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_on", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = facts.unionByName(asked).withColumn(name, F.last(name, ignorenulls=True).over(w)).filter("_side = 1")
    return carried.select("_row.*", *[F.col(f"{name}.{v}").alias(v) for v in values])


def within(rows: DataFrame, intervals: DataFrame, key: str = "ticker", day: str = "ts") -> DataFrame:
    """Rows on days inside one of their key's [start_date, end_date] intervals; an open end is null."""
    inside = (F.col(day) >= F.col("start_date")) & (F.col("end_date").isNull() | (F.col(day) <= F.col("end_date")))
    held = intervals.select(F.col(key).alias("_key"), "start_date", "end_date")
    return rows.join(held, (F.col(key) == F.col("_key")) & inside).drop("_key", "start_date", "end_date")


def later_product(rows: DataFrame, events: DataFrame, *, key: str = "ticker", day: str = "ts", event_day: str = "execution_date", factor: str = "ratio", name: str = "split_ratio") -> DataFrame:
    """The product of ``factor`` over the key's events strictly after each row; 1 without any.

    The product of the events still to come is worked out once for each event, by a window over the
    events alone, and each row takes that of the first event after it through one as-of pass on
    negated days: the event strictly after a day is the last one before it in reverse.
    """
    backwards = Window.partitionBy(key).orderBy(F.col(event_day).desc()).rowsBetween(Window.unboundedPreceding, 0)
    daily = events.groupBy(key, event_day).agg(F.product(factor).alias("_factor"))
    running = daily.withColumn(name, F.product("_factor").over(backwards)).select(key, (-F.unix_date(event_day)).alias("_back"), name)
    asked = rows.withColumn("_back", -F.unix_date(F.col(day).cast("date")) - 1)
    return as_of(asked, running, [name], by=[key], on="_back").drop("_back").withColumn(name, F.coalesce(name, F.lit(1.0)))


def published_as_of(days: DataFrame, macro: DataFrame, on: str = "ts") -> DataFrame:
    """Each day's macro value as first published, by the publication date; of values published on one
    day the one for the latest period counts.  Rows that were never published take no part."""
    w = Window.partitionBy("published_at").orderBy(F.col("date").desc())
    known = macro.filter(F.col("published_at").isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    right = known.select(F.col("published_at").alias(on), F.col("first_published_value").alias("macro_value"))
    return as_of(days, right, ["macro_value"], by=[], on=on)


def aligned(a: DataFrame, b: DataFrame, day: str = "ts") -> DataFrame:
    """(day, a, b) where both have a value on the day."""
    return a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), day)


def differing(a: DataFrame, b: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Days on which two sources' closes differ by more than ``tolerance`` of the second's."""
    left, right = (x.select("ticker", "ts", F.col("close").alias(c)) for x, c in ((a, "close_a"), (b, "close_b")))
    return left.join(right, ["ticker", "ts"]).withColumn("pct_diff", F.try_divide(F.abs(F.col("close_a") - F.col("close_b")), F.col("close_b"))).filter(F.col("pct_diff") > tolerance)


def islands(rows: DataFrame, key: list[str], order: str, gap: int) -> DataFrame:
    """Numbers runs within a key: a new ``island`` starts where ``order`` leaps by more than ``gap``."""
    w = Window.partitionBy(*key).orderBy(order)
    leap = (F.col(order) - F.lag(order).over(w)) > gap
    marked = rows.withColumn("_new", F.when(F.lag(order).over(w).isNull() | leap, 1).otherwise(0))
    return marked.withColumn("island", F.sum("_new").over(w)).drop("_new")


def presence_intervals(snapshots: DataFrame) -> DataFrame:
    """Membership intervals from (index_name, ticker, snapshot) rows taken at change dates.

    A run of consecutive snapshots is one interval; it ends the day before the next snapshot, and has no
    end if it reaches the last one.
    """
    taken = snapshots.select("index_name", "snapshot").distinct()
    w = Window.partitionBy("index_name").orderBy("snapshot")
    dated = taken.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead("snapshot").over(w))
    runs = islands(snapshots.distinct().join(dated, ["index_name", "snapshot"]), ["index_name", "ticker"], "_n", 1)
    return runs.groupBy("index_name", "ticker", "island").agg(F.min("snapshot").alias("start_date"), F.date_sub(F.max_by("_next", "_n"), 1).alias("end_date")).drop("island")
