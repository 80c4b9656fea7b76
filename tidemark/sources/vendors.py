"""Vendors' payloads as frames.

Fetching itself belongs to whoever has the network and the keys: responses land as JSON files, one for
each ticker or day, and everything from there on is distributed.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Series that count as published on the day they are quoted for.
SAME_DAY = ("DFF", "DGS3MO", "DGS2", "DGS10", "T10Y2Y", "VIXCLS", "SP500")
#: A result is a map, as its names T and t differ by case alone.
PAYLOAD = "ticker string, results array<map<string,string>>"


def landed_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Bars of a folder of JSON payloads, one object a line: ``{"ticker": ..., "results": [{"t": epoch ms, "o", "h", "l", "c", "v"}]}``.

    A result may name its own ticker (``T``), as those of a whole day do; a payload without results gives no rows.
    """
    each = spark.read.schema(PAYLOAD).json(folder).select("ticker", F.explode("results").alias("r"))
    field = lambda name, kind: F.col("r")[name].cast(kind)
    moment = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (field("t", "bigint") / 1000).cast("decimal(18,6)"))
    prices = [field(c, "double").alias(name) for c, name in zip("ohlcv", ("open", "high", "low", "close", "volume"), strict=True)]
    return each.select(F.coalesce(field("T", "string"), "ticker").alias("ticker"), moment.alias("ts"), *prices)


def splits(landed: DataFrame) -> DataFrame:
    """(ticker, execution_date, split_from, split_to, ratio), in order."""
    return landed.select("ticker", F.col("execution_date").cast("date"), F.col("split_from").cast("double"), F.col("split_to").cast("double")).withColumn("ratio", F.try_divide("split_to", "split_from")).orderBy("ticker", "execution_date")


def tickers(landed: DataFrame) -> DataFrame:
    """The universe's pages (ticker, name, type, active, delisted_utc) as one row a ticker: the active one, else the one delisted last."""
    best = F.struct(F.coalesce(F.col("active").cast("boolean"), F.lit(False)).alias("active"), F.col("delisted_utc"), F.col("name"), F.col("type"))
    return landed.filter("ticker is not null").groupBy("ticker").agg(F.max(best).alias("b")).select("ticker", "b.name", "b.type", "b.active", "b.delisted_utc")


def metadata(landed: DataFrame) -> DataFrame:
    """Details of tickers as a vendor nests them under ``results``; fields it leaves out are null."""
    fields = {"market_cap": "double", "sic_code": "string", "sic_description": "string", "share_class_shares_outstanding": "double", "weighted_shares_outstanding": "double", "total_employees": "bigint", "primary_exchange": "string", "list_date": "string"}
    kinds = ", ".join(f"{c} {k}" for c, k in {"ticker": "string", **fields}.items())
    return landed.select(F.from_json(F.get_json_object("body", "$.results"), kinds).alias("r")).select("r.*").filter("ticker is not null")


def sectors(landed: DataFrame) -> DataFrame:
    """(ticker, sector, industry) where either is known."""
    return landed.select("ticker", F.nullif(F.trim("sector"), F.lit("")).alias("sector"), F.nullif(F.trim("industry"), F.lit("")).alias("industry")).filter("sector is not null or industry is not null")


def observations(landed: DataFrame) -> DataFrame:
    """Macro observations (series_id, date, value) without the vendor's missing-value mark."""
    return landed.filter(F.col("value") != ".").select("series_id", F.col("date").cast("date"), F.col("value").cast("double"))


def with_publication(values: DataFrame, first: DataFrame | None = None, same_day: tuple[str, ...] = SAME_DAY) -> DataFrame:
    """Values with when and as what they were first published.  Series quoted daily, and series without any
    publication record, count as published on their own date."""
    if first is None:
        return values.withColumn("published_at", F.col("date")).withColumn("first_published_value", F.col("value"))
    known = first.select("series_id").distinct().withColumn("_known", F.lit(True))
    out = values.join(first.select("series_id", "date", "published_at", "first_published_value"), ["series_id", "date"], "left").join(known, "series_id", "left")
    own = F.col("series_id").isin(*same_day) | F.col("_known").isNull()
    return out.withColumn("published_at", F.when(own, F.col("date")).otherwise(F.col("published_at"))).withColumn("first_published_value", F.when(own, F.col("value")).otherwise(F.col("first_published_value"))).drop("_known")


def latest_each_day(shares: DataFrame) -> DataFrame:
    """Share counts (ticker, moment, shares_outstanding) as one a day: the last reported."""
    return shares.groupBy("ticker", F.col("moment").cast("date").alias("ts")).agg(F.max_by("shares_outstanding", "moment").alias("shares_outstanding"))


def unstacked(wide: DataFrame, tickers: list[str], fields: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """A batch with columns ``TICKER_field`` as rows; rows without any value drop out."""
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("ticker"), *[F.col(f"`{t}_{f}`").cast("double").alias(f) for f in fields]) for t in tickers]))
    return wide.select("ts", each.alias("b")).select("b.ticker", "ts", *[f"b.{f}" for f in fields]).dropna(how="all", subset=list(fields))


def membership_csv(spark: SparkSession, path: str, index: str) -> DataFrame:
    """Intervals that come as such: ticker, start_date, end_date."""
    return spark.read.csv(path, header=True).select(F.lit(index).alias("index_name"), "ticker", F.col("start_date").cast("date"), F.col("end_date").cast("date"))


def source_age(spark: SparkSession, path: str, now: float | None = None) -> int:
    """Whole days since a landed file or folder last changed, by its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    changed = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).getModificationTime() / 1000
    return int(((time.time() if now is None else now) - changed) // 86_400)


def stale_source(age_days: int, most: int = 90) -> str | None:
    return f"source has not changed for {age_days} days" if age_days > most else None


class RateLimiter:
    """At most ``calls`` within any ``seconds``."""

    def __init__(self, calls: int = 5, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.calls, self.seconds, self.clock, self.sleep = calls, seconds, clock, sleep
        self.made: deque[float] = deque()

    def wait(self) -> None:
        now = self.clock()
        while self.made and now - self.made[0] >= self.seconds:
            self.made.popleft()
        if len(self.made) >= self.calls:
            self.sleep(self.seconds - (now - self.made[0]))
            now = self.clock()
            self.made.popleft()
        self.made.append(now)


def attempt(fn: Callable, tries: int = 2):
    """(result, None), or (None, the last error) after ``tries`` failures."""
    error = None
    for _ in range(tries):
        try:
            return fn(), None
        except Exception as e:  # noqa: BLE001  a job logs any failure and goes on
            error = e
    return None, str(error)
