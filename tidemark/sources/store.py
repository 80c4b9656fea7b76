"""A store of tables as Parquet folders, with idempotent upserts.

An upsert rewrites only the partitions that its rows fall into: old and new rows of those are grouped by
key, and the new one wins, but for the columns a table declares fixed, which keep their first value.
All of it is one write, to a folder of its own.  What a table consists of stands in a pointer file, and each change adds
a pointer with the next number: readers take the newest, so they see the table before a change or after it and
never half of it, and a job that fails in between has changed nothing.  Two writers that start from the same
pointer can't both succeed: the second finds its number taken and fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.bars import sound
from tidemark.sources.schemas import DERIVED, RAW, Table

#: Older pointers that stay, for readers that have just looked one up.
KEPT_POINTERS = 5
PART = "_part"


class Store:
    """Tables under one folder; ``tables`` names their schemas.  A ``read_only`` store refuses every change."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table] | None = None, *, read_only: bool = False):
        self.spark, self.root, self.tables, self.read_only = spark, root.rstrip("/"), tables or RAW | DERIVED, read_only

    def _table(self, name: str) -> Table:
        if name not in self.tables:
            raise ValueError(f"unknown table {name!r}")
        return self.tables[name]

    # A pointer maps each partition ("" where a table has none) to its folder; Hadoop's file system reads and writes it.
    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _pointers(self, name: str) -> list[int]:
        """Numbers of the table's pointers, ascending."""
        fs, folder = self._fs(f"{self.root}/{name}/_pointers")
        if not fs.exists(folder):
            return []
        found = (str(f.getPath().getName()) for f in fs.listStatus(folder))
        return sorted(int(x.removesuffix(".json")) for x in found if x.endswith(".json"))

    def _pointer(self, name: str) -> tuple[int, dict[str, str]]:
        """(number, partitions) of the newest pointer; (0, none) before the first write."""
        numbers = self._pointers(name)
        if not numbers:
            return 0, {}
        fs, p = self._fs(f"{self.root}/{name}/_pointers/{numbers[-1]:012d}.json")
        stream = fs.open(p)
        try:
            return numbers[-1], json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _point(self, name: str, number: int, parts: dict[str, str]) -> None:
        """Add pointer ``number``: written beside, then renamed to its place, which must be free."""
        folder = f"{self.root}/{name}/_pointers"
        fs, tmp = self._fs(f"{folder}/{uuid.uuid4().hex}.tmp")
        stream = fs.create(tmp)
        stream.write(bytearray(json.dumps(parts).encode()))
        stream.close()
        _, target = self._fs(f"{folder}/{number:012d}.json")
        if fs.exists(target) or not fs.rename(tmp, target):
            fs.delete(tmp, False)
            raise RuntimeError(f"{name} was changed by another writer; try again")
        for old in self._pointers(name)[:-KEPT_POINTERS]:
            fs.delete(self._fs(f"{folder}/{old:012d}.json")[1], False)

    def read(self, name: str, parts: list[str] | None = None) -> DataFrame:
        """A table, or some partitions of it, as it stands; empty, with its columns, before the first write."""
        table, held = self._table(name), self._pointer(name)[1]
        paths = sorted(path for part, path in held.items() if parts is None or part in parts)
        if not paths:
            return self.spark.createDataFrame([], table.columns)
        return self.spark.read.schema(table.columns).parquet(*paths)

    def _write(self, name: str, rows: DataFrame, touched: list[str], number: int, versions: dict[str, str]) -> None:
        """Put ``rows`` in place of the ``touched`` partitions, those without a row becoming empty."""
        if self.read_only:
            raise PermissionError(f"{self.root} is open for reading only")
        table = self._table(name)
        folder = f"{self.root}/{name}/v-{uuid.uuid4().hex}"
        place = {part: i for i, part in enumerate(touched)}
        numbers = F.create_map(*[F.lit(x) for pair in place.items() for x in pair]) if place else F.create_map(F.lit(""), F.lit(0))
        rows.withColumn(PART, numbers[self._part(table)]).select(*table.names, PART).hint("rebalance", F.col(PART)).write.partitionBy(PART).parquet(folder)
        fs, _ = self._fs(folder)
        out = {part: path for part, path in versions.items() if part not in place}
        out |= {part: f"{folder}/{PART}={i}" for part, i in place.items() if fs.exists(self._fs(f"{folder}/{PART}={i}")[1])}
        self._point(name, number + 1, out)

    @staticmethod
    def _part(table: Table) -> Column:
        return F.concat_ws("/", *[F.coalesce(F.expr(c).cast("string"), F.lit("")) for c in table.partition]) if table.partition else F.lit("")

    def _parts(self, table: Table, rows: DataFrame) -> list[str]:
        return sorted(r[0] for r in rows.select(self._part(table).alias("p")).distinct().collect())

    def upsert(self, name: str, rows: DataFrame) -> int:
        """Merge ``rows`` by key, the later of two with one key winning; returns how many partitions were rewritten.

        Bars with unsound prices are not let in.
        """
        table = self._table(name)
        if name.startswith("bars_"):
            rows = rows.filter(sound(with_volume=False))
        for c, kind in (x.split(" ", 1) for x in table.columns.split(", ") if " " in x):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(kind))
        kinds = dict(x.split(" ", 1) for x in table.columns.split(", ") if " " in x)
        rows = rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in table.names])
        touched = self._parts(table, rows)
        if not touched:
            return 0
        new = rows.withColumn("_seq", F.monotonically_increasing_id()).withColumn("_new", F.lit(1))
        number, versions = self._pointer(name)
        held = sorted({versions[p] for p in touched if p in versions})
        old = self.spark.read.schema(table.columns).parquet(*held) if held else self.spark.createDataFrame([], table.columns)
        both = old.withColumn("_seq", F.lit(0).cast("long")).withColumn("_new", F.lit(0)).unionByName(new)
        w = Window.partitionBy(*table.key).orderBy(F.col("_new").desc(), F.col("_seq").desc())
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first = lambda c: F.last(c, ignorenulls=True).over(whole)  # noqa: E731  the oldest row sorts last
        merged = both.withColumns({c: first(c) for c in table.fixed}).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_seq", "_new")
        self._write(name, merged, touched, number, versions)
        return len(touched)

    def replace(self, name: str, rows: DataFrame, parts: Iterable[str] = ()) -> None:
        """Put ``rows`` in place of everything in the partitions they fall into and in ``parts``, which may become empty."""
        table = self._table(name)
        number, versions = self._pointer(name)
        self._write(name, rows, sorted({*self._parts(table, rows), *parts}), number, versions)

    # Readers --------------------------------------------------------------------------------------

    def _bar_parts(self, table: str, source: str | None, start: str | None, end: str | None) -> list[str]:
        """Partitions (source/year) that can hold bars of a source between two days."""
        lo, hi = (date.fromisoformat(x[:10]).year if x else None for x in (start, end))
        out = []
        for part in self._pointer(table)[1]:
            own, _, year = part.rpartition("/")
            if (source is None or own == source) and (lo is None or not year or int(year) >= lo) and (hi is None or not year or int(year) <= hi):
                out.append(part)
        return out

    def bars(self, table: str = "bars_1d", ticker: str | Iterable[str] | None = None, source: str | None = None, start: str | None = None, end: str | None = None, *, ordered: bool = True) -> DataFrame:
        """Bars by optional conditions, both ends included; columns pinned to one value are dropped.

        Only partitions that can hold such bars are read.  Jobs that group by ticker anyway spare the order.
        """
        out, pinned = self.read(table, self._bar_parts(table, source, start, end)), []
        for column, value in (("ticker", ticker), ("source", source)):
            if isinstance(value, str):
                out, pinned = out.filter(F.col(column) == value), [*pinned, column]
            elif value is not None:
                out = out.filter(F.col(column).isin(list(value)))
        if start:
            out = out.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
        if end:
            out = out.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
        out = out.drop(*pinned)
        return out.orderBy("ts") if ordered else out

    def tickers(self, kind: str | None = None, active: bool | None = None) -> DataFrame:
        out = self.read("tickers")
        out = out if kind is None else out.filter(F.col("type") == kind)
        return out if active is None else out.filter(F.col("active") == active)

    def members(self, index: str, as_of: str | None = None) -> DataFrame:
        out = self.read("index_membership").filter(F.col("index_name") == index)
        if as_of:
            day = F.lit(as_of).cast("date")
            out = out.filter((F.col("start_date") <= day) & (F.col("end_date").isNull() | (F.col("end_date") >= day)))
        return out

    def universe(self, indices: list[str]) -> DataFrame:
        return self.read("index_membership").filter(F.col("index_name").isin(indices)).select("ticker").distinct().orderBy("ticker")

    # Ledgers --------------------------------------------------------------------------------------

    def record_jobs(self, results: DataFrame, order: str | None = None) -> None:
        """Log (job_type, key, status, last_error) outcomes; attempts add up over all calls.

        Of several outcomes of one key the last by the column ``order`` stays, without one the last row.
        """
        before = self.read("fetch_jobs").select("job_type", "key", F.col("attempts").alias("_before"))
        placed = results.withColumn("_at", F.col(order) if order else F.monotonically_increasing_id())
        made = placed.groupBy("job_type", "key").agg(F.max_by(F.struct("status", "last_error"), "_at").alias("last"), F.count(F.lit(1)).cast("int").alias("_now")).select("job_type", "key", "last.*", "_now")
        self.upsert("fetch_jobs", made.join(before, ["job_type", "key"], "left").withColumn("attempts", F.coalesce("_before", F.lit(0)) + F.col("_now")))

    def pending(self, job_type: str, keys: DataFrame) -> DataFrame:
        """Keys (key, pos) without a success yet, in their order."""
        done = self.read("fetch_jobs").filter((F.col("job_type") == job_type) & (F.col("status") == "success"))
        return keys.join(done, "key", "left_anti").orderBy("pos")

    def record_run(self, module: str, ticker: str, timeframe: str, config: dict, as_of: str | None = None, rows_dropped: int = 0, warning: str | None = None) -> str:
        run_id = str(uuid.uuid4())
        row = [(run_id, module, ticker, timeframe, as_of, json.dumps(config, sort_keys=True), rows_dropped, warning)]
        self.upsert("runs", self.spark.createDataFrame(row, self._table("runs").columns))
        return run_id

    def key_id(self, name: str, **given: Column) -> Column:
        """An id that follows from a row's key (with some of its columns ``given`` otherwise), the same on every run."""
        return F.substring(F.sha2(F.concat_ws("|", F.lit(name), *[given.get(c, F.col(c)).cast("string") for c in self._table(name).key]), 256), 1, 32)

    def save_results(self, name: str, found: DataFrame, run_id: str, timeframe: str) -> int:
        """Upsert a detector's rows; keys seen before keep their id and fixed columns, gone ones stay."""
        out = found.withColumn("run_id", F.lit(run_id)).withColumn("timeframe", F.lit(timeframe))
        if name == "gaps" and "related" in found.columns:  # a fair-value gap points to the classic gap on its bar and side
            out = out.withColumn("related_id", F.when(F.col("related"), self.key_id(name, kind=F.lit("classic"))))
        return self.upsert(name, out.withColumn("id", self.key_id(name)))

    def fib_set(self, set_id: str) -> tuple[DataFrame, DataFrame]:
        """One Fibonacci set and its levels (ratio, kind, price), by ratio."""
        own = self.read("fib_sets").filter(F.col("id") == set_id)
        return own, own.select(F.explode("levels").alias("l")).select("l.*").orderBy("ratio")

    def label(self, labels: DataFrame) -> int:
        """Set (pattern_id, label, note) of patterns; a pattern's label may change, and each pattern has one."""
        return self.upsert("pattern_labels", labels)

    def labelled(self) -> DataFrame:
        """Patterns with their label, where they have one."""
        return self.read("patterns").join(self.read("pattern_labels").withColumnRenamed("pattern_id", "id"), "id", "left")

    def with_config(self, results: DataFrame, field: str = "fill_by") -> DataFrame:
        """Results joined with a field of the configuration of the run that made them; rows without a run drop out."""
        runs = self.read("runs").select(F.col("id").alias("run_id"), F.get_json_object("config_json", f"$.{field}").alias(field))
        return results.join(runs, "run_id")
