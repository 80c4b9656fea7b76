"""The store: pointers, merging, partitions, ledgers; ingest with resume."""

from datetime import date, datetime

import pytest

from tidemark import ingest, jobs
from tidemark.operators import bars as br
from tidemark.sources.store import Store

BARS = "ticker string, ts timestamp_ntz, source string, open double, high double, low double, close double, volume double"


def bar(ticker, day, close, source="a"):
    return (ticker, datetime.fromisoformat(day), source, close, close + 1, close - 1, close, 10.0)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def test_upserts_merge_by_key_and_partition(spark, store):
    first = [bar("A", "2020-12-30", 10.0), bar("A", "2021-01-04", 11.0), bar("B", "2021-01-04", 20.0), bar("A", "2021-01-04", 99.0, "b")]
    assert store.upsert("bars_1d", spark.createDataFrame(first, BARS)) == 3  # a/2020, a/2021, b/2021
    later = [bar("A", "2021-01-04", 12.0), bar("A", "2021-01-04", 13.0), bar("C", "2021-01-05", 30.0), ("D", datetime(2021, 1, 5), "a", 5.0, 4.0, 6.0, 5.0, 1.0)]
    assert store.upsert("bars_1d", spark.createDataFrame(later, BARS).coalesce(1)) == 1
    got = {(r["ticker"], str(r["ts"].date()), r["source"], r["close"]) for r in store.read("bars_1d").collect()}
    assert got == {("A", "2020-12-30", "a", 10.0), ("A", "2021-01-04", "a", 13.0), ("B", "2021-01-04", "a", 20.0), ("A", "2021-01-04", "b", 99.0), ("C", "2021-01-05", "a", 30.0)}
    assert store.upsert("bars_1d", spark.createDataFrame([], BARS)) == 0
    # reads by source and time open only the partitions that can hold such bars
    assert store._bar_parts("bars_1d", "a", "2021-01-01", None) == ["a/2021"]
    assert [r["close"] for r in store.bars(ticker="A", source="a", start="2020-12-01", end="2021-12-31").collect()] == [10.0, 13.0]
    assert store.bars(source="a", end="2020-12-31", ordered=False).count() == 1


def test_a_failed_write_changes_nothing_and_writers_collide(spark, store):
    schema = "ticker string, name string, type string, active boolean, delisted_utc string"
    store.upsert("tickers", spark.createDataFrame([("A", "a", "CS", True, None)], schema))
    number, parts = store._pointer("tickers")
    with pytest.raises(RuntimeError, match="another writer"):
        store._point("tickers", number, {})
    assert store._pointer("tickers") == (number, parts) and store.read("tickers").count() == 1
    broken = spark.createDataFrame([("B", "b", "CS", True, None)], schema).selectExpr("ticker", "raise_error('x') AS name", "type", "active", "delisted_utc")
    with pytest.raises(Exception, match="x"):
        store.upsert("tickers", broken)
    assert [r["ticker"] for r in store.read("tickers").collect()] == ["A"]
    for n in range(8):
        store.upsert("tickers", spark.createDataFrame([("A", f"a{n}", "CS", True, None)], schema))
    assert len(store._pointers("tickers")) <= 5 and store.read("tickers").first()["name"] == "a7"
    with pytest.raises(PermissionError):
        Store(spark, store.root, read_only=True).upsert("tickers", broken.limit(0).union(spark.createDataFrame([("C", "c", "CS", True, None)], schema)))


def test_replacing_with_nothing_empties(spark, store):
    schema = "index_name string, ticker string, start_date date, end_date date"
    store.replace("index_membership", spark.createDataFrame([("x", "A", date(2020, 1, 1), None), ("y", "B", date(2020, 1, 1), None)], schema))
    store.replace("index_membership", spark.createDataFrame([], schema), ["x"])
    assert [r["ticker"] for r in store.read("index_membership").collect()] == ["B"]


def test_ledger_keeps_the_last_outcome(spark, store):
    rows = [("t", "k", "success", None, 3), ("t", "k", "failed", "late", 1), ("t", "j", "failed", "e", 2)]
    for parts in (1, 3):
        store.record_jobs(spark.createDataFrame(rows, "job_type string, key string, status string, last_error string, seq long").repartition(parts), "seq")
    got = {r["key"]: (r["status"], r["last_error"], r["attempts"]) for r in store.read("fetch_jobs").collect()}
    assert got == {"k": ("success", None, 4), "j": ("failed", "e", 2)}


def test_ingest_resumes(spark, store):
    keys = spark.createDataFrame([(k, n) for n, k in enumerate("ABCD")], "key string, pos int")
    asked, down = [], {"C"}

    def fetch(key):
        asked.append(key)
        if key in down:
            raise OSError("away")
        return [] if key == "D" else [bar(key, "2021-01-04", 10.0)]

    assert ingest.ingest(store, "daily", "bars_1d", keys, fetch, BARS, batch=2) == ingest.Outcome(3, 1, 2)
    assert asked == ["A", "B", "C", "C", "D"]
    down.clear()
    asked.clear()
    assert ingest.ingest(store, "daily", "bars_1d", keys, fetch, BARS) == ingest.Outcome(1, 0, 1) and asked == ["C"]
    assert store.read("bars_1d").count() == 3 and store.pending("daily", keys).count() == 0


def test_sources_must_not_mix(spark):
    mixed = spark.createDataFrame([bar("A", "2021-01-04", 10.0), bar("A", "2021-01-05", 10.0, "b")], BARS)
    with pytest.raises(Exception, match="mixes sources"):
        br.load(mixed).collect()
    assert br.load(mixed, source="a").count() == 1 and br.load(mixed.filter("source = 'b'")).count() == 1


def test_membership_job(spark, store, tmp_path):
    (tmp_path / "landed.csv").write_text("index_name,ticker,snapshot\nx,A,2020-01-01\nx,B,2020-01-01\nx,A,2020-02-01\nx,B,2020-03-01\nx,A,2020-03-01\n")
    args = jobs.parser().parse_args(["membership", "--store", store.root, "--index", "x", "--landed", f"file://{tmp_path}/landed.csv"])
    got = {(r["ticker"], str(r["start_date"]), str(r["end_date"])) for r in jobs.run(spark, args).collect()}
    assert got == {("A", "2020-01-01", "None"), ("B", "2020-01-01", "2020-01-31"), ("B", "2020-03-01", "None")}


def test_labels_and_fib_sets(spark, store):
    store.label(spark.createDataFrame([("p", "good", None)], "pattern_id string, label string, note string"))
    store.label(spark.createDataFrame([("p", "bad", "why")], "pattern_id string, label string, note string"))
    assert [tuple(r) for r in store.read("pattern_labels").collect()] == [("p", "bad", "why")]
    kind = "ticker string, origin_date date, end_date date, levels array<struct<ratio:double,kind:string,price:double>>"
    store.save_results("fib_sets", spark.createDataFrame([("A", date(2020, 1, 1), date(2020, 2, 1), [(0.618, "retracement", 3.0), (0.5, "retracement", 4.0)])], kind), "run", "daily")
    set_id = store.read("fib_sets").first()["id"]
    own, levels = store.fib_set(set_id)
    assert own.count() == 1 and [r["price"] for r in levels.collect()] == [4.0, 3.0]
