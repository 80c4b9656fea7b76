"""Jobs over a small store, run twice: the second run changes nothing that stays."""

import math
from datetime import datetime, timedelta

import pytest

from tidemark import jobs
from tidemark.sources.store import Store


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('store')}"
    rows, day = [], datetime(2020, 1, 1)
    for i in range(420):
        day += timedelta(3 if day.weekday() == 4 else 1)
        for t, f in (("AAA", 1.0), ("BBB", 1.7), ("SPY", 0.4)):
            c = 100 + 25 * math.sin(i * f / 17) + 8 * math.sin(i * f / 5) + i * 0.05
            rows.append((t, day, "yfinance", c - 0.4, c + 1, c - 1, c, 1000.0 + i))
    s = Store(spark, at)
    s.upsert("bars_1d", spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, source string, open double, high double, low double, close double, volume double"))
    s.replace("index_membership", spark.createDataFrame([("sp500", t, datetime(2019, 1, 1).date(), None) for t in ("AAA", "BBB")], "index_name string, ticker string, start_date date, end_date date"))
    return at


@pytest.mark.parametrize("job", jobs.DETECTORS)
def test_detectors_are_idempotent(spark, root, job):
    a = jobs.parser().parse_args([job, "--store", root])
    first = {r["id"] for r in jobs.run(spark, a).select("id").collect()}
    again = {r["id"] for r in jobs.run(spark, a).select("id").collect()}
    assert first == again
    assert Store(spark, root).read("runs").filter(f"module = '{job}'").count() == 2


def test_other_jobs(spark, root, tmp_path):
    args = lambda *x: jobs.parser().parse_args([*x, "--store", root])
    weekly = jobs.run(spark, args("resample"))
    assert weekly.select("ticker").distinct().count() == 3 and jobs.run(spark, args("resample")).count() == weekly.count()
    assert jobs.run(spark, args("breadth")).count() == 420
    assert jobs.run(spark, args("strength")).select("ticker").distinct().count() == 2
    assert jobs.run(spark, args("compare")).count() == 0
    jobs.main(["breadth", "--store", root, "--csv", f"{tmp_path}/csv"])
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 420
