"""Ingest with resume: what a client fetches key by key goes to a table, and a ledger says what is done.

The client is whatever the caller has: a function from a key to rows.  Vendors allow a few calls a minute, so the driver
walks the keys; their rows are upserted and logged by the batch, and a run that was cut off goes on with the keys
that have no success yet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import batched

from pyspark.sql import DataFrame

from tidemark.sources.store import Store
from tidemark.sources.vendors import RateLimiter, attempt

LEDGER = "job_type string, key string, status string, last_error string, seq long"


@dataclass(frozen=True)
class Outcome:
    succeeded: int
    failed: int
    rows: int


def ingest(store: Store, job_type: str, table: str, keys: DataFrame, fetch: Callable[[str], Iterable[tuple]], schema: str, *, batch: int = 50, tries: int = 2, limiter: RateLimiter | None = None) -> Outcome:
    """Fetch every pending key of ``keys`` (key, pos) and upsert its rows, which ``schema`` describes.

    A key whose fetch fails ``tries`` times is logged as failed and stays pending; a key without rows is a success.
    """
    good = bad = total = seq = 0
    pending = (r["key"] for r in store.pending(job_type, keys).select("key").toLocalIterator())
    for some in batched(pending, batch):
        rows, log = [], []
        for key in some:
            if limiter:
                limiter.wait()
            got, error = attempt(lambda key=key: list(fetch(key)), tries)
            rows += got or []
            log.append((job_type, key, "failed" if error else "success", error, seq))
            seq += 1
            good, bad = good + (error is None), bad + (error is not None)
        if rows:
            store.upsert(table, store.spark.createDataFrame(rows, schema))
        # the ledger last: a key counts as done once its rows are in the table
        store.record_jobs(store.spark.createDataFrame(log, LEDGER), "seq")
        total += len(rows)
    return Outcome(good, bad, total)
