"""The folder that driver and executors share, for tables written on the way to a result."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tidemark-')}"


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a local session without that setting gets one of its own,
    on a cluster it is an error, as executors don't see each other's disks."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(named or _own()).rstrip('/')}/tidemark/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to a fresh shared folder and read from there: what is read several times is made once."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
