"""Shared plumbing: scratch tables in the cluster's shared folder, text batches, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_ROWS = 256


@lru_cache(maxsize=1)
def own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tidemark-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  Where none is configured, a local session gets one of its own;
    on a cluster that is an error, as executors don't see each other's disks."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or own_dir()).rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{tag}-{uuid.uuid4().hex[:12]}"


class Scratch:
    """Tables written on the way to a result.  Each is written once, so that later readers neither recompute the
    plan above it nor depend on any one executor's disk, and goes when what was made from it is written."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag = spark, tag
        self.held: list[tuple[DataFrame, str]] = []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, f"{self.tag}-{name}")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete the tables of ``frames`` (as :meth:`save` returned them)."""
        for out, path in self.held:
            if any(out is f for f in frames):
                remove(self.spark, path)
        self.held = [(out, path) for out, path in self.held if not any(out is f for f in frames)]

    def drop_all(self, *but: DataFrame) -> None:
        self.drop(*(out for out, _ in self.held if not any(out is f for f in but)))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in shared storage."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a scratch table that stays."""
    return Scratch(df.sparkSession, tag).save(df, "table")


#: A key with more than one in so many rows is dealt apart from the others.
HOT_SHARE, HOT_LEAST = 1000, 64


def hot_keys(rows: DataFrame, key: str, total: int | None = None) -> list:
    """The keys that hold more than a thousandth of ``rows`` (and more than ``HOT_LEAST`` of them).

    There are fewer than a thousand of them, whatever the table's size, so their list and one row for each can
    be broadcast.
    """
    total = rows.count() if total is None else total
    many = rows.groupBy(key).count().filter((F.col("count") > max(HOT_LEAST, total // HOT_SHARE)) & F.col(key).isNotNull())
    return [r[0] for r in many.select(key).collect()]


def among(key: str, values: list) -> Column:
    """Whether ``key`` is one of ``values``; false where it is null."""
    return F.coalesce(F.col(key).isin(values), F.lit(False)) if values else F.lit(False)


def looked_up(left: DataFrame, key: str, right: DataFrame, how: str = "inner", hot: list | None = None) -> DataFrame:
    """``left`` joined with ``right``, whose ``key`` is unique.

    Rows of hot keys meet their few partners where they are; all others are shuffled, no key with many rows.
    ``left`` is read twice or three times, so it should be a written table.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    cold = left.filter(~among(key, hot)).join(right.filter(~among(key, hot)), key, how)
    return cold.unionByName(left.filter(among(key, hot)).join(F.broadcast(right.filter(among(key, hot))), key, how))


#: Bits that mark ids, so at most a 64th as many rows of 16 bytes are broadcast, however many ids there are.
MARKS = 1 << 23


def marks_of(ids: DataFrame, id_col: str) -> DataFrame:
    """(word, bits): a bitmap of the ids' hashes."""
    at = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(MARKS))
    bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
    return ids.select(at.alias("at")).select(F.expr("at div 64").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def split_by(docs: DataFrame, marks: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose id is surely not among the marked, rows whose id may be): an exact join is only needed for the second,
    so rows with long texts stay where they are unless it concerns them.  With more ids than marks the second part grows
    up to all rows; what the exact join then gives is the same.
    """
    word, bits = fresh("_word", docs.columns), fresh("_bits", docs.columns)
    at = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(MARKS))
    held = F.broadcast(marks.select(F.col("word").alias(word), F.col("bits").alias(bits)))
    met = docs.join(held, F.floor(at / 64) == F.col(word), "left")
    hit = F.coalesce(F.getbit(F.col(bits), (at % 64).cast("int")) == 1, F.lit(False))
    return met.filter(~hit).select(*docs.columns), met.filter(hit).select(*docs.columns)


def fresh(base: str, taken: list[str]) -> str:
    """A column name like ``base`` that is none of ``taken``."""
    lower = {t.lower() for t in taken}
    return next(name for name in (base + "_" * n for n in range(len(taken) + 1)) if name.lower() not in lower)


def width(spark: SparkSession) -> int:
    """Partitions for a shuffle that is asked for by number, as the session sets them."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: How to drop what a worker holds from task to task of one operator, such as a tokenizer.
HELD: list[Callable[[], None]] = []


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, *, holds: bool = False) -> DataFrame:
    """``mapInArrow`` that gives memory back: workers are reused by stages that need it for other things.

    What a worker holds between tasks goes before a stage begins that doesn't hold anything itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holds:
            for drop in HELD:
                drop()
            release()
        yield from fn(batches)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Hand memory that is no longer used back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over a uint64 array: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def pieces_of(batches: Iterator[pa.RecordBatch], rows: int = TOKENIZER_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``: bounds what a worker holds beside the text."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def file_system(uri: str):
    """(pyarrow file system, path in it) of a folder or file in shared storage."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def halve(cache: dict) -> None:
    """Drop the older half of a cache's entries."""
    for key in list(cache)[: len(cache) // 2]:
        del cache[key]
