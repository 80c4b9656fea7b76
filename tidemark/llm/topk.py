"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors are kept in blocks of about ``BLOCK_ROWS``; each block holds, for every dimension, its rows
sorted by that component.  A query walks all lists at once, from the top where its own component is
positive and from the bottom where it is negative.  Every row met is scored in full.  No row not yet
met can beat the sum of the query's components times the values the walk has reached; once that
bound is below the query's k-th best score, the block is done.

Queries are a stated set.  A block's lists are built once, by the one task that has its rows, and the queries
stream past them.  Each query meets one block first; its k-th best score there is the floor that it takes to all
other blocks, where rows below it are neither waited for nor given out.  A query's winners are the best k of what the
blocks gave out, reduced in two levels so that no group grows with the number of blocks alone.

Scores are exact integers: components are quantised to floor(scale * x).  Vectors that are null or hold null or
non-finite components take no part, nor do rows without an id.  Among vectors of different lengths the missing
components count as zero.  A row is excluded from the results of queries with its own id; ties go to the smaller id;
rows that repeat an id are candidates each on their own, and queries each with a result of its own; other columns are
ignored, whatever their names; no queries or no candidates give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, map_arrow

BLOCK_ROWS = 8192
FIRST_DEPTH, GROW = 16, 4


class SortedLists:
    """A block of integer vectors with its rows sorted along every dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors.astype(np.float64)  # integers: exact below 2**53
        self.order = np.argsort(self.vectors, axis=0, kind="stable").T.copy()  # (dimensions, rows), ascending
        self.sorted = np.take_along_axis(self.vectors.T, self.order, axis=1)
        self.scored = self.stopped = 0  # rows scored, and walks that the bound ended before all rows were met

    def top(self, query: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of at least all rows that are among the best k here and score ``floor`` or more."""
        n = len(self.ids)
        live = np.flatnonzero(query)
        met = np.zeros(n, bool)
        scores, rows = [], []
        depth, kth = 0, floor
        while True:
            step = min(n, max(FIRST_DEPTH, depth * GROW))
            if not len(live):
                new = np.arange(n)  # no list to walk: all scores are 0
                step = n
            else:
                q = query[live]
                seen = np.where((q > 0)[:, None], self.order[live, n - step : n - depth], self.order[live, depth:step])
                fresh = np.zeros(n, bool)
                fresh[seen.ravel()] = True
                new = np.flatnonzero(fresh & ~met)
            met[new] = True
            self.scored += len(new)
            if len(new):
                scores.append(self.vectors[new] @ query)
                rows.append(new)
                good = np.concatenate(scores)
                good = good[self.ids[np.concatenate(rows)] != own]
                if len(good) >= k:
                    kth = max(kth, np.partition(good, len(good) - k)[len(good) - k])
            depth = step
            if depth >= n or met.all():
                break
            reach = np.where(query[live] > 0, self.sorted[live, n - depth], self.sorted[live, depth - 1])
            if float(query[live] @ reach) < kth:
                self.stopped += 1
                break
        score, row = np.concatenate(scores), np.concatenate(rows)
        good = (self.ids[row] != own) & (score >= kth)
        return score[good], self.ids[row[good]]


def usable(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id, v): the vectors that take part, quantised to integers."""
    x = F.col(vector_col)
    sound = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return vectors.filter(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(scale))).alias("v"))


FOUND = "q long, query_id long, id long, score long"


def _padded(values: pa.Array, size: int) -> np.ndarray:
    """(rows, size) of a list array, zeros behind the shorter lists."""
    lengths = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), size), np.float64)
    out[np.arange(size) < lengths[:, None]] = values.flatten().to_numpy(zero_copy_only=False)
    return out


def _met(stream: DataFrame, size: int, k: int) -> DataFrame:
    """What each block gives out for its queries.  ``stream``: (block, query, q, id, floor, v), a block's rows before its queries."""

    def run(batches):
        block, lists, rows = None, None, []
        for b in batches:
            cols = {name: b.column(name) for name in b.schema.names}
            blocks, asked = cols["block"].to_numpy(), cols["query"].to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(asked.astype(int)) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(blocks)], strict=True):
                if lo == hi:
                    continue
                if blocks[lo] != block:
                    block, lists, rows = blocks[lo], None, []
                ids = cols["id"].to_numpy()[lo:hi]
                vectors = _padded(cols["v"].slice(lo, hi - lo), size)
                if not asked[lo]:
                    rows.append((ids, vectors))
                    continue
                if lists is None and rows:
                    all_ids = np.concatenate([r[0] for r in rows])
                    order = np.argsort(all_ids, kind="stable")
                    lists, rows = SortedLists(all_ids[order], np.concatenate([r[1] for r in rows])[order]), []
                if lists is None:
                    continue
                out = []
                for own, q, floor, v in zip(ids.tolist(), *(cols[c].slice(lo, hi - lo).to_pylist() for c in ("q", "floor")), vectors, strict=True):
                    score, found = lists.top(v, own, k, -np.inf if floor is None else floor)
                    best = np.lexsort((found, -score))[:k]
                    out.append((np.full(len(best), q), np.full(len(best), own), found[best], score[best].astype(np.int64)))
                yield pa.record_batch([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], ["q", "query_id", "id", "score"])

    return map_arrow(stream, run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """(q, query_id, best): the k best (minus score, id) of each query, in order."""
    pair = F.struct((-F.col("score")).alias("minus"), F.col("id"))
    some = found.groupBy("q", "query_id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(F.slice(F.sort_array(F.collect_list(pair)), 1, k).alias("some"))
    return some.groupBy("q", "query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("some"))), 1, k).alias("best"))


def search(vectors: DataFrame, queries: DataFrame, k: int, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, id, score) from two (id, v) frames of :func:`usable`."""
    scratch = Scratch(vectors.sparkSession, "topk")
    vectors = scratch.save(vectors.select("id", "v", F.monotonically_increasing_id().alias("row")), "vectors")
    queries = scratch.save(queries.select("id", "v", F.monotonically_increasing_id().alias("q")), "queries")
    n, widest = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    size = max(widest, queries.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0])
    blocks = max(1, -(-n // block_rows))
    block = F.pmod(F.xxhash64("id", "row"), F.lit(blocks)).cast("int")
    none = F.lit(None).cast("long")
    rows = vectors.select(block.alias("block"), F.lit(False).alias("query"), none.alias("q"), "id", none.alias("floor"), "v")
    home = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")

    def streamed(asked: DataFrame) -> DataFrame:
        return rows.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "query")

    at_home = queries.select(home.alias("block"), F.lit(True).alias("query"), "q", "id", none.alias("floor"), "v")
    first = scratch.save(_met(streamed(at_home), size, k), "home")
    if blocks == 1:
        best = _best(first, k)
    else:
        kth = first.groupBy("q").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("many")).select("q", F.when(F.col("many") >= k, F.col("least")).alias("floor"))
        others = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: x != home)
        abroad = queries.join(kth, "q", "left").select(F.explode(others).alias("block"), F.lit(True).alias("query"), "q", "id", "floor", "v")
        best = _best(first.unionByName(_met(streamed(abroad), size, k)), k)
    ranked = best.select("query_id", F.posexplode("best").alias("pos", "x"))
    return ranked.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("id"), (-F.col("x.minus")).alias("score"))
