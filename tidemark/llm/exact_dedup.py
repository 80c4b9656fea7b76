"""Exact deduplication against history by a minimal perfect hash.

Texts are equal when identical after every run of ASCII white space became one space; null
counts as empty.  History is kept as an index over its *distinct* SHA-256 digests, in shards
chosen by digest.  A shard is one row: a minimal perfect hash, and by slot the full digest, the
winner's id and how many rows had it.  New rows are first reduced to distinct digests (that is
what tames a text that makes up a third of the rows), sent to the shard of their digest, looked
up, and compared with the slot's 32 bytes.  Members are repeats of the slot's winner;
nonmembers are grouped among themselves.

For one table, rows up to the middle of its id range are history and the rest is the new batch,
so a group's smallest id, which wins, is in history whenever any of the group is.

Defined results: rows with a null id are kept and grouped like any other; a null id wins only
where its group has no other.  Rows with equal ids and equal texts are all returned.  Other columns are ignored,
whatever their names; :func:`keep_first` hands them through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import HOT_LEAST, HOT_SHARE, Scratch, fresh, looked_up, marks_of, split_by, text_or_empty
from tidemark.llm.mph import MinimalPerfectHash

SPACES = r"[\x20\x09-\x0D]+"
#: Distinct digests a shard is planned for: 48 bytes each, so a shard stays far below a task's memory.
SHARD_KEYS = 200_000
DIGEST_BYTES = 32


def normalised(col: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(col), SPACES, " ")


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): SHA-256 of the normalised text as 32 bytes."""
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(text_col), 256)).alias("digest"))


def _winners(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("id").alias("winner"), F.count(F.lit(1)).alias("n"))


def _shard(shards: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _hashes(found: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(digests as rows of bytes, 64-bit keys: bytes 8 to 16, free of the sharding's bytes)."""
    raw = np.frombuffer(b"".join(found), np.uint8).reshape(-1, DIGEST_BYTES)
    return raw, raw[:, 8:16].copy().view("<u8").ravel()


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row a shard from (digest, winner, n): shard, hash, digests, winners, counts; slots in slot order.

    ``more`` holds, in the same layout without a hash, digests whose 64-bit keys coincide with
    another's of the shard (none are to be expected; they are searched one by one).
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        raw, keys = _hashes(pdf["digest"])
        _, first = np.unique(keys, return_index=True)
        rest = np.setdiff1d(np.arange(len(keys)), first)
        mph = MinimalPerfectHash.build(keys[first])
        order = np.empty(len(first), np.int64)
        order[mph.slots(keys[first])] = first
        order = np.concatenate([order, rest])
        # a null winner travels as the smallest long with a flag in the counts' sign
        null = pdf["winner"].isna().to_numpy()[order]
        winners = pdf["winner"].fillna(0).astype("int64").to_numpy()[order]
        n = pdf["n"].to_numpy().astype(np.int64)[order]
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "hash": [mph.dump()], "digests": [raw[order].tobytes()], "winners": [winners.astype("<i8").tobytes()], "counts": [np.where(null, -n, n).astype("<i8").tobytes()]})

    return history.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(build, "shard int, hash binary, digests binary, winners binary, counts binary")


def look_up(index: DataFrame, batch: DataFrame, shards: int) -> DataFrame:
    """(digest, winner, n, member) of every digest of history or batch, from (digest, winner, n) rows of the batch.

    ``winner`` is the slot's for members; ``n`` counts history and batch together.
    """

    def run(slots: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        out = []
        batch_raw, batch_keys = _hashes(new["digest"]) if len(new) else (np.empty((0, DIGEST_BYTES), np.uint8), np.empty(0, np.uint64))
        member = np.zeros(len(new), bool)
        batch_n = new["n"].to_numpy().astype(np.int64) if len(new) else np.empty(0, np.int64)
        if len(slots):
            row = slots.iloc[0]
            held = np.frombuffer(row["digests"], np.uint8).reshape(-1, DIGEST_BYTES)
            winners, counts = np.frombuffer(row["winners"], "<i8"), np.frombuffer(row["counts"], "<i8")
            mph = MinimalPerfectHash.load(row["hash"])
            at = mph.slots(batch_keys)
            member = (at >= 0) & (held[np.maximum(at, 0)] == batch_raw).all(axis=1)
            for extra in range(mph.n, len(held)):
                same = (held[extra] == batch_raw).all(axis=1)
                at[same], member = extra, member | same
            total = np.abs(counts)
            np.add.at(total, at[member], batch_n[member])
            names = pd.Series([None if c < 0 else int(w) for w, c in zip(winners, counts, strict=True)], dtype="Int64")
            if (counts < 0).any():  # history had null ids only: a batch row's id wins
                ids = new["winner"].astype("Int64")
                for i in np.flatnonzero(member):
                    if counts[at[i]] < 0:
                        names[at[i]] = ids.iloc[i]
            out.append(pd.DataFrame({"digest": [x.tobytes() for x in held], "winner": names, "n": total, "member": True}))
        if (~member).any():
            own = new[~member]
            out.append(pd.DataFrame({"digest": own["digest"].to_numpy(), "winner": own["winner"].astype("Int64").to_numpy(), "n": batch_n[~member], "member": False}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"digest": [], "winner": [], "n": [], "member": []})

    left, right = index.groupBy("shard"), batch.withColumn("shard", _shard(shards)).groupBy("shard")
    return left.cogroup(right).applyInPandas(run, "digest binary, winner long, n long, member boolean")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(id, digest, winner, n, member) of every row, dropped ones too.

    A digest on very many rows meets its group by broadcast, all others by a shuffle of digests.
    """
    scratch = scratch or Scratch(docs.sparkSession, "digests")
    rows = scratch.save(digests(docs, id_col=id_col, text_col=text_col), "rows")
    lo, hi, total = rows.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    middle = 0 if lo is None else (lo + hi) // 2
    shards = max(12, -(-total // SHARD_KEYS))
    old = F.coalesce(F.col("id") <= middle, F.lit(False))
    index = scratch.save(build_index(_winners(rows.filter(old)), shards), "index")
    groups = scratch.save(look_up(index, _winners(rows.filter(~old)), shards), "groups")
    scratch.drop(index)
    hot = [r[0] for r in groups.filter(F.col("n") > max(HOT_LEAST, total // HOT_SHARE)).select("digest").collect()]
    return looked_up(rows, "digest", groups, hot=hot)


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the one with the smallest id (if that id repeats, one row of it).

    Rows that go are taken out by id and digest, and only rows whose ids are marked as perhaps going take part in that.
    """
    scratch = Scratch(docs.sparkSession, "digests")
    stays = F.col("id").eqNullSafe(F.col("winner"))
    verdict = dedup(docs, id_col=id_col, text_col=text_col, scratch=scratch).groupBy("id", "digest", stays.alias("stays")).agg(F.count(F.lit(1)).alias("copies"))
    verdict = scratch.save(verdict.filter(~F.col("stays") | (F.col("copies") > 1)), "verdict")
    marks = scratch.save(marks_of(verdict, "id"), "marks")
    scratch.drop_all(verdict, marks)
    sure, open_ = split_by(docs, marks, id_col)
    own, gone_id, gone_digest = (fresh(name, docs.columns) for name in ("_digest", "_gone_id", "_gone_digest"))
    keyed = open_.withColumn(own, F.unhex(F.sha2(normalised(text_col), 256)))
    gone = verdict.filter(~F.col("stays")).select(F.col("id").alias(gone_id), F.col("digest").alias(gone_digest))
    kept = keyed.join(gone, F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_digest)), "left_anti")
    if verdict.filter("stays").limit(1).count():  # whole rows that repeat their id and text
        kept = kept.dropDuplicates([id_col, own])
    return sure.unionByName(kept.drop(own))
