"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A document's set holds its distinct shingles of ``words`` words (ASCII letters lower-cased; words end at
ASCII white space only); with fewer words, the whole sequence as one.  Documents whose sets
intersect in at least ``percent`` hundredths of their union are linked, and groups are the connected
components of the links.

1. Documents with equal sets (by a 128-bit digest) form a class, named by the number of its first row; from here
   on only classes count.
2. Each class's set is sketched, and ``BANDS`` keys of ``WIDTH`` coordinates each are drawn from the sketch.
   Two sets at similarity 0.8 share no key with probability 5e-6, closer ones far less often.  Keys are shuffled once:
   every member learns its bucket's size and smallest member there.
3. Two rounds compare the members of each bucket with one member: first the smallest, so that a group meets in one
   representative, then one drawn for each bucket, skipping what is already together and what sizes alone rule out.
   Compared means: intersected in full.
4. Buckets that still hold more than one component are compared exhaustively, in cells of at most
   ``CELL`` members on a side; a cell gives out links, never its pairs.  Of buckets with the very same members one is enough.

Links are confirmed on full sets of 64-bit shingle hashes.  Components never leave the cluster.  No join or aggregate relies
on the engine to split hot keys: keys with more than a thousandth of all rows (fewer than a thousand keys, by
arithmetic) are looked up by broadcast, sets with very many partners are salted.  Tables on the way go as soon as
what was made from them is written.

Defined results: null and wordless texts have the empty set and are linked with nothing;
rows with equal ids are all returned, and a group's id is the smallest non-null one in it; other columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import Scratch, among, fresh, hot_keys, looked_up, map_arrow, marks_of, mix64, pieces_of, split_by
from tidemark.llm.components import components, rooted
from tidemark.llm.sketch import Sketcher, bands

BANDS, WIDTH = 40, 6
CELL = 1024
DIGEST_BYTES = 16
#: Copies of a set that very many others are compared with; of so many classes one is looked at to find hot buckets.
SALTS, HOT_DRAW = 32, 16
WORD_CACHE = 200_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, kept while there are few enough."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    wide = min(words, len(h))
    out = h[: len(h) - wide + 1].copy()
    for k in range(1, wide):
        out = mix64(out * GOLDEN + np.uint64(k)) + h[k : len(h) - wide + 1 + k]
    out = mix64(out ^ np.uint64(wide))
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def digest_of(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=DIGEST_BYTES).digest()


def signatures(docs: DataFrame, words: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n, digest, keys): a number of the row, the size of its set, a 128-bit digest of it and its band keys
    (both null for the empty set)."""

    def run(batches):
        hashes, sketch = WordHashes(), Sketcher(BANDS * WIDTH)
        for b in pieces_of(batches):
            sets = [shingle_set(text, words, hashes) for text in b.column(2).to_pylist()]
            digests = pa.array([digest_of(s) if len(s) else None for s in sets], pa.binary())
            keys = pa.array([bands(sketch(s), BANDS, WIDTH) if len(s) else None for s in sets], pa.list_(pa.int64()))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(map(len, sets), pa.int64()), digests, keys], ["row", "id", "n", "digest", "keys"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col))
    return map_arrow(rows, run, "row long, id long, n long, digest binary, keys array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, marks: DataFrame, words: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, elements) of the ``wanted`` (id, digest, node) classes, their sets made again from the texts.

    ``marks``: those of the wanted ids; other texts are not moved.
    """

    def run(batches):
        hashes = WordHashes()
        for b in pieces_of(batches):
            sets = [shingle_set(t, words, hashes) for t in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array(map(digest_of, sets), pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["digest", "elements"])

    ids = wanted.select(F.col("id").alias("_id")).distinct()
    _, perhaps = split_by(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), marks, "id")
    rows = perhaps.join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    made = map_arrow(rows.select("text"), run, "digest binary, elements binary")
    return made.join(wanted.select("digest", "node"), "digest").dropDuplicates(["digest"]).select("node", "elements")


def per_bucket(rows: DataFrame, hot: list[int], **totals) -> DataFrame:
    """``rows`` with ``totals``, aggregates over their bucket (``key``), after one shuffle by key.

    Hot buckets are not shuffled: their totals are summed up task by task and come back by broadcast, one
    row for each hot key.
    """
    window = Window.partitionBy("key")
    out = rows.filter(~among("key", hot)).select("*", *(x.over(window).alias(name) for name, x in totals.items()))
    if hot:
        apart = rows.filter(among("key", hot))
        few = apart.groupBy("key").agg(*(x.alias(name) for name, x in totals.items()))
        out = out.unionByName(apart.join(F.broadcast(few), "key"))
    return out


def hot_buckets(classes: DataFrame) -> list[int]:
    """Keys of buckets with more than about a thousandth of all key rows, found on one class in ``HOT_DRAW``.

    Which buckets are dealt as hot changes no result, only the tasks in which they are worked off.
    """
    drawn = classes.filter(F.pmod(F.xxhash64("node"), F.lit(HOT_DRAW)) == 0).select(F.explode("keys").alias("key"))
    return hot_keys(drawn, "key")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def alike(a: str, b: str, percent: int):
    """Whether two sizes allow the similarity asked for."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs``, a written table, whose full sets are similar enough.

    The set of an ``a`` with very many partners is copied into ``SALTS`` parts, and each partner meets one of them.
    """
    hot = hot_keys(pairs, "a")
    salt = F.when(among("a", hot), F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(among("node", hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = sets.select(F.col("node").alias("a"), F.explode(salts).alias("salt"), F.col("elements").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))

    def run(batches):
        for b in pieces_of(batches):
            good = [linked(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), percent) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield pa.record_batch([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    met = pairs.withColumn("salt", salt).join(left, ["a", "salt"]).join(right, "b")
    return map_arrow(met.select("a", "b", "x", "y"), run, "a long, b long")


def cell_links(members: DataFrame, sets: DataFrame, percent: int, cell: int = CELL) -> DataFrame:
    """Links (a, b) between components among the members of each bucket, all pairs considered.

    A bucket larger than ``cell`` is dealt into parts, and each two parts meet in a cell of their own.
    """
    parts = F.ceil(F.col("size") / F.lit(cell)).cast("int")
    dealt = members.filter("size > 2").withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0)))))
    cells = met.select("key", "node", "root", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, roots = pdf["node"].to_numpy(), pdf["root"].to_numpy()
        sets_ = [np.frombuffer(x, "<u8") for x in pdf["elements"]]
        sizes = np.array([len(s) for s in sets_])
        values, inverse = np.unique(np.concatenate(sets_), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        label = np.unique(roots, return_inverse=True)[1]
        side = pdf["part"].to_numpy()
        across = bool(pdf["lo"].iloc[0] != pdf["hi"].iloc[0])
        largest = np.bincount(label).argmax()
        out = []
        for i in np.flatnonzero(label != largest).tolist():
            rest = label != label[i]
            if across:
                rest = rest & (side != side[i])
            if not rest.any():
                continue
            mine = np.zeros(len(values), bool)
            mine[inverse[starts[i] : starts[i] + sizes[i]]] = True
            common = np.add.reduceat(mine[inverse].astype(np.int64), starts)
            good = np.flatnonzero(rest & (100 * common >= percent * (sizes + sizes[i] - common)))
            for j in good.tolist():
                if label[j] != label[i]:
                    out.append((nodes[i], nodes[j]))
                    label[label == label[j]] = label[i]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return cells.join(sets, "node").groupBy("key", "lo", "hi").applyInPandas(run, "a long, b long")


def distinct_buckets(left: DataFrame) -> DataFrame:
    """One of the buckets that hold the very same members, by two 64-bit sums of them; others compare nothing new."""
    keep = left.groupBy("same", "again", "size").agg(F.min("key").alias("key")).select("key")
    return left.join(keep, "key", "left_semi")


def group(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(id, n, group, digest): size of each row's set, the smallest id of its group, and the set's digest."""
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    cols = {"id_col": id_col, "text_col": text_col}
    sigs = scratch.save(signatures(docs, words, **cols), "signatures")
    classes = sigs.filter("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = scratch.save(classes, "classes")
    rows = scratch.save(sigs.select("id", "n", "digest"), "rows")
    scratch.drop(sigs)
    hot = hot_buckets(classes)
    spread = classes.select("node", "n", F.explode("keys").alias("key"))
    met = per_bucket(spread, hot, size=F.count(F.lit(1)), first=F.min(F.struct("node", "n"))).filter("size > 1")
    members = scratch.save(met.select("key", "node", "n", "size", F.col("first.node").alias("a"), F.col("first.n").alias("a_n")), "buckets")
    if not members.limit(1).count():  # no two sets share a key
        scratch.drop_all(rows, classes)
        return looked_up(rows, "digest", classes.select("digest", F.col("id").alias("group")), "left").select("id", "n", F.coalesce("group", "id").alias("group"), "digest")
    classes_, classes = classes, scratch.save(classes.select("digest", "node", "id"), "names")
    scratch.drop(classes_)
    wanted = scratch.save(classes.join(members.select("node").distinct(), "node", "left_semi"), "wanted")
    sets = scratch.save(full_sets(docs, wanted, scratch.save(marks_of(wanted, "id"), "marks"), words, **cols), "sets")

    def links_of(pairs: DataFrame) -> DataFrame:
        pairs = scratch.save(pairs.distinct(), "pairs")
        links = scratch.save(confirmed(pairs, sets, percent), "links")
        scratch.drop(pairs)
        return links

    # a bucket of two is settled by its first comparison
    links = links_of(members.filter((F.col("node") != F.col("a")) & alike("n", "a_n", percent)).select("a", F.col("node").alias("b")))
    labels = components(links, scratch)
    scratch.drop(links)
    members_, members = members, scratch.save(members.filter("size > 2").select("key", "node", "n"), "buckets")
    scratch.drop(members_)
    drawn = F.min(F.struct(F.xxhash64("node", "key").alias("o"), "node", "n", "root"))
    for again in (1, 2):
        open_ = {"lo": F.min("root"), "hi": F.max("root"), "size": F.count(F.lit(1))}
        seen = rooted(members, "node", labels)
        if again == 1:
            left = scratch.save(per_bucket(seen, hot, star=drawn, **open_).filter("lo <> hi"), "left")
            if not left.limit(1).count():
                break
            pairs = left.filter((F.col("root") != F.col("star.root")) & alike("n", "star.n", percent))
            links = links_of(pairs.select(F.col("star.node").alias("a"), F.col("node").alias("b")))
        else:
            marks = {"same": F.bit_xor(F.xxhash64("node")), "again": F.bit_xor(F.xxhash64("node", F.lit(1)))}
            left = scratch.save(per_bucket(seen, hot, **marks, **open_).filter("lo <> hi"), "left")
            links = scratch.save(cell_links(distinct_buckets(left), sets, percent), "links")
        labels = _merged(labels, links, scratch)
        members = left.select("key", "node", "n")
    ids = scratch.save(rooted(classes, "node", labels), "roots")
    best = ids.groupBy("root").agg(F.min("id").alias("group"))
    named = scratch.save(looked_up(ids, "root", best).select("digest", "group"), "groups")
    scratch.drop_all(rows, named)
    return looked_up(rows, "digest", named, "left").select("id", "n", F.coalesce("group", "id").alias("group"), "digest")


def _merged(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels after further links, worked out on the components found so far."""
    if not links.limit(1).count():
        return labels
    edges = rooted(rooted(links, "a", labels, "ra"), "b", labels, "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    over = components(edges, scratch)
    known = labels.union(links.select(F.col("a").alias("node"), F.col("a").alias("root")).union(links.select("b", "b")).distinct().join(labels, "node", "left_anti"))
    known = scratch.save(known.select("node", F.col("root").alias("was")), "labels")
    over = over.select(F.col("node").alias("was"), "root")
    return scratch.save(looked_up(known, "was", over, "left").select("node", F.coalesce("root", "was").alias("root")), "labels")


def with_digest(docs: DataFrame, name: str, words: int, *, text_col: str = "text") -> DataFrame:
    """``docs`` with the digest of each row's set under ``name``; null for the empty set."""
    kept = docs.columns

    def run(batches):
        hashes = WordHashes()
        for b in pieces_of(batches):
            sets = [shingle_set(t, words, hashes) for t in b.column(len(kept)).to_pylist()]
            yield pa.record_batch([*b.columns[: len(kept)], pa.array([digest_of(s) if len(s) else None for s in sets], pa.binary())], [*kept, name])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{name}` binary"])
    return map_arrow(docs.select(*kept, F.col(text_col).alias(fresh("_text", kept))), run, schema)


def keep_one(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group those with its smallest id (a row without an id goes only where
    its group has one).

    A row goes by its id and its set together, so rows that share an id are judged apart; only rows whose ids are marked as
    perhaps going are looked at.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    verdict = group(docs, words=words, percent=percent, id_col=id_col, text_col=text_col, scratch=scratch)
    gone_id, gone_set, own = (fresh(name, docs.columns) for name in ("_gone_id", "_gone_set", "_set"))
    gone = verdict.filter(~F.col("id").eqNullSafe(F.col("group"))).select(F.col("id").alias(gone_id), F.col("digest").alias(gone_set)).distinct()
    gone = scratch.save(gone, "gone")
    marks = scratch.save(marks_of(gone, gone_id), "marks")
    scratch.drop_all(gone, marks)
    sure, open_ = split_by(docs, marks, id_col)
    judged = with_digest(open_, own, words, text_col=text_col)
    kept = judged.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_set)), "left_anti")
    return sure.unionByName(kept.drop(own))
