"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than ``chunk_chars`` is cut into chunks that overlap; ``CHUNK_CHARS`` is so small that most
documents are.  Each chunk is
pre-tokenised on its own, beginning at an arbitrary character, so its first pre-tokens
may be wrong.  The pre-token pattern looks only ahead, never back: once two scans share
one boundary, all later boundaries of the two agree.  Stitching walks the chunks from
the left, finds the first boundary that the trusted scan and the next chunk have in
common inside the overlap, and goes on with the next chunk's boundaries from there.  The
text is thereby cut into segments that begin and end at true pre-token boundaries, and
every segment can be encoded apart from the others.

Texts up to ``spread_chars`` go through all steps inside one task.  Longer ones are
dealt out chunk by chunk over the cluster, stitched from the boundaries inside their overlaps,
and encoded segment by segment, so one huge text does not hold one task.

Defined results: a null text counts as empty; an empty text has no ids; rows with equal
or null ids are all kept, one result for each; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import HELD, map_arrow, pieces_of, saved, text_or_empty, width

CHUNK_CHARS = 1_024
OVERLAP_CHARS = 96
#: Chunks of texts that are dealt out: larger, as each is a row of its own.
SPREAD_CHUNK, SPREAD_OVERLAP = 32_768, 2_048
SPREAD_CHARS = 100_000
#: A match that ends so close to a chunk's end may be cut short by it: no alternative of the
#: pattern looks further ahead than this many characters past its own match.
MARGIN = 8


@lru_cache(maxsize=4)
def codec(ranks_path: str):
    """(tiktoken encoding, bytes of each id, compiled pattern) of a rank file."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        table[rank] = piece
    return enc, table, regex.compile(public_tokenizers.PATTERN)


HELD.append(codec.cache_clear)


def chunks(text: str, chunk_chars: int, overlap: int) -> list[tuple[int, str]]:
    """(start, chunk) with ``overlap`` characters shared by neighbours; the last one reaches the end."""
    if len(text) <= chunk_chars:
        return [(0, text)]
    step = chunk_chars - overlap
    return [(at, text[at : at + chunk_chars]) for at in range(0, max(1, len(text) - overlap), step)]


def starts(chunk: str, last: bool, pattern: regex.Pattern) -> np.ndarray:
    """Where pre-tokens begin in a chunk, as far as its end cannot have changed them.

    The final entry is where the first unsure pre-token begins (or the chunk's length, in the last chunk).
    """
    ends = [0, *[m.end() for m in pattern.finditer(chunk)]]
    if not last:
        del ends[bisect.bisect_right(ends, len(chunk) - MARGIN) :]
    return np.asarray(ends, dtype=np.int64)


def at_edges(own: np.ndarray, size: int, overlap: int) -> np.ndarray:
    """Those of a chunk's boundaries that lie in an overlap, and its last one: all that stitching reads."""
    return own[(own <= overlap) | (own >= size - overlap) | (own == own[-1])]


def stitch(parts: list[tuple[int, np.ndarray]], rescan) -> list[int]:
    """Segment bounds of a text from its chunks' (start, own boundaries), in order.

    ``rescan(frm, to)`` gives true boundaries past ``frm`` until one lies at or beyond ``to``; it is only
    needed where an overlap shares no boundary, as inside one very long pre-token.
    """
    bounds = [0]
    trusted = parts[0][0] + parts[0][1]
    for start, own in parts[1:]:
        own = start + own
        if trusted[-1] >= own[-1]:
            continue
        while True:
            shared = np.intersect1d(trusted, own, assume_unique=True)
            shared = shared[shared > bounds[-1]] if bounds[-1] else shared[shared > 0]
            if len(shared):
                bounds.append(int(shared[0]))
                trusted = own[own >= shared[0]]
                break
            if trusted[-1] >= own[-1]:
                break
            trusted = np.asarray(rescan(int(trusted[-1]), int(own[-1])), dtype=np.int64)
    bounds.append(int(trusted[-1]))
    return bounds


def scan_on(text: str, frm: int, to: int, pattern: regex.Pattern) -> list[int]:
    out = [frm]
    for m in pattern.finditer(text, frm):
        out.append(m.end())
        if m.end() >= to:
            break
    return out


def segments(text: str, ranks_path: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    """The text cut at true pre-token boundaries into pieces of about one chunk each."""
    cut = chunks(text, chunk_chars, overlap)
    if len(cut) == 1:
        return [text]
    pattern = codec(ranks_path)[2]
    parts = [(at, starts(c, at + len(c) == len(text), pattern)) for at, c in cut]
    bounds = stitch(parts, lambda a, b: scan_on(text, a, b, pattern))
    if bounds[-1] < len(text):
        bounds.append(len(text))
    return [text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def encode_text(text: str, ranks_path: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> np.ndarray:
    enc = codec(ranks_path)[0]
    if len(text) <= chunk_chars:
        return enc.encode_to_numpy(text, disallowed_special=()) if text else np.empty(0, np.uint32)
    return np.concatenate([enc.encode_to_numpy(s, disallowed_special=()) for s in segments(text, ranks_path, chunk_chars, overlap)])


def decode_ids(ids, ranks_path: str) -> bytes:
    """Raw bytes of the ids, one after the other; they need not be valid UTF-8 on their own."""
    return b"".join(map(codec(ranks_path)[1].__getitem__, ids))


def encode_documents(docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, spread_chars: int = SPREAD_CHARS, spread_chunk: int = SPREAD_CHUNK, spread_overlap: int = SPREAD_OVERLAP) -> DataFrame:
    """(id_col, ids): one row per input row, ids as packed little-endian unsigned 32-bit integers."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches):
            ids = [encode_text(t, ranks_path, chunk_chars, overlap).astype("<u4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    size = F.char_length("text")
    near = map_arrow(rows.filter(size <= spread_chars), whole, "id long, ids binary", holds=True)
    far = _spread(rows.filter(size > spread_chars), ranks_path, spread_chunk, spread_overlap)
    return near.unionByName(far).withColumnRenamed("id", id_col)


def _spread(rows: DataFrame, ranks_path: str, chunk_chars: int, overlap: int) -> DataFrame:
    """Long texts: every chunk is scanned, and every stitched segment encoded, in whatever task comes up.

    A row gets a key of its own (``uuid``), as ids may repeat; it is saved first so that a retried task
    sees the same keys.
    """
    spark = rows.sparkSession
    n = width(spark)
    keyed = saved(rows.withColumn("key", F.expr("uuid()")), "bpe-long")

    def cut(batches):
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                parts = chunks(text, chunk_chars, overlap)
                yield pa.record_batch([pa.array([key] * len(parts)), pa.array([a for a, _ in parts], pa.int64()), pa.array([c for _, c in parts]), pa.array([i == len(parts) - 1 for i in range(len(parts))])], ["key", "at", "chunk", "last"])

    def scan(batches):
        pattern = codec(ranks_path)[2]
        for b in batches:
            found = [at_edges(starts(c, last, pattern), len(c), overlap).tolist() for c, last in zip(b.column("chunk").to_pylist(), b.column("last").to_pylist(), strict=True)]
            yield pa.record_batch([b.column("key"), b.column("at"), pa.array(found, pa.list_(pa.int64()))], ["key", "at", "own"])

    pieces = map_arrow(keyed.select("key", "text"), cut, "key string, at long, chunk string, last boolean").repartition(n, "key", "at")
    scans = map_arrow(pieces, scan, "key string, at long, own array<long>", holds=True)
    stitched = scans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "own"))).alias("parts"))

    def segment(batches):
        pattern = codec(ranks_path)[2]
        for b in batches:
            for key, text, parts in zip(*(b.column(c).to_pylist() for c in ("key", "text", "parts")), strict=True):
                bounds = stitch([(p["at"], np.asarray(p["own"], dtype=np.int64)) for p in parts], lambda f, t, text=text: scan_on(text, f, t, pattern))
                bounds = bounds if bounds[-1] >= len(text) else [*bounds, len(text)]
                out = [text[f:t] for f, t in zip(bounds, bounds[1:], strict=False)]
                yield pa.record_batch([pa.array([key] * len(out)), pa.array(range(len(out)), pa.int32()), pa.array(out, pa.string())], ["key", "no", "segment"])

    def encode(batches):
        enc = codec(ranks_path)[0]
        for b in batches:
            ids = [enc.encode_to_numpy(s, disallowed_special=()).astype("<u4").tobytes() for s in b.column("segment").to_pylist()]
            yield pa.record_batch([b.column("key"), b.column("no"), pa.array(ids, pa.binary())], ["key", "no", "ids"])

    segs = map_arrow(keyed.select("key", "text").join(stitched, "key"), segment, "key string, no int, segment string", holds=True).repartition(n, "key", "no")
    coded = map_arrow(segs, encode, "key string, no int, ids binary", holds=True).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("all"))

    def join_ids(batches):
        for b in batches:
            yield pa.record_batch([b.column("id"), pa.array([b"".join(p["ids"] for p in ps) for ps in b.column("all").to_pylist()], pa.binary())], ["id", "ids"])

    return map_arrow(keyed.select("key", "id").join(coded, "key").select("id", "all"), join_ids, "id long, ids binary")


def decode_documents(coded: DataFrame, ranks_path: str, *, id_col: str = "doc_id") -> DataFrame:
    """(id_col, bytes): the raw bytes of each row's packed ids; null ids give empty bytes."""

    def run(batches):
        for b in pieces_of(batches):
            raw = [decode_ids(np.frombuffer(x or b"", "<u4").tolist(), ranks_path) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(raw, pa.binary())], [id_col, "bytes"])

    return map_arrow(coded.select(id_col, "ids"), run, f"{id_col} long, bytes binary", holds=True)


def digest_documents(coded: DataFrame, ranks_path: str, *, id_col: str = "doc_id") -> DataFrame:
    """Per row: number of ids, SHA-256 of their decimal form joined by commas, SHA-256 of the decoded bytes."""

    def run(batches):
        enc, table, _ = codec(ranks_path)
        names = [str(i) for i in range(len(table))]
        for b in pieces_of(batches):
            out = []
            for x in b.column(1).to_pylist():
                ids = np.frombuffer(x or b"", "<u4").tolist()
                text = ",".join(map(names.__getitem__, ids))
                out.append((len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(decode_ids(ids, ranks_path)).hexdigest()))
            n, a, d = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(coded.select(id_col, "ids"), run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string", holds=True)
