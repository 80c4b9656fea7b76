"""Variable-capacity best-fit packing of token sequences.

Every document is encoded, closed by an end id, and cut into pieces where it is longer than the largest permitted
sequence.  Pieces go in decreasing order of length into the open bin they fit most tightly; where none fits, a bin is
opened.  Several sequence lengths are permitted, and which to open is decided for a group of pieces as a whole:

* ``least``: the size whose cost for each token is least, where the bin is imagined filled with the longest
  pieces still waiting that fit, and downsized to that filling;
* ``up to c``, for each permitted size c: c itself for pieces that fit in it, else the smallest that holds the piece.

All of these plans are worked out on the group's lengths, every bin of each is downsized to the smallest permitted length
that holds its contents, and the plan with the least total cost is taken.

A group is what one task meets in a row: at most ``GROUP_ITEMS`` documents or ``GROUP_IDS`` ids, so a task holds that much and
nothing is shuffled.  Sequences are written as a table (one row a bin: its ids, and the pieces in it), and the result
is read back from that.

Defined results: a null text counts as empty and holds its end id alone; null and repeated ids are packed as rows of
their own; other columns are ignored, whatever their names; nothing is dropped or truncated; the result is one row for
each piece, and an empty table has none.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, pieces_of, saved, text_or_empty
from tidemark.llm.token_store import encoder

CAPACITIES = (1024, 2048, 4096, 8192, 16384)
GROUP_ITEMS, GROUP_IDS = 20_000, 1 << 24
#: The cost of a sequence of c tokens: START + c + c * c / REACH, a fixed part, a part for each token and attention.
START, REACH = 64.0, 65_536.0
#: Pieces with which a bin is imagined filled, at most.
IMAGINED = 12

SEQUENCES = "bin_id long, bin_capacity int, bin_used int, ids binary, pieces array<struct<id:long,piece:int,start:long,n_tokens:int,bin_offset:int>>"
PIECES = "id long, piece int, start long, n_tokens long, bin_id long, bin_offset long, bin_used long, bin_capacity long, ids_crc32 long"


def cost(capacity: float) -> float:
    return START + capacity + capacity * capacity / REACH


def total_cost(capacity: np.ndarray) -> float:
    return float(sum(map(cost, capacity.tolist())))


class _Waiting:
    """The lengths not yet placed, longest first, for imagining how a bin would be filled."""

    def __init__(self, ordered: np.ndarray):
        self.ascending = ordered[::-1].tolist()

    def filled(self, room: int, placed: int) -> int:
        """Tokens that the longest waiting pieces which fit would add to ``room``, ``placed`` pieces being gone."""
        got, high = 0, len(self.ascending) - placed
        for _ in range(IMAGINED):
            high = bisect_right(self.ascending, room - got, 0, high) - 1
            if high < 0:
                break
            got += self.ascending[high]
        return got


def _fit(ordered: list[int], sizes: list[int], opened) -> tuple[list[int], list[int], list[int]]:
    """Best fit of lengths in decreasing order: (bin of each, its offset there, tokens in each bin).

    ``opened(need, placed)`` names the size to open.  Bins are found by their free room in a bit set: the lowest set
    bit at or above a length.
    """
    room: dict[int, list[int]] = {}
    rooms = 0
    bins, offsets, used = [], [], []
    for placed, need in enumerate(ordered):
        fits = rooms >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            held = room[free]
            at = held.pop()
            if not held:
                rooms ^= 1 << free
        else:
            free, at = opened(need, placed), len(used)
            used.append(0)
        bins.append(at)
        offsets.append(used[at])
        used[at] += need
        free -= need
        held = room.setdefault(free, [])
        if not held:
            rooms |= 1 << free
        held.append(at)
    return bins, offsets, used


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it) of each item, and the downsized capacity of each bin, by the cheapest of all plans."""
    sizes = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    ordered = lengths[order]
    waiting = _Waiting(ordered)
    holds = np.asarray(sizes, np.int64)

    def least(need: int, placed: int) -> int:
        def price(c: int) -> float:
            tokens = need + waiting.filled(c - need, placed + 1)
            return cost(sizes[int(np.searchsorted(holds, tokens))]) / tokens

        return min((c for c in sizes if c >= need), key=price)

    def up_to(c: int):
        return lambda need, _: c if need <= c else sizes[int(np.searchsorted(holds, need))]

    best = None
    plain = ordered.tolist()
    for opened in (least, *map(up_to, sizes)):
        bins, offsets, used = _fit(plain, sizes, opened)
        down = holds[np.searchsorted(holds, used)] if used else np.zeros(0, np.int64)
        price = total_cost(down)
        if best is None or price < best[0] - 1e-9:
            best = price, bins, offsets, down
    placed_in, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    placed_in[order], at[order] = best[1], best[2]
    return placed_in, at, best[3]


def cut(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, number of the piece in it, length) of documents of ``sizes`` ids, none longer than ``most``."""
    many = -(-sizes // most)
    of = np.repeat(np.arange(len(sizes)), many)
    piece = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return of, piece, np.minimum(sizes[of] - piece * most, most)


def sequences(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, group_items: int = GROUP_ITEMS) -> DataFrame:
    """One row a bin: bin_id, bin_capacity, bin_used, ids (as many bytes each as :func:`id_bytes` says) and the pieces in it."""
    most = max(capacities)

    def run(batches):
        coder = encoder(tokenizer_path)
        width, end = coder.bytes, int(end_id).to_bytes(coder.bytes, "little")
        first = TaskContext.get().partitionId() << 40
        keys: list[int | None] = []
        texts: list[bytes] = []
        held = 0
        for b in pieces_of(batches, 1024):
            for key, packed in zip(b.column(0).to_pylist(), coder.encode(b.column(1).to_pylist()), strict=True):
                keys.append(key)
                texts.append(packed + end)
                held += len(packed) // width + 1
                if len(keys) >= group_items or held >= GROUP_IDS:
                    made = _bins(keys, texts, width, capacities, most, first)
                    first += made.num_rows
                    yield from pieces_of([made])
                    keys, texts, held = [], [], 0
        coder.rest()
        if keys:
            yield from pieces_of([_bins(keys, texts, width, capacities, most, first)])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")), run, SEQUENCES, holds=True)


PIECE = pa.struct([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int32()), ("bin_offset", pa.int32())])


def _bins(keys: list, texts: list[bytes], width: int, capacities: tuple[int, ...], most: int, first: int) -> pa.RecordBatch:
    """The sequences of one group; each bin's pieces in order of place."""
    of, piece, n = cut(np.array([len(t) // width for t in texts], np.int64), most)
    bins, offset, capacity = best_fit(n, capacities)
    order = np.lexsort((offset, bins))
    ends = np.searchsorted(bins[order], np.arange(len(capacity) + 1))
    rows = list(zip(of[order].tolist(), piece[order].tolist(), n[order].tolist(), offset[order].tolist(), strict=True))
    ids, inside, used = [], [], []
    for a, b in zip(ends, ends[1:], strict=False):
        parts = rows[a:b]
        ids.append(b"".join(texts[d][p * most * width : (p * most + m) * width] for d, p, m, _ in parts))
        inside.append([{"id": keys[d], "piece": p, "start": p * most, "n_tokens": m, "bin_offset": o} for d, p, m, o in parts])
        used.append(len(ids[-1]) // width)
    values = [pa.array(np.arange(first, first + len(capacity))), pa.array(capacity, pa.int32()), pa.array(used, pa.int32()), pa.array(ids, pa.binary()), pa.array(inside, pa.list_(PIECE))]
    return pa.record_batch(values, ["bin_id", "bin_capacity", "bin_used", "ids", "pieces"])


def read(packed: DataFrame) -> DataFrame:
    """One row a piece of a table of sequences, with the CRC-32 of its ids as unsigned 32-bit integers."""

    def run(batches):
        for b in pieces_of(batches):
            cols: list[list] = [[] for _ in range(9)]
            for number, capacity, used, raw, inside in zip(*(c.to_pylist() for c in b.columns), strict=True):
                width = len(raw) // used
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                for p in inside:
                    at, n = p["bin_offset"], p["n_tokens"]
                    for col, x in zip(cols, (p["id"], p["piece"], p["start"], n, number, at, used, capacity, zlib.crc32(ids[at : at + n])), strict=True):
                        col.append(x)
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 7]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return map_arrow(packed.select("bin_id", "bin_capacity", "bin_used", "ids", "pieces"), run, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One row a piece: id, piece, start, n_tokens, bin_id, bin_offset, bin_used, bin_capacity, ids_crc32."""
    return read(saved(sequences(docs, tokenizer_path, id_col=id_col, **options), "packed")).withColumnRenamed("id", id_col)
