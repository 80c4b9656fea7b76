"""Token-id shards with keyed access through a minimal perfect hash.

A shard is one binary file:

    payload    ids of all its records, little-endian, 2 bytes each if the vocabulary allows it, else 4
    lengths    ids of each record (unsigned 32-bit)
    keys       document key of each record (signed 64-bit; ascending, null keys first and counted apart)
    hash       minimal perfect hash over the distinct keys
    slots      of each slot: fingerprint of its key, first record, number of records (unsigned 32-bit each)
    footer     sizes of all of these, and a magic string

A lookup hashes the key to its slot, compares the fingerprint, and has the records' places in the
payload: constant time, whatever the shard holds.  A key that was never stored is turned away unless
its 32-bit fingerprint coincides with the slot's.

Shards follow each other in ascending key order; a manifest table names them with the number of ids
before each.  Files carry unique names and only those of committed tasks enter the manifest, so a
task that runs twice does no harm.

Defined results: a null text counts as empty and has the end id alone; records of a repeated key lie side by
side, in order of their texts' hashes; a record without a key is stored first and can be listed, not looked up;
a text's ids are the library's by its defaults, so an added token of the tokenizer's file that stands in a text
(``<|endoftext|>``) has its own id; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import gc
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import HELD, file_system, halve, map_arrow, pieces_of, saved, scratch_path, text_or_empty, width
from tidemark.llm.mph import MinimalPerfectHash, key_hashes

MAGIC = b"TIDETOK1"
FOOTER = struct.Struct("<6Q8s")  # id bytes, records, null keys, distinct keys, ids, hash bytes, magic
#: Pre-tokens whose ids a worker keeps at most in a task, and between tasks.
PIECE_CACHE, PIECES_KEPT = 500_000, 200_000
#: Characters of the longest pre-token that is kept.
LONGEST = 64
#: Text a shard is planned for, in bytes, so that its sections fit in a task whatever the table's size; ids read at once.
SHARD_BYTES, READ_IDS = 256 << 20, 1 << 20
#: The pre-token pattern in terms of the ``re`` module, which scans faster; the same where a text has none of ``ODD``.
FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


@lru_cache(maxsize=1)
def odd() -> re.Pattern:
    """Characters that ``re`` classes otherwise than Unicode's letters, numbers and white space:
    numbers that are no decimal digits, and four separators that are no white space.  Only the basic
    plane is listed, as a class of its characters is one table; a text beyond it counts as odd."""
    points = [c for c in range(0x10000) if unicodedata.category(chr(c)) in ("No", "Nl") or 0x1C <= c <= 0x1F]
    return re.compile("[" + "".join(map(chr, points)) + "]")


BEYOND = re.compile("[\U00010000-\U0010ffff]").search
#: A pre-token begins at every space before something else than white space, and at every point and comma after a letter
#: or number.  A text without the first of these is cut at its spaces, one without the second at its points and commas too.
UNEVEN, LOOSE = re.compile(r" \s|\0").search, re.compile(r"[.,](?<![^\W_].)").search


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class CachedEncoder:
    """Ids of texts by a ``tokenizers`` file, one pre-token at a time.

    Texts are cut at spaces, and what is no single word there by the pre-token pattern.  Pre-tokens repeat, so each
    distinct one is encoded by the library's model once and its packed ids are kept in a bounded cache.  Texts that
    hold an added token's content are encoded whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        before = self.tokenizer.pre_tokenizer
        if self.tokenizer.normalizer or not isinstance(before, pre_tokenizers.ByteLevel) or before.add_prefix_space or not before.use_regex:
            raise ValueError("not a plain byte-level tokenizer")
        held = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, held)) if held else r"(?!)").search
        self.bytes = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.exact, self.odd = regex.compile(public_tokenizers.PATTERN).findall, odd().search
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.pieces: dict[str, bytes] = {}

    def _learn(self, wanted: Iterable[str]) -> None:
        """Encode new pre-tokens: the model takes each by the letters of its bytes."""
        kind, tokens, letters = "H" if self.bytes == 2 else "I", self.model.tokenize, self.letters
        for piece in wanted:
            word = piece[piece[0] == " " :]
            if word.isalpha() and word.isascii():
                plain = word if word is piece else "\u0120" + word
            else:
                plain = piece.encode().decode("latin-1").translate(letters)
            self.pieces[piece] = array(kind, [t.id for t in tokens(plain)]).tobytes()

    def _pre_tokens(self, text: str) -> list[str]:
        return self.exact(text) if not text.isascii() and BEYOND(text) or self.odd(text) else FAST.findall(text)

    def _cut(self, text: str) -> list[str]:
        """The text in pieces that end where pre-tokens end."""
        if UNEVEN(text):
            return self._pre_tokens(text)
        if not LOOSE(text):
            text = text.replace(".", "\0.").replace(",", "\0,")
        return text.replace(" ", "\0 ").split("\0")

    def _new(self, found: Iterable[list[str]]) -> set[str]:
        return set(chain.from_iterable(found)).difference(self.pieces)

    def rest(self) -> None:
        """Between tasks only so much is kept."""
        while len(self.pieces) > PIECES_KEPT:
            halve(self.pieces)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        whole = [n for n, t in enumerate(texts) if self.added(t)]
        if whole:
            kind = "H" if self.bytes == 2 else "I"
            coded = self.tokenizer.encode_batch_fast([texts[n] for n in whole], add_special_tokens=False)
            out = dict(zip(whole, [array(kind, e.ids).tobytes() for e in coded], strict=True))
            rest = iter(self.encode([t for n, t in enumerate(texts) if n not in out]))
            return [out[n] if n in out else next(rest) for n in range(len(texts))]
        on = gc.isenabled()
        gc.disable()  # millions of strings in lists, and no cycles
        try:
            return self._encode(texts)
        finally:
            if on:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = [self._cut(t) for t in texts]
        new = self._new(found)
        cut = {p: self._pre_tokens(p) for p in new if not p[p[:1] == " " :].isalpha()}
        new.difference_update(cut)
        new |= self._new(cut.values())
        self._learn(new)
        get = self.pieces.__getitem__
        passing = {p: b"".join(map(get, i)) for p, i in cut.items() if p not in self.pieces}
        self.pieces.update(passing)
        out = [b"".join(map(get, pieces)) for pieces in found]
        for p in chain(passing, (p for p in new if len(p) > LONGEST)):
            del self.pieces[p]
        if len(self.pieces) > PIECE_CACHE:
            halve(self.pieces)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> CachedEncoder:
    return CachedEncoder(path)


HELD.append(encoder.cache_clear)


class ShardWriter:
    """Appends records in key order; payload goes to the file as it comes."""

    def __init__(self, stream, id_bytes: int):
        self.stream, self.id_bytes = stream, id_bytes
        self.lengths: list[int] = []
        self.keys: list[int | None] = []

    def add(self, key: int | None, packed: bytes) -> None:
        self.stream.write(packed)
        self.keys.append(key)
        self.lengths.append(len(packed) // self.id_bytes)

    def close(self) -> None:
        nulls = sum(k is None for k in self.keys)
        keys = np.array([0 if k is None else k for k in self.keys], "<i8")
        distinct, first, many = np.unique(keys[nulls:], return_index=True, return_counts=True)
        hashes = key_hashes(distinct)
        mph = MinimalPerfectHash.build(hashes)
        slots = np.zeros((len(distinct), 3), "<u4")
        slots[mph.slots(hashes)] = np.stack([fingerprints(hashes), first + nulls, many], axis=1).astype("<u4") if len(distinct) else slots
        raw = mph.dump()
        for part in (np.array(self.lengths, "<u4").tobytes(), keys.tobytes(), raw, slots.tobytes()):
            self.stream.write(part)
        self.stream.write(FOOTER.pack(self.id_bytes, len(keys), nulls, len(distinct), sum(self.lengths), len(raw), MAGIC))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


class Shard:
    """A shard read back: all sections but the payload are held, and ids are fetched by record."""

    def __init__(self, source):
        """``source``: a seekable binary file."""
        self.source = source
        source.seek(0, 2)
        end = source.tell() - FOOTER.size
        source.seek(end)
        self.id_bytes, n, self.nulls, distinct, total, hash_bytes, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        source.seek(total * self.id_bytes)
        self.lengths = np.frombuffer(source.read(4 * n), "<u4")
        self.keys = np.frombuffer(source.read(8 * n), "<i8")
        self.mph = MinimalPerfectHash.load(source.read(hash_bytes))
        self.slots = np.frombuffer(source.read(12 * distinct), "<u4").reshape(distinct, 3)
        self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first record, number of records) of each key; 0 records where it isn't stored."""
        hashes = key_hashes(keys)
        at = self.mph.slots(hashes)
        held = self.slots[np.maximum(at, 0)] if len(self.slots) else np.zeros((len(hashes), 3), "<u4")
        hit = (at >= 0) & (held[:, 0] == fingerprints(hashes))
        return np.where(hit, held[:, 1], 0).astype(np.int64), np.where(hit, held[:, 2], 0).astype(np.int64)

    def run(self, first: int, many: int) -> list[np.ndarray]:
        """The ids of ``many`` records that lie side by side, by one read."""
        begin, ends = int(self.starts[first]), (self.starts[first : first + many] + self.lengths[first : first + many]).tolist()
        self.source.seek(begin * self.id_bytes)
        ids = np.frombuffer(self.source.read((ends[-1] - begin) * self.id_bytes), f"<u{self.id_bytes}")
        return [ids[a - begin : b - begin] for a, b in zip([begin, *ends], ends, strict=False)]

    def runs(self, records: list[int]):
        """(first, many) of the runs of neighbours in ``records``, none longer than one read should be."""
        at = 0
        while at < len(records):
            first, many, size = records[at], 1, int(self.lengths[records[at]])
            while at + many < len(records) and records[at + many] == first + many and size < READ_IDS:
                size += int(self.lengths[first + many])
                many += 1
            yield first, many
            at += many

    def get(self, key: int) -> list[np.ndarray]:
        first, many = self.find(np.array([key]))
        return self.run(int(first[0]), int(many[0])) if many[0] else []


def write(docs: DataFrame, tokenizer_path: str, folder: str | None = None, *, end_id: int = 2, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards and return their manifest: shard, path, n_docs, n_ids, first, last, base."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-shards")
    fs, at = file_system(folder)
    fs.create_dir(at, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    if shards is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        shards = max(width(spark), -(-size // SHARD_BYTES))
    order = rows.repartitionByRange(shards, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches):
        coder, writer, stream = encoder(tokenizer_path), None, None
        path = f"{folder}/{uuid.uuid4().hex}.tok"
        end = int(end_id).to_bytes(coder.bytes, "little")
        for b in pieces_of(batches, 1024):
            if writer is None:
                files, inner = file_system(path)
                stream = files.open_output_stream(inner)
                writer = ShardWriter(stream, coder.bytes)
            for key, packed in zip(b.column(0).to_pylist(), coder.encode(b.column(1).to_pylist()), strict=True):
                writer.add(key, packed + end)
        coder.rest()
        if writer is not None:
            writer.close()
            stream.close()
            known = [k for k in writer.keys if k is not None]
            values = [[TaskContext.get().partitionId()], [path], [len(writer.keys)], [sum(writer.lengths)], [known[0] if known else None], [known[-1] if known else None]]
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4]
            yield pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["shard", "path", "n_docs", "n_ids", "first", "last"])

    made = saved(map_arrow(order, run, "shard long, path string, n_docs long, n_ids long, first long, last long", holds=True), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every record, from the files.

    Records with a key are fetched through the index, in their shard's order; ``start`` counts the ids before.
    """

    def run(batches):
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                files, inner = file_system(path)
                with files.open_input_file(inner) as source:
                    shard = Shard(source)
                    first, many = shard.find(shard.keys[shard.nulls :])
                    new = np.concatenate([[True], shard.keys[shard.nulls + 1 :] != shard.keys[shard.nulls : -1]]) if len(first) else np.zeros(0, bool)
                    records = [*range(shard.nulls), *(r for f, m in zip(first[new], many[new], strict=True) for r in range(f, f + m))]
                    for at in range(0, len(records), 4096):
                        part = records[at : at + 4096]
                        crc = [zlib.crc32(ids.astype("<u4")) for f, m in shard.runs(part) for ids in shard.run(f, m)]
                        keys = [None if r < shard.nulls else int(shard.keys[r]) for r in part]
                        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(base + shard.starts[part], pa.int64()), pa.array(shard.lengths[part].astype(np.int64)), pa.array(crc, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    return map_arrow(manifest.select("path", "base").repartition(max(width(manifest.sparkSession), manifest.count()), "path"), run, "key long, start long, n_tokens long, ids_crc32 long")


def fetch(manifest: DataFrame, wanted: DataFrame, *, key_col: str = "doc_id") -> DataFrame:
    """(key, ids) of the wanted keys: each goes to the shard whose range holds it, and is looked up there."""

    def run(batches):
        for b in batches:
            keys = np.array(b.column("key").to_pylist(), np.int64)
            paths = np.array(b.column("path").to_pylist())
            for path in dict.fromkeys(paths.tolist()):
                mine = keys[paths == path]
                files, inner = file_system(path)
                with files.open_input_file(inner) as source:
                    shard = Shard(source)
                    first, many = shard.find(mine)
                    got = [(int(k), ids.astype(np.int64).tolist()) for k, f, m in zip(mine, first, many, strict=True) if m for ids in shard.run(int(f), int(m))]
                yield pa.record_batch([pa.array([k for k, _ in got], pa.int64()), pa.array([x for _, x in got], pa.list_(pa.int64()))], ["key", "ids"])

    keys = wanted.select(F.col(key_col).cast("long").alias("key")).filter("key is not null").distinct()
    dealt = keys.join(manifest.select("path", "first", "last"), F.col("key").between(F.col("first"), F.col("last")))
    return map_arrow(dealt.select("key", "path").repartition("path").sortWithinPartitions("path"), run, "key long, ids array<long>")
