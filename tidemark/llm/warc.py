"""WARC archives with revisits, and their capture index by external merging.

Writing: every task writes its records to one archive (a gzip member each) and remembers, for each
capture, its URL key, timestamp, place and digest.  At the end it sorts these into a *run*, written beside
the archive with a sparse index of places in the run.  A run is as large as one task's captures.

Merging: splitters drawn from the runs' sparse indexes cut the (URL key, timestamp) order into ranges.  A
merge task reads its range's slice of up to ``FAN_IN`` runs and merges them with a loser tree: one path of
comparisons from leaf to root for each capture.  More runs than that are merged in several passes: the
first merges whole runs by the ``FAN_IN``, each later one cuts the ranges of the one before by as much, so tasks
keep one size and every pass opens about as many slices as there are runs.  The last pass merges by the
finest ranges, which follow each other: the globally ordered capture history.
One URL with very many captures is cut by timestamp like everything else.

Reading: the history's rows go to their archives, where each record is read at its offset; what is
returned comes from the archive's bytes, and a response's payload is hashed again.

Defined results: null html is the empty payload, a null URL the empty one; of payloads with at least
``REVISIT_FROM`` bytes the capture with the largest id is the response (all of them, should that id repeat), and captures
without an id are responses; smaller payloads are always responses; a URL that can't be parsed is its own key; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import HOT_LEAST, HOT_SHARE, file_system, looked_up, map_arrow, pieces_of, saved, scratch_path, text_or_empty, width

REVISIT_FROM = 1000
FAN_IN = 64
#: A run's sparse index has an entry for so many captures; splitters are drawn from at most so many entries.
SPARSE, SPLIT_SAMPLE = 128, 20_000
#: Captures a merged range is planned for; bytes between records that are read through, and bytes read at once.
RANGE_CAPTURES, GAP, SPAN = 1_000_000, 1 << 16, 4 << 20
GZIP_LEVEL = 3
EPOCH = 1_577_836_800
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str) -> str:
    """Sort-friendly form of a URL: host labels reversed, scheme, port and fragment dropped; what can't be parsed stays as it is."""
    try:
        parts = urlsplit(url if "://" in url else f"http://{url}")
    except ValueError:  # such as an unclosed bracket, or a host that normalises to other separators
        return url
    host = (parts.netloc.rpartition("@")[2].partition(":")[0]).lower()
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


def record(kind: str, page_id: int | None, url: str, stamp: str, digest: str, size: int, refers: int | None, payload: bytes) -> bytes:
    """One WARC record; a revisit carries the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {stamp}", f"WARC-Target-URI: {quote(url, safe=SAFE)}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


#: All printable ASCII passes as it is but the percent sign, so that unquoting is exact.
SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


def parse(raw: bytes) -> dict:
    """The fields of a record: kind, page_id, url, stamp, size, digest, refers, payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and len(x) > len("<urn:page:>") else None
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    return {"kind": fields["warc-type"], "page_id": number(fields["warc-record-id"]), "url": unquote(fields["warc-target-uri"]), "stamp": fields["warc-date"], "size": size, "digest": digest, "refers": number(fields.get("warc-refers-to", "")), "payload": payload}


class LoserTree:
    """Merge of k sorted iterators; ties go to the iterator that comes first."""

    END = (1,)

    def __init__(self, sources: list[Iterator]):
        self.sources = [iter(s) for s in sources]
        self.k = max(1, len(self.sources))
        # (0, entry, source) sorts before END
        self.heads = [self._next(i) for i in range(len(self.sources))] or [self.END]
        self.losers = [0] * self.k
        self.winner = self._build(1) if self.k > 1 else 0

    def _next(self, i: int) -> tuple:
        for entry in self.sources[i]:
            return (0, entry, i)
        return self.END

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self.heads[a] <= self.heads[b] else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator:
        while self.heads[self.winner] is not self.END:
            i = self.winner
            yield self.heads[i][1]
            self.heads[i] = self._next(i)
            node = (i + self.k) // 2
            while node:
                if self.heads[self.losers[node]] < self.heads[i]:
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


Entry = tuple  # (url key, stamp, page id or -1, archive, offset, length)


def write_run(path: str, entries: Iterator[Entry]) -> list[list]:
    """Write sorted entries as JSON lines; returns the sparse index [[key, stamp, id, place], ...]."""
    fs, at = file_system(path)
    sparse, place = [], 0
    with fs.open_output_stream(at) as out:
        for n, e in enumerate(entries):
            line = (json.dumps(e) + "\n").encode()
            if n % SPARSE == 0:
                sparse.append([*e[:3], place])
            out.write(line)
            place += len(line)
        index = json.dumps(sparse).encode()
        out.write(index + struct.pack("<QQ", place, len(index)))
    return sparse


def read_run(path: str, lo: list | None, hi: list | None) -> Iterator[Entry]:
    """Entries at ``lo`` or above and below ``hi``, read from the place the sparse index gives."""
    fs, at = file_system(path)
    with fs.open_input_file(at) as f:
        end = f.size()
        f.seek(end - 16)
        body, size = struct.unpack("<QQ", f.read(16))
        f.seek(body)
        sparse = json.loads(f.read(size))
        first = 0
        if lo is not None:
            # equal entries may begin before the first sparse entry that equals lo, never before the one ahead of it
            first = sparse[max(0, bisect.bisect_left(sparse, list(lo)) - 1)][3] if sparse else 0
        f.seek(first)
        left, rest = body - first, b""
        while left or rest:
            chunk = f.read(min(left, 1 << 16))
            left -= len(chunk)
            *lines, rest = (rest + chunk).split(b"\n")
            for line in lines:
                e = json.loads(line)
                if hi is not None and e[:3] >= hi:
                    return
                if lo is None or e[:3] >= lo:
                    yield tuple(e)
            if not left:
                return


def planned(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, html, size, digest, refers): ``refers`` is the response's id for captures that are revisits.

    Responses of repeated payloads are found from ids and digests alone.  Payloads are looked up against that
    table, which only holds digests that repeat; small payloads, which refer to nothing, pass by, and a digest on
    very many rows meets its response by broadcast.
    """
    html = text_or_empty(html_col)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), text_or_empty(url_col).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("size"), F.sha1(html).alias("digest"))
    large = F.col("size") >= REVISIT_FROM
    again = saved(rows.filter(large).groupBy("digest").agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "warc-again")
    total = again.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [r[0] for r in again.filter(F.col("n") > max(HOT_LEAST, total // HOT_SHARE)).select("digest").collect()]
    met = looked_up(rows.filter(large), "digest", again.select("digest", "winner"), "left", hot=hot)
    names = ["id", "url", "html", "size", "digest"]
    met = met.select(*names, F.when(F.col("id") < F.col("winner"), F.col("winner")).alias("refers"))
    return met.unionByName(rows.filter(~large).select(*names, F.lit(None).cast("long").alias("refers")))


def write(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives and runs of ``planned`` rows; returns the manifest: archive, run, captures, sparse."""
    folder = folder or scratch_path(records.sparkSession, "warc")
    fs, at = file_system(folder)
    fs.create_dir(at, recursive=True)

    def run(batches):
        name = f"{folder}/{uuid.uuid4().hex}"
        entries, out, place = [], None, 0
        for b in pieces_of(batches):
            if out is None:
                files, inner = file_system(f"{name}.warc.gz")
                out = files.open_output_stream(inner, compression=None)
            for i, url, html, size, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                stamp = datetime.fromtimestamp(EPOCH + (i or 0) % 2_000_000_000, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
                packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                raw = record("response" if refers is None else "revisit", i, url, stamp, digest, size, refers, html.encode())
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                entries.append((url_key(url), stamp, -1 if i is None else i, f"{name}.warc.gz", place, len(member)))
                place += len(member)
        if out is not None:
            out.close()
            sparse = write_run(f"{name}.run", iter(sorted(entries)))
            yield pa.record_batch([pa.array([f"{name}.warc.gz"]), pa.array([f"{name}.run"]), pa.array([len(entries)], pa.int64()), pa.array([[json.dumps(s[:3]) for s in sparse]], pa.list_(pa.string()))], ["archive", "run", "captures", "sparse"])

    return saved(map_arrow(records.select("id", "url", "html", "size", "digest", "refers"), run, "archive string, run string, captures long, sparse array<string>"), "warc-manifest")


def merge(manifest: DataFrame, folder: str | None = None, *, fan_in: int = FAN_IN, ranges: int | None = None) -> DataFrame:
    """(range, place, url_key, stamp, id, archive, offset, length): all captures, in order by range and place.

    What the driver sees is one path for each run and a bounded draw of their sparse indexes.
    """
    spark = manifest.sparkSession
    folder = folder or scratch_path(spark, "warc-merge")
    fs, at = file_system(folder)
    fs.create_dir(at, recursive=True)
    draw = manifest.select(F.explode("sparse").alias("s"))
    points = sorted(json.loads(r[0]) for r in draw.orderBy(F.xxhash64("s")).limit(SPLIT_SAMPLE).collect())
    captures = manifest.agg(F.coalesce(F.sum("captures"), F.lit(0))).first()[0]
    many = min(ranges or max(width(spark), -(-captures // RANGE_CAPTURES)), max(1, len(points)))
    cuts = [points[len(points) * i // many] for i in range(1, many)]
    bounds = [(lo, hi) for lo, hi in zip([None, *cuts], [*cuts, None], strict=True) if lo != hi or lo is None]
    last = len(bounds)
    # a group is what one pass has merged so far: its pieces, by the ranges they cover, each [a, b) of the finest
    groups = [{(0, last): p[0]} for p in manifest.select("run").orderBy("run").collect()]
    parts = [(0, last)]

    def tasks(rows: list[tuple]) -> DataFrame:
        frame = spark.createDataFrame(rows, "grp int, a int, b int, paths array<string>")
        return frame.repartition(max(1, len(rows)), "grp", "a")

    def slices(a: int, b: int, paths: list[str]) -> LoserTree:
        return LoserTree([read_run(p, bounds[a][0], bounds[b - 1][1]) for p in paths])

    def holding(group: dict, a: int, b: int) -> str:
        return next(path for (x, y), path in group.items() if x <= a and b <= y)

    def combine(batches):
        for batch in batches:
            for g, a, b, paths in zip(*(batch.column(c).to_pylist() for c in ("grp", "a", "b", "paths")), strict=True):
                name = f"{folder}/{uuid.uuid4().hex}.run"
                write_run(name, iter(slices(a, b, paths)))
                yield pa.record_batch([pa.array([g], pa.int32()), pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([name])], ["grp", "a", "b", "run"])

    def finish(batches):
        for batch in batches:
            for a, b, paths in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "paths")), strict=True):
                held, place = [], 0
                for e in slices(a, b, paths):
                    held.append(e)
                    if len(held) == 4096:
                        yield _history(a, place, held)
                        place, held = place + len(held), []
                yield _history(a, place, held)

    while len(groups) > fan_in:
        met = [groups[i : i + fan_in] for i in range(0, len(groups), fan_in)]
        rows = [(g, a, b, [holding(x, a, b) for x in some]) for g, some in enumerate(met) for a, b in parts]
        groups = [{} for _ in met]
        for row in saved(map_arrow(tasks(rows), combine, "grp int, a int, b int, run string"), "warc-pass").collect():
            groups[row["grp"]][row["a"], row["b"]] = row["run"]
        parts = [(x, min(x + step, b)) for a, b in parts for step in [max(1, -(-(b - a) // fan_in))] for x in range(a, b, step)]
    final = [(0, r, r + 1, [holding(g, r, r + 1) for g in groups]) for r in range(last)]
    history = saved(map_arrow(tasks(final), finish, HISTORY), "warc-history")
    met = history.count()
    if met != captures:
        raise ValueError(f"the history has {met} captures, the manifest {captures}")
    return history


HISTORY = "range int, place long, url_key string, stamp string, id long, archive string, offset long, length long"


def _history(r: int, place: int, entries: list[Entry]) -> pa.RecordBatch:
    cols = list(zip(*entries, strict=True)) if entries else [()] * 6
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array([r] * len(entries), pa.int32()), pa.array(range(place, place + len(entries)), pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["range", "place", "url_key", "stamp", "id", "archive", "offset", "length"])


def spans(places: list[tuple[int, int, str]]) -> Iterator[list[tuple[int, int, str]]]:
    """Records (offset, length, key) in order of place, parted where a gap or a span would grow too large for one read."""
    held: list[tuple[int, int, str]] = []
    for place in sorted(places):
        if held and (place[0] - held[-1][0] - held[-1][1] > GAP or place[0] + place[1] - held[0][0] > SPAN):
            yield held
            held = []
        held.append(place)
    if held:
        yield held


def read(history: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, url_key, stamp) of the history's captures.

    Records that are neighbours in an archive come with one read.
    """

    def run(batches):
        for b in batches:
            found: dict[str, list] = {}
            for key, archive, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found.setdefault(archive, []).append((offset, length, key))
            out: list[dict] = []
            for archive, places in found.items():
                files, inner = file_system(archive)
                with files.open_input_file(inner) as f:
                    for span in spans(places):
                        begin = span[0][0]
                        f.seek(begin)
                        raw = f.read(span[-1][0] + span[-1][1] - begin)
                        for offset, length, key in span:
                            got = parse(zlib.decompress(raw[offset - begin : offset - begin + length], 31))
                            if got["kind"] == "response":
                                digest, size = hashlib.sha1(got["payload"]).hexdigest(), len(got["payload"])
                                if digest != got["digest"] or size != got["size"]:
                                    raise ValueError(f"{archive} at {offset}: payload does not match its digest")
                            out.append({"page_id": got["page_id"], "payload_bytes": got["size"], "payload_digest": got["digest"], "record_type": got["kind"], "refers_to": got["refers"], "url": got["url"], "url_key": key, "stamp": got["stamp"]})
            yield pa.RecordBatch.from_pylist(out, schema=READ_SCHEMA)

    places = history.select("url_key", "archive", "offset", "length")
    return map_arrow(places.repartition(width(history.sparkSession), "archive").sortWithinPartitions("archive", "offset"), run, READ)


READ_NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "url_key", "stamp"]
READ_SCHEMA = pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes", "refers_to") else pa.string()) for n in READ_NAMES])
READ = ", ".join(f"{n} {'long' if n in ('page_id', 'payload_bytes', 'refers_to') else 'string'}" for n in READ_NAMES)
