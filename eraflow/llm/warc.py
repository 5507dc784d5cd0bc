"""Web archives with a two-level capture index.

Pages become WARC records, one gzip member each, in archives that their tasks write
directly to shared storage. Of records with equal payloads the one with the largest page
id is the response; the others are revisits that name it and carry no payload, only
its HTTP header and digest.

The index is sorted by the address with its host reversed (``com,example)/path``) and the
page id. Its lines lie in compressed blocks, one index file per range partition; next to
it a sparse directory holds the first key and the place of every block. A lookup picks
the file by binary search over the files' first keys (one per range partition, the only
thing that goes through the driver), the block by binary search in that file's
directory, reads one block, searches it, and reads the record by its range. Sorted
lookups open each directory and block once; records are fetched in archive order, and
neighbouring ranges in one read.

Files are written under names no other attempt uses, and only rows of finished tasks name
them.

A null payload is empty. Null page ids sort first and never become the response of a group
that has an id; in a group without ids, all are responses. Rows that repeat the page id of
a group's response are responses too. A null address is stored as empty. Rows that repeat
an address and a page id are captures of their own. A very long page is one record, of
which a task holds one at a time. Other columns, whatever they are called, are ignored.
An empty table gives no file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eraflow.llm.common import broadcast_if_small, file_system, lower_ascii, new_file, store

# Index lines of a block; bytes after which a task begins another archive; gap and total up
# to which neighbouring records are fetched in one read.
BLOCK_LINES, ARCHIVE_BYTES, READ_GAP, READ_BYTES = 2000, 1 << 30, 1 << 16, 8 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURES = "key string, page_id long, path string, place long, size long"
RECORDS = (
    "page_id long, url string, record_type string, payload_digest string, payload_bytes long, "
    "refers_to long, payload binary"
)


def index_key(url: Column) -> Column:
    """The address with its host reversed; white space and control characters, which
    would break the index's lines, as %20."""
    at = F.locate("://", url)
    after = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    rest = F.substring(after, F.length(host) + 1, F.length(after))
    name = F.array_join(F.reverse(F.split(lower_ascii(host), r"\.")), ",")
    key = F.when(at > 0, F.concat(name, F.lit(")"), rest)).otherwise(F.concat(F.lit(")"), F.coalesce(url, F.lit(""))))
    return F.regexp_replace(key, r"[\x00-\x20\x7f]", "%20")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode().rstrip("=")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One compressed record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        "WARC-Target-URI: " + re.sub(r"[\r\n]", "%0A", url or ""), f"WARC-Date: {DATE}",
        f"WARC-Record-ID: {name(page_id)}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    raw = "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"
    return gzip.compress(raw, 6, mtime=0)


def parse(member: bytes) -> tuple:
    """The fields of ``RECORDS`` from one compressed record."""
    raw = zlib.decompress(member, 31)
    head, _, body = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    body = body[: int(fields["Content-Length"])]
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda text: int(text[10:-1]) if len(text) > 11 else None
    kind, mark = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != mark):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    refers = number(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return (
        number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, mark, size, refers,
        payload if kind == "response" else None,
    )


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0
) -> DataFrame:
    """Write a record per page; the stored captures. Payloads of fewer than ``least``
    bytes are never revisits."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"),
        F.sha1(payload).alias("mark"), index_key(F.col(url)).alias("key"),
    )
    groups = (
        rows.where(F.octet_length("payload") >= least).groupBy("mark")
        .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND response IS NOT NULL").select(F.col("mark").alias("_mark"), "response")
    )
    groups = broadcast_if_small(store(groups, f"{folder}/groups"))
    revisit = F.coalesce(F.col("page_id").isNull() | (F.col("page_id") != F.col("response")), F.lit(False))
    joined = rows.join(groups, F.col("mark") == F.col("_mark"), "left").select(
        "key", "page_id", "url", "payload", "response", (F.col("response").isNotNull() & revisit).alias("revisit")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out, path, place = TaskContext.get().partitionId(), 0, None, None, 0
        for batch in batches:
            paths, places, sizes = [], [], []
            cells = [batch.column(c) for c in range(1, 6)]
            for row in zip(*cells, strict=True):
                page, address, body, response, again = (x.as_py() for x in row)
                if out is None or place > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    path = new_file(f"{folder}/archives", f"archive-{part:05d}-{number:04d}", ".warc.gz")
                    system, local = file_system(path)
                    out, place, number = system.open_output_stream(local, compression=None), 0, number + 1
                member = record(page, address, body, response, again)
                out.write(member)
                paths.append(path)
                places.append(place)
                sizes.append(len(member))
                place += len(member)
            if paths:
                yield pa.record_batch(
                    [batch.column(0), batch.column(1), pa.array(paths), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())],
                    ["key", "page_id", "path", "place", "size"],
                )
        if out is not None:
            out.close()

    return store(joined.mapInArrow(write, CAPTURES), f"{folder}/captures")


def _order(key: str, page_id: int | None) -> tuple:
    return key.encode(), page_id is not None, page_id or 0


def _read(path: str, place: int | None = None, size: int | None = None) -> bytes:
    system, local = file_system(path)
    with system.open_input_file(local) as f:
        return f.read() if place is None else f.read_at(size, place)


def build_index(captures: DataFrame, folder: str) -> list[tuple]:
    """Write the index; its files as (first key, first page id, blocks path, directory
    path), in order: one per range partition."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, path, place, first = TaskContext.get().partitionId(), None, None, 0, None
        held: list[tuple] = []
        directory: list[str] = []

        def block() -> None:
            nonlocal out, path, place, first
            if out is None:
                path = new_file(f"{folder}/index", f"shard-{part:05d}", ".blocks")
                system, local = file_system(path)
                out, first = system.open_output_stream(local, compression=None), held[0]
            lines = "".join("\t".join("" if x is None else str(x) for x in row) + "\n" for row in held)
            data = zlib.compress(lines.encode(), 6)
            out.write(data)
            start = "" if held[0][1] is None else held[0][1]
            directory.append(f"{held[0][0]}\t{start}\t{place}\t{len(data)}\n")
            place += len(data)
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) == BLOCK_LINES:
                    block()
        if held:
            block()
        if out is not None:
            out.close()
            system, local = file_system(path + ".directory")
            with system.open_output_stream(local, compression=None) as f:
                f.write(zlib.compress("".join(directory).encode(), 6))
            yield pa.record_batch(
                [pa.array([first[0]]), pa.array([first[1]], pa.int64()), pa.array([path]), pa.array([path + ".directory"])],
                ["key", "page_id", "blocks", "directory"],
            )

    ordered = captures.repartitionByRange("key", "page_id", "path", "place").sortWithinPartitions("key", "page_id", "path", "place")
    shards = store(ordered.mapInArrow(write, "key string, page_id long, blocks string, directory string"), f"{folder}/shards")
    return sorted((tuple(r) for r in shards.collect()), key=lambda r: _order(r[0], r[1]))


class IndexReader:
    """Searches the index; keeps the directory and the block it used last."""

    def __init__(self, shards: list[tuple]):
        self.shards, self.starts = shards, [_order(s[0], s[1]) for s in shards]
        self.directory: tuple = (None, [], [])
        self.block: tuple = (None, [], [])

    def _directory(self, shard: int) -> tuple[list, list]:
        if self.directory[0] != shard:
            text = zlib.decompress(_read(self.shards[shard][3])).decode()
            rows = [line.split("\t") for line in text.split("\n")[:-1]]
            starts = [_order(r[0], int(r[1]) if r[1] else None) for r in rows]
            self.directory = (shard, starts, [(int(r[2]), int(r[3])) for r in rows])
        return self.directory[1], self.directory[2]

    def _block(self, shard: int, number: int) -> tuple[list, list]:
        if self.block[0] != (shard, number):
            place, size = self._directory(shard)[1][number]
            text = zlib.decompress(_read(self.shards[shard][2], place, size)).decode()
            rows = []
            for line in text.split("\n")[:-1]:
                key, page, path, at, n = line.split("\t")
                rows.append((key, int(page) if page else None, path, int(at), int(n)))
            self.block = ((shard, number), [_order(r[0], r[1]) for r in rows], rows)
        return self.block[1], self.block[2]

    def between(self, low: tuple, high: tuple) -> Iterator[tuple]:
        """The captures from ``low`` to ``high``, both included."""
        shard = max(0, bisect_left(self.starts, low) - 1)
        while shard < len(self.shards) and self.starts[shard] <= high:
            starts = self._directory(shard)[0]
            number = max(0, bisect_left(starts, low) - 1)
            while number < len(starts) and starts[number] <= high:
                keys, rows = self._block(shard, number)
                yield from rows[bisect_left(keys, low) : bisect_right(keys, high)]
                number += 1
            shard += 1


def lookup(wanted: DataFrame, shards: list[tuple], exact: bool = True) -> DataFrame:
    """The captures of the distinct keys of ``wanted``: of (key, page_id), or with
    ``exact`` off all captures of a key."""
    columns = ["key", "page_id"] if exact else ["key"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = IndexReader(shards)
        for batch in batches:
            found: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low = _order(row[0], row[1] if exact else None)
                high = low if exact else (low[0], True, 1 << 63)
                found += reader.between(low, high)
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("key", "page_id", "path", "place", "size"), r, strict=True)) for r in found],
                pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("path", pa.string()), ("place", pa.int64()), ("size", pa.int64())]),
            )

    asked = wanted.select(*columns).distinct().repartitionByRange(*columns).sortWithinPartitions(*columns)
    return asked.mapInArrow(find, CAPTURES)


def read_records(captures: DataFrame) -> DataFrame:
    """The records of ``captures`` (path, place, size), from range reads of the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
            ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()),
        ])
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            at = 0
            while at < len(rows):
                path, start, size = rows[at]
                end, to = start + size, at + 1
                while to < len(rows) and rows[to][0] == path and 0 <= rows[to][1] - end <= READ_GAP and rows[to][1] + rows[to][2] - start <= READ_BYTES:
                    end = rows[to][1] + rows[to][2]
                    to += 1
                data = _read(path, start, end - start)
                parsed = [parse(data[p - start : p - start + n]) for _, p, n in rows[at:to]]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*parsed, strict=True), schema, strict=True)], schema=schema)
                at = to

    placed = captures.select("path", "place", "size").repartition("path").sortWithinPartitions("path", "place")
    return placed.mapInArrow(run, RECORDS)

