"""WARC archives of pages, and a two-level index of their captures.

First level: files of compressed blocks of index lines, sorted by reversed-host URL key. Second level: a sparse
directory with the first key of each block. A lookup finds its index file and then its block by binary search, reads
that block's bytes, and reads each record by its range in the archive.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.scratch import shared_dir, written

#: Payloads of fewer bytes are always written whole.
LEAST_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
_UNSAFE = re.compile(r"[\x00-\x20\x7f-\U0010ffff]")


def url_key(url: str | None) -> str:
    """The URL with its host reversed and in small letters, without scheme, leading www, default port or fragment:
    `com,example,blog)/path?query`. Signs outside printable ASCII are percent-encoded; null gives an empty key."""
    if not url:
        return ""
    plain = _UNSAFE.sub(lambda m: quote(m[0].encode("utf-8", "replace")), url)
    try:
        parts = urlsplit(plain)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return f"){plain.lower()}"
    names = host.split(".")
    if len(names) > 2 and re.fullmatch(r"www\d*", names[0]):
        names = names[1:]
    port = "" if port in (None, 80, 443) else f":{port}"
    return f"{','.join(reversed(names))}{port}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record: a response, or a revisit without payload whose HTTP header keeps the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {_UNSAFE.sub(lambda m: quote(m[0].encode('utf-8', 'replace')), url or '')}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def read_record(data: bytes) -> dict:
    """What a record says of itself; a response's payload is held against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda x: int(x[10:-1]) if x and len(x) > 11 else None  # noqa: E731  <urn:page:7>
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To"))}


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@dataclass(frozen=True)
class Archive:
    """Folders of WARC files and index files, and the sparse directory (file, block, first_key, offset, length, lines)."""

    folder: str
    directory: DataFrame
    captures: DataFrame


_LINE = "key string, page_id long, archive string, offset long, length long"


def write_archive(pages: DataFrame, archive_bytes: int = 1 << 30, block_lines: int = 3000, index_files: int | None = None) -> Archive:
    """Archives of all rows of pages (page_id, url, html), written to the shared folder, and their index.

    A null html is an empty payload. Of equal payloads of LEAST_BYTES or more the record with the smallest page_id is
    the response (all rows of that page_id, if it is repeated); the others revisit it; with no page_id at all, all are
    responses. Other columns are ignored. An empty table gives an index without blocks. File names are new for each
    attempt of a task, and only the files of the attempt that ended well are in the index.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark)
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"), F.sha2(html, 256).alias("digest"))
    light = written(rows.select("page_id", "digest", F.length("payload").alias("n")).where(f"n >= {LEAST_BYTES}"), "digests")
    first = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("rows")).where("rows > 1 AND refers_to IS NOT NULL")
    again = light.join(first, "digest").where("NOT (page_id <=> refers_to)").select(F.coalesce("page_id", F.lit(-1)).alias("_id"), F.col("page_id").isNull().alias("_none"), F.col("digest").alias("_digest"), "refers_to").distinct()
    rows = rows.join(again, (F.coalesce("page_id", F.lit(-1)) == F.col("_id")) & (F.col("page_id").isNull() == F.col("_none")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "payload", "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _files(folder)
        store.create_dir(f"{path}/warc", recursive=True)
        name, out, at = "", None, 0
        for b in batches:
            lines = []
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/warc/{name}", compression=None)
                data = gzip.compress(record(page_id, url, payload, digest, refers_to, refers_to is not None), 3, mtime=0)
                out.write(data)
                lines.append((url_key(url), page_id, name, at, len(data)))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*lines, strict=True)) or [[]] * 5, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()], strict=True)], ["key", "page_id", "archive", "offset", "length"])
        if out is not None:
            out.close()

    captures = written(rows.mapInArrow(write, _LINE), "captures")
    files = index_files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(files, "key", "page_id").sortWithinPartitions("key", "page_id")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _files(folder)
        store.create_dir(f"{path}/index", recursive=True)
        name, out, at, block, kept = f"{uuid.uuid4().hex}.idx", None, 0, 0, []

        def flush() -> tuple:
            nonlocal out, at, block, kept
            if out is None:
                out = store.open_output_stream(f"{path}/index/{name}", compression=None)
            data = zlib.compress("\n".join(map(json.dumps, kept)).encode(), 6)
            out.write(data)
            row = (name, block, kept[0][0], at, len(data), len(kept))
            at, block, kept = at + len(data), block + 1, []
            return row

        done = []
        for b in batches:
            for line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                kept.append(line)
                if len(kept) == block_lines:
                    done.append(flush())
        if kept:
            done.append(flush())
        if out is not None:
            out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()], strict=True)], ["file", "block", "first_key", "offset", "length", "lines"])

    return Archive(folder, written(ordered.mapInArrow(index, "file string, block long, first_key string, offset long, length long, lines long"), "directory"), captures)


def lookup(archive: Archive, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The captures (key, page_id, archive, offset, length) of each distinct URL key in urls; null asks for the empty key.

    The driver holds the first key of each index file only, of which there are as many as partitions. Keys go to the
    index files that may hold them, a key over several files to each of these; a task reads the directory entries of
    its file beside its keys and searches them.
    """
    files = archive.directory.where("block = 0").select("first_key", "file").orderBy("first_key", "file").collect()
    starts, names = [r[0] for r in files], [r[1] for r in files]
    folder = archive.folder

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key in {url_key(u) for u in b.column(0).to_pylist()}:
                at = max(0, bisect_left(starts, key) - 1)
                while at < len(starts) and (starts[at] <= key):
                    out.append((names[at], key))
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(2)], ["file", "key"])

    asked = urls.select(F.col(url_col).cast("string")).mapInArrow(ask, "file string, key string").distinct()
    none = lambda t: F.lit(None).cast(t)
    entries = archive.directory.select("file", F.lit(0).alias("kind"), F.col("first_key").alias("key"), "block", "offset", "length")
    both = entries.unionByName(asked.select("file", F.lit(1).alias("kind"), "key", none("long").alias("block"), none("long").alias("offset"), none("long").alias("length")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _files(folder)
        file, firsts, ranges, read, block, lines, keys = None, [], [], None, -1, [], []
        for b in batches:
            out = []
            for name, kind, key, _block, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if name != file:
                    file, firsts, ranges, read, block = name, [], [], None, -1
                if kind == 0:
                    firsts.append(key)
                    ranges.append((offset, length))
                    continue
                read = read or store.open_input_file(f"{path}/index/{file}")
                at = max(0, bisect_left(firsts, key) - 1)
                while at < len(firsts) and firsts[at] <= key:
                    if at != block:
                        read.seek(ranges[at][0])
                        lines = [json.loads(x) for x in zlib.decompress(read.read(ranges[at][1])).split(b"\n")]
                        block, keys = at, [x[0] for x in lines]
                    i = bisect_left(keys, key)
                    while i < len(keys) and keys[i] == key:
                        out.append(lines[i])
                        i += 1
                    at += 1
                if len(out) >= 20_000:
                    yield _captures(out)
                    out = []
            yield _captures(out)

    return both.repartition("file").sortWithinPartitions("file", "kind", "block", "key").mapInArrow(search, _LINE)


def _captures(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate([pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()])], ["key", "page_id", "archive", "offset", "length"])


def read_captures(archive: Archive, captures: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each capture, read by its range."""
    folder = archive.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _files(folder)
        name, file = None, None
        for b in batches:
            out = []
            for warc, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if warc != name:
                    name, file = warc, store.open_input_file(f"{path}/warc/{warc}")
                file.seek(offset)
                out.append(read_record(gzip.decompress(file.read(length))))
            yield pa.RecordBatch.from_pylist(out, pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    near = captures.select("archive", "offset", "length").withColumn("_part", F.floor(F.col("offset") / (1 << 22)))  # 4 MB of an archive to a task
    near = near.repartition("archive", "_part").sortWithinPartitions("archive", "offset").drop("_part")
    return near.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """What the archives of pages say of every row of pages, found by URL key and read back."""
    archive = write_archive(pages)
    return read_captures(archive, lookup(archive, pages))
