"""Web pages as WARC records in ZIP packages, and back.

write_archives packs the pages of each task into packages of bounded size: a WARC member of
records compressed one by one, and a sorted index of their offsets, both stored as they are.  A page whose
payload another page has too is a revisit, a record without payload that names the other's.  read_records goes by
the packages' directories and indexes (archives.py) and reads records by range.

Each attempt of a task writes files of its own names; only the names that a finished task returned are read,
so that lost executors and repeated tasks leave unread files, never half of an archive.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import closing
from typing import Any

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opstables.llm import archives
from opstables.llm.common import SLICE_BYTES, fits_broadcast, stored
from opstables.sources.scratch import shared_dir

#: Bytes of records, and records, after which a package is closed.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 64_000_000, 20_000
#: Payloads of fewer bytes are written again each time.
REVISIT_BYTES = 100
#: Packages of more bytes are read by several tasks: records that start in the same RANGE_BYTES by one.
LARGE_BYTES, RANGE_BYTES = 256_000_000, 16_000_000
#: Tasks that read, at most.
MOST_TASKS = 100_000
#: Fixed values of the formats.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
#: The target of a page without url.
NO_URL = "urn:no-url"
_MANIFEST = "archive string, bytes long, records long"
_ENTRIES = "archive string, member string, start long, length long"
_RECORDS = "page_id long, url string, record_type string, refers_to long, record_id string, refers_to_record string, payload_bytes long, payload_digest string, payload binary"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}:{digest}'.encode()).hexdigest())}>"


def _target(url: str | None) -> str:
    """The url as a header can hold it: white space and control characters are percent-encoded."""
    return NO_URL if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _sort_key(target: str) -> str:
    """Host reversed, then the rest: pages of a domain stand together."""
    found = re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)(?::\d+)?(.*)", target)
    return f"{','.join(reversed(found[1].lower().split('.')))}){found[2] or '/'}" if found else target


def _record(page_id: int | None, target: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """refers_to: the page of the response, if this is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _record_id(page_id, digest), "WARC-Date": date, "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http;msgtype=response", "Content-Length": len(block), "X-Page-Id": "" if page_id is None else page_id,
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _record_id(refers_to, digest), "X-Refers-To-Page-Id": refers_to}
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


class _Package:
    """A package being written: records stream into its WARC member, what the index needs is held."""

    def __init__(self, folder: str) -> None:
        self.uri, self.offset = f"{folder}/{uuid.uuid4().hex}.wacz", 0
        files, path = FileSystem.from_uri(self.uri)
        self._out = files.open_output_stream(path)
        self._zip = zipfile.ZipFile(self._out, "w", zipfile.ZIP_STORED)
        self._member = self._zip.open(WARC_MEMBER, "w", force_zip64=True)
        self._index: list[str] = []

    def add(self, record: bytes, target: str, digest: str, date: str) -> None:
        packer = zlib.compressobj(1, wbits=31)
        packed = packer.compress(record) + packer.flush()
        self._member.write(packed)
        entry = {"url": target, "mime": "text/html", "status": "200", "digest": f"sha256:{digest}", "length": str(len(packed)), "offset": str(self.offset), "filename": WARC_MEMBER.removeprefix("archive/")}
        self._index.append(f"{_sort_key(target)} {re.sub('[^0-9]', '', date)} {json.dumps(entry)}\n")
        self.offset += len(packed)

    def full(self) -> bool:
        return self.offset >= ARCHIVE_BYTES or len(self._index) >= ARCHIVE_RECORDS

    def close(self) -> pa.RecordBatch:
        self._member.close()
        with self._zip.open(INDEX_MEMBER, "w") as index:
            index.writelines(line.encode() for line in sorted(self._index))
        self._zip.close()
        n = self._out.tell()
        self._out.close()
        return pa.RecordBatch.from_pylist([{"archive": self.uri, "bytes": n, "records": len(self._index)}])


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    package: _Package | None = None
    for batch in batches:
        for i in range(batch.num_rows):  # one payload at a time
            page_id, url, html, digest, refers_to = (c[i].as_py() for c in batch.columns)
            package, target = package or _Package(folder), _target(url)
            package.add(_record(page_id, target, html.encode(), digest, refers_to, date), target, digest, date)
            if package.full():
                yield package.close()
                package = None
    if package:
        yield package.close()


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, html (without nulls), digest, refers_to: the page of the response, for pages that revisit it.

    Of equal payloads of REVISIT_BYTES at least, the smallest page_id has the response (each of its rows, if it is
    repeated); a row without page_id revisits, unless all of them are without.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumn("digest", F.sha2("html", 256))
    large = F.octet_length("html") >= REVISIT_BYTES
    same = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    groups = stored(same.select(F.col("digest").alias("shared"), "first"), "warc-groups")
    # rows that share no payload must not meet under one key: theirs is their own
    key: Column = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    small = fits_broadcast(groups.count(), 120)
    joined = rows.withColumn("key", key).join(F.broadcast(groups) if small else groups, F.col("key") == F.col("shared"), "left")
    return joined.select("page_id", "url", "html", "digest", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """archive (URI), bytes, records: the packages written, for pages (page_id, url, html).

    Null html is an empty payload, a null url gets a target that stands for none, and rows without page_id are
    written without one; repeated rows give a record each, an empty table no package.  Html of any length is one record, held whole
    by one task.  Other columns aren't read.  folder: a URI that all executors reach; by default in the shared folder.
    """
    base = folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    files, path = FileSystem.from_uri(base)
    files.create_dir(path, recursive=True)
    return stored(marked(pages).mapInArrow(lambda it: _write(it, base, date), _MANIFEST), "warc-manifest")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each package, a few thousand at a time."""
    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
    for uri in (x for batch in batches for x in batch.column("archive").to_pylist()):
        with closing(archives.opened(uri)) as file:
            held: list[dict[str, Any]] = []
            for member, start, length in archives.entries(archives.Ranges(file)):
                held.append({"archive": uri, "member": member, "start": start, "length": length})
                if len(held) == 4096:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held = []
            yield pa.RecordBatch.from_pylist(held, schema=schema)


def record_index(manifest: DataFrame, tasks: int) -> DataFrame:
    """archive, member, start, length: where each record of the packages (column archive) lies, in order within a package."""
    return manifest.select("archive").repartition(tasks).mapInArrow(_entries, _ENTRIES)


def _fields(head: bytes) -> dict[str, str]:
    lines = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in lines if name.strip()}


def _parsed(record: bytes, payloads: bool) -> tuple:
    """A row of _RECORDS; ValueError if the record isn't what its header says."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest, n = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:"), int(_fields(http)["content-length"])
    if not head.startswith(b"WARC/1.") or kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields.get('warc-record-id')}")
    number = lambda name: int(fields[name]) if fields.get(name) else None
    shown = payload if payloads and kind == "response" else None
    return number("x-page-id"), None if (target := fields["warc-target-uri"]) == NO_URL else target, kind, number("x-refers-to-page-id"), fields["warc-record-id"], fields.get("warc-refers-to"), n, digest, shown


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = [x.split()[0] for x in _RECORDS.split(", ")]
    uri, file, ranges = None, None, None
    for batch in batches:
        rows, held = [], 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for archive, member, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if archive != uri:
                if file:
                    file.close()
                uri, file = archive, archives.opened(archive)
                ranges = archives.Ranges(file)
            packed = ranges.read(start, length)
            rows.append(_parsed(zlib.decompress(packed, 31) if member.endswith(".gz") else packed, payloads))
            held += rows[-1][6] if payloads else 0
            if held > SLICE_BYTES:
                yield out()
                rows, held = [], 0
        yield out()
    if file:
        file.close()


def read_records(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """page_id, url, record_type, refers_to, record_id, refers_to_record, payload_bytes, payload_digest, payload: one row for each record.

    A task reads whole packages, by their order in the index; those of over LARGE_BYTES are read by several, in ranges.  manifest: archive
    (URI) and bytes of each.  A record is checked against its header's length and digest.  Bytes and digest of a revisit are those of the payload that it
    stands for, as its header states; payload is null for revisits, and for all records unless payloads is set.
    """
    large = F.col("bytes") > LARGE_BYTES
    n, n_large, bytes_large = manifest.agg(F.count("*"), F.count_if(large), F.coalesce(F.sum(F.when(large, F.col("bytes"))), F.lit(0))).first()
    # numbers of tasks are given: the rows are few, what they name is not
    where = record_index(manifest.where(~large), min(n - n_large, MOST_TASKS) or 1)
    if n_large:
        apart = record_index(manifest.where(large), min(n_large, MOST_TASKS))
        parts = min(math.ceil(bytes_large / LARGE_BYTES), MOST_TASKS)
        where = where.unionByName(apart.repartition(parts, "archive", F.expr(f"start DIV {RANGE_BYTES}")).sortWithinPartitions("archive", "start"))
    return where.mapInArrow(lambda it: _read(it, payloads), _RECORDS)


def read_pages(manifest: DataFrame) -> DataFrame:
    """page_id, url, html: the pages that were written, those of revisits with the payload of the record that they refer to."""
    records = read_records(manifest, payloads=True)
    full = records.where("record_type = 'response'").groupBy("record_id").agg(F.first("payload").alias("full"))
    both = records.join(full.withColumnRenamed("record_id", "refers_to_record"), "refers_to_record", "left")
    return both.select("page_id", "url", F.coalesce("payload", "full").cast("string").alias("html"))
