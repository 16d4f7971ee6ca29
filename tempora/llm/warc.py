"""WARC archives written and read by an index.

Tasks write records to archive files in a folder that all executors share, each record compressed
on its own, and return one index row a record: file, offset, length, URL and digest. Reading
starts from the index: the rows wanted are sorted by file and offset, neighbouring byte ranges
are read together, and nothing else of the archives is touched. Files of failed or repeated task
attempts have names of their own that no index row mentions.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import byte_column, sliced
from tempora.session import materialize, shared_folder

LEAST_BYTES = 1000  # payloads from this size on are stored once
FILE_BYTES = 256 << 20  # an archive file is closed once it has so many
READ_BYTES = 4 << 20  # of neighbouring records read together, or one longer record
GAP_BYTES = 64 << 10  # of unwanted records read over rather than sought past
ROWS_A_BATCH = 256
INDEX = "file string, offset long, length long, url string, payload_digest string, payload_bytes long, record_type string, record_id string"
RECORD = "record_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"

# Fixed values of the format.
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31  # zlib's window bits for a gzip member
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")


def file_system(path: str):
    """The store of a path and the path in it, for reads and writes inside tasks."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def record(record_id: str, url: bytes | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit with the response's headers alone.
    Bytes of a URL that would end its header line are percent-encoded."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    head = [VERSION, b"WARC-Type: " + (b"revisit" if refers_to else b"response"), f"WARC-Record-ID: <{record_id}>".encode(),
            f"WARC-Date: {date}".encode(), f"WARC-Payload-Digest: sha1:{_base32(digest)}".encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url))
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to}>".encode(), f"WARC-Profile: {IDENTICAL}".encode()]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in raw.split(b"\r\n")[1:])}


def parsed(raw: bytes) -> dict:
    """The fields of a record as ``record`` writes it; the payload of a response is checked against
    its digest, the size of a revisited one is that of the HTTP headers."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = _headers(head)
    if not head.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    http, _, payload = rest[: int(h[b"content-length"])].partition(b"\r\n\r\n")
    digest = base64.b32decode(h[b"warc-payload-digest"].removeprefix(b"sha1:")).hex()
    kind = h[b"warc-type"].decode()
    size = int(_headers(http)[b"content-length"])
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload and digest differ")
    refers = h.get(b"warc-refers-to")
    url = h.get(b"warc-target-uri")
    return {"record_id": h[b"warc-record-id"][1:-1].decode(), "url": None if url is None else url.decode("utf-8", "replace"), "record_type": kind,
            "refers_to": refers[1:-1].decode() if refers else None, "payload_digest": digest, "payload_bytes": size,
            "payload": payload if kind == "response" else None}


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of rows and bytes of payload."""
    some, size = [], 0
    for r in rows:
        some.append(r)
        size += len(r.get("payload") or b"")
        if len(some) == ROWS_A_BATCH or size > READ_BYTES:
            yield pa.RecordBatch.from_pylist(some, schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_pylist(some, schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def write_records(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", compressed: bool = True) -> DataFrame:
    """Writes ``(record_id, url, payload, payload_digest, refers_to)`` as archives under ``folder`` and
    returns their index, one row a record; the caller writes it once (each evaluation of the
    returned frame writes archives anew). A task holds one record and one batch at a time."""
    arrow = _arrow(INDEX)

    def run(batches):
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)

        def written():
            out, name, at = None, "", 0
            try:
                for b in sliced(batches, "payload"):
                    ids, digests, refers = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("record_id", "payload_digest", "refers_to"))
                    urls = b.column(b.schema.get_field_index("url")).cast(pa.binary()).to_pylist()
                    for i, u, p, d, r in zip(ids, urls, byte_column(b, "payload"), digests, refers):
                        if out is None or at >= FILE_BYTES:
                            if out is not None:
                                out.close()
                            name, at = f"{uuid.uuid4().hex}.warc{'.gz' if compressed else ''}", 0
                            out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        raw = record(i, u, p, d, r, date)
                        if compressed:
                            z = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                            raw = z.compress(raw) + z.flush()
                        out.write(raw)
                        yield {"file": name, "offset": at, "length": len(raw), "url": None if u is None else u.decode("utf-8", "replace"),
                               "payload_digest": d, "payload_bytes": len(p), "record_type": "revisit" if r else "response", "record_id": i}
                        at += len(raw)
            finally:
                if out is not None:
                    out.close()

        yield from _batches(written(), arrow)

    return rows.select("record_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(run, INDEX)


def read_records(selected: DataFrame, folder: str) -> DataFrame:
    """The records of the selected index rows, read from the archives under ``folder``.

    Rows are dealt out by ranges of (file, offset), so a task's byte ranges are neighbours: those
    with small gaps between them are read at once, up to a few MB. Repeated rows are read once a
    row. Payloads are null in revisits.
    """
    arrow = _arrow(RECORD)

    def run(batches):
        fs, root = file_system(folder)

        def wanted():
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in range(3)))

        def records():
            opened: dict = {}
            try:
                for name, start, end, group in coalesced(wanted()):
                    if name not in opened:
                        while opened:
                            opened.popitem()[1].close()
                        opened[name] = fs.open_input_file(f"{root}/{name}")
                    raw = opened[name].read_at(end - start, start)
                    for offset, length in group:
                        own = raw[offset - start: offset - start + length]
                        if len(own) != length:
                            raise ValueError(f"{name}: shorter than its index says")
                        yield parsed(zlib.decompress(own, GZIP) if own[:2] == b"\x1f\x8b" else own)
            finally:
                while opened:
                    opened.popitem()[1].close()

        yield from _batches(records(), arrow)

    return selected.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions(
        "file", "offset").mapInArrow(run, RECORD)


def coalesced(ranges: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) as reads (file, start, end, its (offset, length) pairs)."""
    name, start, end, group = None, 0, 0, []
    for f, offset, length in ranges:
        if group and f == name and offset - end <= GAP_BYTES and max(end, offset + length) - start <= READ_BYTES:
            end = max(end, offset + length)
            group.append((offset, length))
            continue
        if group:
            yield name, start, end, group
        name, start, end, group = f, offset, offset + length, [(offset, length)]
    if group:
        yield name, start, end, group


def records_of(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
               least: int = LEAST_BYTES) -> DataFrame:
    """``(record_id, url, payload, payload_digest, refers_to)`` of pages: of equal payloads of at least
    ``least`` bytes the one with the largest id is a response, the others refer to it."""
    own = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).alias("url"),
                       F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("payload_digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    first = (own.where(F.col("size") >= least).groupBy("payload_digest", "size", F.xxhash64("payload").alias("own"))
             .agg(F.max("page").alias("kept"), F.count("*").alias("n")).where("n > 1 and kept is not null").drop("n"))
    first = materialize(first, "repeated")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    joined = own.withColumn("own", F.xxhash64("payload")).join(first, ["payload_digest", "size", "own"], "left")
    return joined.select(name("page").alias("record_id"), "url", "payload", "payload_digest",
                         F.when(~F.col("kept").eqNullSafe(F.col("page")) & F.col("kept").isNotNull(), name("kept")).alias("refers_to"))


def archive_pages(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html",
                  least: int = LEAST_BYTES) -> tuple[DataFrame, str]:
    """Writes all pages as records under ``folder`` (a new one in the shared checkpoint folder if not
    given); the written index and the folder.

    A null html is an empty payload; a null url has no header. Equal payloads are those of one
    digest, size and second hash. Rows that repeat the largest id are all responses; rows without
    an id refer to the row that has one, and are responses if none has. An empty table gives an
    empty index; further columns are ignored.
    """
    folder = folder or shared_folder(pages.sparkSession, "archives")
    return materialize(write_records(records_of(pages, page_id, url, html, least), folder), "index"), folder


def page_of(column: str):
    """The id of a page from its record id; null if it has none."""
    return F.substring(column, len("urn:page:") + 1, 20).try_cast("long")
