"""WARC archives and the normaliser of monolithic gzip.

Archives are first written as a crawler may leave them: one gzip stream over a whole file. The normaliser inflates such a stream once, rewrites every record as a gzip member of its own, and writes a sidecar index of (record, offset, length), by which single records can be read. On the way it turns payloads that another record holds already into revisit records.

Files are reached by pyarrow's filesystems, so the folder may be local, shared or a store. A task that runs again writes files of another name; only those that the manifest names count.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harrow.llm.shared import delete, discard, shared_dir, stash

#: Bytes of records after which a file is closed and the next one opened, and the bytes read at once.
FILE_BYTES, READ_BYTES = 64 << 20, 1 << 20
_DATE = "2024-01-01T00:00:00Z"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def id_text(page: object) -> str:
    """A page id as it stands in a header: %-escaped after a dot, so no text is taken for a missing id; the empty text where there is none."""
    return "" if page is None else "." + quote(str(page), safe="")


def id_of(text: str) -> str | None:
    return unquote(text[1:]) if text else None


def record(page: str, url: str | None, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """A response record with its HTTP head and payload, or a revisit record with the head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, at most READ_BYTES at once."""
    z = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            yield z.decompress(chunk, READ_BYTES)
            chunk = z.unconsumed_tail
            if z.eof:
                chunk, z = z.unused_data, zlib.decompressobj(31)


def records(content: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record in a stream of WARC content."""
    held = bytearray()
    more = iter(content)

    def fill(n: int) -> bool:
        while len(held) < n:
            chunk = next(more, None)
            if chunk is None:
                return False
            held.extend(chunk)
        return True

    while True:
        looked = 0
        while (end := held.find(b"\r\n\r\n", looked)) < 0:
            looked = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                if held.strip():
                    raise ValueError("a WARC record is cut off")
                return
        first, *lines = held[:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines)
        size = int(headers["Content-Length"])
        if not fill(end + 4 + size + 4):
            raise ValueError("a WARC record is cut off")
        yield headers, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size + 4]


def _chunks(at: fs.FileSystem, path: str) -> Iterator[bytes]:
    with at.open_input_stream(path, compression=None) as f:
        while chunk := f.read(READ_BYTES):
            yield chunk


def write(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Writes every row of pages as a response record into monolithic .warc.gz files; the manifest: page_id, file, nth record there, payload's length, digest and SHA-256."""
    d = pages.select("page_id", "url", "html")
    shape = StructType([d.schema["page_id"], *StructType.fromDDL("file string, nth long, payload_bytes long, payload_digest string, same string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = _open(folder)
        at.create_dir(root, recursive=True)
        out = z = None
        name, size, nth = "", 0, 0
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part, rows = b.slice(k, 256), []
                for page, url, html in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    if out is None:
                        name, size, nth = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out, z = at.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                    payload = (html or "").encode()
                    digest = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
                    out.write(z.compress(data := record(id_text(page), url, payload, digest)))
                    rows.append((name, nth, len(payload), digest, hashlib.sha256(payload).hexdigest()))
                    nth, size = nth + 1, size + len(data)
                    if size >= FILE_BYTES:
                        out.write(z.flush())
                        out.close()
                        out = None
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), *columns], shape.names)
        if out is not None:
            out.write(z.flush())
            out.close()

    return d.mapInArrow(run, shape)


def normalise(files: DataFrame, source: str, target: str, level: int = 1) -> DataFrame:
    """Rewrites each file of `files` (file, revisits: array<struct<nth, refers_to>>) from source to target, a member a record, with a sidecar index; (file, records, bytes) of what it wrote. The source file is read once, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = _open(source)
        to, out_root = _open(target)
        to.create_dir(out_root, recursive=True)
        for b in batches:
            for file, revisits in zip(b.column("file").to_pylist(), b.column("revisits").to_pylist()):
                turned = {r["nth"]: id_text(r["refers_to"]) for r in revisits or []}
                name, index, offset = f"{uuid.uuid4().hex}.warc.gz", [], 0
                with to.open_output_stream(f"{out_root}/{name}", compression=None) as out:
                    for nth, (headers, block) in enumerate(records(inflated(_chunks(at, f"{root}/{file}")))):
                        page = headers["WARC-Record-ID"][len("<urn:page:") : -1]
                        head = block.index(b"\r\n\r\n") + 4
                        member = zlib.compressobj(level, zlib.DEFLATED, 31)
                        data = member.compress(record(page, headers.get("WARC-Target-URI"), block[head:], headers["WARC-Payload-Digest"][len("sha1:") :], turned.get(nth))) + member.flush()
                        out.write(data)
                        index.append((page, offset, len(data)))
                        offset += len(data)
                with to.open_output_stream(f"{out_root}/{name}.idx", compression=None) as out:
                    out.write("".join(json.dumps(x) + "\n" for x in index).encode())
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([name]), pa.array([len(index)], pa.int64()), pa.array([offset], pa.int64())], ["source", "file", "records", "bytes"])

    return files.mapInArrow(run, "source string, file string, records long, bytes long")


def read(files: DataFrame, folder: str) -> DataFrame:
    """The records of normalised files, each read by its place in the sidecar index: page (its id as text), record_type, refers_to (likewise), payload_bytes, payload_digest, payload (null for a revisit), file, offset. payload_bytes and the digest are those of the full payload; a response's are made anew and must agree with its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = _open(folder)
        kinds = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]
        names = ["page", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "file", "offset"]
        for b in batches:
            for file in b.column("file").to_pylist():
                rows: list[tuple] = []
                with at.open_input_stream(f"{root}/{file}.idx", compression=None) as f:
                    index = [json.loads(x) for x in f.read().splitlines()]
                with at.open_input_file(f"{root}/{file}") as f:
                    for page, offset, length in index:
                        f.seek(offset)
                        (headers, block), *rest = records(iter([zlib.decompress(f.read(length), 31)]))
                        if rest or headers["WARC-Record-ID"] != f"<urn:page:{page}>":
                            raise ValueError(f"{file} at {offset}: the index names another record")
                        head, _, payload = block.partition(b"\r\n\r\n")
                        digest, kind = headers["WARC-Payload-Digest"][len("sha1:") :], headers["WARC-Type"]
                        size = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
                        if kind == "response" and (size, digest) != (len(payload), base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()):
                            raise ValueError(f"{file} at {offset}: the payload does not match its header")
                        refers = headers.get("WARC-Refers-To")
                        rows.append((id_of(page), kind, id_of(refers[len("<urn:page:") : -1]) if refers else None, size, digest, payload if kind == "response" else None, file, offset))
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return files.select("file").mapInArrow(run, "page string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary, file string, offset long")


def archive(pages: DataFrame, folder: str | None = None, revisit_from: int = 0) -> tuple[DataFrame, str]:
    """Writes pages, normalises the archives and returns (files, folder) for read().

    Of records with equal payloads of at least revisit_from bytes, the one of the smallest page_id stays a response and the others become revisits of it. A null html is an empty payload; a null page_id comes last, and rows that repeat a page_id with one payload are one response and revisits of it. The html goes through the archives alone, never through a shuffle.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    raw, done = f"{folder}/raw", f"{folder}/records"
    manifest = stash(write(pages, raw), "manifest")
    key = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "file", "nth")
    first = manifest.where(F.col("payload_bytes") >= revisit_from).groupBy("same", "payload_bytes").agg(F.min(key).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    # as a table of its own, so that the join can split a payload that is very common
    first = stash(first, "first")
    copies = manifest.join(first, ["same", "payload_bytes"]).where((F.col("file") != F.col("first.file")) | (F.col("nth") != F.col("first.nth")))
    revisits = copies.groupBy("file").agg(F.collect_list(F.struct("nth", F.col("first.page_id").cast("string").alias("refers_to"))).alias("revisits"))
    files = manifest.select("file").distinct().join(revisits, "file", "left")
    files = stash(files, "files")
    made = stash(normalise(spread(files, files.count()), raw, done), "normalised")
    delete(spark, raw)
    discard(manifest, first, files)
    return made, done


def spread(files: DataFrame, n: int) -> DataFrame:
    """Files dealt over tasks, about one to each. A row is a whole archive, so the number of tasks is given: by size a few names would be one task."""
    return files.repartition(max(1, min(n, 10_000)), "file")


def round_trip(pages: DataFrame, folder: str | None = None, revisit_from: int = 0) -> DataFrame:
    """The rows of pages as the archives give them back: page_id, payload_bytes, payload_digest, record_type, refers_to, file, offset. Payloads of any length are taken whole; nulls, ties and repeated rows as in archive(); an empty table gives no rows; other columns are not read."""
    kind = pages.schema["page_id"].dataType
    files, at = archive(pages, folder, revisit_from)
    r = read(spread(files, files.count()), at)
    as_id = lambda c: F.col(c).cast(kind)
    return r.select(as_id("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"), "file", "offset")


#: round_trip()'s rows in DuckDB's SQL, over the table pages, whose page_ids differ.
SQL = """
with p as (select page_id, coalesce(html, '') as h, min(page_id) over (partition by coalesce(html, '')) as first, from_hex(sha1(coalesce(html, '')))::bit::varchar as bits from pages)
select page_id, strlen(h)::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + 16 * substr(bits, 5 * i + 1, 1)::int + 8 * substr(bits, 5 * i + 2, 1)::int + 4 * substr(bits, 5 * i + 3, 1)::int + 2 * substr(bits, 5 * i + 4, 1)::int + substr(bits, 5 * i + 5, 1)::int)::bigint, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from p"""
