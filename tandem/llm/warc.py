"""WARC archives with an index first, and reads that are planned from it.

Writing: each task appends the records of its rows, each a gzip member of its own, to an
archive file of its own in the shared folder and returns one index row per record: file, offset, length, URL, digest. Files
get a fresh name per attempt, and the index, which is a table, names only files of attempts
that ended well, so a lost executor leaves nothing but an unnamed file.

Equal payloads from a minimum size on are stored once: the page with the smallest id is the
response, the others are revisit records that name it and keep only the headers.

Reading: the selected index rows are sorted by file and offset and dealt as stretches of a
file; within a stretch neighbouring byte ranges are coalesced into one read as long as the
gap between them is small, and records are cut out of what was read.

Results: null html counts as an empty payload. A null URL is written as an empty target.
Rows that repeat an id each get a record; a null id cannot be named and is never a response
to others. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import join_hot, prepared
from tandem.session import materialise, scratch_path

REVISIT_BYTES = 100
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
STRETCH_BYTES = 64 << 20
TASK_BYTES = 32 << 20
FILE_BYTES = 256 << 20
LEVEL = 5
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"

INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}')}>"


def make_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit of ``refers_to`` without the payload."""
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_one_line(url)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in "\r\n\t " else c for c in url)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name and the block of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(":", 1) for line in lines[1:])
    named = {name.lower(): value.strip() for name, value in fields.items()}
    return named, rest[: int(named["content-length"])]


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[list[int]]:
    """Groups of positions in ``ranges`` (offset, length; sorted) that one read serves."""
    groups: list[list[int]] = []
    first = end = 0
    for i, (offset, length) in enumerate(ranges):
        if groups and offset - end <= gap and offset + length - first <= most:
            groups[-1].append(i)
            end = max(end, offset + length)
        else:
            groups.append([i])
            first, end = offset, offset + length
    return groups


def _open_folder(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _planned(pages: DataFrame) -> DataFrame:
    """Adds digest, and the page that a repeated payload refers to."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
    )
    digest = F.sha2(F.col("html").cast("binary"), 256)
    keys = materialise(
        rows.where((F.octet_length("html") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", digest.alias("digest")),
        "payloads",
    )
    first = materialise(
        keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated"
    )
    refers = (
        join_hot(keys, first, "digest", "n", keys.count())
        .where(F.col("page_id") != F.col("first"))
        .select("page_id", "digest", F.col("first").alias("refers_to"))
        .distinct()
    )
    return rows.withColumn("digest", digest).join(refers, ["page_id", "digest"], "left")


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record per row of ``pages (page_id, url, html)`` and returns the index, itself a
    written table."""
    prepared(pages.sparkSession)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open_folder(folder)
        system.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, digest, refers_to in zip(
                    *(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))
                ):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    record = gzip.compress(make_record(page_id, url, html.encode(), digest, refers_to), LEVEL, mtime=0)
                    out.write(record)
                    kind = "response" if refers_to is None else "revisit"
                    rows.append((page_id, name, at, len(record), url, digest, kind))
                    at += len(record)
                columns = list(zip(*rows)) if rows else [()] * 7
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds)],
                    names=["page_id", "file", "offset", "length", "url", "digest", "record_type"],
                )
        finally:
            if out is not None:
                out.close()

    return materialise(_planned(pages).mapInArrow(write, INDEX), "warc-index")


def read_records(
    selected: DataFrame, folder: str, gap: int = GAP_BYTES, read_bytes: int = READ_BYTES, stretch_bytes: int = STRETCH_BYTES
) -> DataFrame:
    """Reads the records of index rows: ``page_id, url, record_type, payload_bytes,
    payload_digest, refers_to``, from headers and payload alone."""

    def read(rows: pa.Table) -> pa.Table:
        system, root = _open_folder(folder)
        rows = rows.sort_by([("offset", "ascending")])
        ranges = list(zip(rows.column("offset").to_pylist(), rows.column("length").to_pylist()))
        made = []
        with system.open_input_file(f"{root}/{rows.column('file')[0].as_py()}") as file:
            for group in coalesced(ranges, gap, read_bytes):
                first, end = ranges[group[0]][0], max(sum(ranges[i]) for i in group)
                data = file.read_at(end - first, first)
                for i in group:
                    offset, length = ranges[i]
                    member = data[offset - first : offset - first + length]
                    made.append(_facts(*parse_record(gzip.decompress(member))))
        columns = list(zip(*made))
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
        return pa.table({n: pa.array(list(c), k) for n, c, k in zip(names, columns, kinds)})

    stretch = F.floor(F.col("offset") / stretch_bytes)
    # Tasks by the bytes to read: the index rows themselves are few bytes, by which they would all
    # be merged into one task.
    size = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).head()[0]
    tasks = max(selected.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES)
    return (
        selected.select("file", "offset", "length", stretch.alias("stretch"))
        .repartition(tasks, "file", "stretch")
        .groupBy("file", "stretch")
        .applyInArrow(
            read,
            "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long",
        )
    )


def _facts(fields: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = next(int(v) for n, v in (line.split(b":", 1) for line in http.split(b"\r\n")[1:]) if n.lower() == b"content-length")
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    kind = fields["warc-type"]
    if kind == "response":
        actual = hashlib.sha256(payload).hexdigest()
        if len(payload) != declared or actual != digest:
            raise ValueError(f"payload of page {fields['x-page-id']} does not match its headers")
    page, other = fields["x-page-id"], fields.get("x-refers-to-page-id")
    return (int(page) if page else None, fields["warc-target-uri"], kind, declared, digest, int(other) if other else None)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages, reads every record back: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to``."""
    folder = scratch_path(pages.sparkSession, "warc")
    index = write_archives(pages, folder)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
