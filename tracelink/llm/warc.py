"""WARC archives of pages: records written in segments with chunked payloads, and read back by segment reassembly.

Writing: a page whose payload is at least `revisit_bytes` long and equal to that of a page with a larger id becomes a `revisit` of the
largest such id and carries no payload. All others are `response` records: an HTTP message whose body is framed in chunks. A message longer than
`segment_bytes` is cut into a first record and `continuation` records; each carries its number and the origin's id, the last one the total length.
Archives are gzip files of one member per record, written by the tasks and renamed when they are complete.

Reading: every archive is streamed once for whole records and once for segments. Segments alone are shuffled: by the id of their origin, in order of
their number. A record counts only if its segments run from 1 to the one with the total length and add up to it; then its chunks are decoded.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.llm.hashing import bounded_batches, slices
from tracelink.llm.tokens import _exists
from tracelink.storage import materialise

#: So many repeated payloads at most go to all tasks (some 100 bytes each); more are joined with the pages.
BROADCAST_PAYLOADS = 500_000
INDEX = "file string, records long, bytes long"
PAGE = "page_id long, url string, record_type string, refers_to long, payload binary, payload_digest string, problem string"
SEGMENT = "origin string, number int, total long, page_id long, url string, payload_digest string, block binary, problem string"
_EOL = b"\r\n"


# writing


def frame(payload: bytes, chunk_bytes: int) -> bytes:
    """A body in chunked transfer framing."""
    parts = (payload[at : at + chunk_bytes] for at in range(0, len(payload), chunk_bytes))
    return b"".join([*(b"%x\r\n%b\r\n" % (len(p), p) for p in parts), b"0\r\n\r\n"])


def _header(value: object) -> str:
    """Header values hold no blanks at line ends and no control characters: these are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", str(value))


def record(kind: str, identity: str, fields: dict[str, object], block: bytes, date: str) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{identity}>", "WARC-Date": date, **{k: _header(v) for k, v in fields.items() if v is not None}}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + _EOL + _EOL


def page_records(page_id: int | None, url: str | None, payload: bytes | None, digest: str, refers: int | None, refers_url: str | None, name: Callable[[int], str], segment_bytes: int, chunk_bytes: int, date: str) -> Iterator[bytes]:
    """The records of one page; name(i) is the identity of its i-th."""
    fields = {"WARC-Target-URI": url or f"urn:page:{page_id}", "Page-ID": page_id, "Page-URL-Missing": None if url else "1", "WARC-Payload-Digest": f"sha1:{digest}"}
    if refers is not None:
        more = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Target-URI": refers_url or f"urn:page:{refers}", "WARC-Refers-To-Date": date, "Refers-To-Page-ID": refers}
        yield record("revisit", name(0), fields | more, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n", date)
        return
    message = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + frame(payload, chunk_bytes)
    fields["Content-Type"] = "application/http;msgtype=response"
    if len(message) <= segment_bytes:
        yield record("response", name(0), fields, message, date)
        return
    origin = f"<urn:uuid:{name(0)}>"
    for i, at in enumerate(range(0, len(message), segment_bytes)):
        own = fields if i == 0 else {"WARC-Target-URI": fields["WARC-Target-URI"], "WARC-Segment-Origin-ID": origin}
        last = {"WARC-Segment-Total-Length": len(message)} if at + segment_bytes >= len(message) else {}
        yield record("continuation" if i else "response", name(i), own | {"WARC-Segment-Number": i + 1} | last, message[at : at + segment_bytes], date)


class _Archive:
    """One gzip file, under a hidden name until it is complete."""

    def __init__(self, store, folder: str, file: str):
        self.store, self.file, self.draft, self.target = store, file, f"{folder}/.{file}-{uuid.uuid4().hex}", f"{folder}/{file}"
        self.out, self.records, self.bytes = store.open_output_stream(self.draft, compression=None), 0, 0

    def add(self, data: bytes, level: int) -> None:
        packed = zlib.compress(data, level, wbits=31)
        self.out.write(packed)
        self.records, self.bytes = self.records + 1, self.bytes + len(packed)

    def close(self) -> pa.RecordBatch:
        self.out.close()
        self.store.move(self.draft, self.target)
        return pa.RecordBatch.from_arrays([pa.array([self.file]), pa.array([self.records], pa.int64()), pa.array([self.bytes], pa.int64())], ["file", "records", "bytes"])


def _write(folder: str, segment_bytes: int, chunk_bytes: int, archive_bytes: int, date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task, pages, archive, files = TaskContext.get().partitionId(), 0, None, 0
        for batch in (p for batch in batches for p in slices(batch, "payload")):
            for page in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers", "refers_url")], strict=True):
                # the name follows from the page and its place in the task: equal rows stay apart
                name = lambda i, page=page, pages=pages: str(uuid.UUID(bytes=hashlib.md5(f"{page[0]}/{page[3]}/{task}/{pages}/{i}".encode()).digest(), version=3))
                for data in page_records(*page, name, segment_bytes, chunk_bytes, date):
                    if archive is None:
                        archive, files = _Archive(store, base, f"pages-{task:06d}-{files:06d}.warc.gz"), files + 1
                        archive.add(record("warcinfo", str(uuid.uuid3(uuid.NAMESPACE_URL, archive.file)), {"WARC-Filename": archive.file}, b"", date), level)
                    archive.add(data, level)
                    if archive.bytes >= archive_bytes:
                        yield archive.close()
                        archive = None
                pages += 1
        if archive is not None:
            yield archive.close()

    return run


def planned(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """(page_id, url, payload, digest, refers, refers_url): what is written of each row; a revisit has no payload."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    sized = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    long = F.octet_length("payload") >= revisit_bytes
    content = F.sha2("payload", 256)
    same = sized.where(long).groupBy(content.alias("content")).agg(F.max("page_id").alias("kept"), F.max_by("url", "page_id").alias("kept_url"), F.count("*").alias("n"))
    same = materialise(same.where("n > 1 AND kept IS NOT NULL").drop("n"), "repeated-payloads")
    n = same.count()
    # both sides carry a key of their own, so that adaptive execution can split a payload that many pages hold
    joined = sized.withColumn("key", F.when(long, content)).join(F.broadcast(same) if n <= BROADCAST_PAYLOADS else same, F.col("key") == F.col("content"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    return joined.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), F.sha1("payload").alias("digest"), refers.alias("refers"), F.when(refers.isNotNull(), F.col("kept_url")).alias("refers_url"))


def write_archives(
    pages: DataFrame, path: str, revisit_bytes: int = 1000, segment_bytes: int = 8192, chunk_bytes: int = 4096, archive_bytes: int = 256 << 20, date: str = "2026-01-01T00:00:00Z", level: int = 4
) -> None:
    """Archives of every row of `pages` (page_id, url, html) in `path`/archives, a URI that all executors reach, and their index in `path`/index.

    A null html is an empty payload; a null url is written as urn:page:<id> and read back as null. Rows that share the largest id of equal payloads are responses all
    of them, as are rows with null ids, unless a row with an id has their payload. Repeated rows are records of their own. Blanks and control characters in URLs are
    percent-encoded. Other columns, whatever their names, are not read. `path` must be new. A task that runs again replaces its archives, whose names follow from its number.
    """
    bounded_batches(pages.sparkSession)
    planned(pages, revisit_bytes).mapInArrow(_write(f"{path}/archives", segment_bytes, chunk_bytes, archive_bytes, date, level), INDEX).write.parquet(f"{path}/index")


# reading


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(headers by lower-case name, block, problem) of each record; an archive that breaks off ends with a record with a problem, or none."""
    while line := stream.readline():
        if line == _EOL or line == b"\n":
            continue
        if not line.startswith(b"WARC/"):
            yield {}, b"", "no record header"
            return
        head, last = {}, ""
        while (line := stream.readline()) not in (_EOL, b"\n", b""):
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in " \t" and last:
                head[last] += " " + text.strip()
                continue
            last, _, value = text.partition(":")
            last = last.strip().lower()
            head[last] = value.strip()
        length = head.get("content-length", "")
        if not length.isdigit():
            yield head, b"", "no length"
            return
        block = stream.read(int(length))
        yield head, block, None if len(block) == int(length) else "cut short"


def unframe(body: bytes) -> bytes | None:
    """The payload of a body in chunked transfer framing; None where the framing is broken. Extensions and trailers are left out."""
    parts, at = [], 0
    while True:
        end = body.find(_EOL, at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(parts)
        if body[at + n : at + n + 2] != _EOL:
            return None
        parts.append(body[at : at + n])
        at += n + 2


def payload_of(message: bytes) -> tuple[bytes | None, str | None]:
    """(payload, problem) of an HTTP message."""
    head, gap, body = message.partition(_EOL + _EOL)
    if not gap:
        return None, "no HTTP header"
    if re.search(rb"(?i)\r\ntransfer-encoding:[^\r\n]*\bchunked\b", head):
        payload = unframe(body)
        return payload, None if payload is not None else "broken chunks"
    stated = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]+)", head)
    if stated and int(stated[1]) != len(body):
        return None, "payload of another length"
    return body, None


def _number(value: str | None) -> int | None:
    return int(value) if value and re.fullmatch(r"-?[0-9]{1,18}", value) else None


def _named(head: dict[str, str]) -> tuple[int | None, str | None, str | None]:
    """(page id, URL, payload digest) as a record's headers state them."""
    stated = head.get("warc-payload-digest", "")
    return _number(head.get("page-id")), None if "page-url-missing" in head else head.get("warc-target-uri"), stated.removeprefix("sha1:") or None


def _checked(named: tuple, message: bytes, problem: str | None) -> tuple:
    """A PAGE row of a response."""
    page_id, url, stated = named
    payload, found = (None, problem) if problem else payload_of(message)
    digest = hashlib.sha1(payload).hexdigest() if payload is not None else None
    if digest and stated and len(stated) == 40 and digest != stated.lower():
        found = "payload of another digest"
    return page_id, url, "response", None, payload, digest, found


def _batches(rows: Iterator[tuple], schema: pa.Schema, at: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about `most` bytes in the column `at`."""
    held, size = [], 0
    build = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    for row in rows:
        held.append(row)
        size += len(row[at] or b"") + 200
        if size >= most:
            yield build()
            held, size = [], 0
    if held:
        yield build()


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_schema = lambda ddl: pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in ddl.split(", ")])


def _opened(path: str) -> BinaryIO:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    stream = store.open_input_stream(at, compression=None, buffer_size=1 << 20)
    return gzip.GzipFile(fileobj=stream, mode="rb") if path.endswith(".gz") else io.BufferedReader(stream, 1 << 20)


def _whole(path: str) -> Iterator[tuple]:
    with _opened(path) as stream:
        for head, block, problem in records(stream):
            kind = head.get("warc-type")
            if kind == "revisit":
                page_id, url, digest = _named(head)
                yield page_id, url, kind, _number(head.get("refers-to-page-id")), None, digest, problem
            elif (kind == "response" and "warc-segment-number" not in head) or (problem and not kind):
                yield _checked(_named(head), block, problem)


def _cut(path: str) -> Iterator[tuple]:
    with _opened(path) as stream:
        for head, block, problem in records(stream):
            if "warc-segment-number" in head and head.get("warc-type") in ("response", "continuation"):
                origin = head.get("warc-segment-origin-id") or head.get("warc-record-id")
                yield origin, _number(head["warc-segment-number"]), _number(head.get("warc-segment-total-length")), *_named(head), block, problem


def _read(rows: Callable[[str], Iterator[tuple]], ddl: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = (p for batch in batches for p in batch.column("path").to_pylist())
        schema = _schema(ddl)
        yield from _batches((row for path in paths for row in rows(path)), schema, next(i for i, f in enumerate(schema) if f.type == pa.binary()))

    return run


def assemble(segments: list[tuple]) -> tuple:
    """A PAGE row of one origin's segments, in order of their numbers. A segment that is there twice with the same bytes counts once."""
    kept = [s for i, s in enumerate(segments) if not i or (s[1], s[6]) != (segments[i - 1][1], segments[i - 1][6])]
    problem = next((s[7] for s in kept if s[7]), None)
    if [s[1] for s in kept] != list(range(1, len(kept) + 1)) or kept[-1][2] is None:
        problem = problem or "segments missing"
    elif any(s[2] is not None for s in kept[:-1]) or sum(len(s[6]) for s in kept) != kept[-1][2]:
        problem = problem or "segments of another length"
    return _checked(kept[0][3:6], b"" if problem else b"".join(s[6] for s in kept), problem)


def _reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SEGMENT.split(", ")]
    rows = (row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in names], strict=True))
    pages = (assemble(list(group)) for _, group in groupby(rows, key=lambda r: r[0]))
    yield from _batches(pages, _schema(PAGE), 4)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """PAGE rows of all response and revisit records of the archives (*.warc.gz, *.warc) in `path`, this library's or others'.

    refers_to and page_id are null where a record doesn't state them. A response that fails a check (missing segments, another length or digest, broken chunks, an archive that
    breaks off) is a row with a `problem` and null payload, or with the payload whose digest differs; nothing is left out silently. A folder that isn't there, or is empty, gives no rows.
    """
    bounded_batches(spark)
    if not _exists(spark, path):
        return spark.createDataFrame([], PAGE)
    # only names are read here; Spark deals the files out by their lengths
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc{.gz,}").load(path).select("path")
    whole = files.mapInArrow(_read(_whole, PAGE), PAGE)
    segments = files.mapInArrow(_read(_cut, SEGMENT), SEGMENT)
    joined = segments.repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(_reassembled, PAGE)
    return whole.unionByName(joined)


def page_table(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, problem) of `read_archives` rows, both of the full payload: a revisit's length is that of the response it refers to.

    A revisit whose response isn't there, or has another digest, has a null length and a problem. Length and digest are taken from the payload as it was read.
    """
    size, digest = F.octet_length("payload").cast("long"), F.coalesce(F.sha1("payload"), F.col("payload_digest"))
    light = materialise(pages.select("page_id", "record_type", "refers_to", size.alias("size"), digest.alias("digest"), "problem"), "page-records")
    targets = light.where("record_type = 'response' AND problem IS NULL").groupBy(F.col("page_id").alias("target"), F.col("digest").alias("target_digest")).agg(F.max("size").alias("target_size"))
    revisits = light.where("record_type = 'revisit'")
    wanted = revisits.select(F.col("refers_to").alias("target"), F.col("digest").alias("target_digest")).distinct()
    targets = materialise(targets.join(wanted, ["target", "target_digest"], "left_semi"), "revisited")
    found = revisits.join(targets, (F.col("refers_to") == F.col("target")) & (F.col("digest") == F.col("target_digest")), "left")
    problem = F.coalesce("problem", F.when(F.col("target").isNull(), "revisits nothing"))
    resolved = found.select("page_id", F.col("target_size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", problem.alias("problem"))
    responses = light.where("record_type = 'response'").select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", "problem")
    return responses.unionByName(resolved)

