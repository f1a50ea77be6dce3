import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from tracelink.llm import warc
from tracelink.storage import scratch

LONG = "<p>é" + "long page " * 400_000
SAME = "<html>" + "equal payload " * 100
ROWS = [
    (1, "http://a.example/1", SAME), (2, "http://a.example/two words\r\nX: y", SAME), (3, None, SAME), (4, "http://b.example/", "short"), (5, "http://b.example/2", "short"),
    (6, "http://c.example/", None), (7, "", ""), (8, "http://d.example/", LONG), (9, "http://d.example/", LONG), (9, "http://d.example/", LONG), (None, "http://e.example/", SAME),
    (10, "http://f.example/ü", "\r\n0\r\n\r\nWARC/1.1\r\n\r\n" * 2000), (11, "http://f.example/", "x" * 999), (12, "http://f.example/", "x" * 999), (13, "http://f.example/", "y" * 1000), (14, "http://f.example/", "y" * 1000),
]


def brute(rows):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        kept = max(ids, default=None) if len(data) >= 1000 else None
        revisit = kept is not None and kept != page_id
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", kept if revisit else None, None))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumns({"payload": F.lit("clash"), "digest": F.lit(1), "key": F.lit(2), "content": F.lit(3)})


def round_trip(spark, pages, **sizes):
    path = scratch(spark, "warc-test")
    warc.write_archives(pages, path, **sizes)
    return path, warc.read_archives(spark, f"{path}/archives")


@pytest.mark.parametrize("sizes", [{}, {"segment_bytes": 100, "chunk_bytes": 7}, {"archive_bytes": 1}], ids=["default", "small", "archive-per-record"])
def test_round_trip(spark, pages, sizes):
    if "chunk_bytes" in sizes:
        pages = pages.where("page_id < 8 OR page_id > 9 OR page_id IS NULL")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    _, read = round_trip(spark, pages, **sizes)
    got = warc.page_table(read).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)
    texts = {(r.page_id, bytes(r.payload).decode()) for r in read.where("record_type = 'response'").collect()}
    assert texts == {(p, h or "") for (p, _, h), b in zip(rows, brute(rows), strict=True) if b[3] == "response"}


def test_urls(spark, pages):
    _, read = round_trip(spark, pages)
    urls = {r.page_id: r.url for r in read.collect()}
    assert urls[3] is None and urls[7] is None and urls[10] == "http://f.example/ü" and urls[2] == "http://a.example/two%20words%0D%0AX:%20y"


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    path, read = round_trip(spark, none)
    assert warc.page_table(read).count() == 0 and spark.read.parquet(f"{path}/index").count() == 0
    assert warc.read_archives(spark, path + "-nowhere").count() == 0


def test_equal_payloads_join_without_a_broadcast(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", -1)
    _, read = round_trip(spark, pages)
    assert sorted(map(tuple, warc.page_table(read).collect()), key=key) == sorted(brute(ROWS), key=key)


def message(body=b"5\r\nhello\r\n6;x=1\r\n world\r\n0\r\nTrailer: 1\r\n\r\n"):
    return b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + body


def segmented(parts, total, name="o", **more):
    out = []
    for i, part in enumerate(parts, 1):
        fields = {"WARC-Segment-Number": i, "Page-ID": 1} | ({"WARC-Segment-Origin-ID": f"<urn:uuid:{name}>"} if i > 1 else {}) | ({"WARC-Segment-Total-Length": total} if i == len(parts) else {}) | more
        out.append(warc.record("continuation" if i > 1 else "response", name if i == 1 else f"{name}{i}", fields, part, "2026-01-01T00:00:00Z"))
    return out


def read_files(spark, tmp_path, **files):
    for name, data in files.items():
        (tmp_path / name.replace("__", ".")).write_bytes(data)
    return {(r.page_id, r.problem): r.payload and bytes(r.payload) for r in warc.read_archives(spark, f"file://{tmp_path}").collect()}


def test_segments_in_any_order_over_files_and_forms(spark, tmp_path):
    a, b, c = segmented([message()[:20], message()[20:50], message()[50:]], len(message()))
    got = read_files(spark, tmp_path, one__warc=c + a, two__warc__gz=gzip.compress(b + b))
    assert got == {(1, None): b"hello world"}


@pytest.mark.parametrize(
    "made, problem",
    [
        (lambda: segmented([message()[:20], message()[20:50], message()[50:]], len(message()))[::2], "segments missing"),
        (lambda: segmented([message()[:20], message()[20:]], len(message()))[:1], "segments missing"),
        (lambda: segmented([message()[:20], message()[20:]], len(message()) + 1), "segments of another length"),
        (lambda: segmented([message()[:20], message(b"5\r\nhell\r\n0\r\n\r\n")[20:]], len(message(b"5\r\nhell\r\n0\r\n\r\n"))), "broken chunks"),
        (lambda: segmented([message(b"zz\r\n")], len(message(b"zz\r\n"))), "broken chunks"),
        (lambda: [warc.record("response", "x", {"Page-ID": 1}, b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\nabc", "d")], "payload of another length"),
        (lambda: [warc.record("response", "x", {"Page-ID": 1}, b"no header", "d")], "no HTTP header"),
        (lambda: [warc.record("response", "x", {"Page-ID": 1, "WARC-Payload-Digest": "sha1:" + "0" * 40}, message(), "d")], "payload of another digest"),
        (lambda: [warc.record("response", "x", {"Page-ID": 1}, message(), "d")[:-30]], "cut short"),
    ],
)
def test_what_is_damaged_is_told(spark, tmp_path, made, problem):
    got = read_files(spark, tmp_path, one__warc=b"".join(made()))
    assert list(got) == [(1, problem)] and (got[1, problem] is None or problem == "payload of another digest")


def test_other_archives(spark, tmp_path):
    plain = warc.record("response", "x", {"Page-ID": 1}, b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc", "d")
    other = warc.record("request", "y", {}, b"GET / HTTP/1.1\r\n\r\n", "d") + b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://x/\r\n  folded\r\nContent-Length: 22\r\n\r\nHTTP/1.0 200 OK\r\n\r\nxyz\r\n\r\n"
    assert read_files(spark, tmp_path, one__warc=plain + other, junk__warc=b"junk\r\n") == {(1, None): b"abc", (None, None): b"xyz", (None, "no record header"): None}
    lost = warc.page_table(spark.createDataFrame([(1, None, "revisit", 7, None, "0" * 40, None)], warc.PAGE)).first()
    assert (lost.payload_bytes, lost.problem) == (None, "revisits nothing")


def test_chunks():
    for n in (0, 1, 6, 7, 8, 1000):
        assert warc.unframe(warc.frame(b"z" * n, 7)) == b"z" * n
    assert list(warc.records(io.BytesIO(b""))) == []
