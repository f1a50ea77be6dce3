import json
import sqlite3

import pytest

from tracelink.operators.discovery import known_templates
from tracelink.schema import OBSERVATION
from tracelink.sources import readers, writers
from tracelink.streaming import append_hits, screen_stream, stream_observations


def test_posts_with_and_without_mark(spark, tmp_path):
    text = 'platform,permalink,actor_label,posted_at,message_text\nfb,p,a,2026-01-01,"see http://a.example/x,\nand http://a.example/x"\nfb,p,a,,\n'
    for name, mark in (("a.csv", b""), ("b.csv", b"\xef\xbb\xbf")):
        (tmp_path / name).write_bytes(mark + text.encode())
        rows = readers.posts_csv(spark, str(tmp_path / name)).collect()
        assert len(rows) == 1 and rows[0].platform == "fb"
    posts = spark.createDataFrame([(1, 1, rows[0].message_text)], "id long, case_id long, message_text string")
    assert [(r.original_url, r.domain) for r in readers.post_urls(posts).collect()] == [("http://a.example/x", "a.example")]


def test_har_and_html_and_ads(spark, tmp_path):
    har = {"log": {"entries": [{"request": {"url": "https://h.example/x"}, "response": {"status": 200, "headers": [{"name": "Server", "value": "s"}], "content": {"text": "b"}}, "serverIPAddress": "1.1.1.1"}]}}
    (tmp_path / "a.har").write_text(json.dumps(har))
    (tmp_path / "b.har").write_text("{broken")
    got = readers.har_entries(spark, str(tmp_path / "*.har")).collect()
    assert len(got) == 1 and got[0].host == "h.example" and json.loads(got[0].response_headers_json) == [["Server", "s"]]
    (tmp_path / "p.html").write_bytes(b"\xff<script>gtag('config','G-ABC123')</script>")
    assert readers.html_pages(spark, str(tmp_path / "p.html")).first().tracking_ids == {"Google Analytics 4": ["G-ABC123"]}
    (tmp_path / "ads.txt").write_text("x.com, 1, DIRECT\n")
    assert readers.ads_txt_files(spark, str(tmp_path / "ads.txt")).first().records[0].seller_id == "1"


def test_lists(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"sellers": [{"domain": "www.B.example"}, {"name": "confidential"}, {"domain": "https://a.example/x"}, {"domain": "b.example"}]}))
    assert [r.domain for r in readers.sellers_json(spark, str(tmp_path / "s.json")).collect()] == ["a.example", "b.example"]
    (tmp_path / "l.txt").write_text("www.x.example\n0.0.0.0 y.example\n||z.example^\n# n\n")
    assert [r.domain for r in readers.domain_list(spark, str(tmp_path / "l.txt")).collect()] == ["x.example", "y.example", "z.example"]


def test_observations_and_prevalence(spark, tmp_path):
    one = {"domain": "a", "status": "ok", "accounts": [["x", "1"]]}
    (tmp_path / "l.jsonl").write_text(json.dumps(one) + "\n" + json.dumps(one) + "\n")
    (tmp_path / "a.json").write_text(json.dumps([one, one, one], indent=1))
    assert readers.observations(spark, str(tmp_path / "l.jsonl")).count() == 2 and readers.observations(spark, str(tmp_path / "a.json")).count() == 3
    # both forms in one folder, each told by its own first character
    assert readers.observations(spark, str(tmp_path / "[al].js*")).count() == 5
    rows = spark.createDataFrame([("x", "1", 300, 1000)], "adsystem string, seller_id string, hits long, site_count long")
    writers.write_prevalence(rows, str(tmp_path / "prev"))
    assert [tuple(r) for r in readers.prevalence(spark, str(tmp_path / "prev")).collect()] == [("x", "1", 300, 1000)]
    for bad in ({"schema": "other", "site_count": 5, "accounts": {"a|b": 1}}, {"schema": "prevalence/1", "site_count": 5, "accounts": {"a|b": 6}}, {"schema": "prevalence/1", "site_count": 5, "accounts": {"a|b": True}}, {"schema": "prevalence/1", "site_count": 5, "accounts": {"a|b": -1}}):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        assert readers.prevalence(spark, str(tmp_path / "bad.json")).count() == 0


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "c.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE cases (id INTEGER PRIMARY KEY, title TEXT)")
        db.executemany("INSERT INTO cases VALUES (?, ?)", [(i, f"t{i}") for i in range(250)])
    df = readers.sqlite_table(spark, path, "cases", "id long, title string")
    assert df.count() == 250 and df.where("id = 7").first().title == "t7"
    with pytest.raises(Exception, match="plain name"):
        readers.sqlite_table(spark, path, 'x"; DROP', "id long").count()


def test_store_manifest_and_pack(spark, tmp_path):
    store = tmp_path / "store" / "d"
    store.mkdir(parents=True)
    (store / "a.txt").write_bytes(b"abc")
    files = readers.store_files(spark, str(tmp_path / "store"), content=True)
    assert [(r.path, r.bytes) for r in writers.corpus_manifest(files).collect()] == [("d/a.txt", 3)]
    bodies = spark.createDataFrame([("x", b"1"), ("y", b"2")], "arcname string, content binary")
    mac = writers.write_pack({"cases": spark.createDataFrame([(1, "t")], "id long, title string")}, bodies, str(tmp_path / "pack"), b"k")
    assert len(mac) == 64
    with pytest.raises(ValueError, match="content"):
        writers.write_pack({}, spark.createDataFrame([("x", None)], "arcname string, content binary"), str(tmp_path / "pack2"), b"k")
    with pytest.raises(Exception, match="(?i)exist"):
        writers.bank_observations(bodies, str(tmp_path / "pack"))


def test_screen_stream(spark, tmp_path):
    bank = tmp_path / "bank"
    bank.mkdir()
    rows = [{"domain": d, "status": "ok", "record_count": 1, "raw_sha256": s, "fetched_at": "2026-01-01 00:00:00 UTC"} for d, s in [("a", "S"), ("a", "S"), ("b", "T")]]
    (bank / "1.json").write_text("\n".join(map(json.dumps, rows)))
    good = spark.createDataFrame([("m", "ok", "S", [1])], "domain string, status string, sha string, records array<int>")
    screened = screen_stream(stream_observations(spark, str(bank)), known_templates(good))
    query = append_hits(screened, str(tmp_path / "hits"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert [r.domain for r in spark.read.parquet(str(tmp_path / "hits")).collect()] == ["a"]
    assert "domain STRING" in OBSERVATION


def test_a_large_array_is_not_read_as_lines(spark, tmp_path):
    rows = [{"domain": f"d{i}.example", "status": "ok", "record_count": 1, "raw_sha256": "s" * 64} for i in range(3000)]
    (tmp_path / "a.json").write_text(" \r\n" * 40_000 + json.dumps(rows))
    (tmp_path / "l.jsonl").write_text("\n \n" + "\n".join(map(json.dumps, rows[:7])) + "\n[1]\n")
    (tmp_path / "e.json").write_text(" \n")
    (tmp_path / "none.json").write_text("")
    found = readers.observations(spark, f"{tmp_path}/*.js*")
    assert found.count() == 3007
    # the scan of lines has the files of lines only
    scan = found.where("domain = 'd1.example'").select("status")
    assert "path" not in scan.columns and scan.count() == 2
    lines = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Scan text" in x]
    assert lines and all("NOT" in x and "a.json" in x for x in lines)
