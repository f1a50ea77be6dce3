"""Registered queries of sources and sinks: rows of the driver's tables are written in each format, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.operators import discovery, index, integrity, pins
from tracelink.plans import projections as p
from tracelink.plans.driver_queries import _apex_sql, query
from tracelink.plans.projections import OBSERVED_SQL, PAGES_SQL, SIGNALS_SQL, host
from tracelink.sources import readers, writers
from tracelink.storage import scratch


def _files(rows: DataFrame, text: Column, suffix: str) -> str:
    """A folder with a file of `text` for each of the rows' buckets."""
    path = scratch(rows.sparkSession, suffix)
    rows.select("bucket", text.alias("text")).repartition("bucket").write.partitionBy("bucket").text(path)
    return path


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.page_html(spark, sf_dir).withColumn("bucket", F.col("page_id") % 16)


def bucket_of(path: str) -> Column:
    return F.regexp_extract(path, r"bucket=(\d+)", 1).cast("long").alias("bucket")


@query("""
    SELECT event_type AS platform, 'p/' || event_id AS permalink, 'u' || user_id AS actor_label, '2026-01-0' || (1 + event_id % 9) AS posted_at, 'see, "' || event_id || '"' || chr(10) || 'there' AS message_text
    FROM events WHERE event_id % 10 <> 0
""")
def posts_csv(spark, sf_dir):
    text = F.concat(F.lit('see, "'), "event_id", F.lit('"\nthere'))
    posts = p.read(spark, sf_dir, "events").select(
        F.col("event_type").alias("platform"), F.concat(F.lit("p/"), "event_id").alias("permalink"), F.concat(F.lit("u"), "user_id").alias("actor_label"),
        F.concat(F.lit("2026-01-0"), 1 + F.col("event_id") % 9).alias("posted_at"), F.when(F.col("event_id") % 10 == 0, "").otherwise(text).alias("message_text"),
    )
    path = scratch(spark, "posts")
    posts.write.csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False)
    return readers.posts_csv(spark, path)


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS title FROM nation")
def sqlite_table(spark, sf_dir):
    """The 25 nations by way of a database file in the shared folder, which has to be one that SQLite can open."""
    import os
    import sqlite3
    from urllib.parse import urlparse

    path = urlparse(scratch(spark, "case-db")).path
    os.makedirs(path)
    with sqlite3.connect(f"{path}/case.db") as db:
        db.execute("CREATE TABLE cases (id INTEGER PRIMARY KEY, title TEXT)")
        db.executemany("INSERT INTO cases VALUES (?, ?)", [tuple(r) for r in p.read(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()])
    return readers.sqlite_table(spark, f"{path}/case.db", "cases", "id long, title string")


@query(f"WITH {PAGES_SQL} SELECT DISTINCT page_id % 16 AS bucket, platform, tracking_id FROM found")
def html_pages(spark, sf_dir):
    found = readers.html_pages(spark, _files(_pages(spark, sf_dir), F.col("html"), "pages"))
    each = found.select(bucket_of("path"), F.explode("tracking_ids").alias("platform", "ids"))
    return each.select("bucket", "platform", F.explode("ids").alias("tracking_id"))


@query(f"""
    SELECT page_id % 16 AS bucket, url, {host("url")} AS host, CAST(200 + page_id % 3 AS INT) AS status, '203.0.113.' || page_id % 50 AS server_ip, '[["Server","s' || page_id % 4 || '"]]' AS response_headers_json, 'b' || page_id AS body FROM pages
""")
def har_entries(spark, sf_dir):
    entry = F.struct(
        F.struct("url").alias("request"),
        F.struct((200 + F.col("page_id") % 3).alias("status"), F.array(F.struct(F.lit("Server").alias("name"), F.concat(F.lit("s"), F.col("page_id") % 4).alias("value"))).alias("headers"), F.struct(F.concat(F.lit("b"), "page_id").alias("text")).alias("content")).alias("response"),
        F.concat(F.lit("203.0.113."), F.col("page_id") % 50).alias("serverIPAddress"),
    )
    pages = p.read(spark, sf_dir, "pages").withColumn("bucket", F.col("page_id") % 16)
    docs = pages.groupBy("bucket").agg(F.collect_list(entry).alias("entries")).withColumn("har", F.to_json(F.struct(F.struct("entries").alias("log"))))
    found = readers.har_entries(spark, _files(docs, F.col("har"), "har"))
    return found.withColumn("bucket", bucket_of("capture")).drop("capture")


@query(f"SELECT DISTINCT {_apex_sql(host('url'))} AS domain FROM pages WHERE page_id % 5 <> 0")
def sellers_json(spark, sf_dir):
    named = F.when(F.col("page_id") % 5 == 0, F.lit(None)).when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://"), F.upper("host"), F.lit("/x"))).otherwise(F.concat(F.lit(" "), "host"))
    docs = _pages(spark, sf_dir).groupBy("bucket").agg(F.collect_list(F.struct(named.alias("domain"), F.lit("n").alias("name"))).alias("sellers"))
    return readers.sellers_json(spark, _files(docs, F.to_json(F.struct("sellers")), "sellers"))


@query(f"WITH {OBSERVED_SQL} SELECT domain, status, sha AS raw_sha256, CAST(record_count AS INT) AS record_count, CAST(accounts AS INT) AS accounts FROM observed")
def bank_observations(spark, sf_dir):
    """Half of the observations banked as JSON lines, half as arrays in files beside them, of some two thousand each."""
    path = scratch(spark, "bank")
    rows = p.observations(spark, sf_dir)
    files = max(8, -(-p.read(spark, sf_dir, "documents").count() // 4000))
    lines = F.pmod(F.xxhash64("domain"), F.lit(2)) == 0
    writers.bank_observations(rows.where(lines), f"{path}/run1")
    rest = rows.where(~lines).withColumn("bucket", F.pmod(F.xxhash64("domain", F.lit("file")), F.lit(files)))
    rest = rest.groupBy("bucket").agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("text"))
    # a file for each task, a task for each bucket
    rest.repartitionById(files, F.col("bucket").cast("int")).select("text").write.option("maxRecordsPerFile", 1).text(f"{path}/run2")
    found = readers.observations(spark, f"{path}/run*")
    return found.select("domain", "status", "raw_sha256", "record_count", F.size("accounts").alias("accounts"))


@query(f"""
    WITH {OBSERVED_SQL}, pairs AS (
        SELECT DISTINCT domain, CAST(i + first AS VARCHAR) AS seller_id FROM observed, unnest(range(1, accounts + 1)) r(i) WHERE status = 'ok'
    )
    SELECT 'ads.example' AS adsystem, seller_id, count(*) AS hits, (SELECT count(DISTINCT domain) FROM observed WHERE status = 'ok') AS site_count FROM pairs GROUP BY 2
""")
def prevalence(spark, sf_dir):
    path = scratch(spark, "prevalence")
    writers.write_prevalence(discovery.build_prevalence(p.observations(spark, sf_dir)), path)
    return readers.prevalence(spark, path)


@query("SELECT page_id % 16 AS bucket, count(*) AS pages FROM pages GROUP BY 1")
def store_files(spark, sf_dir):
    """Files found by their names, their sizes checked: a line of 10 bytes for each page."""
    path = _files(p.read(spark, sf_dir, "pages").withColumn("bucket", F.col("page_id") % 16), F.lit("123456789"), "store")
    return readers.store_files(spark, path).groupBy(bucket_of("path")).agg((F.sum("length") / 10).cast("long").alias("pages"))


@query(f"WITH {SIGNALS_SQL} SELECT DISTINCT source_db AS name FROM signals UNION SELECT 'main.db'")
def known_databases(spark, sf_dir):
    return integrity.known_databases(p.signals(spark, sf_dir), "main.db", "", "db1")


@query(f"WITH {PAGES_SQL} SELECT 'url_artifacts' AS t, CAST(ua_id AS VARCHAR) AS id, original_url FROM urls UNION ALL SELECT 'message_evidence', CAST(page_id AS VARCHAR), 'see ' || url || '.' FROM pages")
def evidence_pack(spark, sf_dir):
    """A pack's tables, read back from its CSV folders."""
    t = p.case_tables(spark, sf_dir)
    path = scratch(spark, "pack")
    bodies = p.read(spark, sf_dir, "pages").select(F.concat(F.lit("b/"), "page_id").alias("arcname"), F.col("html").cast("binary").alias("content"))
    writers.write_pack({"url_artifacts": t.url_artifacts, "message_evidence": t.message_evidence}, bodies, path, b"key")
    pack = readers.evidence_pack(spark, path)
    urls = pack["url_artifacts"].select(F.lit("url_artifacts").alias("t"), "id", "original_url")
    return urls.union(pack["message_evidence"].select(F.lit("message_evidence"), "id", "message_text"))


@query("SELECT 'b/' || doc_id AS arcname, sha256(coalesce(text, '')) AS sha256, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents")
def write_pack(spark, sf_dir):
    """The manifest of a pack whose bodies are the documents."""
    path = scratch(spark, "pack")
    bodies = p.read(spark, sf_dir, "documents").select(F.concat(F.lit("b/"), "doc_id").alias("arcname"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    writers.write_pack({}, bodies, path, b"key")
    return spark.read.csv(f"{path}/manifest", header=True, schema="arcname string, sha256 string, bytes long")


#: A key's inner and outer pads, as the definition of an HMAC has them.
_KEY = b"case-key"
_INNER, _OUTER = (bytes(x ^ pad for x in _KEY.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))


@query(f"""
    WITH lines AS (
        SELECT 'b/' || page_id AS arcname, sha256(coalesce(html, '')) AS sha FROM pages
    ), message AS (
        SELECT encode(string_agg(sha || '  ' || arcname || chr(10), '' ORDER BY arcname)) AS m FROM lines
    )
    SELECT sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || m))) AS hmac FROM message
""")
def manifest_hmac(spark, sf_dir):
    bodies = p.read(spark, sf_dir, "pages").select(F.concat(F.lit("b/"), "page_id").alias("arcname"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    return spark.createDataFrame([(integrity.manifest_hmac(integrity.export_manifest(bodies), _KEY),)], "hmac string")


@query(f"WITH {SIGNALS_SQL} SELECT signal_type, signal_value, source_db, case_id, scan_run_id FROM signals WHERE NOT (source_db = 'db0' AND case_id = 0) OR signal_type = 'final_domain'")
def write_index(spark, sf_dir):
    """An index in which one case of one database was written anew, with fewer signals."""
    path, signals = scratch(spark, "index"), p.signals(spark, sf_dir)
    index.write_index(signals, path)
    index.write_index(signals.where("source_db = 'db0' AND case_id = 0 AND signal_type = 'final_domain'"), path)
    return spark.read.schema(signals.schema).parquet(path).select("signal_type", "signal_value", "source_db", "case_id", "scan_run_id")


@query("SELECT 's' || doc_id AS domain, sha256(text) AS body_sha256 FROM documents")
def bank_bodies(spark, sf_dir):
    path = scratch(spark, "bodies")
    writers.bank_bodies(p.read(spark, sf_dir, "documents").select(F.concat(F.lit("s"), "doc_id").alias("domain"), F.col("text").cast("binary").alias("content")), path)
    return spark.read.parquet(path).select("domain", F.sha2("content", 256).alias("body_sha256"))


@query("SELECT doc_id AS id, doc_id % 3 = 0 AS truncated, CASE WHEN doc_id % 3 <> 0 THEN sha256(text) END AS complete_sha256 FROM documents")
def append_acquisitions(spark, sf_dir):
    path = scratch(spark, "acquisitions")
    rows = p.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3 == 0).alias("truncated"), F.sha2("text", 256).alias("complete_sha256"))
    for half in (0, 1):
        writers.append_acquisitions(rows.where(F.col("id") % 2 == half), path)
    return spark.read.parquet(path).select("id", "truncated", "complete_sha256")


@query("""
    SELECT user_id AS case_id, event_type AS action, coalesce(props, '') AS detail, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events UNION ALL SELECT max(user_id) + 1, 'export', 'a, "b"', 't2' FROM events
""")
def append_audit(spark, sf_dir):
    """Events as entries of their users' trails, in two runs, and one entry by itself."""
    path = scratch(spark, "audit")
    events = p.read(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("action"), F.coalesce("props", F.lit("")).alias("detail"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "event_id")
    for half in (0, 1):
        writers.append_audit_rows(rows.where(F.col("event_id") % 2 == half), path)
    writers.append_audit(spark, path, events.agg(F.max("user_id")).first()[0] + 1, "export", 'a, "b"', "t2")
    return spark.read.schema(writers.AUDIT).parquet(path)


@query(f"""
    WITH {PAGES_SQL}, shots AS (
        SELECT DISTINCT scan_run_id FROM scans WHERE scan_run_id % 2 = 0 AND scan_run_id % 7 <> 0
    )
    SELECT u.case_id, o.scan_run_id, s.final_url FROM urls u JOIN own_done o USING (ua_id) JOIN scans s ON s.scan_run_id = o.scan_run_id WHERE o.scan_run_id NOT IN (SELECT scan_run_id FROM shots)
""")
def failed_capture_csv(spark, sf_dir):
    path = scratch(spark, "failed")
    writers.failed_capture_csv(pins.pending_snapshots(p.case_tables(spark, sf_dir)), path)
    return spark.read.csv(path, header=True, schema="case_id long, scan_run_id long, final_url string")


@query("""SELECT '{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || '}' AS line FROM documents WHERE lang IS NOT NULL""")
def to_json_lines(spark, sf_dir):
    return writers.to_json_lines(p.read(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", "lang", "n_chars"))


SHOTS_SQL = f"""
    shots AS (
        SELECT page_id, page_id * 10 AS scan_run_id, page_id % 4 AS case_id, {host("url")} AS host, 'store/' || page_id % 4 || '/' || page_id // 2 AS dir,
            CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 2 = 0 THEN 'playwright' ELSE 'http_only' END AS method, '2026-01-0' || (1 + page_id % 9) AS taken, url FROM pages
    )"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of pages: two to a directory, a third without a method."""
    i, host_ = F.col("page_id"), F.col("host")
    directory = F.concat(F.lit("store/"), i % 4, F.lit("/"), F.floor(i / 2))
    return p.page_html(spark, sf_dir).select(
        i.alias("id"), (i * 10).alias("scan_run_id"), F.when(i % 2 == 0, F.upper(host_)).otherwise(host_).alias("final_domain"), F.concat(directory, F.lit("/shot.png")).alias("screenshot_path"),
        F.concat(directory, F.lit("/page.html")).alias("html_path"), F.lit(None).cast("string").alias("har_path"), F.when(i % 3 == 0, F.lit(None)).when(i % 2 == 0, "playwright").otherwise("http_only").alias("capture_method"),
        F.concat(F.lit("2026-01-0"), 1 + i % 9).alias("captured_at"), F.when(i % 5 == 0, "error").otherwise("ok").alias("capture_status"), F.concat(F.lit("https://"), host_).alias("final_url"),
        F.when(i % 4 == 0, '{"addresses":["203.0.113.9"]}').alias("investigator_ip_json"),
    )


@query(f"""
    WITH {SHOTS_SQL}, named AS (
        SELECT DISTINCT host AS domain, taken || '_' || coalesce(method, 'capture') AS base, dir AS target FROM shots
    ), numbered AS (
        SELECT *, row_number() OVER (PARTITION BY domain, base ORDER BY target) AS n FROM named
    )
    SELECT domain, CASE WHEN n > 1 THEN base || '-' || n ELSE base END AS link_name, target FROM numbered
""")
def browse_tree(spark, sf_dir):
    return writers.browse_tree(snapshots(spark, sf_dir))


@query(f"""
    WITH {SHOTS_SQL}, last AS (SELECT max(page_id) AS page_id FROM shots GROUP BY dir)
    SELECT dir, '{{"scan_run_id":' || scan_run_id || ',"scan_url":"' || url || '","final_url":"https://' || host || '","final_domain":"' || CASE WHEN page_id % 2 = 0 THEN upper(host) ELSE host END || '","captured_at":"' || taken || '","capture_status":"'
        || CASE WHEN page_id % 5 = 0 THEN 'error' ELSE 'ok' END || '"' || coalesce(',"capture_method":"' || method || '"', '') || '}}' AS caption
    FROM shots JOIN last USING (page_id)
""")
def capture_captions(spark, sf_dir):
    scans = p.read(spark, sf_dir, "pages").select((F.col("page_id") * 10).alias("id"), F.col("url").alias("final_url"), F.lit(None).cast("string").alias("run_at"))
    return writers.capture_captions(snapshots(spark, sf_dir), scans)


@query(f"WITH {SHOTS_SQL} SELECT DISTINCT dir, 'main.db, other.db' AS dbs FROM shots")
def referenced_directories(spark, sf_dir):
    shots = snapshots(spark, sf_dir)
    found = integrity.merge_references(integrity.referenced_directories(shots, "other.db"), integrity.referenced_directories(shots, "main.db"))
    return found.withColumn("dbs", F.array_join("dbs", ", "))


@query("""
    SELECT 'd' || page_id AS dir, CASE page_id % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'manifest_only' WHEN 2 THEN 'capture' ELSE 'partial' END AS kind,
        CASE page_id % 5 WHEN 2 THEN 2 ELSE 1 END AS files, CASE page_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 15 ELSE 8 END AS bytes FROM pages
""")
def store_directories(spark, sf_dir):
    k, png = F.col("page_id") % 5, F.unhex(F.lit("89504E470D0A1A0A"))
    file = lambda name, length, content: F.struct(F.lit(name).alias("name"), F.lit(length).cast("long").alias("length"), content.alias("content"))
    shot = file("shot.png", 8, png)
    files = F.when(k == 0, F.array(file("page.html", 0, F.lit(b"")))).when(k == 1, F.array(file("capture.json", 5, F.lit(b"{   }")))).when(k == 2, F.array(shot, file("page.html", 7, F.lit(b"<html/>")))).otherwise(F.array(shot))
    rows = p.read(spark, sf_dir, "pages").select("page_id", F.explode(files).alias("f")).select(F.concat(F.lit("d"), "page_id", F.lit("/"), "f.name").alias("path"), "f.length", "f.content")
    return integrity.store_directories(rows).select("dir", "kind", "files", "bytes")
