"""Registered queries of scalar functions and smaller operators, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelink.functions import parsing as ps
from tracelink.functions import urls as u
from tracelink.operators import discovery, headers, infra, insights, integrity, pins, url
from tracelink.plans import projections as p
from tracelink.plans.driver_queries import PINNED_SQL, query
from tracelink.plans.projections import CERTS_SQL, PAGES_SQL, host


def _docs(spark, sf_dir):
    return p.read(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")


def _pages(spark, sf_dir):
    return p.read(spark, sf_dir, "pages").select("page_id", "url")


@query(f"""
    WITH {CERTS_SQL}
    SELECT case_id, issuer, count(DISTINCT domain) AS domain_count, count(DISTINCT original_url) AS url_count, count(DISTINCT serial) AS cert_count, min(not_before) AS earliest_not_before FROM certs GROUP BY 1, 2
""")
def certificate_authorities(spark, sf_dir):
    return infra.certificate_authorities(p.certificates(spark, sf_dir)).drop("domains")


COOKIES_SQL = """
    cookies AS (
        SELECT DISTINCT 'd' || user_id % 40 || '.example' AS domain, 'o' || user_id % 5 || '.example' AS cookie_domain, user_id % 40 AS d, '/p' || user_id % 3 AS path, user_id % 2 = 0 AS httponly FROM events
    )"""


def _cookies(spark, sf_dir):
    value = F.concat(F.lit("k=1; Domain=.o"), F.col("user_id") % 5, F.lit(".example; Path=/p"), F.col("user_id") % 3, F.when(F.col("user_id") % 2 == 0, "; HttpOnly").otherwise(""), F.lit("; SameSite=Lax"))
    return p.read(spark, sf_dir, "events").select(F.lit(0).alias("case_id"), F.concat(F.lit("d"), F.col("user_id") % 40, F.lit(".example")).alias("domain"), F.lit("set-cookie").alias("header"), value.alias("value"))


@query(f"WITH {COOKIES_SQL} SELECT DISTINCT domain AS response_domain, cookie_domain FROM cookies")
def cookie_origin_leaks(spark, sf_dir):
    return headers.cookie_origin_leaks(_cookies(spark, sf_dir)).drop("case_id")


@query(f"WITH {COOKIES_SQL} SELECT path, httponly, false AS secure, 'lax' AS samesite, count(DISTINCT domain) AS domain_count FROM cookies GROUP BY 1, 2 HAVING count(DISTINCT domain) >= 2")
def shared_cookie_templates(spark, sf_dir):
    return headers.shared_cookie_templates(_cookies(spark, sf_dir)).drop("case_id", "domains")


def _partly_scanned(spark, sf_dir):
    """The case tables with the scans of some artifacts left out."""
    t = p.case_tables(spark, sf_dir)
    t.scan_runs = t.scan_runs.where("url_artifact_id % 6 NOT IN (1, 3)")
    return t


PARTLY_SQL = f"{PAGES_SQL}, part_scans AS (SELECT * FROM scans WHERE ua_id % 6 NOT IN (1, 3))"


@query(f"""
    WITH {PARTLY_SQL}, seen AS (SELECT DISTINCT u.case_id, u.original_url FROM urls u JOIN part_scans s USING (ua_id))
    SELECT u.case_id, u.original_url, min(u.ua_id) AS url_artifact_id FROM urls u WHERE (u.case_id, u.original_url) NOT IN (SELECT case_id, original_url FROM seen) GROUP BY 1, 2
""")
def unscanned_urls(spark, sf_dir):
    return pins.unscanned_urls(_partly_scanned(spark, sf_dir))


@query(f"""
    WITH {PARTLY_SQL}, seen AS (SELECT DISTINCT u.case_id, u.original_url FROM urls u JOIN part_scans s USING (ua_id))
    SELECT u.case_id, count(CASE WHEN u.ua_id % 6 IN (1, 3) AND s.original_url IS NOT NULL THEN 1 END) AS covered FROM urls u LEFT JOIN seen s ON s.case_id = u.case_id AND s.original_url = u.original_url GROUP BY 1
""")
def covered_by_sibling(spark, sf_dir):
    return pins.covered_by_sibling(_partly_scanned(spark, sf_dir))


@query(f"""
    WITH {PAGES_SQL}
    SELECT o.scan_run_id, NOT (o.scan_run_id % 2 = 1 AND o.scan_run_id % 7 <> 0) AS needs_html, true AS needs_ads_txt, u.ua_id % 7 >= 3 AS needs_enrichment FROM urls u JOIN own_done o USING (ua_id)
""")
def scans_needing(spark, sf_dir):
    return pins.scans_needing(p.case_tables(spark, sf_dir))


@query(f"WITH {PAGES_SQL} SELECT u.case_id, count(DISTINCT i.host) AS domain_count FROM urls u JOIN ids i ON i.page_id = u.ua_id GROUP BY 1")
def case_domain_count(spark, sf_dir):
    return insights.case_domain_count(p.case_tables(spark, sf_dir))


@query(f"""
    WITH {PAGES_SQL}, {PINNED_SQL}, tags AS (
        SELECT DISTINCT case_id, final_domain, original_url, unnest(CASE tagged WHEN 0 THEN ['multi_hop', 'http'] WHEN 1 THEN ['new_domain'] ELSE [] END) AS tag FROM pinned
    )
    SELECT case_id, tag, count(*) AS n FROM tags GROUP BY 1, 2
""")
def risk_tag_histogram(spark, sf_dir):
    return insights.risk_tag_histogram(url.destination_rows(p.case_tables(spark, sf_dir)))


@query("SELECT page_id % 4 AS case_id, true AS scanned, '低' AS level FROM pages WHERE page_id >= 8 AND false UNION ALL SELECT c, true, '中' FROM (VALUES (0), (1), (2), (3)) v(c)")
def completeness(spark, sf_dir):
    return insights.completeness(p.case_tables(spark, sf_dir)).select("case_id", "scanned", "level")


@query("""
    SELECT 'message_evidence.case_id' AS relation, 0 AS n UNION ALL SELECT 'url_artifacts.message_id', 0 UNION ALL SELECT 'scan_runs.url_artifact_id', 0 UNION ALL SELECT 'redirect_hops.scan_run_id', 0
    UNION ALL SELECT 'snapshots.scan_run_id', 3 * count(*) FROM pages WHERE page_id % 6 IN (1, 3) UNION ALL SELECT 'acquisitions.scan_run_id', 0
""")
def foreign_key_orphans(spark, sf_dir):
    return integrity.foreign_key_orphans(_partly_scanned(spark, sf_dir))


@query(f"""
    WITH {PAGES_SQL}, hosts AS (
        SELECT scan_run_id, {host("final_url")} AS h FROM scans UNION SELECT s.scan_run_id, {host("u.original_url")} FROM scans s JOIN urls u USING (ua_id) UNION SELECT s.scan_run_id, i.host FROM scans s JOIN ids i ON i.page_id = s.ua_id
    ), apexes AS (SELECT DISTINCT scan_run_id, array_to_string(string_split(h, '.')[-2:], '.') AS a FROM hosts)
    SELECT scan_run_id, string_agg(a, ', ' ORDER BY a) AS domains FROM apexes GROUP BY 1
""")
def expected_domains(spark, sf_dir):
    return integrity.expected_domains(p.case_tables(spark, sf_dir)).withColumn("domains", F.array_join("domains", ", "))


@query(r"""
    WITH pieces AS (SELECT page_id, unnest(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&')) AS piece FROM pages)
    SELECT page_id, split_part(piece, '=', 1) AS key, piece[strpos(piece, '=') + 1:] AS value, CASE split_part(piece, '=', 1) WHEN 'utm_source' THEN 'google_analytics' WHEN 'ref' THEN 'generic' ELSE '' END AS platform_id FROM pieces WHERE piece <> ''
""")
def query_pairs(spark, sf_dir):
    each = _pages(spark, sf_dir).select("page_id", F.explode(u.query_pairs("url")).alias("p"))
    return each.select("page_id", "p.key", "p.value", u.identify_param("p.key").alias("platform_id"))


@query(r"""
    WITH s AS (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '') AS q FROM pages), k AS (
        SELECT page_id, url, list_filter(q, lambda x: split_part(x, '=', 1) NOT IN ('utm_source', 'ref')) AS kept, list_filter(q, lambda x: split_part(x, '=', 1) IN ('utm_source', 'ref')) AS gone FROM s)
    SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END || regexp_extract(url, '(#.*)$', 1) AS stripped_url,
        array_to_string(list_sort(list_transform(gone, lambda x: split_part(x, '=', 1))), ', ') AS stripped FROM k
""")
def strip_tracking_params(spark, sf_dir):
    s = u.strip_tracking_params("url")
    return _pages(spark, sf_dir).select("page_id", s["url"].alias("stripped_url"), F.array_join(s["stripped"], ", ").alias("stripped"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN '__hash__:' || sha256(text)[1:12] ELSE text END AS compared FROM documents")
def comparison_value(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", u.comparison_value("text").alias("compared"))


@query("""
    SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'a' || doc_id || '.example' WHEN 1 THEN 'b' || doc_id || '.example' WHEN 2 THEN 'c' || doc_id || '.example' WHEN 3 THEN 'd' || doc_id || '.example' END AS domain FROM documents
""")
def list_domains(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    shapes = [F.concat(F.lit("A"), n, F.lit(".example")), F.concat(F.lit("0.0.0.0  b"), n, F.lit(".example # x")), F.concat(F.lit("||c"), n, F.lit(".example^$third-party")), F.concat(F.lit("d"), n, F.lit(".example;17")), F.concat(F.lit("@@||e"), n, F.lit(".example")), F.concat(F.lit("f.example##.ad"), n), F.concat(F.lit("# "), n), F.lit("domain")]
    line = F.element_at(F.array(*shapes), (F.col("doc_id") % 8 + 1).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", ps.list_domain(line).alias("domain"))


@query("""
    SELECT doc_id, 'o' || doc_id % 5 || '.example' AS owner_domain, CASE WHEN doc_id % 2 = 0 THEN 'm' || doc_id % 3 || '.example' END AS manager_domain, CAST(2 AS INT) AS records, 'x.com|' || doc_id || '|DIRECT, y.com|9|RESELLER' AS flat FROM documents
""")
def ads_txt_bodies(spark, sf_dir):
    n = F.col("doc_id")
    body = F.concat(
        F.lit("# head\nOWNERDOMAIN=first.example\nX.com, "), n, F.lit(", direct # c\nOwnerDomain = O"), n % 5, F.lit(".example\r\nz.com,,DIRECT\ny.com,9,Reseller,tag\nshort,line\n"),
        F.when(n % 2 == 0, F.concat(F.lit("MANAGERDOMAIN=M"), n % 3, F.lit(".example, us\n"))).otherwise(""),
    )
    a = ps.ads_txt_body(body)
    flat = F.array_join(F.transform(a["records"], lambda r: F.concat_ws("|", r["adsystem"], r["seller_id"], r["relationship"])), ", ")
    return _docs(spark, sf_dir).select("doc_id", a["owner_domain"].alias("owner_domain"), a["manager_domain"].alias("manager_domain"), F.size(a["records"]).alias("records"), flat.alias("flat"))


@query("""
    SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS openssl, CAST(o_orderdate AS TIMESTAMP) AS posted, CAST(o_orderdate AS DATE) AS whois,
        date_diff('day', CAST(o_orderdate AS TIMESTAMP), TIMESTAMP '1998-01-01 00:00:00') < 180 AS is_new FROM orders WHERE CAST(CAST(o_orderdate AS TIMESTAMP) AS DATE) = CAST(o_orderdate AS TIMESTAMP)
""")
def parsed_dates(spark, sf_dir):
    at = F.col("at")
    orders = p.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at")).where(F.col("at") == F.to_date("at").cast("timestamp"))
    posted = F.element_at(F.array(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(at, "yyyy/MM/dd HH:mm"), F.date_format(at, "yyyy-MM-dd")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    whois = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(at, "d.M.yyyy")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return orders.select("o_orderkey", ps.openssl_date(F.concat(F.date_format(at, "MMM d HH:mm:ss yyyy"), F.lit(" GMT"))).alias("openssl"), ps.posted_at(posted).alias("posted"), ps.whois_date(whois).alias("whois"), ps.is_new_domain(F.to_date(at), F.lit("1998-01-01").cast("timestamp")).alias("is_new"))


@query(f"""
    SELECT page_id, array_to_string(list_filter([CASE WHEN page_id % 5 >= 3 THEN 'multi_hop' END, CASE WHEN page_id % 4 = 0 THEN 'suspicious_extension' END, CASE WHEN url LIKE 'http://%' THEN 'http' END, CASE WHEN page_id % 3 = 0 THEN 'many_trackers' END], lambda x: x IS NOT NULL), ', ') AS tags
    FROM pages
""")
def risk_tags(spark, sf_dir):
    named = F.when(F.col("page_id") % 4 == 0, F.concat(F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]+)", 1), F.lit("/x/Setup.EXE?a=1"))).otherwise(F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]+)", 1))
    hosts = F.when(F.col("page_id") % 3 == 0, F.array(*map(F.lit, ["a.doubleclick.net", "b.hotjar.com", "x.segment.com"]))).otherwise(F.array(*map(F.lit, ["a.doubleclick.net", "b.doubleclick.net", "c.example"])))
    return _pages(spark, sf_dir).select("page_id", F.array_join(ps.risk_tags(named, (F.col("page_id") % 5).cast("int"), hosts), ", ").alias("tags"))


@query("SELECT page_id, 'https://c' || page_id || '.example/' AS declared, page_id % 2 = 0 AS challenged FROM pages")
def page_declarations(spark, sf_dir):
    n = F.col("page_id")
    target = F.concat(F.lit("https://c"), n, F.lit(".example/"))
    html = F.concat(F.when(n % 3 == 0, F.concat(F.lit("<meta property='og:url' content='"), target, F.lit("'>"))).otherwise(F.concat(F.lit('<link href="'), target, F.lit('" rel="canonical"><meta property="og:url" content="https://no.example/">'))), F.when(n % 2 == 0, "<title>Just a Moment...</title>").otherwise(""))
    # before the page, as challenges are looked for in the first 5000 characters
    page = F.concat(html, F.coalesce("html", F.lit("")))
    return p.read(spark, sf_dir, "pages").select("page_id", ps.declared_url(page).alias("declared"), ps.is_challenge(page).alias("challenged"))


@query("SELECT doc_id, replace(text || ' 10.1.1.1 10.1.1.10', '10.1.1.1', 'X') IS NOT NULL AS done, 2 AS n FROM documents")
def redactions(spark, sf_dir):
    text = F.concat(F.regexp_replace("text", r"10\.1\.1\.1", ""), F.lit(" 10.1.1.1 10.1.1.10"))
    addresses = F.array(F.lit("10.1.1.1"), F.lit("10.1.1.10"))
    return _docs(spark, sf_dir).select("doc_id", integrity.redact(text, addresses, "X").endswith(" X X").alias("done"), (integrity.occurrences(text, F.array(F.lit("10.1.1.1")))).alias("n"))


@query("""
    WITH d AS (SELECT doc_id % 300 AS dir, octet_length(encode(text)) AS n FROM documents), s AS (SELECT dir, count(*) AS files, sum(n) AS bytes FROM d GROUP BY 1)
    SELECT dir % 3 = 0 AS owned, CASE WHEN bytes = 0 THEN 'empty' ELSE 'partial' END AS kind, CASE WHEN bytes < 1024 THEN '<1K' WHEN bytes < 1048576 THEN '<1M' ELSE '>=1M' END AS band, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM s GROUP BY 1, 2, 3
""")
def reconcile_report(spark, sf_dir):
    files = _docs(spark, sf_dir).select(F.concat(F.lit("c/"), F.col("doc_id") % 300, F.lit("/"), F.col("doc_id"), F.lit(".html")).alias("path"), F.octet_length("text").cast("long").alias("length"), F.col("text").cast("binary").alias("content"))
    shots = _docs(spark, sf_dir).where("doc_id % 300 % 3 = 0").select(F.concat(F.lit("c/"), F.col("doc_id") % 300, F.lit("/s.png")).alias("screenshot_path"), F.lit(None).cast("string").alias("html_path"), F.lit("").alias("har_path"))
    refs = integrity.merge_references(integrity.referenced_directories(shots, "db1"), integrity.referenced_directories(shots, "db2"))
    return integrity.reconcile_report(integrity.reconcile(integrity.store_directories(files), refs))


@query("""
    SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'wrong_kind' WHEN doc_id % 11 = 0 THEN 'legacy_unverifiable' WHEN doc_id % 5 = 0 THEN 'body_missing' WHEN doc_id % 13 = 0 THEN 'body_mismatch' WHEN doc_id % 3 = 0 THEN 'truncated' ELSE 'verified' END AS state,
        CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 5 <> 0 AND doc_id % 13 <> 0 AND doc_id % 3 <> 0 THEN sha256(text) END AS identity FROM documents
""")
def verify_acquisitions(spark, sf_dir):
    d = F.col("doc_id")
    rows = _docs(spark, sf_dir).select(
        d.alias("id"), F.when(d % 7 == 0, "html").otherwise("ads_txt").alias("kind"), d.alias("scan_run_id"), F.when(d % 11 == 0, "").otherwise(F.concat(F.lit("b/"), d)).alias("body_path"), (d % 3 == 0).alias("truncated"),
        F.when(d % 13 == 0, "other").otherwise(F.sha2("text", 256)).alias("captured_sha256"), F.sha2("text", 256).alias("complete_sha256"),
    )
    bodies = _docs(spark, sf_dir).where("doc_id % 5 <> 0").select(F.concat(F.lit("b/"), d).alias("body_path"), F.sha2("text", 256).alias("body_sha256"))
    return integrity.verify_acquisitions(rows, bodies, "ads_txt").drop("scan_run_id")


@query("SELECT source AS domain, min(doc_id) AS pos FROM documents GROUP BY 1")
def distinct_in_order(spark, sf_dir):
    rows = p.read(spark, sf_dir, "documents").select(F.col("source").alias("domain"), F.col("doc_id").alias("pos"))
    return discovery.distinct_in_order(rows, "domain")


@query("SELECT 'www.s' || doc_id || '.example' AS domain FROM documents WHERE doc_id % 4 <> 0")
def without_scanned(spark, sf_dir):
    name = lambda: F.concat(F.lit("s"), "doc_id", F.lit(".example"))
    candidates = _docs(spark, sf_dir).select(F.concat(F.lit("www."), name()).alias("domain"))
    return discovery.without_scanned(candidates, _docs(spark, sf_dir).where("doc_id % 4 = 0").select(name().alias("apex")))


@query("SELECT page_id, CASE WHEN page_id % 4 = 1 THEN CASE WHEN page_id % 3 = 0 THEN 'lease_expired' ELSE 'running' END ELSE 'done' END AS status FROM pages")
def reclaim_stuck(spark, sf_dir):
    scans = _pages(spark, sf_dir).select("page_id", F.when(F.col("page_id") % 4 == 1, "running").otherwise("done").alias("status"), F.when(F.col("page_id") % 3 == 0, "2026-01-01 00:00:00 UTC").otherwise("2026-03-01 00:00:00 UTC").alias("run_at"))
    return pins.reclaim_stuck(scans, "2026-02-01 00:00:00 UTC").drop("run_at")


@query("SELECT 'u' AS a, CASE WHEN page_id % 2 = 0 THEN 'multi_hop, new_domain' ELSE 'multi_hop' END AS tags, page_id FROM pages")
def merge_risk_tags(spark, sf_dir):
    a, b = F.from_json(F.lit('["multi_hop"]'), "ARRAY<STRING>"), F.from_json(F.when(F.col("page_id") % 2 == 0, '["multi_hop","new_domain"]').otherwise("bad"), "ARRAY<STRING>")
    return _pages(spark, sf_dir).select(F.lit("u").alias("a"), F.array_join(ps.merge_tags(a, b), ", ").alias("tags"), "page_id")
