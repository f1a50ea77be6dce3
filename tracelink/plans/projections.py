"""Deterministic views of the driver's tables as tables of the case model, the same in Spark and in DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.schema import CaseTables, empty_tables


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _page_html(host: Column) -> Column:
    """Snippets whose ids follow from the host; a documentation id on every tenth page."""
    h = F.md5(host)
    number = lambda a, n: F.lpad(F.conv(F.substring(h, a, 2), 16, 10), n, "1")
    return F.concat(
        F.lit("<script>gtag('config', 'G-"), F.upper(F.substring(h, 1, 2)), F.lit("ABCDE1');fbq('init', '"), number(9, 15), F.lit("');</script><script src=\"https://www.googletagmanager.com/gtm.js?id=GTM-"),
        F.upper(F.substring(h, 17, 1)), F.lit("QRS7\"></script>"), F.when(F.col("page_id") % 10 == 0, F.lit("<script>gtag('config', 'UA-12345678-1');gtag('config', 'G-XXXXXXX');</script>")).otherwise(""),
    )


def page_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, html): whole pages with a snippet after each."""
    from tracelink.functions.urls import hostname

    return read(spark, sf_dir, "pages").withColumn("host", hostname("url")).select("page_id", "host", F.concat(F.coalesce("html", F.lit("")), _page_html(F.col("host"))).alias("html"))


def case_tables(spark: SparkSession, sf_dir: str) -> CaseTables:
    """Pages as posts and artifacts, three scans of each, captures with ids and endpoints."""
    from tracelink.functions.fingerprints import tracking_ids
    from tracelink.functions.urls import hostname

    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    other = pages.select(F.col("page_id").alias("o"), F.col("url").alias("o_url"))
    n = pages.agg(F.count("*").alias("n"))
    again = (F.col("page_id") % 6 == 1) & (F.col("page_id") >= 4)
    urls = pages.join(other, F.when(again, F.col("page_id") - 4).otherwise(F.col("page_id")) == F.col("o")).select(F.col("page_id").alias("id"), F.col("page_id").alias("message_id"), (F.col("page_id") % 4).alias("case_id"), F.col("o_url").alias("original_url"))
    posts = pages.select(F.col("page_id").alias("id"), (F.col("page_id") % 4).alias("case_id"), F.lit("web").alias("platform"), F.concat(F.lit("actor"), F.col("page_id") % 7).alias("actor_label"), F.concat(F.lit("see "), "url", F.lit(".")).alias("message_text"))
    k = F.col("k")
    scans = pages.crossJoin(F.broadcast(n)).withColumn("k", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    scans = scans.join(other, (F.col("page_id") * 7 + 3) % F.col("n") == F.col("o"))
    tags = F.when(F.col("page_id") % 3 == 0, F.lit('["multi_hop","http"]')).when(F.col("page_id") % 3 == 1, F.lit('["new_domain"]'))
    scans = scans.select(
        (F.col("page_id") * 10 + k).alias("id"), F.col("page_id").alias("url_artifact_id"), F.when(F.col("page_id") % 5 == 0, "error").when((F.col("page_id") + k) % 3 == 1, "error").otherwise("done").alias("status"),
        F.col("o_url").alias("final_url"), (F.col("page_id") % 5).cast("int").alias("hop_count"), F.concat(F.lit("AS"), F.col("page_id") % 9).alias("asn"), F.concat(F.lit("org"), F.col("page_id") % 9).alias("as_org"), tags.alias("intel_risk_tags"),
        F.when(F.col("page_id") % 8 == 0, F.lit('{"verdict":"cloaking_suspect","diffs":["status_code"]}')).alias("cloaking_signal_json"), F.when(F.col("page_id") % 7 < 3, F.lit("2026-01-01 00:00:00 UTC")).alias("domain_enriched_at"),
    )
    ids = page_html(spark, sf_dir).select(F.col("page_id").alias("p"), "host", F.to_json(tracking_ids("html")).alias("tracking_ids_json"))
    snaps = scans.join(ids, F.col("url_artifact_id") == F.col("p")).select(
        F.col("id"), F.col("id").alias("scan_run_id"), F.col("final_url"), F.col("host").alias("final_domain"), "tracking_ids_json", F.when(F.col("id") % 7 == 0, "error").otherwise("ok").alias("capture_status"),
        F.when(F.col("id") % 2 == 0, "playwright").otherwise("http_only").alias("capture_method"),
        F.concat(F.lit('["cdn.'), hostname("final_url"), F.lit('","www.google.com","203.0.113.'), F.col("p") % 20, F.lit('"]')).alias("request_domains_json"),
    )
    cases = posts.select("case_id").distinct().select(F.col("case_id").alias("id"), F.concat(F.lit("case "), "case_id").alias("title"))
    return empty_tables(spark, cases=cases, message_evidence=posts, url_artifacts=urls, scan_runs=scans, snapshots=snaps)


#: The same rows in SQL; `host` is the host of a URL.
HOST = r"lower(regexp_replace(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#]*)', 1), '[\[\]]', '', 'g'))"


def host(u: str) -> str:
    return HOST.replace("{u}", u)


PAGES_SQL = f"""
    urls AS (
        SELECT p.page_id AS ua_id, p.page_id AS post_id, p.page_id % 4 AS case_id, o.url AS original_url
        FROM pages p JOIN pages o ON o.page_id = CASE WHEN p.page_id % 6 = 1 AND p.page_id >= 4 THEN p.page_id - 4 ELSE p.page_id END
    ), scans AS (
        SELECT p.page_id * 10 + k AS scan_run_id, p.page_id AS ua_id, CASE WHEN p.page_id % 5 = 0 OR (p.page_id + k) % 3 = 1 THEN 'error' ELSE 'done' END AS status,
            o.url AS final_url, p.page_id % 5 AS hop_count, 'AS' || p.page_id % 9 AS asn, 'org' || p.page_id % 9 AS as_org, p.page_id % 3 AS tagged, p.page_id % 8 = 0 AS suspect
        FROM pages p CROSS JOIN (VALUES (0), (1), (2)) v(k) CROSS JOIN (SELECT count(*) AS n FROM pages) c JOIN pages o ON o.page_id = (p.page_id * 7 + 3) % c.n
    ), own_done AS (
        SELECT ua_id, max(scan_run_id) AS scan_run_id FROM scans WHERE status = 'done' GROUP BY 1
    ), url_done AS (
        SELECT * FROM (
            SELECT u.ua_id, coalesce(o.scan_run_id, max(o.scan_run_id) OVER (PARTITION BY u.case_id, u.original_url)) AS scan_run_id
            FROM urls u LEFT JOIN own_done o USING (ua_id)
        ) WHERE scan_run_id IS NOT NULL
    ), url_any AS (
        SELECT ua_id, max(scan_run_id) AS scan_run_id FROM scans GROUP BY 1
    ), ids AS (
        SELECT page_id, {host("url")} AS host, md5({host("url")}) AS h FROM pages
    ), found AS (
        SELECT page_id, host, 'Google Analytics 4' AS platform, 'G-' || upper(h[1:2]) || 'ABCDE1' AS tracking_id FROM ids
        UNION ALL SELECT page_id, host, 'Meta Pixel', lpad(CAST(CAST('0x' || h[9:10] AS INT) AS VARCHAR), 15, '1') FROM ids
        UNION ALL SELECT page_id, host, 'Google Tag Manager', 'GTM-' || upper(h[17:17]) || 'QRS7' FROM ids
    )"""


def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, domain, header, value): 40 domains, event types as headers; some constant, some on many domains."""
    d = F.col("user_id") % 40
    constant = (d + F.ascii("event_type")) % 3 == 0
    value = F.when(constant, F.concat(F.lit("stack-"), d % 6)).otherwise(F.get_json_object("props", "$.k"))
    rows = read(spark, sf_dir, "events").select(F.lit(0).cast("long").alias("case_id"), F.concat(F.lit("d"), d).alias("domain"), F.col("event_type").alias("header"), value.alias("value"))
    return rows.withColumn("header", F.when(F.col("header") == "click", "server").when(F.col("header") == "view", "x-powered-by").otherwise(F.concat(F.lit("x-"), "header")))


HEADERS_SQL = """
    header_rows AS (
        SELECT CAST(0 AS BIGINT) AS case_id, 'd' || user_id % 40 AS domain, CASE event_type WHEN 'click' THEN 'server' WHEN 'view' THEN 'x-powered-by' ELSE 'x-' || event_type END AS header,
            CASE WHEN (user_id % 40 + ascii(event_type)) % 3 = 0 THEN 'stack-' || (user_id % 40) % 6 ELSE json_extract_string(props, '$.k') END AS value
        FROM events
    )"""


def capture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d, ten = F.col("event_type"), F.col("user_id") % 25, F.col("event_id") % 10
    method = F.when(e.isin("click", "view"), "http_only").when(e.isin("signup", "purchase"), "playwright").otherwise("manual")
    ok = F.when(e.isin("click", "view"), ten < d % 11).when(d % 5 == 0, ten < 5).otherwise(ten < 9)
    return read(spark, sf_dir, "events").select(F.lit(0).cast("long").alias("case_id"), F.concat(F.lit("d"), d).alias("domain"), method.alias("capture_method"), ok.alias("ok"))


CAPTURES_SQL = """
    captures AS (
        SELECT CAST(0 AS BIGINT) AS case_id, 'd' || user_id % 25 AS domain, CASE WHEN event_type IN ('click', 'view') THEN 'http_only' WHEN event_type IN ('signup', 'purchase') THEN 'playwright' ELSE 'manual' END AS capture_method,
            CASE WHEN event_type IN ('click', 'view') THEN event_id % 10 < (user_id % 25) % 11 WHEN (user_id % 25) % 5 = 0 THEN event_id % 10 < 5 ELSE event_id % 10 < 9 END AS ok
        FROM events
    )"""


def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 3).alias("case_id"), F.col("o_orderkey").alias("ua_id"), F.col("o_orderkey").alias("post_id"), F.concat(F.lit("u"), F.col("o_orderkey") % 700).alias("original_url"), F.concat(F.lit("d"), F.col("o_orderkey") % 50).alias("domain"),
        F.concat(F.lit("CA "), F.col("o_custkey") % 5).alias("issuer"), F.col("o_custkey").cast("string").alias("serial"), F.col("o_orderdate").cast("timestamp").alias("not_before"), F.lit(None).cast("timestamp").alias("not_after"), F.lit(1).alias("sans"),
    )


CERTS_SQL = """
    certs AS (
        SELECT o_custkey % 3 AS case_id, o_orderkey AS ua_id, o_orderkey AS post_id, 'u' || o_orderkey % 700 AS original_url, 'd' || o_orderkey % 50 AS domain, 'CA ' || o_custkey % 5 AS issuer, CAST(o_custkey AS VARCHAR) AS serial, CAST(o_orderdate AS TIMESTAMP) AS not_before
        FROM orders
    )"""


def ads_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 domains' ads.txt with a skewed account each line; a tenth of them unread."""
    rows = read(spark, sf_dir, "lineitem")
    d = F.col("l_suppkey") % 40
    account = F.floor(F.sqrt(F.col("l_partkey").cast("double")) * 6).cast("int").cast("string")
    record = F.struct(F.lit("ads.example").alias("adsystem"), account.alias("seller_id"), F.when(F.col("l_returnflag") == "R", "DIRECT").otherwise("RESELLER").alias("relationship"), F.lit(None).cast("string").alias("cert_authority_id"))
    per = rows.groupBy(d.alias("d")).agg(F.array_sort(F.collect_set(record)).alias("records"))
    name = F.concat(F.lit("d"), "d", F.lit(".example"))
    return per.select(
        F.lit(0).cast("long").alias("case_id"), F.col("d").alias("ua_id"), F.col("d").alias("post_id"), F.concat(F.lit("http://"), name, F.lit("/")).alias("original_url"), F.col("d").alias("scan_run_id"), name.alias("domain"), name.alias("apex"), F.when(F.col("d") % 10 == 9, "error").otherwise("ok").alias("status"),
        F.sha2((F.col("d") % 13).cast("string"), 256).alias("sha"), F.when(F.col("d") % 4 == 0, "manager.example").alias("manager"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("long").alias("acquisition_id"), "records",
    )


ADS_SQL = """
    direct AS (
        SELECT DISTINCT CAST(0 AS BIGINT) AS case_id, l_suppkey % 40 AS d, 'd' || l_suppkey % 40 || '.example' AS domain, 'ads.example' AS adsystem, CAST(CAST(floor(sqrt(CAST(l_partkey AS DOUBLE)) * 6) AS INT) AS VARCHAR) AS seller_id
        FROM lineitem WHERE l_returnflag = 'R'
    ), files AS (
        SELECT DISTINCT l_suppkey % 40 AS d, 'd' || l_suppkey % 40 || '.example' AS domain, CASE WHEN (l_suppkey % 40) % 10 = 9 THEN 'error' ELSE 'ok' END AS status, sha256(CAST((l_suppkey % 40) % 13 AS VARCHAR)) AS sha
        FROM lineitem
    )"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as observed ads.txt files: equal texts are equal files."""
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("s"), "doc_id", F.lit(".example")).alias("domain"), F.when(F.col("doc_id") % 11 == 0, "error").when(F.col("doc_id") % 13 == 0, "off_site_redirect").otherwise("ok").alias("status"),
        F.sha2("text", 256).alias("raw_sha256"), F.when(F.col("doc_id") % 17 == 0, 0).otherwise(1).alias("record_count"), F.lit(None).cast("string").alias("verdict"),
        F.transform(F.sequence(F.lit(1), (F.col("n_chars") % 400 + 1).cast("int")), lambda i: F.array(F.lit("ads.example"), (i + F.col("n_chars") % 50).cast("string"))).alias("accounts"),
    )


OBSERVED_SQL = """
    observed AS (
        SELECT doc_id, 's' || doc_id || '.example' AS domain, CASE WHEN doc_id % 11 = 0 THEN 'error' WHEN doc_id % 13 = 0 THEN 'off_site_redirect' ELSE 'ok' END AS status, sha256(text) AS sha,
            CASE WHEN doc_id % 17 = 0 THEN 0 ELSE 1 END AS record_count, n_chars % 400 + 1 AS accounts, n_chars % 50 AS first
        FROM documents
    )"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of three databases: landing domains, ids and endpoints of pages."""
    from tracelink.functions.urls import hostname

    pages = read(spark, sf_dir, "pages").select("page_id", hostname("url").alias("host"))
    db = F.concat(F.lit("db"), F.col("page_id") % 3)
    part = lambda kind, value: pages.select(F.lit(kind).alias("signal_type"), value.alias("signal_value"), F.lit(None).cast("string").alias("platform"), db.alias("source_db"), (F.col("page_id") % 4).alias("case_id"), F.concat(F.lit("case "), F.col("page_id") % 4).alias("case_title"), F.col("page_id").alias("scan_run_id"), F.col("host").alias("final_domain"), F.concat(F.lit("2026-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")).alias("observed_at"), F.lit("2026-02-01").alias("indexed_at"))
    endpoint = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("example."), F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")), (F.col("page_id") % 3 + 1).cast("int"))))
    endpoint = F.coalesce(endpoint, F.concat(F.lit("site"), F.col("page_id") % 90, F.lit(".example.org")))
    parts = [part("final_domain", F.col("host")), part("tracking_id", F.substring(F.md5("host"), 1, 2)), part("har_endpoint", endpoint)]
    return reduce(DataFrame.unionByName, parts)


SIGNALS_SQL = f"""
    pg AS (
        SELECT page_id, {host("url")} AS host FROM pages
    ), kinds AS (
        SELECT page_id, host, 'final_domain' AS signal_type, host AS signal_value FROM pg
        UNION ALL SELECT page_id, host, 'tracking_id', md5(host)[1:2] FROM pg
        UNION ALL SELECT page_id, host, 'har_endpoint', CASE WHEN page_id % 2 = 0 THEN 'example.' || ['com', 'net', 'org'][page_id % 3 + 1] ELSE 'site' || page_id % 90 || '.example.org' END FROM pg
    ), signals AS (
        SELECT signal_type, signal_value, 'db' || page_id % 3 AS source_db, page_id % 4 AS case_id, page_id AS scan_run_id, host AS final_domain, '2026-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS observed_at FROM kinds
    )"""
