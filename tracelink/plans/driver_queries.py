"""The registered queries of the attribution engine and their DuckDB equivalents."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.functions import urls
from tracelink.functions.decisions import first_of
from tracelink.functions.fingerprints import pattern_table, tracking_ids
from tracelink.operators import ads, discovery, groups, headers, index, infra, insights, integrity, pins, url
from tracelink.plans import projections as p
from tracelink.plans.projections import ADS_SQL, CAPTURES_SQL, CERTS_SQL, HEADERS_SQL, OBSERVED_SQL, PAGES_SQL, SIGNALS_SQL, host

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator groups over the pages' hard signals."""
    return operator_groups(spark, sf_dir)


def text(c: str | Column) -> Column:
    """An array as text, so that results compare between engines."""
    return F.array_join(c, ", ")


PARAMS_SQL = rf"""
    observed AS (
        SELECT u.case_id, u.ua_id, u.post_id, u.original_url AS url FROM urls u
        UNION SELECT u.case_id, u.ua_id, u.post_id, s.final_url FROM urls u JOIN url_any a USING (ua_id) JOIN scans s ON s.scan_run_id = a.scan_run_id
    ), pieces AS (
        SELECT *, unnest(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&')) AS piece FROM observed
    ), params AS (
        SELECT case_id, ua_id, post_id, url, {host("url")} AS domain, url_decode(replace(split_part(piece, '=', 1), '+', ' ')) AS k, url_decode(replace(piece[strpos(piece, '=') + 1:], '+', ' ')) AS v
        FROM pieces WHERE strpos(piece, '=') > 1 AND length(piece) > strpos(piece, '=')
    )"""
PLATFORM_SQL = """CASE WHEN lower(k) LIKE 'utm\\_%' ESCAPE '\\' THEN 'google_analytics' WHEN lower(k) IN ('ref', 'aff', 'aff_id', 'affiliate_id', 'uid', 'sid', 'click_id', 'tracking_id', 'campaign_id', 'source') THEN 'generic'
        WHEN lower(k) = 'fbclid' THEN 'meta_facebook' WHEN lower(k) = 'gclid' THEN 'google_ads' ELSE '' END"""


@query(f"""
    WITH {PAGES_SQL}, {PARAMS_SQL}
    SELECT case_id, k AS param_key, v AS param_value, string_agg(DISTINCT domain, ', ' ORDER BY domain) AS domains, count(DISTINCT post_id) AS post_count, count(DISTINCT url) AS url_count,
        {PLATFORM_SQL} AS platform_id, CASE {PLATFORM_SQL} WHEN 'generic' THEN 'generic' WHEN '' THEN 'unknown' ELSE 'platform' END AS owner_kind, lower(k) AS purpose_key
    FROM params GROUP BY case_id, k, v HAVING count(DISTINCT post_id) >= 2
""")
def shared_params(spark, sf_dir):
    return url.shared_params(url.param_rows(p.case_tables(spark, sf_dir)))


@query(f"""
    WITH {PAGES_SQL}, {PARAMS_SQL}
    SELECT case_id, k AS param_key, count(DISTINCT post_id) AS distinct_posts, count(DISTINCT v) AS distinct_values, count(DISTINCT domain) AS distinct_domains
    FROM params GROUP BY case_id, k HAVING count(DISTINCT post_id) >= 3 AND count(DISTINCT v) >= 1 AND count(DISTINCT domain) <= 500
""")
def shared_param_keys(spark, sf_dir):
    from tracelink.config import Conf

    rows = url.shared_param_keys(url.param_rows(p.case_tables(spark, sf_dir)), Conf(key_max_domains=500, key_min_values=1))
    return rows.select("case_id", "param_key", "distinct_posts", "distinct_values", "distinct_domains")


PINNED_SQL = f"""
    pinned AS (
        SELECT u.case_id, u.ua_id, u.post_id, u.original_url, s.*, {host("u.original_url")} AS original_domain, {host("s.final_url")} AS final_domain
        FROM urls u JOIN url_done d ON d.ua_id = u.ua_id JOIN (SELECT scan_run_id, final_url, hop_count, asn, as_org, tagged, suspect FROM scans) s ON s.scan_run_id = d.scan_run_id
    )"""


@query(f"""
    WITH {PAGES_SQL}, {PINNED_SQL}
    SELECT case_id, original_domain, final_domain, count(DISTINCT original_url) AS url_count, count(DISTINCT post_id) AS post_count, min(hop_count) AS min_hops, max(hop_count) AS max_hops
    FROM pinned WHERE original_domain <> final_domain GROUP BY 1, 2, 3
""")
def wrapper_relationships(spark, sf_dir):
    return url.wrapper_relationships(p.case_tables(spark, sf_dir)).drop("sample_urls")


@query(f"""
    WITH {PAGES_SQL}, {PINNED_SQL}, first AS (SELECT case_id, final_domain, original_url, min_by(tagged, ua_id) AS tagged FROM pinned GROUP BY 1, 2, 3)
    SELECT p.case_id, p.final_domain, count(DISTINCT p.original_url) AS url_count, count(DISTINCT post_id) AS post_count, count(DISTINCT CASE WHEN f.tagged < 2 THEN p.original_url END) AS flagged_url_count,
        string_agg(DISTINCT p.original_url, ', ' ORDER BY p.original_url) AS urls, true AS is_resolved,
        concat_ws(', ', 'http=' || nullif(count(DISTINCT CASE WHEN f.tagged = 0 THEN p.original_url END), 0), 'multi_hop=' || nullif(count(DISTINCT CASE WHEN f.tagged = 0 THEN p.original_url END), 0), 'new_domain=' || nullif(count(DISTINCT CASE WHEN f.tagged = 1 THEN p.original_url END), 0)) AS tag_counts
    FROM pinned p JOIN first f USING (case_id, final_domain, original_url) GROUP BY 1, 2
""")
def shared_destinations(spark, sf_dir):
    counted = F.array_join(F.transform(F.map_entries("tag_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return url.shared_destinations(p.case_tables(spark, sf_dir)).withColumns({"urls": text("urls"), "tag_counts": F.coalesce(counted, F.lit(""))}).drop("posts")


@query(f"""
    WITH {PAGES_SQL}, {PINNED_SQL}, landed AS (
        SELECT q.*, i.host FROM pinned q LEFT JOIN ids i ON i.page_id = q.scan_run_id // 10
    ), first AS (
        SELECT case_id, asn, original_url, min_by(tagged, ua_id) AS tagged FROM landed GROUP BY 1, 2, 3
    ), urls_ AS (
        SELECT case_id, asn, count(*) AS url_count, count(CASE WHEN tagged < 2 THEN 1 END) AS flagged_url_count, count(CASE WHEN tagged = 0 THEN 1 END) AS hop, count(CASE WHEN tagged = 1 THEN 1 END) AS new_ FROM first GROUP BY 1, 2
    ), per AS (
        SELECT case_id, asn, max_by(as_org, ua_id) AS as_org, '—' AS as_country, count(DISTINCT host) AS domain_count, count(DISTINCT post_id) AS post_count, string_agg(DISTINCT host, ', ' ORDER BY host) AS domains FROM landed GROUP BY 1, 2
    )
    SELECT per.*, url_count, flagged_url_count, concat_ws(', ', CASE WHEN hop > 0 THEN 'http=' || hop || ', multi_hop=' || hop END, CASE WHEN new_ > 0 THEN 'new_domain=' || new_ END) AS tag_counts FROM per JOIN urls_ USING (case_id, asn)
""")
def asn_clusters(spark, sf_dir):
    counted = F.array_join(F.transform(F.map_entries("tag_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    found = infra.asn_clusters(p.case_tables(spark, sf_dir)).withColumn("domains", text(F.transform("domains", lambda d: d["domain"])))
    return found.withColumn("tag_counts", F.coalesce(counted, F.lit("")))


TRACKED_SQL = f"""
    tracked AS (
        SELECT u.case_id, u.ua_id, u.post_id, u.original_url, f.host AS domain, f.platform, f.tracking_id
        FROM urls u JOIN url_done d ON d.ua_id = u.ua_id JOIN found f ON f.page_id = d.scan_run_id // 10 WHERE d.scan_run_id % 7 <> 0
    )"""


@query(f"""
    WITH {PAGES_SQL}, {TRACKED_SQL}
    SELECT case_id, platform, tracking_id, count(DISTINCT domain) AS domain_count, count(DISTINCT original_url) AS url_count, count(DISTINCT post_id) AS post_count, string_agg(DISTINCT domain, ', ' ORDER BY domain) AS domains
    FROM tracked GROUP BY 1, 2, 3 HAVING count(DISTINCT domain) >= 2
""")
def shared_tracking_ids(spark, sf_dir):
    return infra.shared_tracking_ids(p.case_tables(spark, sf_dir)).withColumn("domains", text("domains"))


#: One snippet for each fixed pattern, in their order: {n} is a number of eight digits, {h} eight hex digits in capitals.
SNIPPETS = [
    ("Meta Pixel", "1{n}123456", "fbq( 'init' , \"{id}\")"), ("Google Analytics 4", "G-{h}", "gtag('config','{id}')"), ("Google Analytics 4", "G-A{h}", "<a href=https://www.google-analytics.com/g/collect?v=2&tid={id}>"),
    ("Google Analytics (UA)", "UA-1{n}-1", "ga( 'create', '{id}' )"), ("Google Analytics (UA)", "UA-2{n}-2", "<img src=//www.google-analytics.com/collect?tid={id}>"), ("Google Tag Manager", "GTM-{h}", "(window,'dataLayer' , '{id}')"),
    ("Google Tag Manager", "GTM-A{h7}", "https://www.googletagmanager.com/ns.html?id={id}"), ("Google Ads", "AW-1{n}", "gtag('config', '{id}')"), ("Google Ads", "AW-2{n}", "{'send_to': '{id}/label'}"), ("TikTok Pixel", "C{h}AAAAAAA", "ttq.load('{id}')"),
    ("Microsoft Clarity", "x{n}", "src=https://www.clarity.ms/tag/{id}?ref"), ("Microsoft Clarity", "y{n}", "clarity('set', 'project', '{id}')"), ("Hotjar", "1{n}", "h._hjSettings={hjid:{id},hjsv:6}"), ("LINE Tag", "line-{n}", "_lt('init', {customerType: 'lap', tagId: '{id}'})"),
    ("X / Twitter Pixel", "o{n}", "twq('config','{id}')"), ("Google AdSense", "ca-pub-1{n}1234567", "<ins data-ad-client='{id}'>"), ("Google AdSense", "ca-pub-2{n}1234567", "google_ad_client : '{id}'"), ("Google AdSense", "ca-pub-3{n}1234567", "pagead2.googlesyndication.com/pagead/js?client={id}"),
    ("Meta Facebook Page", "4{n}, 5{n}", "<meta content='x'><meta property='fb:pages' content='{id}'>"),
]


def _pieces(text: str) -> list[str]:
    """A snippet's text, cut at its places."""
    return [x for x in re.split(r"(\{n\}|\{h7\}|\{h\})", text) if x]


def _filled_sql(text: str) -> str:
    return " || ".join(x[1:-1] if x in ("{n}", "{h7}", "{h}") else "'" + x.replace("'", "''") + "'" for x in _pieces(text))


def _filled(text: str) -> Column:
    return F.concat(*[F.col(x[1:-1]) if x in ("{n}", "{h7}", "{h}") else F.lit(x) for x in _pieces(text)])


@query(f"""
    WITH numbered AS (
        SELECT page_id, lpad(CAST(page_id AS VARCHAR), 8, '9') AS n, upper(md5(CAST(page_id AS VARCHAR))[1:8]) AS h, upper(md5(CAST(page_id AS VARCHAR))[1:7]) AS h7 FROM pages
    ), every AS (
        {" UNION ALL ".join(f"SELECT page_id, '{label}' AS platform, unnest(string_split({_filled_sql(id)}, ', ')) AS tracking_id FROM numbered WHERE page_id % 19 <> {i}" for i, (label, id, _) in enumerate(SNIPPETS))}
    )
    SELECT DISTINCT page_id, platform, tracking_id FROM every
""")
def extract_tracking_ids(spark, sf_dir):
    """Whole pages with a snippet for each pattern but one, by the fixed patterns read as a table."""
    i = F.col("page_id")
    pages = p.read(spark, sf_dir, "pages").withColumns({"n": F.lpad(i.cast("string"), 8, "9"), "h": F.upper(F.substring(F.md5(i.cast("string")), 1, 8)), "h7": F.upper(F.substring(F.md5(i.cast("string")), 1, 7))})
    shown = [F.when(i % 19 != k, _filled(snippet.replace("{id}", id))).otherwise("") for k, (_, id, snippet) in enumerate(SNIPPETS)]
    html = F.concat_ws("\n", F.col("html"), *shown)
    each = pages.select("page_id", F.explode(tracking_ids(html, pattern_table(spark))).alias("platform", "ids"))
    return each.select("page_id", "platform", F.explode("ids").alias("tracking_id"))


@query(f"""
    WITH {PAGES_SQL}, {PARAMS_SQL}, by_url AS (
        SELECT case_id, ua_id, post_id, original_url, domain, k AS param_key, NULL AS tracking_id, {PLATFORM_SQL} AS platform_id FROM params JOIN (SELECT ua_id, original_url FROM urls) o USING (ua_id)
    ), by_html AS (
        SELECT u.case_id, u.ua_id, u.post_id, u.original_url, f.host AS domain, NULL AS param_key, f.tracking_id, CASE f.platform WHEN 'Meta Pixel' THEN 'meta_facebook' WHEN 'Google Analytics 4' THEN 'google_analytics' ELSE 'google_tag_manager' END AS platform_id
        FROM urls u JOIN url_any d ON d.ua_id = u.ua_id JOIN found f ON f.page_id = d.scan_run_id // 10 WHERE d.scan_run_id % 7 <> 0
    ), every AS (
        SELECT * FROM by_url WHERE platform_id <> '' UNION ALL SELECT * FROM by_html
    ), per AS (
        SELECT case_id, platform_id, count(DISTINCT original_url) AS url_count, count(DISTINCT post_id) AS post_count, count(DISTINCT domain) AS domain_count, coalesce(string_agg(DISTINCT param_key, ', ' ORDER BY param_key), '') AS param_keys,
            coalesce(string_agg(DISTINCT tracking_id, ', ' ORDER BY tracking_id), '') AS tracking_ids, string_agg(DISTINCT domain, ', ' ORDER BY domain) AS domains, count(param_key) > 0 AS u, count(tracking_id) > 0 AS h FROM every GROUP BY 1, 2
    ), meet AS (
        SELECT DISTINCT a.case_id, a.platform_id FROM every a JOIN every b ON a.case_id = b.case_id AND a.platform_id = b.platform_id AND a.param_key IS NOT NULL AND b.tracking_id IS NOT NULL AND (a.ua_id = b.ua_id OR a.domain = b.domain)
    )
    SELECT per.* EXCLUDE (u, h), CASE WHEN platform_id = 'generic' THEN 'generic' ELSE 'platform' END AS owner_kind,
        CASE WHEN u AND h AND (case_id, platform_id) IN (SELECT (case_id, platform_id) FROM meet) THEN 'both' WHEN u AND h THEN 'mixed_nonoverlap' WHEN h THEN 'html_embedded' ELSE 'url_param' END AS signal_source FROM per
""")
def ad_tracking_platforms(spark, sf_dir):
    return infra.ad_tracking_platforms(p.case_tables(spark, sf_dir)).withColumns({c: text(c) for c in ("param_keys", "tracking_ids", "domains")})


@query(f"""
    WITH {PAGES_SQL}, ends AS (
        SELECT u.case_id, i.host AS domain, unnest(['cdn.' || {host("s.final_url")}, '203.0.113.' || u.ua_id % 20]) AS endpoint
        FROM urls u JOIN own_done d ON d.ua_id = u.ua_id JOIN scans s ON s.scan_run_id = d.scan_run_id JOIN ids i ON i.page_id = u.ua_id WHERE d.scan_run_id % 7 <> 0
    )
    SELECT case_id, endpoint, count(DISTINCT domain) AS domain_count, string_agg(DISTINCT domain, ', ' ORDER BY domain) AS domains, endpoint LIKE '203.%' AS is_direct_ip
    FROM ends WHERE endpoint <> domain AND NOT ends_with(endpoint, '.' || domain) GROUP BY 1, 2 HAVING count(DISTINCT domain) >= 2
""")
def shared_endpoints(spark, sf_dir):
    return infra.shared_endpoints(p.case_tables(spark, sf_dir)).withColumn("domains", text("domains"))


@query(f"""
    WITH {PAGES_SQL}
    SELECT u.ua_id AS url_artifact_id, o.scan_run_id AS own_done, d.scan_run_id AS url_done, a.scan_run_id AS url_any
    FROM urls u LEFT JOIN own_done o USING (ua_id) LEFT JOIN url_done d USING (ua_id) LEFT JOIN url_any a USING (ua_id)
""")
def pinned_scans(spark, sf_dir):
    t = p.case_tables(spark, sf_dir)
    out = t.url_artifacts.select(F.col("id").alias("url_artifact_id"))
    for name, pin in (("own_done", pins.own_scan(t)), ("url_done", pins.url_scan(t)), ("url_any", pins.url_scan(t, False))):
        out = out.join(pin.withColumnRenamed("scan_run_id", name), "url_artifact_id", "left")
    return out


@query(f"""
    WITH {PAGES_SQL}, newest AS (SELECT ua_id, max_by(status, scan_run_id) = 'done' AS done FROM scans GROUP BY 1)
    SELECT u.case_id, count(*) AS total, count(CASE WHEN done THEN 1 END) AS scanned, count(d.scan_run_id) - count(CASE WHEN done THEN 1 END) AS borrowed
    FROM urls u LEFT JOIN newest USING (ua_id) LEFT JOIN url_done d USING (ua_id) GROUP BY 1
""")
def case_counts(spark, sf_dir):
    t = p.case_tables(spark, sf_dir)
    borrowed = t.url_artifacts.select(F.col("id").alias("url_artifact_id"), "case_id").join(pins.url_scan(t), "url_artifact_id").groupBy("case_id").agg(F.count("*").alias("n"))
    return pins.case_counts(t).join(borrowed, "case_id", "left").select("case_id", "total", "scanned", (F.coalesce("n", F.lit(0)) - F.col("scanned")).alias("borrowed"))


@query(f"""
    WITH {PAGES_SQL}, shots AS (
        SELECT DISTINCT scan_run_id FROM scans WHERE scan_run_id % 2 = 0 AND scan_run_id % 7 <> 0
    )
    SELECT u.case_id, u.ua_id, o.scan_run_id FROM urls u JOIN own_done o USING (ua_id) WHERE o.scan_run_id NOT IN (SELECT scan_run_id FROM shots)
""")
def pending_snapshots(spark, sf_dir):
    return pins.pending_snapshots(p.case_tables(spark, sf_dir)).drop("final_url")


@query(f"WITH {PAGES_SQL} SELECT u.case_id, count(DISTINCT u.original_url) AS urls, count(s.scan_run_id) AS scan_count FROM urls u JOIN scans s USING (ua_id) GROUP BY 1")
def case_list(spark, sf_dir):
    t = p.case_tables(spark, sf_dir)
    urls_ = t.url_artifacts.groupBy("case_id").agg(F.count_distinct("original_url").alias("urls"))
    return pins.case_list(t).join(urls_, "case_id").select("case_id", "urls", "scan_count")


@query(f"""
    WITH {PAGES_SQL}, newest AS (SELECT ua_id, max_by(status, scan_run_id) = 'done' AS done, any_value(final_url) AS final_url FROM scans GROUP BY 1)
    SELECT u.case_id, count(CASE WHEN done AND u.ua_id % 7 >= 3 THEN 1 END) AS no_intel, count(CASE WHEN done AND u.ua_id % 11 = 0 THEN 1 END) AS no_snapshot, count(CASE WHEN done AND lower(final_url) LIKE 'https%' THEN 1 END) AS no_tls,
        count(CASE WHEN done THEN 1 END) AS no_corroboration, count(CASE WHEN NOT done THEN 1 END) AS unscanned
    FROM urls u JOIN newest USING (ua_id) GROUP BY 1
""")
def evidence_gaps(spark, sf_dir):
    """Every eleventh artifact has no captures."""
    t = p.case_tables(spark, sf_dir)
    t.snapshots = t.snapshots.where("scan_run_id DIV 10 % 11 <> 0")
    return insights.evidence_gaps(t)


@query(f"WITH {PAGES_SQL} SELECT u.case_id, count(DISTINCT CASE WHEN u.ua_id % 8 = 0 THEN u.original_url END) AS suspects FROM urls u JOIN own_done o USING (ua_id) GROUP BY 1")
def cloaking_suspects(spark, sf_dir):
    return insights.cloaking_suspects(p.case_tables(spark, sf_dir))


@query(f"""
    WITH {CERTS_SQL}
    SELECT case_id, issuer, serial, min(not_before) AS not_before, count(DISTINCT domain) AS domain_count, count(DISTINCT original_url) AS url_count, count(DISTINCT post_id) AS post_count, 1 AS san_count, string_agg(DISTINCT domain, ', ' ORDER BY domain) AS domains
    FROM certs GROUP BY 1, 2, 3 HAVING count(DISTINCT domain) >= 2
""")
def shared_certificates(spark, sf_dir):
    return infra.shared_certificates(p.certificates(spark, sf_dir)).withColumn("domains", text("domains")).drop("not_after")


@query(f"""
    WITH RECURSIVE {CERTS_SQL}, one AS MATERIALIZED (
        SELECT case_id, issuer, serial, min(not_before) AS issued FROM certs GROUP BY 1, 2, 3
    ), opens(case_id, start) AS (
        SELECT case_id, min(issued) FROM one GROUP BY 1
        UNION SELECT o.case_id, (SELECT min(issued) FROM one WHERE one.case_id = o.case_id AND one.issued > o.start + INTERVAL 24 HOUR) FROM opens o WHERE start IS NOT NULL
    )
    SELECT o.case_id, min(c.issued) AS window_start, max(c.issued) AS window_end, count(DISTINCT (c.issuer, c.serial)) AS cert_count, count(DISTINCT x.domain) AS domain_count,
        string_agg(DISTINCT x.domain, ', ' ORDER BY x.domain) AS domains, string_agg(DISTINCT c.issuer, ', ' ORDER BY c.issuer) AS issuers
    FROM opens o JOIN one c ON c.case_id = o.case_id AND c.issued BETWEEN o.start AND o.start + INTERVAL 24 HOUR JOIN certs x ON x.case_id = c.case_id AND x.issuer = c.issuer AND x.serial = c.serial
    WHERE o.start IS NOT NULL GROUP BY o.case_id, o.start HAVING count(DISTINCT (c.issuer, c.serial)) >= 2 AND count(DISTINCT x.domain) >= 2
""")
def issuance_windows(spark, sf_dir):
    found = infra.issuance_windows(p.certificates(spark, sf_dir))
    return found.withColumns({"domains": text("domains"), "issuers": text("issuers")})


@query(f"""
    WITH {HEADERS_SQL}
    SELECT case_id, domain, header, min(value) AS value, count(*) AS observations FROM header_rows GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND count(DISTINCT value) = 1
""")
def per_domain_constants(spark, sf_dir):
    return headers.per_domain_constants(p.header_rows(spark, sf_dir))


@query(f"""
    WITH {HEADERS_SQL}
    SELECT case_id, header, value, count(DISTINCT domain) AS domain_count, string_agg(DISTINCT domain, ', ' ORDER BY domain) AS domains
    FROM header_rows WHERE header IN ('server', 'x-powered-by') AND value <> '' GROUP BY 1, 2, 3 HAVING count(DISTINCT domain) >= 2
""")
def shared_header_templates(spark, sf_dir):
    return headers.shared_header_templates(p.header_rows(spark, sf_dir)).withColumn("domains", text("domains"))


@query("""
    WITH v AS (
        SELECT 'd' || user_id % 40 AS domain, CASE event_type WHEN 'click' THEN 'server' ELSE 'x-powered-by' END AS header, CASE event_type WHEN 'click' THEN 'Apache/2.' || user_id % 9 ELSE 'PHP/' || user_id % 12 || '.1' END AS value
        FROM events
    )
    SELECT DISTINCT domain, header, value FROM v WHERE (header = 'server' AND regexp_matches(value, '^Apache/2\\.[5-8]$')) OR (header <> 'server' AND regexp_matches(value, '^PHP/(9|10|11)\\.'))
""")
def fake_versions(spark, sf_dir):
    e = F.col("event_type")
    value = F.when(e == "click", F.concat(F.lit("Apache/2."), F.col("user_id") % 9)).otherwise(F.concat(F.lit("PHP/"), F.col("user_id") % 12, F.lit(".1")))
    rows = p.read(spark, sf_dir, "events").select(F.lit(0).alias("case_id"), F.concat(F.lit("d"), F.col("user_id") % 40).alias("domain"), F.when(e == "click", "server").otherwise("x-powered-by").alias("header"), value.alias("value"))
    return headers.fake_versions(rows).select("domain", "header", "value").distinct()


OPSEC_SQL = f"""
    {CAPTURES_SQL}, per AS (
        SELECT case_id, domain, count(CASE WHEN capture_method = 'http_only' AND ok THEN 1 END) AS lw_ok, count(CASE WHEN capture_method = 'http_only' THEN 1 END) AS lw_total,
            count(CASE WHEN capture_method = 'playwright' AND ok THEN 1 END) AS pw_ok, count(CASE WHEN capture_method = 'playwright' THEN 1 END) AS pw_total
        FROM captures GROUP BY 1, 2
    ), levels AS (
        SELECT *, CASE WHEN lw_total = 0 OR pw_total = 0 OR pw_ok / pw_total < 0.7 THEN 'indeterminate' WHEN lw_ok / lw_total >= 0.7 THEN 'low' WHEN lw_ok / lw_total >= 0.2 THEN 'medium' ELSE 'strong' END AS level,
            CASE WHEN lw_total = 0 AND pw_total = 0 THEN 'no_capture' WHEN lw_total = 0 THEN 'no_lightweight' WHEN pw_total = 0 THEN 'no_playwright' WHEN pw_ok / pw_total < 0.7 THEN 'playwright_unreliable' END AS indeterminate_reason FROM per
    )"""


@query(f"WITH {OPSEC_SQL} SELECT case_id, domain, lw_ok, lw_total, pw_ok, pw_total, level, indeterminate_reason FROM levels")
def opsec_profile(spark, sf_dir):
    return insights.opsec_profile(p.capture_rows(spark, sf_dir)).drop("lw_rate", "pw_rate", "diff_above_50")


@query(f"WITH {OPSEC_SQL} SELECT case_id, indeterminate_reason, count(*) AS n FROM levels WHERE level = 'indeterminate' GROUP BY 1, 2")
def opsec_gap(spark, sf_dir):
    return insights.opsec_gap(insights.opsec_profile(p.capture_rows(spark, sf_dir)))


@query(f"""
    WITH {ADS_SQL}, sizes AS (
        SELECT domain, count(*) AS n FROM direct GROUP BY 1
    ), linked AS (
        SELECT a.domain AS d1, b.domain AS d2 FROM direct a JOIN direct b ON a.seller_id = b.seller_id AND a.domain < b.domain JOIN sizes s ON s.domain = a.domain JOIN sizes t ON t.domain = b.domain
        GROUP BY 1, 2, s.n, t.n HAVING count(*) >= 8 AND count(*) >= 0.4 * least(s.n, t.n)
    ), pairs AS (
        SELECT a.seller_id, count(*) AS linked FROM direct a JOIN direct b ON a.seller_id = b.seller_id AND a.domain < b.domain JOIN linked l ON l.d1 = a.domain AND l.d2 = b.domain GROUP BY 1
    ), foot AS (
        SELECT seller_id, count(DISTINCT domain) AS apexes FROM direct WHERE d % 10 <> 9 GROUP BY 1
    ), per AS (
        SELECT seller_id, count(DISTINCT domain) AS domain_count, string_agg(DISTINCT domain, ', ' ORDER BY domain) AS domains, bool_and(d % 4 = 0 AND d % 10 <> 9) AS managed FROM direct GROUP BY 1 HAVING count(DISTINCT domain) >= 2
    ), figures AS (
        SELECT per.*, coalesce(apexes, 0) AS global_apex_count, coalesce(linked, 0) AS linked_pairs, (SELECT count(DISTINCT domain) FROM files WHERE status = 'ok') AS denominator
        FROM per LEFT JOIN foot USING (seller_id) LEFT JOIN pairs USING (seller_id)
    )
    SELECT 'ads.example' AS adsystem, seller_id, domain_count, domains, global_apex_count, linked_pairs, managed AS all_carriers_managed,
        domain_count / denominator AS breadth_ratio, linked_pairs / (domain_count * (domain_count - 1) / 2) AS pair_link_ratio, domain_count AS url_count, domain_count AS post_count, CASE WHEN managed OR domain_count / denominator >= 0.8 OR linked_pairs / (domain_count * (domain_count - 1) / 2) >= 0.6 OR global_apex_count >= 10 THEN 'manager' WHEN global_apex_count <= 4 THEN 'operator' ELSE 'uncertain' END AS tier
    FROM figures
""")
def shared_ad_accounts(spark, sf_dir):
    rows = ads.shared_ad_accounts(p.ads_rows(spark, sf_dir)).withColumn("domains", text("domains"))
    return rows.select("adsystem", "seller_id", "domain_count", "domains", "global_apex_count", "linked_pairs", "all_carriers_managed", "tier", "breadth_ratio", "pair_link_ratio", "url_count", "post_count")


@query(f"WITH {ADS_SQL} SELECT sha AS sha256, count(DISTINCT domain) AS domain_count, string_agg(DISTINCT domain, ', ' ORDER BY domain) AS domains, 'legacy_unverifiable' AS verification FROM files WHERE status = 'ok' GROUP BY 1 HAVING count(DISTINCT domain) >= 2")
def shared_templates(spark, sf_dir):
    from tracelink.schema import DDL

    states = ads.acquisition_states(p.ads_rows(spark, sf_dir), spark.createDataFrame([], DDL["acquisitions"]), None)
    return ads.shared_templates(ads.domain_states(states)).select("sha256", "domain_count", text("domains").alias("domains"), "verification")


@query(f"WITH {ADS_SQL} SELECT adsystem, seller_id, count(DISTINCT domain) AS global_apex_count FROM direct WHERE d % 10 <> 9 GROUP BY 1, 2")
def account_footprint(spark, sf_dir):
    return ads.account_footprint(ads.direct_accounts(p.ads_rows(spark, sf_dir)))


@query(f"""
    WITH {OBSERVED_SQL}, pairs AS (
        SELECT DISTINCT domain, CAST(i + first AS VARCHAR) AS seller_id FROM observed, unnest(range(1, accounts + 1)) r(i) WHERE status = 'ok'
    )
    SELECT 'ads.example' AS adsystem, seller_id, count(*) AS hits, (SELECT count(DISTINCT domain) FROM observed WHERE status = 'ok') AS site_count FROM pairs GROUP BY 2
""")
def build_prevalence(spark, sf_dir):
    return discovery.build_prevalence(p.observations(spark, sf_dir))


@query(f"""
    WITH {OBSERVED_SQL}
    SELECT sha AS sha256, sha[1:12] AS sha256_short, count(DISTINCT domain) AS domain_count, string_agg(DISTINCT domain, ', ' ORDER BY domain) AS domains, max(accounts) AS account_count,
        CASE WHEN max(accounts) >= 300 THEN 'platform' ELSE 'portfolio' END AS kind
    FROM observed WHERE status = 'ok' GROUP BY sha HAVING count(DISTINCT domain) >= 2
""")
def cluster_by_template(spark, sf_dir):
    return discovery.cluster_by_template(p.observations(spark, sf_dir)).withColumn("domains", text("domains"))


SCREEN_SQL = f"""
    {OBSERVED_SQL}, known AS (
        SELECT DISTINCT sha FROM observed WHERE doc_id % 3 = 0
    ), screened AS (
        SELECT domain, CASE WHEN status = 'error' THEN 'unreachable' WHEN status = 'off_site_redirect' THEN 'off_site_redirect' WHEN record_count = 0 THEN 'no_ads_txt' WHEN sha IN (SELECT sha FROM known) THEN 'template_match' ELSE 'no_match' END AS verdict
        FROM observed
    )"""


def _screened(spark, sf_dir):
    seen = p.observations(spark, sf_dir)
    known = p.read(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("sha")).distinct().withColumn("matched_domains", F.array(F.lit("x")))
    return discovery.screen_ads_txt(seen, known)


@query(f"WITH {SCREEN_SQL} SELECT domain, verdict FROM screened")
def screen_ads_txt(spark, sf_dir):
    return _screened(spark, sf_dir).select("domain", "verdict")


@query(f"WITH {SCREEN_SQL} SELECT verdict, count(*) AS n FROM screened GROUP BY 1")
def verdict_histogram(spark, sf_dir):
    return discovery.verdict_histogram(_screened(spark, sf_dir))


@query(f"""
    WITH RECURSIVE {PAGES_SQL}, {TRACKED_SQL}, shared AS (
        SELECT case_id, platform, tracking_id FROM tracked WHERE platform <> 'Google Tag Manager' GROUP BY 1, 2, 3 HAVING count(DISTINCT domain) >= 2
    ), member AS (
        SELECT DISTINCT t.case_id, t.platform || '|' || t.tracking_id AS s, t.domain FROM tracked t JOIN shared USING (case_id, platform, tracking_id)
    ), edges AS (
        SELECT DISTINCT a.case_id, a.domain AS x, b.domain AS y FROM member a JOIN member b ON a.case_id = b.case_id AND a.s = b.s
    ), reach(case_id, x, y) AS (
        SELECT case_id, x, y FROM edges UNION SELECT r.case_id, r.x, e.y FROM reach r JOIN edges e ON e.case_id = r.case_id AND e.x = r.y
    ), part AS (
        SELECT case_id, x AS domain, min(y) AS label, count(*) AS group_size FROM reach GROUP BY 1, 2
    )
    SELECT case_id, domain, label, group_size, dense_rank() OVER (PARTITION BY case_id ORDER BY group_size DESC, label) AS gid FROM part
""")
def operator_groups(spark, sf_dir):
    tracking = infra.shared_tracking_ids(p.case_tables(spark, sf_dir))
    none = spark.createDataFrame([], "case_id long, issuer string, serial string, domains array<string>")
    files = spark.createDataFrame([], "case_id long, sha256 string, domains array<string>, verification string")
    return groups.memberships(groups.hard_signals(tracking, none, files)).select("case_id", "domain", "label", F.col("group_size"), "gid")


@query(f"""
    WITH {PAGES_SQL}, {TRACKED_SQL}
    SELECT case_id, tracking_id AS container_id, count(DISTINCT domain) AS domain_count FROM tracked WHERE platform = 'Google Tag Manager' GROUP BY 1, 2 HAVING count(DISTINCT domain) >= 2
""")
def weak_containers(spark, sf_dir):
    tracking = infra.shared_tracking_ids(p.case_tables(spark, sf_dir))
    members = spark.createDataFrame([], "case_id long, domain string, gid int")
    return groups.weak_containers(tracking, members).select("case_id", "container_id", "domain_count")


@query(f"""
    WITH {SIGNALS_SQL}
    SELECT signal_type, signal_value, count(DISTINCT (source_db, case_id)) AS case_count, count(DISTINCT final_domain) AS domain_count, count(*) AS hit_count
    FROM signals GROUP BY 1, 2 HAVING count(DISTINCT (source_db, case_id)) >= 2
""")
def recurring_signals(spark, sf_dir):
    return index.recurring_signals(p.signals(spark, sf_dir)).drop("platform", "cases")


def _apex_sql(h: str) -> str:
    return f"CASE WHEN len(string_split({h}, '.')) <= 2 THEN {h} ELSE array_to_string(string_split({h}, '.')[-2:], '.') END"


@query(f"""
    WITH {SIGNALS_SQL}, landing AS (
        SELECT DISTINCT {_apex_sql("signal_value")} AS apex FROM signals WHERE signal_type = 'final_domain'
    ), calls AS (
        SELECT signal_value AS endpoint, final_domain, source_db, case_id, {_apex_sql("final_domain")} AS apex FROM signals WHERE signal_type = 'har_endpoint' AND signal_value IN (SELECT apex FROM landing)
    )
    SELECT endpoint, count(DISTINCT CASE WHEN apex <> endpoint THEN final_domain END) AS caller_count, count(DISTINCT (source_db, case_id)) AS case_count, string_agg(DISTINCT CASE WHEN apex <> endpoint THEN final_domain END, ', ' ORDER BY CASE WHEN apex <> endpoint THEN final_domain END) AS called_by
    FROM calls GROUP BY 1 HAVING count(DISTINCT CASE WHEN apex <> endpoint THEN final_domain END) > 0
""")
def operator_cross_links(spark, sf_dir):
    return index.operator_cross_links(p.signals(spark, sf_dir)).withColumn("called_by", text("called_by")).drop("investigated_as_landing_in")


@query(f"WITH {SIGNALS_SQL} SELECT signal_type, source_db, case_id, scan_run_id, final_domain, observed_at FROM signals WHERE signal_value = md5({host('(SELECT url FROM pages WHERE page_id = 0)')})[1:2]")
def lookup(spark, sf_dir):
    first = p.read(spark, sf_dir, "pages").where("page_id = 0").select(F.substring(F.md5(urls.hostname("url")), 1, 2)).first()[0]
    return index.lookup(p.signals(spark, sf_dir), first).select("signal_type", "source_db", "case_id", "scan_run_id", "final_domain", "observed_at")


@query(f"SELECT page_id, {host('url')} AS host, {_apex_sql(host('url'))} AS apex, {_apex_sql(host('url'))} AS naive FROM pages")
def host_normalisers(spark, sf_dir):
    h = urls.hostname("url")
    return p.read(spark, sf_dir, "pages").select("page_id", h.alias("host"), urls.registrable_domain(h).alias("apex"), urls.naive_apex(h).alias("naive"))


@query("SELECT page_id, regexp_replace(url, '#.*$', '') AS found FROM pages UNION ALL SELECT page_id, 'https://x.example/a' FROM pages")
def extract_urls(spark, sf_dir):
    message = F.concat(F.lit("see ("), F.regexp_replace("url", "#.*$", ""), F.lit(") and <https://x.example/a>, https://x.example/a."))
    return p.read(spark, sf_dir, "pages").select("page_id", F.explode(urls.extract_urls(message)).alias("found"))


@query("""
    WITH found AS (
        SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,3}(?:\\.[0-9]{1,3}){3}')) AS address FROM documents
    )
    SELECT DISTINCT doc_id AS capture, address FROM found
    WHERE NOT regexp_matches(address, '^(0|10|127|192\\.168|169\\.254|172\\.(1[6-9]|2[0-9]|3[01])|100\\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])|2(2[4-9]|3[0-9]|4[0-9]|5[0-5]))\\.')
        AND list_max([CAST(x AS INT) FOR x IN string_split(address, '.')]) <= 255
""")
def echoed_addresses(spark, sf_dir):
    docs = p.read(spark, sf_dir, "documents")
    entries = docs.select(F.col("doc_id").alias("capture"), F.lit("https://a.example/").alias("url"), F.lit(None).cast("string").alias("server_ip"), F.lit(None).cast("string").alias("response_headers_json"), F.col("text").alias("body"))
    return integrity.echoed_addresses(entries)


@query("""
    SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'MISSING' WHEN doc_id % 7 = 0 THEN 'UNTRACKED' ELSE 'CHANGED' END AS state
    FROM documents WHERE (doc_id % 5 = 0) <> (doc_id % 7 = 0) OR (doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 3 = 0 AND text <> '')
""")
def compare_manifest(spark, sf_dir):
    docs = p.read(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("d"), "doc_id"))
    recorded = docs.where("doc_id % 7 <> 0").select("path", F.sha2("text", 256).alias("sha256"))
    there = docs.where("doc_id % 5 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("text")), 256).alias("sha256"))
    return integrity.compare_manifest(recorded, there)


@query("""
    WITH r AS (
        SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id END AS scan_run_id, doc_id % 5 AS five, doc_id % 7 AS seven, text FROM documents
    )
    SELECT CASE WHEN five = 0 THEN 'missing' WHEN seven = 0 AND text <> 'x' THEN 'altered' WHEN scan_run_id IS NULL THEN 'detached' ELSE 'ok' END AS health, count(*) AS n FROM r GROUP BY 1
""")
def acquisition_health(spark, sf_dir):
    docs = p.read(spark, sf_dir, "documents")
    rows = docs.select(F.concat(F.lit("b/"), "doc_id").alias("body_path"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")).alias("scan_run_id"), F.sha2("text", 256).alias("captured_sha256"))
    bodies = docs.where("doc_id % 5 <> 0").select(F.concat(F.lit("b/"), "doc_id").alias("body_path"), F.sha2(F.when(F.col("doc_id") % 7 == 0, F.lit("x")).otherwise(F.col("text")), 256).alias("body_sha256"))
    return integrity.acquisition_health(rows, bodies)


@query(f"""
    WITH {HEADERS_SQL}, {OPSEC_SQL}, t AS (
        SELECT count(*) AS n FROM (SELECT header, value FROM header_rows WHERE header IN ('server', 'x-powered-by') AND value <> '' GROUP BY 1, 2 HAVING count(DISTINCT domain) >= 2)
    ), s AS (SELECT count(*) AS n FROM levels WHERE level = 'strong')
    SELECT CAST(0 AS BIGINT) AS case_id, t.n AS grouping, s.n AS behaviour, CAST(round_even(100.0 * (6 * least(t.n, 3) + 3 * least(s.n, 3)) / 30, 0) AS INT) AS score FROM t, s
""")
def evidence_coverage(spark, sf_dir):
    templates = headers.shared_header_templates(p.header_rows(spark, sf_dir))
    strong = insights.opsec_profile(p.capture_rows(spark, sf_dir)).where("level = 'strong'")
    return insights.evidence_coverage(insights.signal_summary(header_templates=templates, strong_opsec=strong)).drop("money")


@query("""
    WITH c AS (
        SELECT o_custkey % 5 AS batch, o_orderkey // 500 AS chunk, count(CASE WHEN (o_orderkey // 500) % 4 = 0 OR o_orderkey % 10 = 0 THEN 1 END) AS ok, count(*) AS total FROM orders GROUP BY 1, 2
    ), b AS (
        SELECT *, (total - ok) / total >= 0.8 AS bad FROM c
    ), i AS (
        SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY batch ORDER BY chunk) AS island FROM b
    ), r AS (
        SELECT batch, chunk, ok, total, bad, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY batch, island ORDER BY chunk) AS BIGINT) AS run FROM i
    )
    SELECT *, run >= 3 AS abort FROM r
""")
def chunk_failures(spark, sf_dir):
    orders = p.read(spark, sf_dir, "orders")
    ok = (F.floor(F.col("o_orderkey") / 500) % 4 == 0) | (F.col("o_orderkey") % 10 == 0)
    return insights.chunk_failures(orders.select((F.col("o_custkey") % 5).alias("batch"), F.col("o_orderkey").alias("seq"), ok.alias("ok")), 500)


@query("SELECT doc_id, CASE WHEN n_chars % 4 = 0 THEN 'no_tracking_params' WHEN n_chars % 4 = 1 THEN 'fetch_error' WHEN doc_id % 2 = 0 THEN 'cloaking_suspect' ELSE 'no_cloaking' END AS verdict FROM documents")
def cloaking_verdicts(spark, sf_dir):
    from tracelink.functions.decisions import cloaking

    docs = p.read(spark, sf_dir, "documents")
    kind, even = F.col("n_chars") % 4, F.col("doc_id") % 2 == 0
    summary = lambda status, size: F.struct(F.when(kind == 1, "timeout").alias("error"), status.alias("status_code"), F.lit("a.example").alias("final_domain"), F.lit("s").alias("body_sha256"), size.alias("body_size"))
    found = cloaking(summary(F.lit(200), F.lit(100)), summary(F.when(even & (F.col("doc_id") % 4 == 0), 403).otherwise(200), F.when(even, 60).otherwise(75)), F.when(kind == 0, F.array()).otherwise(F.array(F.lit("gclid"))), F.lit(True))
    return docs.select("doc_id", found["verdict"].alias("verdict"))


@query("""
    SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'wayback' WHEN page_id % 5 = 1 THEN 'timeout' WHEN page_id % 5 = 2 THEN 'file_missing' WHEN page_id % 2 = 0 THEN 'cf_challenge' WHEN page_id % 5 = 3 THEN 'error' ELSE 'ok' END AS status FROM pages
""")
def capture_status(spark, sf_dir):
    from tracelink.functions import decisions

    k = F.col("page_id") % 5
    status = decisions.capture_status(F.when(k == 1, "Timed out after 30 s"), k == 4, k.isin(0, 3, 4), k == 0, F.col("page_id") % 2 == 0)
    return p.read(spark, sf_dir, "pages").select("page_id", status.alias("status"))


@query("""
    WITH j AS (SELECT o_orderkey AS pos, o_custkey % 7 AS apex FROM orders)
    SELECT pos, apex, row_number() OVER (PARTITION BY apex ORDER BY pos) AS turn FROM j
""")
def round_robin(spark, sf_dir):
    from pyspark.sql import Window

    jobs = p.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") % 7).alias("apex"))
    ordered = discovery.round_robin(jobs)
    return ordered.withColumn("turn", F.row_number().over(Window.partitionBy("apex").orderBy("pos")))


from tracelink.plans import case_queries, function_queries, report_queries, store_queries, stored_queries, suffix_queries  # noqa: E402, F401  registers their queries
