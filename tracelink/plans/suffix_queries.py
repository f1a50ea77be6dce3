"""Registered queries of public-suffix rules, with their DuckDB SQL. The rules follow from the tables: some fixed ones, and exceptions named by hosts."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracelink.functions import urls
from tracelink.functions.suffixes import SuffixRules
from tracelink.operators import ads, discovery, index
from tracelink.plans import projections as p
from tracelink.plans.driver_queries import query, text
from tracelink.plans.projections import ADS_SQL, SIGNALS_SQL, host

FIXED = [("com", False), ("net", False), ("org", False), ("example.com", True), ("*.example.net", True), ("org", False)]


def page_rules(spark: SparkSession, sf_dir: str) -> SuffixRules:
    """Hosts with three labels under example.net of every third page are exceptions; the fourth labels from the right under example.org are suffixes of tenants."""
    pages = p.read(spark, sf_dir, "pages").select("page_id", urls.hostname("url").alias("host"))
    exception = F.regexp_extract("host", r"([^.]+\.example\.net)$", 1)
    tenant = F.regexp_extract("host", r"([^.]+\.example\.org)$", 1)
    found = pages.where("page_id % 3 = 0").select(F.when(exception != "", F.concat(F.lit("!"), exception)).alias("rule")).union(pages.where("page_id % 5 = 0").select(F.nullif(tenant, F.lit("")))).where("rule IS NOT NULL").distinct()
    return SuffixRules(spark.createDataFrame(FIXED, "rule string, private boolean").union(found.withColumn("private", F.lit(True))))


#: rules, and the registrable domain of each host in a relation hosts(host).
APEX_SQL = rf"""
    rules AS (
        SELECT DISTINCT rule FROM (
            SELECT unnest(['com', 'net', 'org', 'example.com', '*.example.net']) AS rule
            UNION ALL SELECT '!' || regexp_extract({host("url")}, '([^.]+\.example\.net)$', 1) FROM pages WHERE page_id % 3 = 0 AND regexp_matches({host("url")}, '[^.]\.example\.net$')
            UNION ALL SELECT regexp_extract({host("url")}, '([^.]+\.example\.org)$', 1) FROM pages WHERE page_id % 5 = 0 AND regexp_matches({host("url")}, '[^.]\.example\.org$')
        )
    ), labels AS (
        SELECT host, string_split(host, '.') AS l FROM (SELECT DISTINCT host FROM hosts)
    ), suffixes AS (
        SELECT host, l, k, array_to_string(l[len(l) - k + 1:len(l)], '.') AS s FROM (SELECT host, l, unnest(range(1, len(l) + 1)) AS k FROM labels)
    ), hits AS (
        SELECT host, rule LIKE '!%' AS exception, CASE WHEN rule LIKE '!%' THEN k - 1 WHEN rule LIKE '*.%' THEN k + 1 ELSE k END AS n
        FROM suffixes JOIN rules ON s = regexp_replace(rule, '^(!|\*\.)', '') WHERE NOT (rule LIKE '*.%' AND k = len(l))
    ), best AS (
        SELECT host, coalesce(max(CASE WHEN exception THEN n END), max(n)) AS n FROM hits GROUP BY 1
    ), apexes AS (
        SELECT host, CASE WHEN n IS NULL OR len(l) <= n THEN host ELSE array_to_string(l[len(l) - n:len(l)], '.') END AS apex FROM labels LEFT JOIN best USING (host)
    )"""


@query(f"""
    WITH hosts AS (
        SELECT page_id, {host("url")} AS host FROM pages UNION ALL SELECT page_id, 'a.b.' || {host("url")} FROM pages UNION ALL SELECT page_id, 'unlisted' || page_id || '.tenant.test' FROM pages
    ), {APEX_SQL}
    SELECT page_id, host, apex FROM hosts JOIN apexes USING (host)
""")
def registrable_domains(spark, sf_dir):
    """Hosts of pages, hosts below them, and hosts whose top-level name no rule lists."""
    hosts = p.read(spark, sf_dir, "pages").select("page_id", urls.hostname("url").alias("h"))
    unlisted = F.concat(F.lit("unlisted"), "page_id", F.lit(".tenant.test"))
    every = hosts.select("page_id", F.explode(F.array("h", F.concat(F.lit("a.b."), "h"), unlisted)).alias("host"))
    return page_rules(spark, sf_dir).with_apexes(every, apex="host")


@query(f"""
    WITH {SIGNALS_SQL}, hosts AS (
        SELECT DISTINCT signal_value AS host FROM signals WHERE signal_type = 'final_domain' UNION SELECT final_domain FROM signals
    ), {APEX_SQL}, landing AS (
        SELECT DISTINCT apex FROM signals JOIN apexes ON host = signal_value WHERE signal_type = 'final_domain'
    ), calls AS (
        SELECT signal_value AS endpoint, final_domain, source_db, case_id, apex FROM signals JOIN apexes ON host = final_domain WHERE signal_type = 'har_endpoint' AND signal_value IN (SELECT apex FROM landing)
    )
    SELECT endpoint, count(DISTINCT CASE WHEN apex <> endpoint THEN final_domain END) AS caller_count, count(DISTINCT (source_db, case_id)) AS case_count,
        string_agg(DISTINCT CASE WHEN apex <> endpoint THEN final_domain END, ', ' ORDER BY CASE WHEN apex <> endpoint THEN final_domain END) AS called_by
    FROM calls GROUP BY 1 HAVING count(DISTINCT CASE WHEN apex <> endpoint THEN final_domain END) > 0
""")
def operator_cross_links_by_suffix(spark, sf_dir):
    """Tenants of one provider are landings of their own, so that its name links nobody."""
    found = index.operator_cross_links(p.signals(spark, sf_dir), page_rules(spark, sf_dir))
    return found.withColumn("called_by", text("called_by")).drop("investigated_as_landing_in")


def _tenant(d):
    return F.concat(F.lit("t"), d % 4, F.lit(".host"), d % 3, F.lit(".example"))


@query(f"""
    WITH {ADS_SQL}, tenants AS (
        SELECT *, CASE WHEN d % 3 = 0 THEN 't' || d % 4 || '.host0.example' ELSE 'host' || d % 3 || '.example' END AS apex FROM direct
    )
    SELECT adsystem, seller_id, count(DISTINCT apex) AS global_apex_count FROM tenants WHERE d % 10 <> 9 GROUP BY 1, 2
""")
def account_footprint_by_suffix(spark, sf_dir):
    """Files of tenants of three providers, of which the rules know one."""
    rules = SuffixRules(spark.createDataFrame([("example", False), ("host0.example", True)], "rule string, private boolean"))
    rows = p.ads_rows(spark, sf_dir).withColumn("domain", _tenant(F.col("ua_id")))
    return ads.account_footprint(ads.direct_accounts(rules.with_apexes(rows, apex="domain")))


@query(f"""
    WITH hosts AS (SELECT {host("url")} AS host FROM pages), {APEX_SQL}, scanned AS (
        SELECT DISTINCT apex FROM pages JOIN apexes ON host = {host("url")} WHERE page_id % 4 = 0
    )
    SELECT page_id, {host("url")} AS domain FROM pages JOIN apexes ON host = {host("url")} WHERE apex NOT IN (SELECT apex FROM scanned)
""")
def without_scanned_by_suffix(spark, sf_dir):
    rules = page_rules(spark, sf_dir)
    hosts = p.read(spark, sf_dir, "pages").select("page_id", urls.hostname("url").alias("domain"))
    scanned = rules.with_apexes(hosts.where("page_id % 4 = 0"), apex="domain").select("apex")
    return discovery.without_scanned(hosts, scanned, rules)

