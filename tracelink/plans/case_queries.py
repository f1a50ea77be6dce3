"""Registered queries of case operators that read richer projections of the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink import config
from tracelink.functions import der, parsing
from tracelink.operators import ads, discovery, groups, headers, index, infra, insights, integrity, pins
from tracelink.plans import projections as p
from tracelink.plans.driver_queries import OPSEC_SQL, SCREEN_SQL, TRACKED_SQL, _apex_sql, query, text
from tracelink.plans.projections import ADS_SQL, HEADERS_SQL, PAGES_SQL, SIGNALS_SQL, host
from tracelink.plans.store_queries import SHOTS_SQL, snapshots
from tracelink.schema import CaseTables, conform

UNIVERSAL = ", ".join(f"'{x}'" for x in config.UNIVERSAL_TOKENS)


def _counts(**tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in tables.items()])


@query(f"""
    WITH {PAGES_SQL}, per AS (
        SELECT ua_id, max_by(status, scan_run_id) = 'done' AS done, count(CASE WHEN NOT (scan_run_id % 2 = 0 AND scan_run_id % 7 <> 0) THEN 1 END) AS pending FROM scans GROUP BY 1
    )
    SELECT u.case_id, count(*) AS url_count, count(CASE WHEN done THEN 1 END) AS scanned, count(CASE WHEN NOT done THEN 1 END) AS unscanned, CAST(sum(pending) AS BIGINT) AS pending FROM urls u JOIN per USING (ua_id) GROUP BY 1
""")
def case_show(spark, sf_dir):
    return pins.case_show(p.case_tables(spark, sf_dir))


@query("SELECT CAST(1 AS BIGINT) AS id, 'case 1' AS title")
def require_case(spark, sf_dir):
    return pins.require_case(p.case_tables(spark, sf_dir), 1).select("id", "title")


@query("""
    WITH left_ AS (SELECT * FROM pages WHERE page_id % 4 <> 1)
    SELECT 'cases' AS name, count(DISTINCT page_id % 4) AS n FROM left_ UNION ALL SELECT 'message_evidence', count(*) FROM left_ UNION ALL SELECT 'url_artifacts', count(*) FROM left_
    UNION ALL SELECT 'scan_runs', 3 * count(*) FROM left_ UNION ALL SELECT 'snapshots', 3 * count(*) FROM left_ UNION ALL SELECT 'acquisitions', (SELECT count(*) FROM pages) UNION ALL SELECT 'attached', count(*) FROM left_
""")
def delete_case(spark, sf_dir):
    t = p.case_tables(spark, sf_dir)
    t.acquisitions = conform(spark, p.read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") * 10).alias("scan_run_id")), "acquisitions")
    left = pins.delete_case(t, 1)
    names = ["cases", "message_evidence", "url_artifacts", "scan_runs", "snapshots", "acquisitions"]
    return _counts(**{n: getattr(left, n) for n in names}, attached=left.acquisitions.where("scan_run_id IS NOT NULL"))


@query("""
    SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'xx-XX' WHEN n_regionkey < 3 THEN 'l' || n_regionkey END AS browser_locale, CASE WHEN n_regionkey < 3 THEN 'Zone/' || n_regionkey END AS browser_timezone FROM nation
""")
def with_locale(spark, sf_dir):
    nation, region = p.read(spark, sf_dir, "nation"), p.read(spark, sf_dir, "region")
    cases = nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("preset"), F.when(F.col("n_nationkey") % 3 == 0, "xx-XX").alias("browser_locale"), F.lit(None).cast("string").alias("browser_timezone"))
    presets = region.where("r_regionkey < 3").select(F.col("r_regionkey").alias("preset"), F.concat(F.lit("l"), "r_regionkey").alias("locale"), F.concat(F.lit("Zone/"), "r_regionkey").alias("timezone"))
    return pins.with_locale(cases, presets)


@query(f"""
    WITH {HEADERS_SQL}, {OPSEC_SQL}, each AS (
        SELECT CAST(0 AS BIGINT) AS case_id, 'header_templates' AS operator, count(*) AS n FROM (SELECT header, value FROM header_rows WHERE header IN ('server', 'x-powered-by') AND value <> '' GROUP BY 1, 2 HAVING count(DISTINCT domain) >= 2)
        UNION ALL SELECT case_id, 'opsec_' || level, count(*) FROM levels GROUP BY 1, 2
    )
    SELECT * FROM each WHERE n > 0
""")
def signal_summary(spark, sf_dir):
    profile = insights.opsec_profile(p.capture_rows(spark, sf_dir))
    levels = {f"opsec_{x}": profile.where(F.col("level") == x) for x in ("strong", "medium", "low", "indeterminate")}
    return insights.signal_summary(header_templates=headers.shared_header_templates(p.header_rows(spark, sf_dir)), **levels)


@query("""
    WITH c AS (
        SELECT o_orderkey AS case_id, o_orderkey % 3 AS g, o_custkey % 2 AS b, o_orderkey // 7 % 2 AS m FROM orders
    ), v AS (
        SELECT *, CASE WHEN g > 0 AND (b > 0 OR m > 0) THEN 'coordinated' WHEN g > 0 THEN 'linked' WHEN b > 0 THEN 'suspicious' WHEN m > 0 THEN 'monetised' ELSE 'no_signal' END AS verdict FROM c
    )
    SELECT case_id, verdict, concat_ws('; ', verdict, CASE WHEN g > 0 THEN 'grouping: ' || g END, CASE WHEN b > 0 THEN 'behaviour: ' || b END, CASE WHEN m > 0 THEN 'money: ' || m END) AS text FROM v
""")
def verdicts(spark, sf_dir):
    key = F.col("o_orderkey")
    coverage = p.read(spark, sf_dir, "orders").select(key.alias("case_id"), (key % 3).alias("grouping"), (F.col("o_custkey") % 2).alias("behaviour"), (F.floor(key / 7) % 2).alias("money"))
    return insights.verdicts(coverage).select("case_id", "verdict", "text")


@query("""
    WITH b AS (
        SELECT o_custkey % 400 AS case_id, 0 AS s, 'orders' AS source, o_orderkey AS rank, 'order ' || o_orderkey AS bullet FROM orders
        UNION ALL SELECT l_suppkey % 400, 1, 'parts', l_partkey, 'part ' || l_partkey || '/' || l_linenumber FROM lineitem
    ), k AS (
        SELECT *, row_number() OVER (PARTITION BY case_id, s ORDER BY rank DESC, bullet) AS k FROM b
    ), n AS (
        SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY s, k) AS place FROM k WHERE k <= 3
    )
    SELECT case_id, place, source, bullet FROM n WHERE place <= 5
""")
def insight_bullets(spark, sf_dir):
    orders = p.read(spark, sf_dir, "orders").withColumn("case_id", F.col("o_custkey") % 400)
    lines = p.read(spark, sf_dir, "lineitem").withColumn("case_id", F.col("l_suppkey") % 400)
    return insights.insight_bullets(5, 3, orders=(orders, "o_orderkey", "'order ' || o_orderkey"), parts=(lines, "l_partkey", "'part ' || l_partkey || '/' || l_linenumber"))


@query("SELECT CASE WHEN page_id % 5 = 0 THEN 'error' ELSE 'ok' END AS capture_status, count(*) AS n, count(CASE WHEN page_id % 4 = 0 THEN 1 END) AS ip_hits FROM pages GROUP BY 1")
def capture_report(spark, sf_dir):
    return insights.capture_report(snapshots(spark, sf_dir))


@query(f"""
    WITH {SHOTS_SQL}, paths AS (
        SELECT case_id, host, dir, page_id, unnest(['shot', 'page']) AS file FROM shots
    )
    SELECT s.case_id, s.host AS domain, count(*) AS captures, count(*) AS screenshots, string_agg(DISTINCT method, ', ' ORDER BY method) AS methods, string_agg(DISTINCT dir, ', ' ORDER BY dir) AS dirs,
        (SELECT count(*) FROM paths x WHERE x.case_id = s.case_id AND x.host = s.host AND NOT (x.file = 'shot' AND x.page_id // 2 % 3 = 0)) AS missing
    FROM shots s GROUP BY 1, 2
""")
def evidence_by_domain(spark, sf_dir):
    t, shots = p.case_tables(spark, sf_dir), snapshots(spark, sf_dir)
    t.snapshots = conform(spark, shots, "snapshots")
    files = shots.where(F.floor(F.col("id") / 2) % 3 == 0).select(F.col("screenshot_path").alias("path"))
    found = insights.evidence_by_domain(t, files)
    return found.select("case_id", "domain", "captures", "screenshots", F.nullif(text("methods"), F.lit("")).alias("methods"), text("dirs").alias("dirs"), "missing")


WIDE_SQL = """
    direct AS (
        SELECT DISTINCT l_suppkey % 40 AS d, 'd' || l_suppkey % 40 || '.example' AS domain, CASE WHEN l_partkey % 7 = 0 THEN 'openx.com' ELSE 'ads.example' END AS adsystem, l_partkey AS seller FROM lineitem WHERE l_returnflag = 'R'
    ), files AS (
        SELECT DISTINCT 'd' || l_suppkey % 40 AS domain FROM lineitem WHERE l_suppkey % 10 <> 9
    )"""


@query(f"""
    WITH {WIDE_SQL}, per AS (
        SELECT adsystem, seller, count(DISTINCT domain) AS domain_count, bool_and(d % 4 = 0 AND d % 10 <> 9) AS managed, count(DISTINCT CASE WHEN d % 10 <> 9 THEN domain END) AS apexes FROM direct GROUP BY 1, 2 HAVING count(DISTINCT domain) >= 2
    ), sizes AS (SELECT domain, count(*) AS n FROM direct GROUP BY 1), linked AS (
        SELECT a.domain AS d1, b.domain AS d2 FROM direct a JOIN direct b ON a.seller = b.seller AND a.domain < b.domain JOIN sizes s ON s.domain = a.domain JOIN sizes t ON t.domain = b.domain GROUP BY 1, 2, s.n, t.n HAVING count(*) >= 8 AND count(*) >= 0.4 * least(s.n, t.n)
    ), pairs AS (
        SELECT a.seller, count(*) AS linked FROM direct a JOIN direct b ON a.seller = b.seller AND a.domain < b.domain JOIN linked l ON l.d1 = a.domain AND l.d2 = b.domain GROUP BY 1
    )
    SELECT adsystem, CAST(seller AS VARCHAR) AS seller_id, domain_count, apexes AS global_apex_count, managed AS all_carriers_managed, CASE WHEN seller % 5 = 0 THEN (seller % 20) / 1000 END AS reference_prevalence,
        CASE WHEN managed OR adsystem = 'openx.com' OR (seller % 5 = 0 AND seller % 20 >= 5) OR domain_count / (SELECT count(*) FROM files) >= 0.8 OR coalesce(linked, 0) / (domain_count * (domain_count - 1) / 2) >= 0.6 OR apexes >= 10 THEN 'manager' WHEN apexes <= 4 THEN 'operator' ELSE 'uncertain' END AS tier
    FROM per LEFT JOIN pairs USING (seller)
""")
def shared_ad_accounts_by_prevalence(spark, sf_dir):
    """Accounts of parts, some of an exchange and some in a prevalence table."""
    d, part = F.col("l_suppkey") % 40, F.col("l_partkey")
    adsystem = F.when(part % 7 == 0, "openx.com").otherwise("ads.example")
    record = F.struct(adsystem.alias("adsystem"), part.cast("string").alias("seller_id"), F.when(F.col("l_returnflag") == "R", "DIRECT").otherwise("RESELLER").alias("relationship"), F.lit(None).cast("string").alias("cert_authority_id"))
    lines = p.read(spark, sf_dir, "lineitem")
    # a file's records come in rows of a thousand parts each
    each = lines.select(d.alias("ua_id"), F.floor(part / 1000).alias("piece"), record.alias("record")).distinct()
    rows = p.ads_rows(spark, sf_dir).drop("records").join(each.groupBy("ua_id", "piece").agg(F.collect_list("record").alias("records")).drop("piece"), "ua_id")
    prevalence = lines.where(part % 5 == 0).select(adsystem.alias("adsystem"), part.cast("string").alias("seller_id"), (part % 20).alias("hits"), F.lit(1000).cast("long").alias("site_count")).distinct()
    return ads.shared_ad_accounts(rows, prevalence).select("adsystem", "seller_id", "domain_count", "global_apex_count", "all_carriers_managed", "reference_prevalence", "tier")


@query(f"WITH {ADS_SQL} SELECT sha, string_agg(DISTINCT domain, ', ' ORDER BY domain) AS matched_domains FROM files WHERE status = 'ok' GROUP BY 1")
def known_templates(spark, sf_dir):
    return discovery.known_templates(p.ads_rows(spark, sf_dir)).withColumn("matched_domains", text("matched_domains"))


@query(f"WITH {ADS_SQL} SELECT domain, adsystem, seller_id FROM direct")
def direct_pairs(spark, sf_dir):
    each = p.ads_rows(spark, sf_dir).select("domain", F.explode(discovery.direct_pairs(F.col("records"))).alias("pair"))
    return each.select("domain", F.col("pair")[0].alias("adsystem"), F.col("pair")[1].alias("seller_id"))


@query(f"""
    WITH {SCREEN_SQL} SELECT domain, verdict FROM screened UNION ALL SELECT 'unknown' || doc_id, 'unreachable' FROM documents WHERE doc_id % 9 = 0
""")
def screen_domains(spark, sf_dir):
    """Every domain twice in the list, and some that nobody reached."""
    docs = p.read(spark, sf_dir, "documents")
    known = docs.where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("sha")).distinct().withColumn("matched_domains", F.array(F.lit("x")))
    listed = docs.select(F.concat(F.lit("s"), "doc_id", F.lit(".example")).alias("domain"), F.col("doc_id").alias("pos"))
    more = docs.where("doc_id % 9 = 0").select(F.concat(F.lit("unknown"), "doc_id").alias("domain"), F.col("doc_id").alias("pos"))
    return discovery.screen_domains(listed.union(listed).union(more), p.observations(spark, sf_dir), known).select("domain", "verdict")


SHARED_SQL = f"""
    {PAGES_SQL}, {TRACKED_SQL}, shared AS (
        SELECT case_id, platform, tracking_id, min(domain) AS first FROM tracked WHERE platform <> 'Google Tag Manager' GROUP BY 1, 2, 3 HAVING count(DISTINCT domain) >= 2
    ), member AS (
        SELECT DISTINCT t.case_id, t.platform || '|' || t.tracking_id AS s, t.domain FROM tracked t JOIN shared USING (case_id, platform, tracking_id)
    ), edges AS (
        SELECT DISTINCT a.case_id, a.domain AS x, b.domain AS y FROM member a JOIN member b ON a.case_id = b.case_id AND a.s = b.s
    ), reach(case_id, x, y) AS (
        SELECT case_id, x, y FROM edges UNION SELECT r.case_id, r.x, e.y FROM reach r JOIN edges e ON e.case_id = r.case_id AND e.x = r.y
    ), part AS (
        SELECT case_id, x AS domain, min(y) AS label, count(*) AS group_size FROM reach GROUP BY 1, 2
    ), members AS (
        SELECT *, dense_rank() OVER (PARTITION BY case_id ORDER BY group_size DESC, label) AS gid FROM part
    )"""


def _bound(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tracking ids, hard signals, members) of the pages."""
    tracking = infra.shared_tracking_ids(p.case_tables(spark, sf_dir))
    none = spark.createDataFrame([], "case_id long, issuer string, serial string, domains array<string>")
    signals = groups.hard_signals(tracking, none, spark.createDataFrame([], "case_id long, sha256 string, domains array<string>, verification string"))
    return tracking, signals, groups.memberships(signals)


NO_FAKES = "case_id long, domain string, header string, value string, reason string"


@query(f"""
    WITH RECURSIVE {SHARED_SQL}, per AS (
        SELECT case_id, gid, min(label) AS label, string_agg(domain, ', ' ORDER BY domain) AS domains, count(*) AS domain_count FROM members GROUP BY 1, 2
    ), bound AS (
        SELECT m.case_id, m.gid, count(*) AS signal_count, string_agg(s.platform || ' ' || s.tracking_id, ', ' ORDER BY s.platform, s.tracking_id) AS signals FROM shared s JOIN members m ON m.case_id = s.case_id AND m.domain = s.first GROUP BY 1, 2
    )
    SELECT per.*, signal_count, signals, 'html' AS channels FROM per JOIN bound USING (case_id, gid)
""")
def operator_group_rows(spark, sf_dir):
    _, signals, members = _bound(spark, sf_dir)
    found = groups.groups(signals, members, spark.createDataFrame([], NO_FAKES))
    named = F.array_join(F.transform("signals", lambda s: F.concat_ws(" ", s["signal"], s["value"])), ", ")
    return found.select("case_id", "gid", "label", text("domains").alias("domains"), "domain_count", "signal_count", named.alias("signals"), text("channels").alias("channels"))


def _id_sql(value: str) -> str:
    return f"'n' || sha256('tracking_id|' || {value})[1:12]"


@query(f"""
    WITH {PAGES_SQL}, {TRACKED_SQL}, shared AS (
        SELECT case_id, platform, tracking_id FROM tracked WHERE platform <> 'Google Tag Manager' GROUP BY 1, 2, 3 HAVING count(DISTINCT domain) >= 2
    ), cases AS (SELECT DISTINCT case_id FROM shared)
    SELECT case_id, 0 AS place, 'graph operators {{' AS line FROM cases UNION ALL SELECT case_id, 3, '}}' FROM cases
    UNION ALL SELECT case_id, 1, '  ' || {_id_sql("tracking_id")} || ' [label="tracking_id: ' || CASE WHEN length(tracking_id) > 12 THEN tracking_id[1:12] || '…' ELSE tracking_id END || '"];' FROM shared
    UNION ALL SELECT DISTINCT case_id, 2, '  "' || domain || '" -- ' || {_id_sql("tracking_id")} || ';' FROM tracked JOIN shared USING (case_id, platform, tracking_id)
""")
def group_graph(spark, sf_dir):
    _, signals, members = _bound(spark, sf_dir)
    return groups.dot_lines(groups.groups(signals, members, spark.createDataFrame([], NO_FAKES)))


@query(f"""
    WITH {HEADERS_SQL}, t AS (
        SELECT case_id, header, value, count(DISTINCT domain) AS domain_count, count(DISTINCT domain) / 40 AS breadth_ratio, count(DISTINCT CASE WHEN CAST(domain[2:] AS INT) < 20 THEN CAST(domain[2:] AS INT) % 3 END) > 1 AS spans_groups
        FROM header_rows WHERE header IN ('server', 'x-powered-by') AND value <> '' GROUP BY 1, 2, 3 HAVING count(DISTINCT domain) >= 2
    )
    SELECT * FROM t WHERE breadth_ratio < 0.8 AND lower(value) NOT IN ({UNIVERSAL})
""")
def weak_headers(spark, sf_dir):
    rows = p.header_rows(spark, sf_dir)
    number = F.substring("domain", 2, 9).cast("int")
    members = rows.select("case_id", "domain").distinct().where(number < 20).withColumn("gid", number % 3)
    counts = spark.createDataFrame([(0, 40)], "case_id long, domain_count long")
    return groups.weak_headers(headers.shared_header_templates(rows), counts, members).select("case_id", "header", "value", "domain_count", "breadth_ratio", "spans_groups")


STATES = list(groups.REASONS)


@query(f"""
    WITH t AS (SELECT sha256(text) AS sha256, {STATES!r}[doc_id % 8] AS verification FROM documents)
    SELECT *, CASE verification {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in groups.REASONS.items())} END AS reason FROM t WHERE verification IS NOT NULL
""")
def unverified_templates(spark, sf_dir):
    state = F.get(F.array(F.lit("verified"), *map(F.lit, STATES)), (F.col("doc_id") % 8).cast("int"))
    return groups.unverified_templates(p.read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), state.alias("verification")))


@query(f"""
    WITH RECURSIVE {SHARED_SQL}
    SELECT 'groups' AS name, count(DISTINCT (case_id, gid)) AS n FROM members UNION ALL SELECT 'members', count(*) FROM members
    UNION ALL SELECT 'weak_containers', count(*) FROM (SELECT case_id, tracking_id FROM tracked WHERE platform = 'Google Tag Manager' GROUP BY 1, 2 HAVING count(DISTINCT domain) >= 2)
    UNION ALL SELECT 'unverified_templates', 1 UNION ALL SELECT 'weak_headers', 0 UNION ALL SELECT 'completeness', (SELECT count(DISTINCT page_id % 4) FROM pages)
""")
def case_clusters(spark, sf_dir):
    """How many rows each table of the answer has."""
    tracking, _, _ = _bound(spark, sf_dir)
    certs = spark.createDataFrame([], "case_id long, issuer string, serial string, domains array<string>")
    files = spark.createDataFrame([(0, "s", ["a", "b"], "truncated")], "case_id long, sha256 string, domains array<string>, verification string")
    templates = spark.createDataFrame([], "case_id long, header string, value string, domain_count long, domains array<string>")
    counts = spark.createDataFrame([], "case_id long, domain_count long")
    found = groups.case_clusters(tracking, certs, files, spark.createDataFrame([], NO_FAKES), templates, counts, insights.completeness(p.case_tables(spark, sf_dir)))
    return _counts(**found)


def _full_tables(spark: SparkSession, sf_dir: str) -> tuple[CaseTables, DataFrame]:
    """The case tables with registrars, certificates, ads.txt files, response headers and retained bytes, and the hashes of these bytes.

    Neighbouring pages of a case share certificates and files. Bytes of even pages are retained, those of every seventh in part.
    """
    t, i = p.case_tables(spark, sf_dir), F.col("url_artifact_id")
    sha = F.sha2(F.concat(F.lit("file "), F.floor(i / 24)), 256)
    manager = F.when(i % 4 == 0, F.concat(F.lit('"manager_domain":"M'), i % 3, F.lit('.example ",'))).otherwise("")
    records = F.concat(F.lit('"records":[{"adsystem":"ads.example","seller_id":" '), i % 23, F.lit(' ","relationship":"DIRECT"},{"adsystem":"openx.com","seller_id":"7","relationship":"DIRECT"},{"adsystem":"ads.example","seller_id":"r","relationship":"RESELLER"}]}'))
    acquired = F.when(i % 2 == 0, F.concat(F.lit('"acquisition_id":'), "id", F.lit(","))).otherwise("")
    document = F.concat(F.lit('{"status":"'), F.when(i % 10 == 9, "error").otherwise("ok"), F.lit('","raw_sha256":"'), sha, F.lit('",'), acquired, F.lit('"owner_domain":"o'), i % 6, F.lit('.example",'), manager, records)
    tls = F.concat(F.lit('{"serialNumber":" S'), F.floor(i / 8), F.lit('","notBefore":"Apr  7 00:00:00 2026 GMT","issuer":{"organizationName":"Org '), i % 4, F.lit('"}}'))
    t.scan_runs = t.scan_runs.withColumns({
        "whois_registrar": F.when(i % 7 != 0, F.concat(F.lit(" Registrar "), i % 5, F.lit(" "))), "ads_txt_json": F.when(i % 3 != 0, document),
        "tls_info_json": F.when(i % 3 != 1, tls), "run_at": F.concat(F.lit("2026-01-0"), 1 + i % 9, F.lit(" 00:00:00 UTC")),
    })
    pairs = F.concat(F.lit('[["Server","nginx"],["X-Powered-By","ab"],["X-Frame-Options","SAMEORIGIN-ALWAYS"],["Via","1.1 proxy/'), i % 7, F.lit('"],["X-Origin"," origin/'), i % 7, F.lit('"]]'))
    t.redirect_hops = conform(spark, t.scan_runs.select("id", F.col("id").alias("scan_run_id"), F.col("final_url").alias("url"), pairs.alias("response_headers_json")), "redirect_hops")
    kept = t.scan_runs.where(i % 2 == 0).select("id", F.lit("ads_txt").alias("kind"), F.col("id").alias("scan_run_id"), F.concat(F.lit("b/"), F.floor(i / 24)).alias("body_path"), (i % 7 == 0).alias("truncated"), sha.alias("captured_sha256"), sha.alias("complete_sha256"))
    t.acquisitions = conform(spark, kept, "acquisitions")
    n = F.floor(F.col("page_id") / 24)
    bodies = p.read(spark, sf_dir, "pages").select(F.concat(F.lit("b/"), n).alias("body_path"), F.sha2(F.concat(F.lit("file "), n), 256).alias("body_sha256")).distinct()
    return t, bodies


#: base: own scans; files, cert_rows: of the scans in a pin; i is the artifact that the scan belongs to.
FULL_SQL = f"""
    base AS (
        SELECT u.case_id, u.ua_id, d.scan_run_id, {host("s.final_url")} AS final_domain, i.host AS page_host FROM urls u JOIN own_done d ON d.ua_id = u.ua_id JOIN scans s ON s.scan_run_id = d.scan_run_id JOIN ids i ON i.page_id = u.ua_id
    ), landed AS (
        SELECT u.case_id, u.ua_id, d.scan_run_id, d.scan_run_id // 10 AS i, {host("s.final_url")} AS domain FROM urls u JOIN url_done d ON d.ua_id = u.ua_id JOIN scans s ON s.scan_run_id = d.scan_run_id
    ), cert_rows AS (
        SELECT case_id, 'Org ' || i % 4 AS issuer, 'S' || i // 8 AS serial, domain FROM landed WHERE i % 3 <> 1
    ), template_rows AS (
        SELECT case_id, sha256('file ' || i // 24) AS sha, domain, coalesce(max_by(CASE WHEN i % 7 = 0 THEN 'truncated' ELSE 'verified' END, ua_id) FILTER (WHERE i % 2 = 0), 'legacy_unverifiable') AS state FROM landed WHERE i % 3 <> 0 AND i % 10 <> 9 GROUP BY 1, 2, 3
    )"""


@query(f"""
    WITH {PAGES_SQL}, {FULL_SQL}, calls AS (
        SELECT *, unnest(['cdn.' || final_domain, '203.0.113.' || ua_id % 20]) AS endpoint FROM base WHERE scan_run_id % 7 <> 0
    ), files AS (
        SELECT *, CASE WHEN ua_id % 10 = 9 THEN 'error' ELSE 'ok' END AS status FROM base WHERE ua_id % 3 <> 0
    ), managed_ AS (
        SELECT DISTINCT case_id, final_domain FROM files WHERE status = 'ok' AND ua_id % 4 = 0
    ), carriers AS (
        SELECT case_id, ua_id % 23 AS seller, count(DISTINCT final_domain) AS domains, count(DISTINCT CASE WHEN (case_id, final_domain) IN (SELECT (case_id, final_domain) FROM managed_) THEN final_domain END) AS managed FROM files GROUP BY 1, 2
    ), good AS (
        SELECT case_id, count(DISTINCT final_domain) AS n FROM files WHERE status = 'ok' GROUP BY 1
    ), apexes AS (
        SELECT ua_id % 23 AS seller, count(DISTINCT {_apex_sql("final_domain")}) AS apexes FROM files WHERE status = 'ok' GROUP BY 1
    ), demoted AS (
        SELECT c.case_id, seller FROM carriers c LEFT JOIN good USING (case_id) LEFT JOIN apexes USING (seller) WHERE domains >= 2 AND managed = domains OR domains / greatest(coalesce(n, 0), 1) >= 0.8 OR domains >= 2 AND apexes > 4 OR apexes >= 10
    ), constants AS (
        SELECT u.case_id, {host("s.final_url")} AS domain, 'origin/' || min(s.ua_id % 7) AS value FROM urls u JOIN scans s ON s.ua_id = u.ua_id WHERE s.status = 'done' GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT s.ua_id % 7) = 1
    ), firsts AS (
        SELECT case_id, final_domain AS domain, min_by(scan_run_id, ua_id) AS scan_run_id FROM base GROUP BY 1, 2
    ), found_ AS (
        SELECT scan_run_id, 'final_domain' AS signal_type, final_domain AS signal_value, NULL AS platform, final_domain FROM base
        UNION ALL SELECT scan_run_id, 'registrar', 'Registrar ' || ua_id % 5, NULL, final_domain FROM base WHERE ua_id % 7 <> 0
        UNION ALL SELECT scan_run_id, 'asn', 'AS' || ua_id % 9, 'org' || ua_id % 9, final_domain FROM base
        UNION ALL SELECT scan_run_id, 'cert_serial', 'S' || ua_id // 8, 'Org ' || ua_id % 4, final_domain FROM base WHERE ua_id % 3 <> 1
        UNION ALL SELECT b.scan_run_id, CASE f.platform WHEN 'Google Tag Manager' THEN 'gtm_container' ELSE 'tracking_id' END, f.tracking_id, f.platform, page_host FROM base b JOIN found f ON f.page_id = b.ua_id WHERE b.scan_run_id % 7 <> 0
        UNION ALL SELECT scan_run_id, 'header_value', value, 'x-origin', domain FROM constants JOIN firsts USING (case_id, domain)
        UNION ALL SELECT DISTINCT scan_run_id, 'har_endpoint', CASE WHEN endpoint LIKE '203.%' THEN endpoint ELSE {_apex_sql("endpoint")} END, NULL, page_host FROM calls
            WHERE CASE WHEN endpoint LIKE '203.%' THEN endpoint ELSE {_apex_sql("endpoint")} END <> {_apex_sql("page_host")}
        UNION ALL SELECT scan_run_id, 'ads_txt_template', sha256('file ' || ua_id // 24), NULL, final_domain FROM files WHERE status = 'ok' AND ua_id % 2 = 0 AND ua_id % 7 <> 0
        UNION ALL SELECT scan_run_id, 'ads_txt_owner', 'o' || ua_id % 6 || '.example', NULL, final_domain FROM files WHERE status = 'ok'
        UNION ALL SELECT scan_run_id, 'ads_txt_manager', 'm' || ua_id % 3 || '.example', NULL, final_domain FROM files WHERE status = 'ok' AND ua_id % 4 = 0
        UNION ALL SELECT scan_run_id, 'ads_txt_seller', CAST(ua_id % 23 AS VARCHAR), 'ads.example', final_domain FROM files WHERE (case_id, ua_id % 23) NOT IN (SELECT (case_id, seller) FROM demoted)
    )
    SELECT signal_type, signal_value, platform, 'main.db' AS source_db, b.case_id, 'case ' || b.case_id AS case_title, f.scan_run_id, f.final_domain, '2026-01-0' || (1 + b.ua_id % 9) || ' 00:00:00 UTC' AS observed_at, 't' AS indexed_at
    FROM found_ f JOIN base b USING (scan_run_id)
""")
def extract_signals(spark, sf_dir):
    t, bodies = _full_tables(spark, sf_dir)
    return index.extract_signals(t, "main.db", "t", bodies=bodies)


BOUND_SQL = f"""
    {PAGES_SQL}, {TRACKED_SQL}, {FULL_SQL}, hard AS (
        SELECT case_id, 'tracking_id' AS type, platform AS label, tracking_id AS value, domain FROM tracked WHERE platform <> 'Google Tag Manager'
        UNION SELECT case_id, 'certificate', issuer, serial, domain FROM cert_rows
        UNION SELECT case_id, 'ads_txt_template', 'ads.txt', sha, domain FROM template_rows WHERE (case_id, sha) NOT IN (SELECT (case_id, sha) FROM template_rows WHERE state <> 'verified')
    ), shared AS (
        SELECT case_id, type, label, value, min(domain) AS first FROM hard GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT domain) >= 2
    ), star AS (
        SELECT DISTINCT case_id, first AS x, domain AS y FROM hard JOIN shared USING (case_id, type, label, value)
    ), edges AS (
        SELECT * FROM star UNION SELECT case_id, y, x FROM star
    ), reach(case_id, x, y) AS (
        SELECT case_id, x, x FROM edges UNION SELECT r.case_id, r.x, e.y FROM reach r JOIN edges e ON e.case_id = r.case_id AND e.x = r.y
    ), part AS (
        SELECT case_id, x AS domain, min(y) AS label, count(*) AS group_size FROM reach GROUP BY 1, 2
    ), members AS (
        SELECT *, dense_rank() OVER (PARTITION BY case_id ORDER BY group_size DESC, label) AS gid FROM part
    )"""


def _all_bound(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(hard signals, members) of tracking ids, certificates and verified files."""
    t, bodies = _full_tables(spark, sf_dir)
    templates = ads.shared_templates(ads.domain_states(ads.acquisition_states(ads.ads_rows(t), t.acquisitions, bodies)))
    signals = groups.hard_signals(infra.shared_tracking_ids(t), infra.shared_certificates(infra.certificates(t)), templates)
    return signals, groups.memberships(signals)


@query(f"""
    WITH RECURSIVE {BOUND_SQL}, per AS (
        SELECT case_id, gid, min(label) AS label, string_agg(domain, ', ' ORDER BY domain) AS domains, count(*) AS domain_count FROM members GROUP BY 1, 2
    ), bound AS (
        SELECT m.case_id, m.gid, count(*) AS signal_count, string_agg(s.type || ' ' || s.label || ' ' || s.value, ', ' ORDER BY s.type, s.label, s.value) AS signals,
            string_agg(DISTINCT CASE s.type WHEN 'tracking_id' THEN 'html' WHEN 'certificate' THEN 'tls' ELSE 'ads_txt' END, ', ' ORDER BY CASE s.type WHEN 'tracking_id' THEN 'html' WHEN 'certificate' THEN 'tls' ELSE 'ads_txt' END) AS channels
        FROM shared s JOIN members m ON m.case_id = s.case_id AND m.domain = s.first GROUP BY 1, 2
    )
    SELECT per.*, signal_count, signals, channels FROM per JOIN bound USING (case_id, gid)
""")
def operator_groups_by_all_signals(spark, sf_dir):
    """Groups that ids, certificates and files with retained bytes bind together."""
    signals, members = _all_bound(spark, sf_dir)
    found = groups.groups(signals, members, spark.createDataFrame([], NO_FAKES))
    named = F.array_join(F.transform("signals", lambda s: F.concat_ws(" ", s["type"], s["signal"], s["value"])), ", ")
    return found.select("case_id", "gid", "label", text("domains").alias("domains"), "domain_count", "signal_count", named.alias("signals"), text("channels").alias("channels"))


@query(f"""
    WITH {PAGES_SQL}, {FULL_SQL}, worst AS (
        SELECT case_id, sha, string_agg(domain, ', ' ORDER BY domain) AS domains, count(*) AS domain_count, bool_or(state = 'truncated') AS t, bool_or(state = 'legacy_unverifiable') AS l FROM template_rows GROUP BY 1, 2 HAVING count(*) >= 2
    )
    SELECT case_id, sha AS sha256, domains, domain_count, CASE WHEN t THEN 'truncated' WHEN l THEN 'legacy_unverifiable' ELSE 'verified' END AS verification FROM worst
""")
def shared_templates_with_bodies(spark, sf_dir):
    """Files served by several domains, some with all their bytes retained."""
    t, bodies = _full_tables(spark, sf_dir)
    found = ads.shared_templates(ads.domain_states(ads.acquisition_states(ads.ads_rows(t), t.acquisitions, bodies)))
    return found.select("case_id", "sha256", text("domains").alias("domains"), "domain_count", "verification")


@query(f"""
    WITH {SIGNALS_SQL} SELECT signal_type, signal_value, source_db, case_id, scan_run_id, CASE WHEN scan_run_id % 3 = 0 THEN 'zz' ELSE final_domain END AS final_domain FROM signals
""")
def last_write(spark, sf_dir):
    """Every third signal written again with another domain."""
    rows = p.signals(spark, sf_dir)
    again = rows.where("scan_run_id % 3 = 0").withColumn("final_domain", F.lit("zz"))
    return index.last_write(rows.union(again)).select("signal_type", "signal_value", "source_db", "case_id", "scan_run_id", "final_domain")


@query("""
    WITH k AS (SELECT page_id % 9 AS k FROM pages)
    SELECT CASE k WHEN 0 THEN 'kind_not_allowed' WHEN 1 THEN 'single_byte_fill' WHEN 2 THEN 'no_domain' WHEN 3 THEN 'no_capture_time' WHEN 4 THEN 'scan_unknown' WHEN 5 THEN 'earlier_than_scan'
        WHEN 6 THEN 'domain_never_observed' WHEN 7 THEN 'directory_changed' ELSE 'attach' END AS decision, count(*) AS n FROM k GROUP BY 1
""")
def attach_decisions(spark, sf_dir):
    """Claims made of pages: every gate of the list meets some of them."""
    from tracelink.functions import urls
    from tracelink.functions.decisions import first_of

    pages, apex = p.read(spark, sf_dir, "pages").withColumn("k", F.col("page_id") % 9), urls.registrable_domain(urls.hostname("url"))
    claims = pages.select(
        F.concat(F.lit("c/"), "page_id").alias("dir"), F.col("page_id").alias("scan_run_id"), first_of((F.col("k") == 0, "empty"), otherwise="capture").alias("kind"), (F.col("k") == 1).alias("filled"),
        F.when(F.col("k") != 2, apex).alias("domain"), F.lit(None).cast("string").alias("manifest_domain"), F.to_timestamp(F.when(F.col("k") != 3, F.lit("2026-01-02 00:00:00"))).alias("captured_at"), F.lit("x").alias("digest"),
    )
    scans = pages.where("k <> 4").select(F.col("page_id").alias("scan_run_id"), F.when(F.col("k") == 5, "2026-01-03 00:00:00 UTC").otherwise("2026-01-01 00:00:00 UTC").alias("run_at"))
    expected = pages.where("k <> 4").select(F.col("page_id").alias("scan_run_id"), F.array(F.when(F.col("k") == 6, "other.example").otherwise(apex)).alias("domains"))
    now = claims.select("dir", F.when(F.col("scan_run_id") % 9 == 7, "y").otherwise("x").alias("digest_now"))
    return integrity.decision_histogram(integrity.attach_decisions(claims, scans, expected, now))


@query("SELECT count(*) AS captures, count(DISTINCT page_id % 30) AS addresses, count(CASE WHEN page_id % 2 = 0 THEN 1 END) AS screenshots FROM pages")
def ip_summary(spark, sf_dir):
    i = F.col("page_id")
    pages = p.read(spark, sf_dir, "pages")
    shots = pages.select(i.alias("id"), F.when(i % 2 == 0, "a/shot.png").alias("screenshot_path"))
    return integrity.ip_summary(pages.select(i.alias("capture"), F.concat(F.lit("203.0.113."), i % 30).alias("address")), shots)


@query("""
    SELECT page_id, CASE WHEN page_id % 5 < 4 THEN page_id % 6 END AS status, CASE WHEN page_id % 5 < 4 THEN CASE page_id % 6 WHEN 0 THEN 'granted' WHEN 1 THEN 'grantedWithMods' WHEN 2 THEN 'rejection' WHEN 3 THEN 'waiting' WHEN 4 THEN 'revocationWarning' ELSE 'revocationNotification' END END AS status_text,
        CASE WHEN page_id % 5 < 4 THEN CASE WHEN page_id % 5 = 2 THEN 'no ' || page_id % 100 ELSE '' END END AS status_string, CASE WHEN page_id % 5 < 4 THEN CASE WHEN page_id % 5 = 1 THEN 'badAlg,badRequest' ELSE '' END END AS fail_info, CASE WHEN page_id % 5 < 4 THEN true END AS has_token
    FROM pages
""")
def timestamp_reply(spark, sf_dir):
    """Replies with a status, with failures, with a text, of lengths with every second byte, and some cut short."""
    i = F.col("page_id")
    k, status = i % 5, F.format_string("%02X", i % 6)
    text = F.hex(F.concat(F.lit("no "), i % 100).cast("binary"))
    length = lambda x: F.lpad(F.hex((F.length(x) / 2).cast("int")), 4, "0")
    short = lambda x: F.lpad(F.hex((F.length(x) / 2).cast("int")), 2, "0")
    info = F.concat(F.lit("0201"), status, F.when(k == 1, "030205A0").when(k == 2, F.concat(F.lit("30"), F.lpad(F.hex((F.length(text) / 2 + 2).cast("int")), 2, "0"), F.lit("0C"), short(text), text)).otherwise(""))
    body = F.concat(F.lit("30"), short(info), info, F.repeat(F.lit("30"), (256 + i % 4096).cast("int")))
    whole = F.concat(F.lit("3082"), length(body), body)
    pages = p.read(spark, sf_dir, "pages").select("page_id", F.unhex(F.when(k == 4, F.substring(whole, 1, 300)).otherwise(whole)).alias("reply"))
    return pages.withColumn("r", der.timestamp_reply(F.col("reply"))).select("page_id", "r.*")


@query("""
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Org ' || page_id % 5 || ' (cn)' WHEN 1 THEN 'Org ' || page_id % 5 WHEN 2 THEN 'cn' ELSE '' END AS label FROM pages
""")
def issuer_label(spark, sf_dir):
    k, org = F.col("page_id") % 4, F.concat(F.lit("Org "), F.col("page_id") % 5)
    both = F.create_map(F.lit("organizationName"), F.when(k == 0, F.to_json(F.array(org))).otherwise(org), F.lit("commonName"), F.lit("cn"))
    issuer = F.when(k == 0, both).when(k == 1, F.create_map(F.lit("organizationName"), org)).when(k == 2, F.create_map(F.lit("commonName"), F.lit("cn"))).otherwise(F.create_map(F.lit("organizationName"), F.lit("")))
    return p.read(spark, sf_dir, "pages").select("page_id", parsing.issuer_label(issuer).alias("label"))


@query("SELECT o_orderkey, o_custkey % 5 <> 0 AND datediff('day', o_orderdate, TIMESTAMP '1996-06-01') < 180 AS is_new FROM orders")
def is_new_domain(spark, sf_dir):
    created = F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderdate"))
    return p.read(spark, sf_dir, "orders").select("o_orderkey", parsing.is_new_domain(created, F.lit("1996-06-01 00:00:00").cast("timestamp")).alias("is_new"))


@query(f"SELECT DISTINCT event_type || CASE WHEN user_id % 2 = 0 THEN '' ELSE '/1' END AS value, user_id % 10 / 10 >= 0.8 OR event_type IN ({UNIVERSAL}) AND user_id % 2 = 0 AS generic, user_id % 10 AS share FROM events")
def is_generic_weak(spark, sf_dir):
    share = F.col("user_id") % 10
    value: Column = F.concat("event_type", F.when(F.col("user_id") % 2 == 0, "").otherwise("/1"))
    return p.read(spark, sf_dir, "events").select(value.alias("value"), groups.is_generic_weak(value, share / 10).alias("generic"), share.alias("share")).distinct()


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + to_microseconds(o_orderkey % 1000) END AS captured_at FROM orders")
def directory_time(spark, sf_dir):
    name = F.concat(F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss"), F.format_string("%06d", F.col("o_orderkey") % 1000), F.when(F.col("o_orderkey") % 3 == 0, "_x").otherwise("_a1B2"))
    return p.read(spark, sf_dir, "orders").select("o_orderkey", parsing.directory_time(name).alias("captured_at"))

