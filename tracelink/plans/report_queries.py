"""Registered queries of the case report, with DuckDB SQL over the SQL of the operators it reads."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tracelink.config import Conf
from tracelink.operators import ads, headers, infra, insights, report, url
from tracelink.plans import projections as p
from tracelink.plans.case_queries import _full_tables
from tracelink.plans.driver_queries import ORACLES, PINNED_SQL, query
from tracelink.plans.projections import CAPTURES_SQL, HEADERS_SQL, PAGES_SQL

KEYS = Conf(key_max_domains=500, key_min_values=1)


def _found(spark: SparkSession, sf_dir: str) -> tuple[report.Findings, object]:
    t = p.case_tables(spark, sf_dir)
    params, certs = url.param_rows(t), p.certificates(spark, sf_dir)
    found = report.Findings(
        destinations=url.shared_destinations(t), wrappers=url.wrapper_relationships(t), params=url.shared_params(params), param_keys=url.shared_param_keys(params, KEYS), asns=infra.asn_clusters(t), certificates=infra.shared_certificates(certs),
        windows=infra.issuance_windows(certs), tracking=infra.shared_tracking_ids(t), endpoints=infra.shared_endpoints(t), cloaking=insights.cloaking_suspects(t), header_templates=headers.shared_header_templates(p.header_rows(spark, sf_dir)),
        opsec=insights.opsec_profile(p.capture_rows(spark, sf_dir)),
    )
    return found, t


def _pairs(numbers: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(numbers)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def _told() -> Column:
    return F.concat(_pairs(F.col("numbers")), F.lit("|"), F.array_join(F.transform("items", _pairs), " "))


def _relations(*names: str) -> str:
    return ", ".join(f"r_{n} AS ({ORACLES[n]})" for n in names)


def _one(key: str, relation: str, order: str, /, **values: str) -> str:
    """SQL of a bullet from the first row of a relation; n is how many it has in the case."""
    told = " || ';' || ".join(f"'{k}=' || {v}" for k, v in sorted({"n": "n", **values}.items()))
    return f"SELECT case_id, {key} AS key, {told} || '|' AS told FROM (SELECT *, count(*) OVER (PARTITION BY case_id) AS n, row_number() OVER (PARTITION BY case_id ORDER BY {order}) AS rn FROM {relation}) WHERE rn = 1"


OWNER = {"owner_kind": "owner_kind", "platform_id": "platform_id"}
PARAM = "'key=' || param_key || ';owner_kind=' || owner_kind || ';platform_id=' || platform_id || ';posts=' || post_count || ';value=' || param_value[1:80] || '|'"


@query(f"""
    WITH {PAGES_SQL}, {PINNED_SQL}, {_relations("shared_destinations", "wrapper_relationships", "shared_params", "shared_param_keys", "asn_clusters", "shared_certificates", "issuance_windows", "shared_tracking_ids", "shared_endpoints", "cloaking_suspects", "shared_header_templates", "opsec_profile")},
    tags AS (
        SELECT case_id, unnest(CASE tagged WHEN 0 THEN ['http', 'multi_hop'] WHEN 1 THEN ['new_domain'] ELSE [] END) AS tag FROM (SELECT case_id, final_domain, original_url, min_by(tagged, ua_id) AS tagged FROM pinned GROUP BY 1, 2, 3)
    ), each AS (
        SELECT case_id, 'cloaking' AS key, 'n=' || suspects || '|' AS told FROM r_cloaking_suspects WHERE suspects > 0
        UNION ALL {_one("'header_template'", "r_shared_header_templates", "domain_count DESC, header, value", header="header", value="value", domains="domain_count")}
        UNION ALL SELECT case_id, 'opsec_strong', 'n=' || count(*) || '|' || string_agg('domain=' || domain, ' ' ORDER BY domain) FILTER (WHERE rn <= 3) FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY domain) AS rn FROM r_opsec_profile WHERE level = 'strong') GROUP BY 1
        UNION ALL SELECT case_id, 'landing', '|' || string_agg('domain=' || final_domain || ';posts=' || post_count || ';urls=' || url_count, ' ' ORDER BY rn) FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY post_count DESC, url_count DESC, final_domain) AS rn FROM r_shared_destinations) WHERE rn <= 3 GROUP BY 1
        UNION ALL SELECT case_id, 'risk', 'flagged=' || flagged || '|' || string_agg('n=' || n || ';tag=' || tag, ' ' ORDER BY n DESC, tag) FROM (SELECT case_id, tag, count(*) AS n FROM tags GROUP BY 1, 2) JOIN (SELECT case_id, CAST(sum(flagged_url_count) AS BIGINT) AS flagged FROM r_shared_destinations GROUP BY 1) USING (case_id) GROUP BY case_id, flagged
        UNION ALL {_one("'wrapper'", "r_wrapper_relationships", "url_count DESC, post_count DESC, original_domain, final_domain", urls="url_count", original="original_domain", final="final_domain")}
        UNION ALL SELECT case_id, CASE rn WHEN 1 THEN 'param' ELSE 'param2' END, {PARAM} FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY post_count DESC, url_count DESC, param_key, param_value) AS rn FROM r_shared_params) WHERE rn <= 2
        UNION ALL {_one("'param_key'", "(SELECT k.*, o.owner_kind, o.platform_id FROM r_shared_param_keys k JOIN (SELECT DISTINCT param_key, owner_kind, platform_id FROM r_shared_params) o USING (param_key))", "distinct_posts DESC, distinct_values DESC, param_key", key="param_key", posts="distinct_posts", values="distinct_values", domains="distinct_domains", **OWNER)}
        UNION ALL {_one("'tracking_id'", "(SELECT * FROM r_shared_tracking_ids WHERE platform <> 'Google Tag Manager')", "domain_count DESC, platform, tracking_id", platform="platform", tracking_id="tracking_id", domains="domain_count")}
        UNION ALL {_one("CASE WHEN is_direct_ip THEN 'endpoint_direct_ip' ELSE 'endpoint' END", "r_shared_endpoints", "domain_count DESC, is_direct_ip DESC, endpoint", endpoint="endpoint", domains="domain_count")}
        UNION ALL {_one("'tls_cert'", "r_shared_certificates", "domain_count DESC, url_count DESC, issuer, serial", issuer="issuer", domains="domain_count")}
        UNION ALL {_one("'tls_window'", "r_issuance_windows", "domain_count DESC, window_start", certs="cert_count", domains="domain_count")}
        UNION ALL {_one("'infra'", "r_asn_clusters", "CASE WHEN tag_counts = '' THEN 0 ELSE len(string_split(tag_counts, ', ')) END DESC, url_count DESC, asn", asn="asn", org="as_org", domains="domain_count", urls="url_count")}
    )
    SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY list_position({report.BULLETS!r}, CASE key WHEN 'endpoint_direct_ip' THEN 'endpoint' ELSE key END)) AS INT) AS place, key, told FROM each
""")
def case_bullets(spark, sf_dir):
    """What stands out in each case of the pages, certificates, headers and captures."""
    found, t = _found(spark, sf_dir)
    return report.bullets(found, report.counts(t)).select("case_id", "place", "key", _told().alias("told"))


@query(f"""
    WITH {_relations("case_counts", "shared_destinations", "shared_params", "asn_clusters")}
    SELECT case_id, total AS url_count, scanned, (SELECT count(*) FROM r_shared_destinations d WHERE d.case_id = c.case_id) AS destinations, CAST(0 AS BIGINT) AS unresolved,
        (SELECT count(*) FROM r_shared_params d WHERE d.case_id = c.case_id) AS params, (SELECT count(*) FROM r_asn_clusters d WHERE d.case_id = c.case_id) AS asns
    FROM r_case_counts c
""")
def case_headline(spark, sf_dir):
    found, t = _found(spark, sf_dir)
    return report.headline(found, report.counts(t))


@query(f"""
    WITH {_relations("case_counts", "evidence_gaps", "opsec_gap")}, each AS (
        SELECT case_id, unnest([1, 2, 3, 4, 5]) AS place, unnest(['intel', 'snap', 'tls', 'corr', 'unscanned']) AS key, unnest([no_intel, no_snapshot, no_tls, no_corroboration, total - scanned]) AS n, scanned FROM r_case_counts JOIN r_evidence_gaps USING (case_id)
    )
    SELECT case_id, place, key, n FROM each WHERE n > 0 AND (scanned > 0 OR key = 'unscanned')
    UNION ALL SELECT case_id, CASE indeterminate_reason WHEN 'no_lightweight' THEN 6 ELSE 7 END, 'opsec_' || indeterminate_reason, n FROM r_opsec_gap WHERE indeterminate_reason IN ('no_lightweight', 'no_playwright')
""")
def case_gaps(spark, sf_dir):
    t = p.case_tables(spark, sf_dir)
    t.snapshots = t.snapshots.where("scan_run_id DIV 10 % 11 <> 0")
    return report.gaps(t, report.counts(t), insights.opsec_profile(p.capture_rows(spark, sf_dir)))


@query(f"""
    WITH {HEADERS_SQL}, {CAPTURES_SQL}, {_relations("case_counts", "shared_tracking_ids", "shared_certificates", "shared_header_templates", "shared_templates_with_bodies", "cloaking_suspects", "opsec_profile", "shared_ad_accounts")}, s AS (
        SELECT case_id, 'tracking' AS k, count(*) AS n FROM r_shared_tracking_ids WHERE platform <> 'Google Tag Manager' GROUP BY 1
        UNION ALL SELECT case_id, 'certificates', count(*) FROM r_shared_certificates GROUP BY 1 UNION ALL SELECT case_id, 'header_templates', count(*) FROM r_shared_header_templates GROUP BY 1
        UNION ALL SELECT case_id, 'verified_templates', count(*) FROM r_shared_templates_with_bodies WHERE verification = 'verified' GROUP BY 1 UNION ALL SELECT case_id, 'cloaking', suspects FROM r_cloaking_suspects WHERE suspects > 0
        UNION ALL SELECT case_id, 'strong_opsec', count(*) FROM r_opsec_profile WHERE level = 'strong' GROUP BY 1 UNION ALL SELECT CAST(0 AS BIGINT), 'operator_accounts', count(*) FROM r_shared_ad_accounts WHERE tier = 'operator'
    ), w AS (
        SELECT case_id, coalesce(sum(n) FILTER (WHERE k IN ('tracking', 'certificates', 'header_templates', 'verified_templates')), 0) AS g, coalesce(sum(n) FILTER (WHERE k IN ('cloaking', 'strong_opsec')), 0) AS b, coalesce(sum(n) FILTER (WHERE k = 'operator_accounts'), 0) AS m,
            string_agg(list_element(['tracking_account', 'certificate', 'header_template', 'ads_template', 'cloaking', 'opsec', 'ad_account'], list_position(['tracking', 'certificates', 'header_templates', 'verified_templates', 'cloaking', 'strong_opsec', 'operator_accounts'], k)) || '=' || n, ', '
                ORDER BY list_position(['tracking', 'certificates', 'header_templates', 'verified_templates', 'cloaking', 'strong_opsec', 'operator_accounts'], k)) FILTER (WHERE n > 0) AS reasons
        FROM s GROUP BY 1
    )
    SELECT c.case_id, total AS url_count, scanned, CASE WHEN g > 0 THEN 'strong' ELSE 'none' END AS grouping, coalesce(b, 0) > 0 AS behaviour, CAST(coalesce(m, 0) AS BIGINT) AS money, CAST(round_even(100.0 * (6 * least(coalesce(g, 0), 3) + 3 * least(coalesce(b, 0), 3) + least(coalesce(m, 0), 3)) / 30, 0) AS INT) AS coverage,
        CASE WHEN g > 0 AND b > 0 THEN 'grouping_and_behaviour' WHEN g > 0 THEN 'grouping' WHEN b > 0 THEN 'behaviour' ELSE 'no_signal' END AS summary, scanned < total AS partial, coalesce(reasons, '') <> '' AS has_signal, coalesce(reasons, '') AS reasons
    FROM r_case_counts c LEFT JOIN w USING (case_id)
""")
def case_narrative(spark, sf_dir):
    """The reading of each case: files with retained bytes beside ids, certificates, headers and captures."""
    found, t = _found(spark, sf_dir)
    full, bodies = _full_tables(spark, sf_dir)
    found.templates = ads.shared_templates(ads.domain_states(ads.acquisition_states(ads.ads_rows(full), full.acquisitions, bodies)))
    found.accounts = ads.shared_ad_accounts(p.ads_rows(spark, sf_dir))
    told = report.narrative(report.signal_counts(found), report.counts(t))
    return told.withColumn("reasons", F.array_join(F.transform("reasons", lambda r: F.concat(r["key"], F.lit("="), r["n"])), ", "))
