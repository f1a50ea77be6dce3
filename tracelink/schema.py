"""The case model: typed tables, and the JSON documents inside their columns."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DDL = {
    "cases": "id BIGINT, title STRING, description STRING, created_at STRING, updated_at STRING, browser_locale STRING, browser_timezone STRING",
    "message_evidence": "id BIGINT, case_id BIGINT, platform STRING, permalink STRING, actor_label STRING, posted_at STRING, message_text STRING, screenshot_path STRING, ingested_at STRING",
    "url_artifacts": "id BIGINT, message_id BIGINT, case_id BIGINT, original_url STRING, domain STRING, url_order INT, created_at STRING",
    "scan_runs": "id BIGINT, url_artifact_id BIGINT, run_at STRING, final_url STRING, hop_count INT, status STRING, notes STRING, whois_registrar STRING, whois_creation_date STRING, ip_address STRING, asn STRING, as_org STRING, as_country STRING, intel_risk_tags STRING, domain_enriched_at STRING, tls_info_json STRING, final_response_headers_json STRING, corroboration_json STRING, cloaking_signal_json STRING, ads_txt_json STRING",
    "redirect_hops": "id BIGINT, scan_run_id BIGINT, hop_order INT, url STRING, status_code INT, location STRING, resolved_url STRING, fetched_at STRING, response_headers_json STRING",
    "snapshots": "id BIGINT, scan_run_id BIGINT, final_url STRING, final_domain STRING, screenshot_path STRING, html_path STRING, har_path STRING, request_domains_json STRING, risk_tags STRING, whois_registrar STRING, whois_creation_date STRING, captured_at STRING, capture_status STRING, capture_detail STRING, ip_address STRING, asn STRING, as_org STRING, as_country STRING, tracking_ids_json STRING, capture_method STRING, investigator_ip_json STRING",
    "acquisitions": "id BIGINT, kind STRING, scan_run_id BIGINT, requested_url STRING, final_url STRING, redirect_chain_json STRING, status STRING, status_code INT, fetched_at STRING, response_headers_json STRING, user_agent STRING, tool_version STRING, truncated BOOLEAN, captured_bytes BIGINT, body_path STRING, captured_sha256 STRING, complete_sha256 STRING, error STRING",
    "signals": "signal_type STRING, signal_value STRING, platform STRING, source_db STRING, case_id BIGINT, case_title STRING, scan_run_id BIGINT, final_domain STRING, observed_at STRING, indexed_at STRING",
}
OBSERVATION = "domain STRING, verdict STRING, status STRING, status_code INT, raw_sha256 STRING, record_count INT, accounts ARRAY<ARRAY<STRING>>, owner_domain STRING, manager_domain STRING, fetched_at STRING, truncated BOOLEAN, final_url STRING, body_file STRING, body_sha256 STRING"
TLS = "serialNumber STRING, issuer MAP<STRING,STRING>, notBefore STRING, notAfter STRING, subjectAltName ARRAY<STRING>"
ADS_TXT = "status STRING, status_code INT, raw_sha256 STRING, truncated BOOLEAN, acquisition_id BIGINT, owner_domain STRING, manager_domain STRING, record_count INT, records ARRAY<STRUCT<adsystem:STRING,seller_id:STRING,relationship:STRING,cert_authority_id:STRING>>"
CLOAKING = "verdict STRING, diffs ARRAY<STRING>, stripped_params ARRAY<STRING>"
PREVALENCE = "adsystem STRING, seller_id STRING, hits BIGINT, site_count BIGINT"


@dataclass
class CaseTables:
    """All cases at once; every operator groups by case_id."""

    cases: DataFrame
    message_evidence: DataFrame
    url_artifacts: DataFrame
    scan_runs: DataFrame
    redirect_hops: DataFrame
    snapshots: DataFrame
    acquisitions: DataFrame

    def for_case(self, case_id: int) -> CaseTables:
        """One case only: the filter reaches the scans, and prunes partitions where tables are partitioned by case_id."""
        posts = self.message_evidence.where(F.col("case_id") == case_id)
        urls = self.url_artifacts.where(F.col("case_id") == case_id)
        scans = self.scan_runs.join(urls.select(F.col("id").alias("url_artifact_id")), "url_artifact_id", "left_semi")
        of_scans = scans.select(F.col("id").alias("scan_run_id"))
        rest = [t.join(of_scans, "scan_run_id", "left_semi") for t in (self.redirect_hops, self.snapshots, self.acquisitions)]
        return CaseTables(self.cases.where(F.col("id") == case_id), posts, urls, scans, *rest)


def empty_tables(spark: SparkSession, **given: DataFrame) -> CaseTables:
    """Tables of the model, empty where none is given; given ones get the columns they lack as null."""
    return CaseTables(**{f.name: conform(spark, given[f.name], f.name) if f.name in given else spark.createDataFrame([], DDL[f.name]) for f in fields(CaseTables)})


def conform(spark: SparkSession, df: DataFrame, table: str) -> DataFrame:
    """`df` with the table's columns and types, in order."""
    schema = spark.createDataFrame([], DDL[table]).schema
    return df.select(*[(F.col(c.name) if c.name in df.columns else F.lit(None)).cast(c.dataType).alias(c.name) for c in schema])


def read_tables(spark: SparkSession, path: str) -> CaseTables:
    """Parquet tables of a case store; a capture without a method is one of the browser's."""
    frames = {f.name: spark.read.schema(DDL[f.name]).parquet(f"{path}/{f.name}") for f in fields(CaseTables)}
    frames["snapshots"] = frames["snapshots"].withColumn("capture_method", F.coalesce("capture_method", F.lit("playwright")))
    return CaseTables(**frames)


def filled(c: Column | str) -> Column:
    """Neither null nor blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(c) != "", F.lit(False))


def tls(c: str = "tls_info_json") -> Column:
    return F.from_json(c, TLS)


def ads_txt(c: str = "ads_txt_json") -> Column:
    return F.from_json(c, ADS_TXT)


def string_list(c: str) -> Column:
    """JSON list of strings; null and malformed become an empty list."""
    return F.coalesce(F.from_json(c, "ARRAY<STRING>"), F.array().cast("array<string>"))


def tracking_map(c: str = "tracking_ids_json") -> Column:
    """platform -> ids; a value that is no list is left out by itself, not with the whole document."""
    outer = F.coalesce(F.from_json(c, "MAP<STRING,STRING>"), F.create_map().cast("map<string,string>"))
    inner = F.transform_values(outer, lambda k, v: F.from_json(v, "ARRAY<STRING>"))
    return F.map_filter(inner, lambda k, v: v.isNotNull())


def header_pairs(c: str = "response_headers_json") -> Column:
    """[[name, value], ...] with lower-case names; pairs of another length are left out, repeats stay."""
    pairs = F.filter(F.coalesce(F.from_json(c, "ARRAY<ARRAY<STRING>>"), F.array().cast("array<array<string>>")), lambda p: F.size(p) == 2)
    return F.transform(pairs, lambda p: F.struct(F.lower(p[0]).alias("header"), p[1].alias("value")))
