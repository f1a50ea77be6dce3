"""Response headers of every finished scan's hops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelink import config
from tracelink.config import Conf
from tracelink.functions.parsing import set_cookie
from tracelink.functions.urls import hostname, naive_apex
from tracelink.operators.infra import sorted_set
from tracelink.schema import CaseTables, filled, header_pairs


def header_rows(t: CaseTables) -> DataFrame:
    """(case_id, domain, header, value) of all hops of all finished scans, repeats kept."""
    of = t.url_artifacts.select(F.col("id").alias("url_artifact_id"), "case_id")
    scans = t.scan_runs.where("status = 'done'").select(F.col("id").alias("scan_run_id"), "url_artifact_id").join(of, "url_artifact_id")
    hops = t.redirect_hops.where(filled("response_headers_json")).select("scan_run_id", hostname("url").alias("domain"), F.explode(header_pairs()).alias("p"))
    return hops.join(scans, "scan_run_id").where("domain <> ''").select("case_id", "domain", "p.header", F.trim("p.value").alias("value"))


def per_domain_constants(rows: DataFrame, conf: Conf = Conf()) -> DataFrame:
    """(case_id, domain, header, value, observations): headers that a domain always sends with the same value."""
    per = rows.where(~F.col("header").isin(config.VOLATILE_HEADERS)).groupBy("case_id", "domain", "header")
    per = per.agg(F.count("*").alias("observations"), F.min("value").alias("value"), F.max("value").alias("other"))
    return per.where((F.col("observations") >= conf.min_observations) & (F.col("value") == F.col("other"))).drop("other").orderBy("case_id", "domain", "header")


def shared_header_templates(rows: DataFrame, conf: Conf = Conf()) -> DataFrame:
    per = rows.where(F.col("header").isin(config.TEMPLATE_HEADERS) & filled("value")).groupBy("case_id", "header", "value")
    per = per.agg(F.count_distinct("domain").alias("domain_count"), sorted_set("domain").alias("domains"))
    return per.where(F.col("domain_count") >= conf.min_domains).orderBy("case_id", F.desc("domain_count"), "header", "value")


def fake_versions(rows: DataFrame) -> DataFrame:
    """Distinct (case_id, domain, header, value, reason): versions that were never released."""
    found = F.array_compact(F.array(*[F.when(F.col("value").rlike("(?i)" + p), F.lit(reason)) for p, reason in config.FAKE_VERSIONS]))
    seen = rows.where(F.col("header").isin(config.VERSION_HEADERS)).select("case_id", "domain", "header", "value").distinct()
    return seen.withColumn("reason", F.explode(found)).orderBy("case_id", "domain", "header", "value", "reason")


def _cookies(rows: DataFrame) -> DataFrame:
    return rows.where("header = 'set-cookie'").select("case_id", "domain", set_cookie("value").alias("c"))


def cookie_origin_leaks(rows: DataFrame) -> DataFrame:
    """Cookies set for a domain of another apex than the one that answers."""
    leaks = _cookies(rows).where(filled("c.domain")).where(naive_apex("c.domain") != naive_apex("domain"))
    return leaks.select("case_id", F.col("domain").alias("response_domain"), F.col("c.domain").alias("cookie_domain")).distinct().orderBy("case_id", "response_domain", "cookie_domain")


def shared_cookie_templates(rows: DataFrame, conf: Conf = Conf()) -> DataFrame:
    key = ["case_id", "path", "httponly", "secure", "samesite"]
    per = _cookies(rows).select("case_id", "domain", "c.path", "c.httponly", "c.secure", "c.samesite").groupBy(*key)
    return per.agg(F.count_distinct("domain").alias("domain_count"), sorted_set("domain").alias("domains")).where(F.col("domain_count") >= conf.min_domains).orderBy("case_id", F.desc("domain_count"), *key[1:])
