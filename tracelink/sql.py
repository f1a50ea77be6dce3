"""The library in SQL: operators as views over a case store, and scalar functions of a session.

Views and SQL functions are plans, not programs: the optimiser opens them and pushes filters and columns through them to the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.config import Conf
from tracelink.functions import parsing, urls
from tracelink.operators import ads, headers, infra, insights, pins, url
from tracelink.schema import CaseTables

#: Scalar functions of one text: name, its definition, the type it returns.
SCALARS: dict[str, tuple[Callable[[Column], Column], str]] = {
    "url_host": (urls.hostname, "STRING"), "naive_apex": (urls.naive_apex, "STRING"), "is_ipv4": (urls.is_ipv4, "BOOLEAN"), "param_platform": (urls.identify_param, "STRING"), "param_value": (urls.comparison_value, "STRING"),
    "owner_kind": (urls.owner_kind, "STRING"), "ads_txt_url": (urls.ads_txt_url, "STRING"), "posted_at": (parsing.posted_at, "TIMESTAMP"), "openssl_date": (parsing.openssl_date, "TIMESTAMP"), "platform_of_label": (infra.platform_of_label, "STRING"),
}


def _text(spark: SparkSession, build: Callable[[Column], Column]) -> str:
    """SQL of a column expression of x."""
    plan = spark.sql("SELECT '' AS x").select(build(F.col("x")).alias("y"))._jdf.queryExecution().analyzed()
    return plan.expressions().head().child().sql().replace("__auto_generated_subquery_name.", "")


def register_functions(spark: SparkSession, prefix: str = "tl_") -> list[str]:
    """Temporary SQL functions of the session, by SCALARS; returns their names."""
    names = []
    for name, (build, kind) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(x STRING) RETURNS {kind} RETURN {_text(spark, build)}")
        names.append(prefix + name)
    return names


def case_views(t: CaseTables, prevalence: DataFrame | None = None, bodies: DataFrame | None = None, conf: Conf = Conf()) -> dict[str, DataFrame]:
    """The operators that are one plan over the case tables, by name. Sorting is left to the query."""
    certs, rows, params, files = infra.certificates(t), headers.header_rows(t), url.param_rows(t, conf), ads.ads_rows(t)
    return {
        "asn_clusters": infra.asn_clusters(t), "shared_certificates": infra.shared_certificates(certs, conf), "certificate_authorities": infra.certificate_authorities(infra.certificates(t, "own_done")),
        "shared_tracking_ids": infra.shared_tracking_ids(t, conf), "ad_tracking_platforms": infra.ad_tracking_platforms(t), "shared_endpoints": infra.shared_endpoints(t, conf), "shared_destinations": url.shared_destinations(t),
        "wrapper_relationships": url.wrapper_relationships(t, conf), "shared_params": url.shared_params(params, conf), "shared_param_keys": url.shared_param_keys(params, conf), "header_constants": headers.per_domain_constants(rows, conf),
        "header_templates": headers.shared_header_templates(rows, conf), "fake_versions": headers.fake_versions(rows), "shared_ad_accounts": ads.shared_ad_accounts(files, prevalence, conf), "account_footprint": ads.account_footprint(ads.direct_accounts(files)),
        "shared_templates": ads.shared_templates(ads.domain_states(ads.acquisition_states(files, t.acquisitions, bodies)), conf), "cloaking_suspects": insights.cloaking_suspects(t), "evidence_gaps": insights.evidence_gaps(t), "completeness": insights.completeness(t),
        "case_counts": pins.case_counts(t), "unscanned_urls": pins.unscanned_urls(t), "pending_snapshots": pins.pending_snapshots(t),
    }


def register_case(spark: SparkSession, t: CaseTables, prevalence: DataFrame | None = None, bodies: DataFrame | None = None, prefix: str = "tl_", conf: Conf = Conf()) -> list[str]:
    """Temporary views of the session: `case_views` under a prefix; returns their names. A name that is there already is replaced."""
    views = case_views(t, prevalence, bodies, conf)
    for name, rows in views.items():
        rows.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in views]
