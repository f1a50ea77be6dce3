"""Aggregates over hosting, certificates, tracking ids and endpoints; all cases in one pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelink import config
from tracelink.config import Conf
from tracelink.functions.parsing import issuer_label, openssl_date
from tracelink.functions.urls import hostname, identify_param, is_direct_ip, is_noise_endpoint, owner_kind, query_pairs, within
from tracelink.operators.pins import latest_snapshot, pinned, usable_snapshots
from tracelink.schema import CaseTables, filled, string_list, tls, tracking_map


def sorted_set(c: Column | str) -> Column:
    return F.array_sort(F.collect_set(c))


def _counts(*more: Column) -> list[Column]:
    return [F.count_distinct("domain").alias("domain_count"), F.count_distinct("original_url").alias("url_count"), F.count_distinct("post_id").alias("post_count"), *more]


def asn_clusters(t: CaseTables) -> DataFrame:
    """Per case and ASN: domains, URLs, posts, flagged URLs and a histogram of risk tags; most tags first.

    A URL counts once, however many artifacts carry it, with the tags of its first artifact; a domain has the address of its first. The organisation and
    country are those of the largest artifact id. Artifacts without a landing domain give these only.
    """
    snaps = latest_snapshot(t).select("scan_run_id", "final_domain", F.col("asn").alias("s_asn"), F.col("as_org").alias("s_org"), F.col("as_country").alias("s_country"), F.col("ip_address").alias("s_ip"), F.col("risk_tags").alias("s_tags"))
    rows = pinned(t, "url_done", "final_url", "asn", "as_org", "as_country", "ip_address", "intel_risk_tags").join(snaps, "scan_run_id", "left")
    rows = rows.select(
        "case_id", "ua_id", "post_id", "original_url", F.coalesce("s_asn", "asn").alias("asn"), F.coalesce("s_org", "as_org").alias("org"), F.coalesce("s_country", "as_country").alias("country"),
        F.coalesce(F.nullif("final_domain", F.lit("")), hostname("final_url")).alias("domain"), F.coalesce("s_ip", "ip_address").alias("ip"),
        F.array_distinct(F.concat(string_list("s_tags"), string_list("intel_risk_tags"))).alias("tags"),
    ).where(filled("asn"))
    key, landed = ["case_id", "asn"], rows.where("domain <> ''")
    per = rows.groupBy(*key).agg(
        F.coalesce(F.max_by("org", "ua_id"), F.lit("—")).alias("as_org"), F.coalesce(F.max_by("country", "ua_id"), F.lit("—")).alias("as_country"), F.count_distinct(F.when(F.col("domain") != "", F.col("post_id"))).alias("post_count")
    )
    domains = landed.groupBy(*key, "domain").agg(F.min_by("ip", "ua_id").alias("ip_address"))
    domains = domains.groupBy(*key).agg(F.count("*").alias("domain_count"), F.array_sort(F.collect_list(F.struct("domain", "ip_address"))).alias("domains"))
    urls = landed.groupBy(*key, "original_url").agg(F.min_by("tags", "ua_id").alias("tags"))
    counts = urls.groupBy(*key).agg(F.count("*").alias("url_count"), F.count_if(F.size("tags") > 0).alias("flagged_url_count"))
    tags = urls.select(*key, F.explode("tags").alias("tag")).groupBy(*key, "tag").agg(F.count("*").alias("n"))
    tags = tags.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "n")))).alias("tag_counts"))
    out = per.join(domains, key, "left").join(counts, key, "left").join(tags, key, "left").fillna(0, ["domain_count", "url_count", "flagged_url_count"])
    return out.orderBy("case_id", F.desc(F.coalesce(F.size("tag_counts"), F.lit(0))), F.desc("url_count"), "asn")


def certificates(t: CaseTables, pin: str = "url_done") -> DataFrame:
    """(case_id, ua_id, post_id, original_url, domain, issuer, serial, not_before, not_after, sans) of pinned scans that landed somewhere and have a certificate."""
    rows = pinned(t, pin, "final_url", "tls_info_json", posts=pin != "own_done").where(filled("tls_info_json")).withColumn("tls", tls())
    rows = rows.select(
        "case_id", "ua_id", "post_id", "original_url", hostname("final_url").alias("domain"), issuer_label(F.col("tls.issuer")).alias("issuer"), F.trim("tls.serialNumber").alias("serial"),
        openssl_date("tls.notBefore").alias("not_before"), openssl_date("tls.notAfter").alias("not_after"), F.size(F.coalesce("tls.subjectAltName", F.array().cast("array<string>"))).alias("sans"),
    )
    return rows.where(F.col("domain") != "")


def shared_certificates(certs: DataFrame, conf: Conf = Conf()) -> DataFrame:
    """Certificates (issuer, serial) seen on several domains of a case."""
    per = certs.where(filled("serial")).groupBy("case_id", "issuer", "serial").agg(
        F.min("not_before").alias("not_before"), F.max("not_after").alias("not_after"), F.max("sans").alias("san_count"), sorted_set("domain").alias("domains"), *_counts()
    )
    return per.where(F.col("domain_count") >= conf.min_domains).orderBy("case_id", F.desc("domain_count"), F.desc("url_count"), "issuer", "serial")


def _openings(span: int):
    """Times (case_id, second) of one run that open a window: the first, and each that is over `span` after the one before."""

    def run(group: pa.Table) -> pa.Table:
        times = np.sort(group.column("second").to_numpy())
        found, at = [], 0
        while at < len(times):
            found.append(int(times[at]))
            at = int(np.searchsorted(times, times[at] + span, "right"))
        case = group.column("case_id")
        return pa.table({"case_id": pa.array([case[0].as_py()] * len(found), case.type), "start": pa.array(found, pa.int64())})

    return run


def issuance_windows(certs: DataFrame, conf: Conf = Conf()) -> DataFrame:
    """Certificates of a case issued within hours of the first of their window; a window opens where the last one's span ends.

    A time after a gap of more than the span always opens a window, so the runs between such gaps are walked through apart; a run holds its distinct
    seconds only. Gaps are found over buckets as long as the span. A certificate meets its window in one of the two buckets that this touches.
    """
    span = conf.cert_window_hours * 3600
    one = certs.where(filled("serial") & F.col("not_before").isNotNull()).groupBy("case_id", "issuer", "serial").agg(F.min("not_before").alias("at"), F.collect_set("domain").alias("domains"))
    one = one.withColumn("second", F.unix_timestamp("at")).withColumn("bucket", F.floor(F.col("second") / span))
    times = one.select("case_id", "second", "bucket").distinct()
    line = Window.partitionBy("case_id").orderBy("bucket")
    buckets = times.groupBy("case_id", "bucket").agg(F.min("second").alias("first"), F.max("second").alias("last"))
    gap = F.coalesce(F.col("first") - F.lag("last").over(line) > span, F.lit(True)).cast("int")
    runs = buckets.withColumn("gap", gap).withColumn("run", F.sum("gap").over(line)).select("case_id", "bucket", "run")
    case_type = certs.schema["case_id"].dataType.simpleString()
    windows = times.join(runs, ["case_id", "bucket"]).groupBy("case_id", "run").applyInArrow(_openings(span), f"case_id {case_type}, start long")
    first = F.floor(F.col("start") / span)
    windows = windows.withColumn("bucket", F.explode(F.array(first, first + 1)))
    inside = one.join(windows, ["case_id", "bucket"]).where(F.col("second").between(F.col("start"), F.col("start") + span))
    flat = inside.withColumn("domain", F.explode("domains"))
    per = flat.groupBy("case_id", "start").agg(
        F.min("at").alias("window_start"), F.max("at").alias("window_end"), F.count_distinct("issuer", "serial").alias("cert_count"), F.count_distinct("domain").alias("domain_count"),
        sorted_set("domain").alias("domains"), sorted_set("issuer").alias("issuers"),
    )
    good = per.where((F.col("cert_count") >= 2) & (F.col("domain_count") >= conf.min_domains)).drop("start")
    return good.orderBy("case_id", F.desc("domain_count"), "window_start")


def certificate_authorities(certs: DataFrame) -> DataFrame:
    """Issuers of a case's certificates, of `certificates(t, "own_done")`; one without a name is —."""
    per = certs.withColumn("issuer", F.coalesce(F.nullif("issuer", F.lit("")), F.lit("—"))).groupBy("case_id", "issuer")
    per = per.agg(F.count_distinct("domain").alias("domain_count"), F.count_distinct("original_url").alias("url_count"), F.count_distinct(F.when(filled("serial"), F.col("serial"))).alias("cert_count"), sorted_set("domain").alias("domains"), F.min("not_before").alias("earliest_not_before"))
    return per.orderBy("case_id", F.desc("domain_count"), "issuer")


def tracking_rows(t: CaseTables, pin: str = "url_done") -> DataFrame:
    """(case_id, ua_id, post_id, original_url, scan_run_id, domain, platform, tracking_id): ids on every usable capture of the pinned scans, under the domain that the capture landed on; empty where it states none."""
    snaps = usable_snapshots(t, "tracking_ids_json").select("scan_run_id", F.lower(F.coalesce("final_domain", F.lit(""))).alias("domain"), F.explode(tracking_map()).alias("platform", "ids"))
    rows = pinned(t, pin).join(snaps, "scan_run_id")
    return rows.select("case_id", "ua_id", "post_id", "original_url", "scan_run_id", "domain", "platform", F.explode("ids").alias("tracking_id")).where("tracking_id <> ''")


def shared_tracking_ids(t: CaseTables, conf: Conf = Conf()) -> DataFrame:
    per = tracking_rows(t).where(F.col("domain") != "").groupBy("case_id", "platform", "tracking_id").agg(*_counts(), sorted_set("domain").alias("domains"))
    return per.where(F.col("domain_count") >= conf.min_domains).orderBy("case_id", F.desc("domain_count"), F.desc("url_count"), "platform", "tracking_id")


def platform_of_label(label: Column | str) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in config.LABEL_PLATFORMS.items() for x in pair])
    c = F.col(label) if isinstance(label, str) else label
    return F.coalesce(F.try_element_at(labels, c), c)


def ad_tracking_platforms(t: CaseTables) -> DataFrame:
    """Platforms of a case by their evidence: URL parameters, ids in HTML, or both on the same artifact or domain.

    A parameter counts for the host of the URL that holds it, an id for the domain its capture landed on. A platform that a capture names without an id is evidence too.
    """
    base = pinned(t, "url_any", "final_url", how="left")
    own = ["case_id", "ua_id", "post_id", "original_url"]
    urls = base.select(*own, F.explode(F.array_distinct(F.array("original_url", "final_url"))).alias("url")).withColumn("domain", hostname("url")).where("domain <> ''")
    keys = urls.select(*own, "domain", F.explode(query_pairs("url")).alias("p")).select(*own, "domain", identify_param("p.key").alias("platform_id"), F.col("p.key").alias("param_key"), F.array().cast("array<string>").alias("ids"))
    snaps = usable_snapshots(t, "tracking_ids_json").select("scan_run_id", F.nullif(F.lower("final_domain"), F.lit("")).alias("domain"), F.explode(tracking_map()).alias("platform", "ids"))
    html = base.join(snaps, "scan_run_id").select(*own, "domain", platform_of_label("platform").alias("platform_id"), F.lit(None).cast("string").alias("param_key"), "ids")
    from_url = F.col("param_key").isNotNull()
    per = keys.where("platform_id <> ''").unionByName(html).groupBy("case_id", "platform_id").agg(
        sorted_set("param_key").alias("param_keys"), F.array_sort(F.filter(F.array_distinct(F.flatten(F.collect_set("ids"))), lambda x: x != "")).alias("tracking_ids"), *_counts(), sorted_set("domain").alias("domains"),
        F.collect_set(F.when(from_url, F.col("ua_id"))).alias("ua_u"), F.collect_set(F.when(~from_url, F.col("ua_id"))).alias("ua_h"),
        F.collect_set(F.when(from_url, F.col("domain"))).alias("d_u"), F.collect_set(F.when(~from_url, F.col("domain"))).alias("d_h"),
    )
    both = (F.size("ua_u") > 0) & (F.size("ua_h") > 0)
    source = F.when(both & (F.arrays_overlap("ua_u", "ua_h") | F.arrays_overlap("d_u", "d_h")), "both").when(both, "mixed_nonoverlap").when(F.size("ua_h") > 0, "html_embedded").otherwise("url_param")
    rank = F.array_position(F.array(*map(F.lit, ["both", "mixed_nonoverlap", "html_embedded", "url_param"])), F.col("signal_source"))
    out = per.withColumns({"signal_source": source, "owner_kind": owner_kind("platform_id")}).drop("ua_u", "ua_h", "d_u", "d_h")
    return out.orderBy("case_id", F.desc("url_count"), F.desc("domain_count"), rank, "platform_id")


def endpoint_rows(t: CaseTables, pin: str = "own_done") -> DataFrame:
    """(case_id, ua_id, scan_run_id, domain, endpoint): third-party hosts that usable captures asked for, under the domain that the capture landed on."""
    snaps = usable_snapshots(t, "request_domains_json").select("scan_run_id", F.lower("final_domain").alias("domain"), F.explode(F.array_distinct(string_list("request_domains_json"))).alias("endpoint"))
    rows = pinned(t, pin, posts=False).join(snaps, "scan_run_id").select("case_id", "ua_id", "scan_run_id", "domain", F.lower(F.trim("endpoint")).alias("endpoint"))
    return rows.where((F.col("domain") != "") & filled("endpoint") & ~within(F.col("endpoint"), F.col("domain")) & ~is_noise_endpoint("endpoint"))


def shared_endpoints(t: CaseTables, conf: Conf = Conf()) -> DataFrame:
    """Third-party hosts that several landing domains of a case call; addresses first."""
    per = endpoint_rows(t).groupBy("case_id", "endpoint").agg(F.count_distinct("domain").alias("domain_count"), sorted_set("domain").alias("domains"))
    per = per.where(F.col("domain_count") >= conf.min_domains).withColumn("is_direct_ip", is_direct_ip("endpoint"))
    return per.orderBy("case_id", F.desc("domain_count"), F.desc("is_direct_ip"), "endpoint")


def newest(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The row of the largest `order` in each group."""
    line = Window.partitionBy(*by).orderBy(F.desc(order))
    return df.withColumn("_row", F.row_number().over(line)).where("_row = 1").drop("_row")
