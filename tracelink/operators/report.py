"""The reading of a case: bullets, gaps, headline figures and reasons as keys with their numbers, for any language.

Each bullet takes a kind of finding: how many there are in a case, and the figures of the first in the finding's own order. These are aggregates that combine
before they shuffle; only where the first few are shown a ranking follows. Findings are the operators' own rows, by case.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelink.config import Conf
from tracelink.operators import ads, headers, infra, insights, pins, url
from tracelink.operators.groups import is_gtm
from tracelink.schema import CaseTables

#: Bullets in the order in which they are told; the first so many of a case are.
BULLETS = [
    "cloaking", "fake_version", "header_template", "opsec_strong", "landing", "risk", "unresolved", "wrapper", "param", "param2", "param_key", "tracking_id", "endpoint", "tls_cert", "tls_window", "infra", "no_scans",
]
MOST = 17
#: Reasons in order: key, tier, and the counter that fires it.
REASONS = [
    ("tracking_account", "strong", "tracking"), ("certificate", "strong", "certificates"), ("header_template", "strong", "header_templates"), ("ads_template", "strong", "verified_templates"),
    ("cloaking", "behaviour", "cloaking"), ("fake_version", "behaviour", "fake_versions"), ("opsec", "behaviour", "strong_opsec"), ("ad_account", "support", "operator_accounts"),
]
ITEM = "map<string,string>"


@dataclass
class Findings:
    """Rows of the operators, each with case_id; None where an operator hasn't run."""

    destinations: DataFrame | None = None
    wrappers: DataFrame | None = None
    params: DataFrame | None = None
    param_keys: DataFrame | None = None
    asns: DataFrame | None = None
    certificates: DataFrame | None = None
    windows: DataFrame | None = None
    tracking: DataFrame | None = None
    endpoints: DataFrame | None = None
    cloaking: DataFrame | None = None
    fake_versions: DataFrame | None = None
    header_templates: DataFrame | None = None
    opsec: DataFrame | None = None
    accounts: DataFrame | None = None
    templates: DataFrame | None = None


def findings(t: CaseTables, captures: DataFrame | None = None, prevalence: DataFrame | None = None, bodies: DataFrame | None = None, conf: Conf = Conf()) -> Findings:
    """All operators over the cases of `t`. captures: rows of `insights.opsec_profile`'s input."""
    certs, rows, params = infra.certificates(t), headers.header_rows(t), url.param_rows(t, conf)
    files = ads.ads_rows(t)
    return Findings(
        url.shared_destinations(t), url.wrapper_relationships(t, conf), url.shared_params(params, conf), url.shared_param_keys(params, conf), infra.asn_clusters(t), infra.shared_certificates(certs, conf), infra.issuance_windows(certs, conf),
        infra.shared_tracking_ids(t, conf), infra.shared_endpoints(t, conf), insights.cloaking_suspects(t), headers.fake_versions(rows), headers.shared_header_templates(rows, conf),
        insights.opsec_profile(captures, conf) if captures is not None else None, ads.shared_ad_accounts(files, prevalence, conf), ads.shared_templates(ads.domain_states(ads.acquisition_states(files, t.acquisitions, bodies)), conf),
    )


def counts(t: CaseTables) -> DataFrame:
    """(case_id, url_count, scanned) of all cases, those without URLs too."""
    return t.cases.select(F.col("id").alias("case_id")).join(pins.case_counts(t), "case_id", "left").select("case_id", F.coalesce("total", F.lit(0)).alias("url_count"), F.coalesce("scanned", F.lit(0)).alias("scanned"))


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _numbers(**values: str | Column) -> Column:
    """A map of figures as text; empty for null."""
    return F.create_map(*[x for name, c in values.items() for x in (F.lit(name), F.coalesce(_text(c), F.lit("")))])


def _down(*names: str) -> list[Column]:
    return [-F.col(n) for n in names]


def _first(rows: DataFrame, key: str | Column, order: list[Column | str], /, **values: str | Column) -> DataFrame:
    """A bullet per case: n, and the figures of the row that is first in `order`."""
    key = F.lit(key) if isinstance(key, str) else key
    told = F.struct(key.alias("key"), _numbers(**values).alias("numbers"))
    per = rows.groupBy("case_id").agg(F.count("*").alias("n"), F.min_by(told, F.struct(*order)).alias("b"))
    return per.select("case_id", "b.key", F.map_concat("b.numbers", _numbers(n="n")).alias("numbers"), F.array().cast(f"array<{ITEM}>").alias("items"))


def _top(rows: DataFrame, order: list[Column | str], most: int) -> DataFrame:
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy("case_id").orderBy(*order))).where(F.col("_place") <= most)


def _listed(rows: DataFrame, key: str, item: Column, place: str = "_place", **values: Column) -> DataFrame:
    """A bullet per case with its rows as items, in order."""
    per = rows.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("at"), F.map_entries(item).alias("e")))).alias("each"), *[v.alias(name) for name, v in values.items()])
    items = F.transform("each", lambda x: F.map_from_entries(x["e"]))
    return per.select("case_id", F.lit(key).alias("key"), (_numbers(**{name: name for name in values}) if values else F.create_map().cast(ITEM)).alias("numbers"), items.alias("items"))


def _owner(rows: DataFrame) -> dict[str, str]:
    return {c: c for c in ("owner_kind", "platform_id") if c in rows.columns}


def bullets(found: Findings, counted: DataFrame, most: int = MOST) -> DataFrame:
    """(case_id, place, key, numbers, items): what stands out in each case, in the order of BULLETS. counted: of `counts`.

    A case without any finding and without a finished scan has the bullet no_scans. Numbers and items are text by name.
    """
    parts: list[DataFrame] = []
    none = F.array().cast(f"array<{ITEM}>").alias("items")
    if found.cloaking is not None:
        parts.append(found.cloaking.where("suspects > 0").select("case_id", F.lit("cloaking").alias("key"), _numbers(n="suspects").alias("numbers"), none))
    if found.fake_versions is not None:
        parts.append(_first(found.fake_versions, "fake_version", ["domain", "header", "reason"], domain="domain", header="header", value="value"))
    if found.header_templates is not None:
        parts.append(_first(found.header_templates, "header_template", [*_down("domain_count"), "header", "value"], header="header", value="value", domains="domain_count"))
    if found.opsec is not None:
        strong = found.opsec.where("level = 'strong'")
        shown = _listed(_top(strong, ["domain"], 3), "opsec_strong", _numbers(domain="domain"))
        parts.append(shown.join(strong.groupBy("case_id").agg(F.count("*").alias("n")), "case_id").select("case_id", "key", _numbers(n="n").alias("numbers"), "items"))
    if found.destinations is not None:
        landed, open_ = found.destinations.where("is_resolved"), found.destinations.where("NOT is_resolved")
        parts.append(_listed(_top(landed, [*_down("post_count", "url_count"), "final_domain"], 3), "landing", _numbers(domain="final_domain", posts="post_count", urls="url_count")))
        tags = landed.where("tag_counts IS NOT NULL").select("case_id", F.explode("tag_counts").alias("tag", "k")).groupBy("case_id", "tag").agg(F.sum("k").alias("k"))
        flagged = landed.groupBy("case_id").agg(F.sum("flagged_url_count").alias("flagged"))
        ranked = tags.withColumn("_place", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("k"), "tag")))
        parts.append(_listed(ranked, "risk", _numbers(tag="tag", n="k")).join(flagged, "case_id").select("case_id", "key", _numbers(flagged="flagged").alias("numbers"), "items"))
        parts.append(open_.groupBy("case_id").agg(F.count("*").alias("n")).select("case_id", F.lit("unresolved").alias("key"), _numbers(n="n").alias("numbers"), none))
    if found.wrappers is not None:
        parts.append(_first(found.wrappers, "wrapper", [*_down("url_count", "post_count"), "original_domain", "final_domain"], urls="url_count", original="original_domain", final="final_domain"))
    if found.params is not None:
        two = _top(found.params, [*_down("post_count", "url_count"), "param_key", "param_value"], 2)
        told = _numbers(key="param_key", value=F.left("param_value", F.lit(80)), posts="post_count", **_owner(found.params))
        parts.append(two.select("case_id", F.when(F.col("_place") == 1, "param").otherwise("param2").alias("key"), told.alias("numbers"), none))
    if found.param_keys is not None:
        parts.append(_first(found.param_keys, "param_key", [*_down("distinct_posts", "distinct_values"), "param_key"], key="param_key", posts="distinct_posts", values="distinct_values", domains="distinct_domains", **_owner(found.param_keys)))
    if found.tracking is not None:
        ids = found.tracking.where(~is_gtm("platform"))
        parts.append(_first(ids, "tracking_id", [*_down("domain_count"), "platform", "tracking_id"], platform="platform", tracking_id="tracking_id", domains="domain_count"))
    if found.endpoints is not None:
        kind = F.when(F.col("is_direct_ip"), "endpoint_direct_ip").otherwise("endpoint")
        parts.append(_first(found.endpoints, kind, [*_down("domain_count"), ~F.col("is_direct_ip"), "endpoint"], endpoint="endpoint", domains="domain_count"))
    if found.certificates is not None:
        parts.append(_first(found.certificates, "tls_cert", [*_down("domain_count", "url_count"), "issuer", "serial"], domains="domain_count", issuer="issuer"))
    if found.windows is not None:
        parts.append(_first(found.windows, "tls_window", [*_down("domain_count"), "window_start"], domains="domain_count", certs="cert_count"))
    if found.asns is not None:
        tagged = F.coalesce(F.size("tag_counts"), F.lit(0))
        parts.append(_first(found.asns, "infra", [-tagged, *_down("url_count"), "asn"], asn="asn", org="as_org", domains="domain_count", urls="url_count"))
    every = reduce(DataFrame.unionByName, parts)
    idle = counted.where("scanned = 0").select("case_id").join(every.select("case_id").distinct(), "case_id", "left_anti")
    every = every.unionByName(idle.select("case_id", F.lit("no_scans").alias("key"), F.create_map().cast(ITEM).alias("numbers"), none))
    order = F.array_position(F.array(*map(F.lit, BULLETS)), F.when(F.col("key") == "endpoint_direct_ip", "endpoint").otherwise(F.col("key")))
    line = Window.partitionBy("case_id").orderBy("_order")
    return every.withColumn("_order", order).withColumn("place", F.row_number().over(line)).where(F.col("place") <= most).select("case_id", "place", "key", "numbers", "items")


def headline(found: Findings, counted: DataFrame) -> DataFrame:
    """(case_id, url_count, scanned, destinations, unresolved, params, asns): the figures of a case's first line."""
    out = counted
    for name, rows in (
        ("destinations", found.destinations.where("is_resolved") if found.destinations is not None else None), ("unresolved", found.destinations.where("NOT is_resolved") if found.destinations is not None else None),
        ("params", found.params), ("asns", found.asns),
    ):
        out = out.join(rows.groupBy("case_id").agg(F.count("*").alias(name)), "case_id", "left") if rows is not None else out.withColumn(name, F.lit(0).cast("long"))
    return out.fillna(0, ["destinations", "unresolved", "params", "asns"])


def gaps(t: CaseTables, counted: DataFrame, opsec: DataFrame | None = None) -> DataFrame:
    """(case_id, place, key, n): what hasn't been collected: intel, snapshots, certificates and corroboration of finished scans, URLs without one, and the path that an OPSEC verdict lacks."""
    missing = insights.evidence_gaps(t)
    keys = [("intel", "no_intel"), ("snap", "no_snapshot"), ("tls", "no_tls"), ("corr", "no_corroboration")]
    both = counted.join(missing, "case_id", "left")
    scanned = F.col("scanned") > 0
    each = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("key"), F.when(scanned, F.col(c)).alias("n")) for i, (k, c) in enumerate(keys, 1)], F.struct(F.lit(5).alias("place"), F.lit("unscanned").alias("key"), (F.col("url_count") - F.col("scanned")).alias("n")))
    out = both.select("case_id", F.explode(each).alias("g")).select("case_id", "g.place", "g.key", "g.n")
    if opsec is not None:
        paths = insights.opsec_gap(opsec).where("indeterminate_reason IN ('no_lightweight', 'no_playwright')")
        place = F.when(F.col("indeterminate_reason") == "no_lightweight", 6).otherwise(7)
        out = out.unionByName(paths.select("case_id", place.alias("place"), F.concat(F.lit("opsec_"), "indeterminate_reason").alias("key"), "n"))
    return out.where("n > 0")


def signal_counts(found: Findings) -> DataFrame:
    """(case_id, operator, n) as `insights.signal_summary` has them: the hard signals of each case."""
    named = {
        "tracking": found.tracking.where(~is_gtm("platform")) if found.tracking is not None else None, "certificates": found.certificates, "header_templates": found.header_templates,
        "verified_templates": found.templates.where("verification = 'verified'") if found.templates is not None else None, "fake_versions": found.fake_versions,
        "strong_opsec": found.opsec.where("level = 'strong'") if found.opsec is not None else None, "operator_accounts": found.accounts.where("tier = 'operator'") if found.accounts is not None else None,
    }
    out = insights.signal_summary(**{k: v for k, v in named.items() if v is not None})
    if found.cloaking is not None:
        out = out.unionByName(found.cloaking.where("suspects > 0").select("case_id", F.lit("cloaking").alias("operator"), F.col("suspects").alias("n")))
    return out


def narrative(signals: DataFrame, counted: DataFrame, conf: Conf = Conf()) -> DataFrame:
    """(case_id, url_count, scanned, grouping, behaviour, money, coverage, summary, partial, has_signal, reasons) of every case.

    grouping is strong or none; summary names which of grouping and behaviour there is; partial tells that URLs are left to scan. reasons: struct<tier, key, n> of what fired, strongest first.
    No motive is read into any of it.
    """
    each = signals.where("n > 0").groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("operator", "n"))).alias("by"))
    cover = insights.evidence_coverage(signals, conf)
    out = counted.join(each, "case_id", "left").join(cover, "case_id", "left").withColumn("by", F.coalesce("by", F.create_map().cast("map<string,bigint>")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    strong, behaved = zero("grouping") > 0, zero("behaviour") > 0
    reasons = F.array_compact(F.array(*[F.when(F.try_element_at("by", F.lit(source)) > 0, F.struct(F.lit(tier).alias("tier"), F.lit(key).alias("key"), F.try_element_at("by", F.lit(source)).alias("n"))) for key, tier, source in REASONS]))
    summary = F.when(strong & behaved, "grouping_and_behaviour").when(strong, "grouping").when(behaved, "behaviour").otherwise("no_signal")
    return out.select(
        "case_id", "url_count", "scanned", F.when(strong, "strong").otherwise("none").alias("grouping"), behaved.alias("behaviour"), zero("money").alias("money"), zero("score").alias("coverage"),
        summary.alias("summary"), (F.col("scanned") < F.col("url_count")).alias("partial"), (F.size(reasons) > 0).alias("has_signal"), reasons.alias("reasons"),
    )
