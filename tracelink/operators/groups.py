"""Operator groups: hard signals bind domains, weak ones are shown and never bind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelink import config
from tracelink.config import Conf
from tracelink.operators.graph import connected_components
from tracelink.operators.infra import sorted_set
from tracelink.storage import materialise

CHANNELS = {"tracking_id": "html", "certificate": "tls", "ads_txt_template": "ads_txt"}


def is_gtm(platform: Column | str) -> Column:
    return F.contains(F.lower(F.col(platform) if isinstance(platform, str) else platform), F.lit("tag manager"))


def is_generic_weak(value: Column, breadth: Column, conf: Conf = Conf()) -> Column:
    return (breadth >= conf.weak_breadth) | F.lower(value).isin(config.UNIVERSAL_TOKENS)


def hard_signals(tracking: DataFrame, certificates: DataFrame, templates: DataFrame) -> DataFrame:
    """(case_id, type, label, value, domains): ids except containers, certificates, verified templates. Accounts never bind."""
    ids = tracking.where(~is_gtm("platform")).select("case_id", F.lit("tracking_id").alias("type"), F.col("platform").alias("label"), F.col("tracking_id").alias("value"), "domains")
    certs = certificates.select("case_id", F.lit("certificate").alias("type"), F.col("issuer").alias("label"), F.col("serial").alias("value"), "domains")
    files = templates.where("verification = 'verified'").select("case_id", F.lit("ads_txt_template").alias("type"), F.lit("ads.txt").alias("label"), F.col("sha256").alias("value"), "domains")
    return ids.union(certs).union(files)


def memberships(signals: DataFrame) -> DataFrame:
    """(case_id, domain, gid, group_size, label): components of domains over shared signals, largest first; gid counts from 1 in each case.

    Domains of cases are numbered once; each signal links its domains to its first, so that edges grow with members and hold numbers only.
    """
    flat = signals.select("case_id", F.col("domains")[0].alias("first"), F.explode("domains").alias("domain"))
    flat = materialise(flat, "signal-domains")
    nodes = materialise(flat.select("case_id", "domain").distinct().withColumn("node", F.monotonically_increasing_id()), "domain-numbers")
    side = lambda name, number: nodes.select("case_id", F.col("domain").alias(name), F.col("node").alias(number))
    edges = flat.join(side("first", "a"), ["case_id", "first"]).join(side("domain", "b"), ["case_id", "domain"]).select("a", "b")
    rows = connected_components(edges).join(nodes, "node").select("case_id", "domain", "component")
    sizes = rows.groupBy("case_id", "component").agg(F.count("*").alias("group_size"), F.min("domain").alias("label"))
    sizes = sizes.where("group_size > 1")
    gid = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("group_size"), "label"))
    return rows.join(sizes.withColumn("gid", gid), ["case_id", "component"]).select("case_id", "domain", "gid", "group_size", "label")


def groups(signals: DataFrame, members: DataFrame, fakes: DataFrame) -> DataFrame:
    """(case_id, gid, label, domains, domain_count, signals, signal_count, channels, fake_versions)."""
    per = members.groupBy("case_id", "gid").agg(F.first("label").alias("label"), sorted_set("domain").alias("domains"), F.count("*").alias("domain_count"))
    first = signals.withColumn("domain", F.col("domains")[0]).join(members.select("case_id", "domain", "gid"), ["case_id", "domain"])
    channel = F.create_map(*[F.lit(x) for pair in CHANNELS.items() for x in pair])
    of = first.groupBy("case_id", "gid").agg(
        F.array_sort(F.collect_list(F.struct("type", F.col("label").alias("signal"), "value", "domains"))).alias("signals"), F.count("*").alias("signal_count"), sorted_set(channel[F.col("type")]).alias("channels")
    )
    fake = fakes.join(members.select("case_id", "domain", "gid"), ["case_id", "domain"]).groupBy("case_id", "gid").agg(sorted_set(F.struct("domain", "header", "value", "reason")).alias("fake_versions"))
    return per.join(of, ["case_id", "gid"], "left").join(fake, ["case_id", "gid"], "left").orderBy("case_id", "gid")


def weak_containers(tracking: DataFrame, members: DataFrame) -> DataFrame:
    """Shared tag containers: their domains with the group each is in (null: none), and whether they span groups."""
    rows = tracking.where(is_gtm("platform")).select("case_id", "platform", F.col("tracking_id").alias("container_id"), "domain_count", F.explode("domains").alias("domain"))
    joined = rows.join(members.select("case_id", "domain", "gid"), ["case_id", "domain"], "left")
    per = joined.groupBy("case_id", "platform", "container_id", "domain_count").agg(sorted_set(F.struct("domain", F.col("gid").alias("group_id"))).alias("members"), (F.count_distinct("gid") > 1).alias("spans_groups"))
    return per.orderBy("case_id", F.desc("domain_count"), "container_id")


def weak_headers(templates: DataFrame, domain_counts: DataFrame, members: DataFrame, conf: Conf = Conf()) -> DataFrame:
    """Header values on several domains, without what every server sends; the most distinctive first."""
    rows = templates.join(domain_counts.withColumnRenamed("domain_count", "total"), "case_id").withColumn("breadth_ratio", F.col("domain_count") / F.greatest("total", F.lit(1)))
    rows = rows.where(~is_generic_weak(F.col("value"), F.col("breadth_ratio"), conf))
    flat = rows.select("case_id", "header", "value", F.explode("domains").alias("domain")).join(members.select("case_id", "domain", "gid"), ["case_id", "domain"])
    spans = flat.groupBy("case_id", "header", "value").agg((F.count_distinct("gid") > 1).alias("spans_groups"))
    out = rows.join(spans, ["case_id", "header", "value"], "left").withColumn("spans_groups", F.coalesce("spans_groups", F.lit(False)))
    return out.drop("total").orderBy("case_id", "breadth_ratio", F.desc("domain_count"), "header", "value")


#: Why a template of a state doesn't bind.
REASONS = {
    "hash_disagrees": "the retained bytes have another hash than the claim", "body_mismatch": "the file differs from what was captured", "wrong_scan_run": "the bytes belong to another scan",
    "wrong_kind": "the bytes are of another kind", "body_missing": "the file is gone", "truncated": "only a part was retained", "legacy_unverifiable": "nothing was retained to verify",
}


def unverified_templates(templates: DataFrame) -> DataFrame:
    reason = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return templates.where("verification <> 'verified'").withColumn("reason", F.try_element_at(reason, F.col("verification")))


def short_serial(serial: Column) -> Column:
    return F.when(F.length(serial) > 12, F.concat(F.left(serial, F.lit(12)), F.lit("…"))).otherwise(serial)


def node_id(value: Column) -> Column:
    return F.concat(F.lit("n"), F.substring(F.sha2(value, 256), 1, 12))


def group_color(gid: Column, palette: int = 8) -> Column:
    return F.pmod(gid - 1, F.lit(palette))


def case_clusters(tracking, certificates, templates, fakes, header_templates, domain_counts, completeness, conf: Conf = Conf()) -> dict[str, DataFrame]:
    """The flagship answer as named tables."""
    signals = hard_signals(tracking, certificates, templates)
    members = memberships(signals)
    return {
        "groups": groups(signals, members, fakes), "members": members, "weak_containers": weak_containers(tracking, members),
        "weak_headers": weak_headers(header_templates, domain_counts, members, conf), "unverified_templates": unverified_templates(templates), "completeness": completeness,
    }


def dot_lines(groups_: DataFrame) -> DataFrame:
    """(case_id, place, line): a graph of groups and signals in the DOT language, one row per line."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    flat = groups_.select("case_id", "gid", F.explode("signals").alias("s")).select("case_id", "gid", "s.*")
    edges = flat.select("case_id", "gid", "type", "value", F.explode("domains").alias("domain"))
    line = F.concat(F.lit("  "), quote(F.col("domain")), F.lit(" -- "), node_id(F.concat_ws("|", "type", "value")), F.lit(";"))
    nodes = flat.select("case_id", F.lit(1).alias("place"), F.concat(F.lit("  "), node_id(F.concat_ws("|", "type", "value")), F.lit(" [label="), quote(F.concat_ws(": ", "type", short_serial(F.col("value")))), F.lit("];")).alias("line"))
    frame = groups_.select("case_id").distinct()
    out = frame.select("case_id", F.lit(0).alias("place"), F.lit("graph operators {").alias("line")).union(nodes).union(edges.select("case_id", F.lit(2), line)).union(frame.select("case_id", F.lit(3), F.lit("}")))
    return out.orderBy("case_id", "place", "line")
