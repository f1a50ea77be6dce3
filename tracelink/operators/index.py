"""The cross-case signal index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelink import config
from tracelink.config import Conf
from tracelink.functions.parsing import issuer_text
from tracelink.functions.suffixes import SuffixRules, apexes
from tracelink.functions.urls import hostname, is_noise_endpoint
from tracelink.operators import ads, headers, infra
from tracelink.operators.groups import is_generic_weak, is_gtm
from tracelink.operators.pins import pinned, usable_snapshots
from tracelink.schema import CaseTables, string_list, tracking_map

COLUMNS = ["signal_type", "signal_value", "platform", "source_db", "case_id", "case_title", "scan_run_id", "final_domain", "observed_at", "indexed_at"]
KEY = ["signal_type", "signal_value", "source_db", "case_id", "scan_run_id"]


def _emitted(rows: DataFrame, kind: str | Column, value: str | Column, platform: str | Column | None = None, *seq: str) -> DataFrame:
    """Signal rows of (case_id, scan_run_id, final_domain, observed_at); seq: the columns by which the last of equal keys is told."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    kind = F.lit(kind) if isinstance(kind, str) else kind
    platform = F.lit(None).cast("string") if platform is None else F.nullif(F.trim(col(platform)), F.lit(""))
    order = F.array(*[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in seq]) if seq else F.array().cast("array<bigint>")
    rows = rows.select("case_id", "scan_run_id", kind.alias("signal_type"), F.trim(col(value)).alias("signal_value"), platform.alias("platform"), F.nullif(F.trim("final_domain"), F.lit("")).alias("final_domain"), "observed_at", order.alias("seq"))
    return rows.where("signal_value <> ''")


def scan_signals(base: DataFrame) -> DataFrame:
    """Landing domain, registrar, ASN (under its organisation) and certificate serial (under its issuer) of each pinned scan."""
    tls = F.from_json("tls_info_json", "serialNumber STRING, issuer MAP<STRING,STRING>")
    kind = lambda name, value, platform=F.lit(None).cast("string"): F.struct(F.lit(name).alias("signal_type"), value.alias("signal_value"), platform.alias("platform"))
    kinds = F.array(kind("final_domain", F.col("final_domain")), kind("registrar", F.col("whois_registrar")), kind("asn", F.col("asn"), F.col("as_org")), kind("cert_serial", F.col("tls.serialNumber"), issuer_text(F.col("tls.issuer"))))
    each = base.withColumn("tls", tls).withColumn("k", F.explode(kinds))
    return _emitted(each, F.col("k.signal_type"), "k.signal_value", "k.platform")


def tracking_signals(base: DataFrame, t: CaseTables) -> DataFrame:
    """Ids on usable captures, under the domain that the capture landed on; containers are a kind of their own."""
    snaps = usable_snapshots(t, "tracking_ids_json").select("scan_run_id", F.col("id").alias("capture"), F.lower("final_domain").alias("final_domain"), F.posexplode(F.map_entries(tracking_map())).alias("label", "e"))
    rows = base.drop("final_domain").join(snaps, "scan_run_id").select("case_id", "scan_run_id", "observed_at", "final_domain", "capture", "label", F.col("e.key").alias("key"), F.posexplode("e.value").alias("place", "value"))
    return _emitted(rows, F.when(is_gtm("key"), "gtm_container").otherwise("tracking_id"), "value", "key", "capture", "label", "place")


def header_signals(base: DataFrame, t: CaseTables, conf: Conf = Conf()) -> DataFrame:
    """Values that a domain always sends in a header that tells deployments apart, under the header's name; they belong to the domain's first artifact with a scan."""
    first = base.where("final_domain <> ''").groupBy("case_id", "final_domain").agg(F.min_by(F.struct("scan_run_id", "observed_at"), "ua_id").alias("s"))
    value = F.trim("value")
    told = (F.length(value) >= conf.header_min_length) | F.contains(value, F.lit("/"))
    own = (F.col("header").startswith("x-") | (F.col("header") == "server")) & ~F.col("header").isin(config.INDEX_NOISE_HEADERS)
    constants = headers.per_domain_constants(headers.header_rows(t), conf).where(own & told & ~is_generic_weak(value, F.lit(0.0), conf))
    rows = constants.join(first, (constants.case_id == first.case_id) & (F.lower(constants.domain) == first.final_domain)).drop(first.case_id)
    rows = rows.select("case_id", "s.scan_run_id", "s.observed_at", F.col("domain").alias("final_domain"), "header", "value")
    # of equal values of one scan the last header by name stays
    line = F.dense_rank().over(Window.partitionBy("case_id", "scan_run_id").orderBy("final_domain", "header"))
    return _emitted(rows.withColumn("place", line), "header_value", "value", "header", "place")


def endpoint_signals(base: DataFrame, t: CaseTables, rules: SuffixRules | None = None) -> DataFrame:
    """Registrable domains of third-party hosts that usable captures asked for, under the domain that the capture landed on."""
    snaps = usable_snapshots(t, "request_domains_json").select("scan_run_id", F.col("id").alias("capture"), F.lower("final_domain").alias("final_domain"), F.posexplode(string_list("request_domains_json")).alias("place", "raw"))
    rows = base.drop("final_domain").join(snaps.withColumn("host", F.lower(F.trim("raw"))).where("host <> '' AND final_domain <> ''"), "scan_run_id").where(~is_noise_endpoint("host"))
    rows = apexes(rows, rules, apex="host", landing="final_domain").where("apex <> '' AND landing <> '' AND apex <> landing")
    return _emitted(rows, "har_endpoint", "apex", None, "capture", "place")


def ads_signals(base: DataFrame, t: CaseTables, prevalence: DataFrame | None = None, bodies: DataFrame | None = None, conf: Conf = Conf(), rules: SuffixRules | None = None) -> DataFrame:
    """Verified templates, declared owners and managers, and the accounts of ads.txt files that may tell an operator.

    Left out are accounts of exchanges, those that `shared_ad_accounts` doesn't take for an operator's, those on many apexes or on most domains of the case, known commodities, and
    all accounts of a domain with hundreds of them.
    """
    seen = base.select("scan_run_id", "observed_at")
    files = ads.ads_rows(t, "own_done", rules).join(seen, "scan_run_id").withColumn("final_domain", F.col("domain"))
    good = files.where((F.col("status") == "ok") & (F.size("records") > 0))
    states = ads.acquisition_states(files, t.acquisitions, bodies).where("verification = 'verified'").select("case_id", "domain", "scan_run_id", "sha").distinct()
    templates = _emitted(good.join(states, ["case_id", "domain", "scan_run_id", "sha"], "left_semi"), "ads_txt_template", "sha")
    stated = files.where("status = 'ok'")
    declared = _emitted(stated, "ads_txt_owner", "owner").unionByName(_emitted(stated, "ads_txt_manager", "manager"))

    accounts = ads.direct_accounts(files)
    carriers = accounts.groupBy("case_id", "domain").agg(F.count_distinct(*ads.ACCOUNT).alias("n")).where(F.col("n") >= conf.carrier_max_accounts)
    each = accounts.where(~F.col("adsystem").isin(config.EXCHANGES)).groupBy("case_id", "scan_run_id", "domain", "final_domain", "observed_at", *ads.ACCOUNT).agg(F.min("place").alias("place"))
    each = each.join(carriers.select("case_id", "domain"), ["case_id", "domain"], "left_anti")
    demoted = ads.shared_ad_accounts(ads.ads_rows(t, "url_done", rules), prevalence, conf).where("tier <> 'operator'").select("case_id", *ads.ACCOUNT)
    wide = ads.account_footprint(accounts).where(F.col("global_apex_count") >= conf.manager_min_apexes).select(*ads.ACCOUNT)
    case_size = good.groupBy("case_id").agg(F.count_distinct("domain").alias("size"))
    breadth = accounts.groupBy("case_id", *ads.ACCOUNT).agg(F.count_distinct("domain").alias("n")).join(case_size, "case_id", "left")
    broad = breadth.where(F.col("n") / F.greatest(F.coalesce("size", F.lit(0)), F.lit(1)) >= conf.manager_breadth).select("case_id", *ads.ACCOUNT)
    each = each.join(wide, ads.ACCOUNT, "left_anti").join(demoted.union(broad).distinct(), ["case_id", *ads.ACCOUNT], "left_anti")
    if prevalence is not None:
        each = each.join(prevalence.where(F.col("hits") / F.col("site_count") >= conf.commodity_prevalence).select(*ads.ACCOUNT), ads.ACCOUNT, "left_anti")
    return templates.unionByName(declared).unionByName(_emitted(each, "ads_txt_seller", "seller_id", "adsystem", "place"))


def extract_signals(t: CaseTables, source_db: str, indexed_at: str, prevalence: DataFrame | None = None, bodies: DataFrame | None = None, conf: Conf = Conf(), rules: SuffixRules | None = None) -> DataFrame:
    """All kinds of signals of all cases, singletons included; of rows with one key (type, value, db, case, scan) the last stays: that of the newest capture, or of the last place in a document."""
    base = pinned(t, "own_done", "final_url", "run_at", "whois_registrar", "asn", "as_org", "tls_info_json", posts=False)
    base = base.select("case_id", "ua_id", "scan_run_id", hostname("final_url").alias("final_domain"), F.col("run_at").alias("observed_at"), "whois_registrar", "asn", "as_org", "tls_info_json")
    scan = base.select("case_id", "ua_id", "scan_run_id", "final_domain", "observed_at")
    rows = scan_signals(base)
    for part in (tracking_signals(scan, t), header_signals(scan, t, conf), endpoint_signals(scan, t, rules), ads_signals(scan, t, prevalence, bodies, conf, rules)):
        rows = rows.unionByName(part)
    titles = t.cases.select(F.col("id").alias("case_id"), F.col("title").alias("case_title"))
    rows = rows.join(titles, "case_id", "left").withColumns({"source_db": F.lit(source_db), "indexed_at": F.lit(indexed_at)})
    return last_write(rows.select(*COLUMNS, "seq"), "seq").drop("seq")


def last_write(rows: DataFrame, *order: str) -> DataFrame:
    """One row per key: the last by `order`, then by domain and platform."""
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in KEY]), F.struct(*order, "final_domain", "platform"))
    return rows.groupBy(*KEY).agg(last.alias("_last")).select(*KEY, "_last.*").select(*rows.columns)


def write_index(signals: DataFrame, path: str) -> None:
    """Replaces the partitions (source_db, case_id) that `signals` holds, and no other; a large case is written by several tasks."""
    sorted_ = signals.hint("rebalance", "source_db", "case_id").sortWithinPartitions("source_db", "case_id", "signal_type", "signal_value")
    sorted_.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_db", "case_id").parquet(path)


def lookup(signals: DataFrame, value: str, signal_type: str | None = None) -> DataFrame:
    found = signals.where(F.col("signal_value") == value)
    found = found.where(F.col("signal_type") == signal_type) if signal_type else found
    return found.orderBy(F.desc("observed_at"), "source_db", "case_id")


def recurring_signals(signals: DataFrame, min_cases: int = 2, min_domains: int = 1) -> DataFrame:
    """Values that recur over cases and domains, with the cases; those on most domains first. The platform is that of the first case that has one."""
    per = signals.groupBy("signal_type", "signal_value").agg(
        F.count_distinct(F.struct("source_db", "case_id")).alias("case_count"), F.count_distinct("final_domain").alias("domain_count"), F.count("*").alias("hit_count"), F.min_by("platform", F.when(F.col("platform").isNotNull(), F.struct("source_db", "case_id", "platform"))).alias("platform"),
        infra.sorted_set(F.struct("source_db", "case_id", "case_title")).alias("cases"),
    )
    per = per.where((F.col("case_count") >= min_cases) & (F.col("domain_count") >= min_domains))
    return per.orderBy(F.desc("domain_count"), F.desc("case_count"), F.desc("hit_count"), "signal_type", "signal_value")


def operator_cross_links(signals: DataFrame, rules: SuffixRules | None = None) -> DataFrame:
    """Endpoints that are themselves landing apexes of some case, and who calls them; case_count counts callers' cases before same-apex callers go."""
    landings = apexes(signals.where("signal_type = 'final_domain'"), rules, endpoint="signal_value").select("endpoint", "source_db", "case_id", "case_title").distinct()
    landings = landings.groupBy("endpoint").agg(infra.sorted_set(F.struct("source_db", "case_id", "case_title")).alias("investigated_as_landing_in"))
    calls = signals.where("signal_type = 'har_endpoint'").select(F.col("signal_value").alias("endpoint"), "final_domain", "source_db", "case_id").join(landings.select("endpoint"), "endpoint", "left_semi")
    calls, other = apexes(calls, rules, caller="final_domain"), F.col("caller") != F.col("endpoint")
    per = calls.groupBy("endpoint").agg(infra.sorted_set(F.when(other, F.col("final_domain"))).alias("called_by"), F.count_distinct(F.when(other, F.col("final_domain"))).alias("caller_count"), F.count_distinct(F.struct("source_db", "case_id")).alias("case_count"))
    return per.where("caller_count > 0").join(landings, "endpoint").orderBy(F.desc("caller_count"), "endpoint")
