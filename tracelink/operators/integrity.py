"""Does every claim still match the bytes it rests on. Gates fail closed: a null input is a refusal."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelink import config
from tracelink.functions.decisions import first_of, holds, verification
from tracelink.functions.parsing import directory_time, utc_text
from tracelink.functions.suffixes import SuffixRules, apexes
from tracelink.functions.urls import hostname, is_direct_ip, query_pairs
from tracelink.operators.infra import sorted_set
from tracelink.schema import CaseTables, filled, header_pairs


def referenced_directories(snapshots: DataFrame, source_db: str) -> DataFrame:
    """(dir, dbs): directories that captures point at."""
    paths = snapshots.select(F.explode(F.array("screenshot_path", "html_path", "har_path")).alias("path")).where(filled("path"))
    dirs = paths.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir")).where("dir <> ''")
    return dirs.groupBy("dir").agg(F.array(F.lit(source_db)).alias("dbs"))


def merge_references(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.groupBy("dir").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("dbs")))).alias("dbs"))


def store_directories(files: DataFrame) -> DataFrame:
    """(dir, kind, files, bytes, captured_at) of a store's directories from (path, length, content or null)."""
    head = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"
    rows = files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length", holds(head).alias("png"))
    per = rows.groupBy("dir").agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max(F.col("name") == "capture.json").alias("manifest"), F.max(F.col("name").endswith(".png") & F.col("png")).alias("shot"),
        F.max(F.col("name").endswith(".html")).alias("page"), F.max(F.col("name").endswith(".har")).alias("har"),
    )
    kind = first_of((F.col("bytes") == 0, "empty"), ((F.col("files") == 1) & F.col("manifest"), "manifest_only"), (F.col("shot") & F.col("page"), "capture"), otherwise="partial")
    return per.select("dir", kind.alias("kind"), "files", "bytes", directory_time(F.regexp_extract("dir", "([^/]*)$", 1)).alias("captured_at"))


def is_single_byte_fill(content: Column) -> Column:
    """All bytes the same, as a file system leaves behind."""
    text = F.hex(content)
    return holds((F.length(content) > 0) & (text == F.repeat(F.left(text, F.lit(2)), F.length(content))))


def reconcile(directories: DataFrame, references: DataFrame) -> DataFrame:
    """Directories with `owned`: does a database point at them."""
    return directories.join(references, "dir", "left").withColumn("owned", F.col("dbs").isNotNull())


def reconcile_report(reconciled: DataFrame) -> DataFrame:
    """(owned, kind, band, n, bytes): histogram by structure and size."""
    band = F.when(F.col("bytes") < 1 << 10, "<1K").when(F.col("bytes") < 1 << 20, "<1M").otherwise(">=1M")
    return reconciled.groupBy("owned", "kind", band.alias("band")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).orderBy("owned", "kind", "band")


def is_safe(databases: DataFrame) -> DataFrame:
    """(safe): whether every known database (name, readable) could be asked."""
    return databases.agg(F.coalesce(F.bool_and(F.coalesce("readable", F.lit(False))), F.lit(False)).alias("safe"))


def known_databases(signals: DataFrame, *names: str) -> DataFrame:
    given = signals.sparkSession.createDataFrame([(n,) for n in names], "name string")
    return signals.select(F.col("source_db").alias("name")).union(given).where(filled("name")).distinct().orderBy("name")


def verify_acquisitions(acquisitions: DataFrame, bodies: DataFrame, kind: str) -> DataFrame:
    """(id, scan_run_id, state, identity): state of each acquisition's bytes against its own claim, and the hash it may be known by."""
    rows = acquisitions.join(bodies, "body_path", "left")
    struct = F.struct("id", "kind", "scan_run_id", "body_path", "truncated", "captured_sha256", "complete_sha256")
    state = verification(struct, F.lit(kind), F.col("scan_run_id"), F.col("complete_sha256"), F.col("body_sha256"))
    return rows.select("id", "scan_run_id", state.alias("state"), F.when(state == "verified", F.col("complete_sha256")).alias("identity"))


def acquisition_health(acquisitions: DataFrame, bodies: DataFrame) -> DataFrame:
    """(health, n): ok, detached from its scan, file missing, file altered."""
    rows = acquisitions.where(filled("body_path")).join(bodies, "body_path", "left")
    health = first_of((F.col("body_sha256").isNull(), "missing"), (~F.col("body_sha256").eqNullSafe(F.col("captured_sha256")), "altered"), (F.col("scan_run_id").isNull(), "detached"), otherwise="ok")
    return rows.groupBy(health.alias("health")).agg(F.count("*").alias("n")).orderBy("health")


def expected_domains(t: CaseTables, rules: SuffixRules | None = None) -> DataFrame:
    """(scan_run_id, domains): apexes that a scan has been seen on: its URLs, its hops, its captures."""
    urls = t.url_artifacts.select(F.col("id").alias("url_artifact_id"), "original_url")
    scans = t.scan_runs.join(urls, "url_artifact_id", "left").select(F.col("id").alias("scan_run_id"), F.explode(F.array("final_url", "original_url")).alias("u"))
    hops = t.redirect_hops.select("scan_run_id", F.explode(F.array("url", "resolved_url", "location")).alias("u"))
    hosts = scans.union(hops).select("scan_run_id", hostname("u").alias("host")).union(t.snapshots.select("scan_run_id", F.lower("final_domain")))
    return apexes(hosts.where(filled("host")), rules, apex="host").groupBy("scan_run_id").agg(sorted_set("apex").alias("domains"))


def attach_decisions(claims: DataFrame, scans: DataFrame, expected: DataFrame, now: DataFrame, kinds: tuple[str, ...] = ("capture", "partial")) -> DataFrame:
    """Decision for each claim (dir, scan_run_id, kind, filled, domain, manifest_domain, captured_at, digest): attach, or why not.

    scans (scan_run_id, run_at), expected (scan_run_id, domains), now (dir, digest_now): as they are here and now.
    """
    rows = claims.join(scans, "scan_run_id", "left").join(expected, "scan_run_id", "left").join(now, "dir", "left")
    run = utc_text("run_at")
    reason = first_of(
        (~holds(F.col("kind").isin(*kinds)), "kind_not_allowed"), (F.coalesce("filled", F.lit(True)), "single_byte_fill"), (F.col("run_at").isNull() & F.col("domains").isNull(), "scan_unknown"),
        (F.col("manifest_domain").isNotNull() & F.col("domain").isNotNull() & (F.col("manifest_domain") != F.col("domain")), "artifacts_disagree"), (F.coalesce(F.size("domains"), F.lit(0)) <= 0, "nothing_to_corroborate"),
        (F.coalesce("domain", "manifest_domain").isNull(), "no_domain"), (~holds(F.array_contains("domains", F.coalesce("domain", "manifest_domain"))), "domain_never_observed"), (F.col("captured_at").isNull(), "no_capture_time"),
        (run.isNull(), "no_run_at"), (~holds(F.col("captured_at") >= run), "earlier_than_scan"), (~F.col("digest").eqNullSafe(F.col("digest_now")) | F.col("digest").isNull(), "directory_changed"), otherwise="attach",
    )
    return rows.withColumn("decision", reason)


def decision_histogram(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "decision")


def export_manifest(members: DataFrame) -> DataFrame:
    """(arcname, sha256, bytes) of (arcname, content), in order."""
    return members.select("arcname", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("bytes")).orderBy("arcname")


def manifest_hmac(manifest: DataFrame, key: bytes) -> str:
    """HMAC-SHA256 of the manifest's lines: a keyed digest of a text that fits the driver (one line per member of one case's pack)."""
    lines = (f"{r.sha256}  {r.arcname}\n" for r in manifest.orderBy("arcname").toLocalIterator())
    mac = hmac.new(key, digestmod=hashlib.sha256)
    for line in lines:
        mac.update(line.encode())
    return mac.hexdigest()


def compare_manifest(manifest: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(path, state): CHANGED, MISSING or UNTRACKED, of (path, bytes, sha256) against what is there."""
    a, b = manifest.alias("a"), on_disk.alias("b")
    joined = a.join(b, F.col("a.path") == F.col("b.path"), "full_outer")
    state = first_of((F.col("b.path").isNull(), "MISSING"), (F.col("a.path").isNull(), "UNTRACKED"), (~F.col("a.sha256").eqNullSafe(F.col("b.sha256")), "CHANGED"))
    return joined.select(F.coalesce("a.path", "b.path").alias("path"), state.alias("state")).where("state IS NOT NULL").orderBy("path")


_DOTTED = r"(?<![0-9.])((?:[0-9]{1,3}\.){3}[0-9]{1,3})(?![0-9.])"
_PRIVATE = r"^(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])|2(?:2[4-9]|3[0-9]|4[0-9]|5[0-5]))\."


def is_public_ipv4(address: Column) -> Column:
    return is_direct_ip(address) & ~address.contains(":") & ~address.rlike(_PRIVATE)


def echoed_addresses(entries: DataFrame) -> DataFrame:
    """(capture, address): public addresses that responses echo, by header, query key, /ip/ path or body; those of servers and hosts are not.

    entries: (capture, url, server_ip, response_headers_json, body).
    """
    headers = F.transform(F.filter(header_pairs(), lambda p: p["header"].isin(config.ECHO_HEADERS)), lambda p: p["value"])
    keys = F.transform(F.filter(query_pairs("url"), lambda p: F.lower(p["key"]).isin(config.ECHO_KEYS)), lambda p: p["value"])
    path = F.array(F.regexp_extract("url", r"/ip/([0-9.]+)", 1))
    texts = F.concat(headers, keys, path, F.array(F.coalesce("body", F.lit(""))))
    found = F.array_distinct(F.flatten(F.transform(texts, lambda x: F.regexp_extract_all(x, F.lit(_DOTTED), F.lit(1)))))
    rows = entries.select("capture", F.explode(found).alias("address")).where(is_public_ipv4(F.col("address"))).distinct()
    servers = entries.select("capture", F.explode(F.array("server_ip", hostname("url"))).alias("address")).distinct()
    return rows.join(servers, ["capture", "address"], "left_anti")


def redact(text: Column, addresses: Column, mask: str = "[redacted]") -> Column:
    """Longest addresses first, so that none is left inside another."""
    longest = F.reverse(F.array_sort(F.transform(addresses, lambda a: F.struct(F.length(a).alias("n"), a.alias("a")))))
    return F.aggregate(longest, text, lambda acc, x: F.replace(acc, x["a"], F.lit(mask)))


def occurrences(text: Column, addresses: Column) -> Column:
    return F.aggregate(addresses, F.lit(0), lambda n, a: n + F.size(F.split(text, F.concat(F.lit(r"\Q"), a, F.lit(r"\E")), -1)) - 1)


def redacted_har(har: Column, addresses: Column) -> Column:
    """The redacted text, or null where it no longer parses."""
    out = redact(har, addresses)
    return F.when(F.try_parse_json(out).isNotNull(), out)


def ip_summary(hits: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(captures, addresses, screenshots): captures with hits, distinct addresses, screenshots that someone has to look at."""
    shots = snapshots.where(filled("screenshot_path")).select(F.col("id").alias("capture"), F.lit(1).alias("shot"))
    joined = hits.join(shots, "capture", "left")
    return joined.agg(F.count_distinct("capture").alias("captures"), F.count_distinct("address").alias("addresses"), F.count_distinct(F.when(F.col("shot") == 1, F.col("capture"))).alias("screenshots"))


def foreign_key_orphans(t: CaseTables) -> DataFrame:
    """(relation, n): rows whose parent isn't there."""
    links = [
        ("message_evidence.case_id", t.message_evidence, "case_id", t.cases), ("url_artifacts.message_id", t.url_artifacts, "message_id", t.message_evidence), ("scan_runs.url_artifact_id", t.scan_runs, "url_artifact_id", t.url_artifacts),
        ("redirect_hops.scan_run_id", t.redirect_hops, "scan_run_id", t.scan_runs), ("snapshots.scan_run_id", t.snapshots, "scan_run_id", t.scan_runs), ("acquisitions.scan_run_id", t.acquisitions, "scan_run_id", t.scan_runs),
    ]
    out = None
    for name, child, key, parent in links:
        lost = child.where(F.col(key).isNotNull()).join(parent.select(F.col("id").alias(key)), key, "left_anti").agg(F.lit(name).alias("relation"), F.count("*").alias("n"))
        out = lost if out is None else out.union(lost)
    return out.select("relation", "n")
