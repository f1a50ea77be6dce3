"""Row pinning: which scan and which captures of a URL an operator reads.

A correlated scalar subquery in a join condition becomes one or two aggregates and an equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelink.schema import CaseTables, filled


def own_scan(t: CaseTables, done: bool = True) -> DataFrame:
    """(url_artifact_id, scan_run_id): each artifact's newest scan, of its own only."""
    scans = t.scan_runs.where("status = 'done'") if done else t.scan_runs
    return scans.where("url_artifact_id IS NOT NULL").groupBy("url_artifact_id").agg(F.max("id").alias("scan_run_id"))


def url_scan(t: CaseTables, done: bool = True) -> DataFrame:
    """(url_artifact_id, scan_run_id): the own newest scan, or else the newest of an artifact with the same URL in the same case."""
    own = own_scan(t, done)
    urls = t.url_artifacts.select(F.col("id").alias("url_artifact_id"), "case_id", "original_url")
    both = urls.join(own, "url_artifact_id", "left")
    sibling = both.groupBy("case_id", "original_url").agg(F.max("scan_run_id").alias("sibling"))
    joined = both.join(sibling, ["case_id", "original_url"], "left").select("url_artifact_id", F.coalesce("scan_run_id", "sibling").alias("scan_run_id"))
    return joined.where("scan_run_id IS NOT NULL")


PINS = {"own_done": lambda t: own_scan(t), "own_any": lambda t: own_scan(t, False), "url_done": lambda t: url_scan(t), "url_any": lambda t: url_scan(t, False)}


def pinned(t: CaseTables, pin: str, *scan_columns: str, how: str = "inner", posts: bool = True) -> DataFrame:
    """(case_id, ua_id, post_id, original_url, scan_run_id, columns of the pinned scan) per artifact; posts=False keeps artifacts whose post isn't there."""
    columns = ["case_id", "ua_id", "post_id", "original_url", "scan_run_id", *scan_columns]
    stored = getattr(t, "pin_tables", {})
    if pin in stored:
        chosen = stored[pin].select(*columns, "has_post")
        if how != "inner":
            chosen = chosen.unionByName(stored[f"{pin}_none"], allowMissingColumns=True)
        return (chosen.where("has_post") if posts else chosen).select(*columns)
    urls = t.url_artifacts.select(F.col("id").alias("ua_id"), F.col("message_id").alias("post_id"), "case_id", "original_url")
    scans = t.scan_runs.select(F.col("id").alias("scan_run_id"), *scan_columns)
    base = urls.join(t.message_evidence.select(F.col("id").alias("post_id")), "post_id", "left_semi") if posts else urls
    base = base.join(PINS[pin](t).withColumnRenamed("url_artifact_id", "ua_id"), "ua_id", how)
    return base.join(scans, "scan_run_id", how).select(*columns)


def usable_snapshots(t: CaseTables, column: str) -> DataFrame:
    """Every good capture whose `column` holds something: all personas of a scan count."""
    if column not in t.snapshots.columns:
        raise ValueError(f"no such column: {column}")
    return t.snapshots.where((F.col("capture_status") == "ok") & filled(column))


def latest_snapshot(t: CaseTables) -> DataFrame:
    """The newest capture of each scan, whatever its status."""
    if "newest" in t.snapshots.columns:  # stored with the mark
        return t.snapshots.where("newest").drop("newest")
    newest = t.snapshots.groupBy("scan_run_id").agg(F.max("id").alias("id"))
    return t.snapshots.join(newest.select("id"), "id", "left_semi")


def browser_captures(t: CaseTables) -> DataFrame:
    """scan_run_id of scans that a browser, an analyst or an archive has captured; light fetches and alternative personas don't count.

    Analyst's and archive's captures are told by their status. A capture without status counts by its screenshot, one without method as the browser's.
    """
    method, status = F.col("capture_method"), F.coalesce("capture_status", F.lit(""))
    good = ((status == "ok") & (F.coalesce(method, F.lit("playwright")) == "playwright")) | status.isin("manual", "wayback") | ((status == "") & filled("screenshot_path"))
    return t.snapshots.where(good).select("scan_run_id").distinct()


def unscanned_urls(t: CaseTables) -> DataFrame:
    """(case_id, original_url, url_artifact_id): URLs that no artifact of the case has scanned, by their first artifact."""
    scanned = t.scan_runs.select(F.col("url_artifact_id").alias("id"))
    urls = t.url_artifacts.select("id", "case_id", "original_url")
    done = urls.join(scanned, "id", "left_semi").select("case_id", "original_url")
    return urls.join(done, ["case_id", "original_url"], "left_anti").groupBy("case_id", "original_url").agg(F.min("id").alias("url_artifact_id"))


def covered_by_sibling(t: CaseTables) -> DataFrame:
    """(case_id, covered): artifacts without a scan of their own whose URL another artifact has scanned."""
    urls = t.url_artifacts.select(F.col("id").alias("url_artifact_id"), "case_id")
    counted = urls.join(own_scan(t, False).withColumn("own", F.lit(1)), "url_artifact_id", "left")
    any_ = url_scan(t, False).select("url_artifact_id", F.lit(1).alias("any"))
    return counted.join(any_, "url_artifact_id", "left").groupBy("case_id").agg((F.count("any") - F.count("own")).alias("covered"))


def scans_needing(t: CaseTables) -> DataFrame:
    """(scan_run_id, needs_html, needs_ads_txt, needs_enrichment) of the newest finished scans."""
    last = own_scan(t).select("scan_run_id")
    light = t.snapshots.groupBy("scan_run_id").agg(F.count_if((F.col("capture_method") == "http_only") & (F.col("capture_status") == "ok")).alias("n"))
    scans = t.scan_runs.withColumnRenamed("id", "scan_run_id").join(last, "scan_run_id", "left_semi").join(light, "scan_run_id", "left")
    return scans.select("scan_run_id", (F.coalesce("n", F.lit(0)) == 0).alias("needs_html"), (~filled("ads_txt_json")).alias("needs_ads_txt"), (~filled("domain_enriched_at")).alias("needs_enrichment"))


def pending_snapshots(t: CaseTables, files: DataFrame | None = None) -> DataFrame:
    """(case_id, ua_id, scan_run_id, final_url) of finished scans without a browser capture.

    files (path): if given, a capture counts only while its screenshot is there.
    """
    captured = browser_captures(t)
    if files is not None:
        shots = t.snapshots.where(filled("screenshot_path")).join(files.select(F.col("path").alias("screenshot_path")), "screenshot_path", "left_semi")
        captured = captured.join(shots.select("scan_run_id"), "scan_run_id", "left_semi")
    return pinned(t, "own_done", "final_url").join(captured, "scan_run_id", "left_anti").select("case_id", "ua_id", "scan_run_id", "final_url")


def case_list(t: CaseTables) -> DataFrame:
    """(case_id, title, url_count, scan_count), newest case first."""
    urls = t.url_artifacts.groupBy("case_id").agg(F.count("*").alias("url_count"))
    of = t.url_artifacts.select(F.col("id").alias("url_artifact_id"), "case_id")
    scans = t.scan_runs.join(of, "url_artifact_id").groupBy("case_id").agg(F.count("*").alias("scan_count"))
    cases = t.cases.select(F.col("id").alias("case_id"), "title").join(urls, "case_id", "left").join(scans, "case_id", "left")
    return cases.fillna(0, ["url_count", "scan_count"]).orderBy(F.desc("case_id"))


def case_show(t: CaseTables) -> DataFrame:
    """(case_id, url_count, scanned, unscanned, pending); pending are scans without a browser capture."""
    counts = case_counts(t)
    of = t.url_artifacts.select(F.col("id").alias("url_artifact_id"), "case_id")
    scans = t.scan_runs.select(F.col("id").alias("scan_run_id"), "url_artifact_id").join(browser_captures(t), "scan_run_id", "left_anti")
    pending = scans.join(of, "url_artifact_id").groupBy("case_id").agg(F.count("*").alias("pending"))
    return counts.select("case_id", F.col("total").alias("url_count"), "scanned", (F.col("total") - F.col("scanned")).alias("unscanned")).join(pending, "case_id", "left").fillna(0, ["pending"])


def case_counts(t: CaseTables) -> DataFrame:
    """(case_id, total, scanned): artifacts, and those whose own newest scan is finished."""
    done = t.scan_runs.where("status = 'done'").select(F.col("id").alias("scan_run_id"))
    scanned = own_scan(t, False).join(done, "scan_run_id", "left_semi").select(F.col("url_artifact_id").alias("id"), F.lit(1).alias("one"))
    return t.url_artifacts.select("id", "case_id").join(scanned, "id", "left").groupBy("case_id").agg(F.count("*").alias("total"), F.count("one").alias("scanned"))


def require_case(t: CaseTables, case_id: int) -> DataFrame:
    found = t.cases.where(F.col("id") == case_id)
    if found.isEmpty():
        raise LookupError(f"no case {case_id}")
    return found


def delete_case(t: CaseTables, case_id: int) -> CaseTables:
    """The tables without a case; its acquisitions stay, detached from their scans."""
    gone_urls = t.url_artifacts.where(F.col("case_id") == case_id).select(F.col("id").alias("url_artifact_id"))
    gone = t.scan_runs.join(gone_urls, "url_artifact_id", "left_semi").select(F.col("id").alias("scan_run_id"))
    marked = t.acquisitions.join(gone.withColumn("gone", F.lit(True)), "scan_run_id", "left")
    kept = marked.withColumn("scan_run_id", F.when(F.col("gone").isNull(), F.col("scan_run_id"))).select(*t.acquisitions.columns)
    other = F.col("case_id") != case_id
    return CaseTables(
        t.cases.where(F.col("id") != case_id), t.message_evidence.where(other), t.url_artifacts.where(other), t.scan_runs.join(gone_urls, "url_artifact_id", "left_anti"),
        t.redirect_hops.join(gone, "scan_run_id", "left_anti"), t.snapshots.join(gone, "scan_run_id", "left_anti"), kept,
    )


def with_locale(cases: DataFrame, presets: DataFrame) -> DataFrame:
    """Cases with browser_locale and browser_timezone filled from (preset, locale, timezone); what a case states itself goes first."""
    joined = cases.join(presets, "preset", "left")
    return joined.withColumns({"browser_locale": F.coalesce("browser_locale", "locale"), "browser_timezone": F.coalesce("browser_timezone", "timezone")}).drop("locale", "timezone", "preset")


def reclaim_stuck(scans: DataFrame, cutoff: str) -> DataFrame:
    """Scans with those that run since before `cutoff` marked lease_expired."""
    stuck = (F.col("status") == "running") & (F.col("run_at") < cutoff)
    return scans.withColumn("status", F.when(F.coalesce(stuck, F.lit(False)), "lease_expired").otherwise(F.col("status")))
