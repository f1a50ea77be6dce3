"""Evasion profiles, evidence gaps, coverage and the readings that are made of other operators' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelink.config import Conf
from tracelink.functions.decisions import SUCCESS, first_of, opsec_level, opsec_reason
from tracelink.functions.urls import hostname
from tracelink.operators.pins import browser_captures, pinned
from tracelink.schema import CaseTables, filled


def capture_rows(t: CaseTables) -> DataFrame:
    """(case_id, domain, capture_method, ok) of every capture of every scan."""
    of = t.url_artifacts.select(F.col("id").alias("url_artifact_id"), "case_id", "original_url")
    scans = t.scan_runs.select(F.col("id").alias("scan_run_id"), "url_artifact_id", F.col("final_url").alias("scan_url")).join(of, "url_artifact_id")
    domain = F.coalesce(F.nullif(F.lower("final_domain"), F.lit("")), hostname(F.coalesce("scan_url", "original_url")))
    return t.snapshots.join(scans, "scan_run_id").select("case_id", domain.alias("domain"), "capture_method", F.coalesce(F.col("capture_status").isin(*SUCCESS), F.lit(False)).alias("ok"))


def opsec_profile(rows: DataFrame, conf: Conf = Conf()) -> DataFrame:
    """Per domain the success rates of the light and the browser capture, and the evasion level these give.

    A rate without captures is null, which is indeterminate and never none.
    """
    light, browser = F.col("capture_method") == "http_only", F.col("capture_method") == "playwright"
    per = rows.where(filled("domain")).groupBy("case_id", "domain").agg(
        F.count_if(light & F.col("ok")).alias("lw_ok"), F.count_if(light).alias("lw_total"), F.count_if(browser & F.col("ok")).alias("pw_ok"), F.count_if(browser).alias("pw_total")
    )
    per = per.withColumns({"lw_rate": F.try_divide("lw_ok", "lw_total"), "pw_rate": F.try_divide("pw_ok", "pw_total")})
    return per.withColumns({
        "level": opsec_level(F.col("lw_rate"), F.col("pw_rate"), conf), "indeterminate_reason": opsec_reason(F.col("lw_total"), F.col("pw_total"), F.col("pw_rate"), conf),
        "diff_above_50": F.coalesce(F.col("pw_rate") - F.col("lw_rate") > 0.5, F.lit(False)),
    }).orderBy("case_id", "domain")


def opsec_gap(profile: DataFrame) -> DataFrame:
    return profile.where("level = 'indeterminate'").groupBy("case_id", "indeterminate_reason").agg(F.count("*").alias("n"))


def cloaking_suspects(t: CaseTables) -> DataFrame:
    rows = pinned(t, "own_done", "cloaking_signal_json", posts=False)
    suspect = F.get_json_object("cloaking_signal_json", "$.verdict") == "cloaking_suspect"
    return rows.groupBy("case_id").agg(F.count_distinct(F.when(suspect, F.col("original_url"))).alias("suspects"))


def evidence_gaps(t: CaseTables) -> DataFrame:
    """What artifacts whose newest scan is finished lack: intel and captures where it landed, certificates where it landed on https, corroboration; and artifacts without such a scan. One pass."""
    captured = t.snapshots.select("scan_run_id").distinct().withColumn("captured", F.lit(True))
    rows = pinned(t, "own_any", "status", "final_url", "domain_enriched_at", "tls_info_json", "corroboration_json", how="left", posts=False).join(captured, "scan_run_id", "left")
    done = F.coalesce(F.col("status") == "done", F.lit(False))
    landed = done & F.col("final_url").isNotNull()
    return rows.groupBy("case_id").agg(
        F.count_if(landed & ~filled("domain_enriched_at")).alias("no_intel"), F.count_if(landed & F.col("captured").isNull()).alias("no_snapshot"), F.count_if(landed & F.lower("final_url").startswith("https") & ~filled("tls_info_json")).alias("no_tls"),
        F.count_if(done & ~filled("corroboration_json")).alias("no_corroboration"), F.count_if(~done).alias("unscanned"),
    )


def risk_tag_histogram(rows: DataFrame) -> DataFrame:
    """(case_id, tag, n): URLs of each landing host that carry a tag, whichever of a URL's artifacts has it. rows: of `url.destination_rows`."""
    each = rows.select("case_id", "final_domain", "original_url", F.explode("tags").alias("tag")).distinct()
    return each.groupBy("case_id", "tag").agg(F.count("*").alias("n")).orderBy("case_id", F.desc("n"), "tag")


def case_domain_count(t: CaseTables) -> DataFrame:
    """Distinct landing domains over all captures."""
    of = t.url_artifacts.select(F.col("id").alias("url_artifact_id"), "case_id")
    scans = t.scan_runs.select(F.col("id").alias("scan_run_id"), "url_artifact_id").join(of, "url_artifact_id")
    return t.snapshots.where(filled("final_domain")).join(scans, "scan_run_id").groupBy("case_id").agg(F.count_distinct(F.lower("final_domain")).alias("domain_count"))


def completeness(t: CaseTables) -> DataFrame:
    """(case_id, scanned, page_captured, tls, ads_txt, level, gaps): four flags and the level they give."""
    captured = browser_captures(t).withColumn("c", F.lit(True))
    rows = pinned(t, "own_done", "tls_info_json", "ads_txt_json").join(captured, "scan_run_id", "left")
    flags = rows.groupBy("case_id").agg(F.lit(True).alias("scanned"), F.max(F.col("c").isNotNull()).alias("page_captured"), F.max(filled("tls_info_json")).alias("tls"), F.max(filled("ads_txt_json")).alias("ads_txt"))
    names = ["scanned", "page_captured", "tls", "ads_txt"]
    out = t.cases.select(F.col("id").alias("case_id")).join(flags, "case_id", "left").fillna(False, names)
    held = sum((F.col(n).cast("int") for n in names), F.lit(0))
    gaps = F.array_compact(F.array(*[F.when(~F.col(n), F.lit(n)) for n in names]))
    return out.withColumns({"level": F.when(held == 4, "高").when(held >= 2, "中").otherwise("低"), "gaps": gaps})


def signal_summary(**operators: DataFrame) -> DataFrame:
    """(case_id, operator, n): how many rows each named operator has per case."""
    parts = [df.groupBy("case_id").agg(F.count("*").alias("n")).select("case_id", F.lit(name).alias("operator"), "n") for name, df in operators.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.orderBy("case_id", "operator")


#: Operators by the kind of evidence they are.
CLASSES = {
    "grouping": ["tracking", "certificates", "header_templates", "verified_templates"],
    "behaviour": ["cloaking", "fake_versions", "strong_opsec"],
    "money": ["operator_accounts"],
}


def evidence_coverage(summary: DataFrame, conf: Conf = Conf()) -> DataFrame:
    """(case_id, score): weighted, capped evidence as a share of the most there can be, 0 to 100."""
    weights = dict(zip(CLASSES, conf.coverage_weights, strict=True))
    sums = [F.sum(F.when(F.col("operator").isin(names), F.col("n")).otherwise(0)).alias(kind) for kind, names in CLASSES.items()]
    capped = sum((F.least(F.col(k), F.lit(conf.coverage_cap)) * w for k, w in weights.items()), F.lit(0))
    per = summary.groupBy("case_id").agg(*sums)
    return per.withColumn("score", F.bround(100 * capped / (conf.coverage_cap * sum(weights.values()))).cast("int"))


def verdicts(coverage: DataFrame) -> DataFrame:
    """The reading of a case: what kinds of evidence there are, strongest first."""
    tier = first_of(((F.col("grouping") > 0) & ((F.col("behaviour") > 0) | (F.col("money") > 0)), "coordinated"), (F.col("grouping") > 0, "linked"), (F.col("behaviour") > 0, "suspicious"), (F.col("money") > 0, "monetised"), otherwise="no_signal")
    reasons = F.array_compact(F.array(*[F.when(F.col(k) > 0, F.format_string(f"{k}: %d", F.col(k))) for k in CLASSES]))
    return coverage.withColumns({"verdict": tier, "reasons": reasons, "text": F.concat_ws("; ", F.col("verdict"), reasons)})


def insight_bullets(limit: int = 17, per_source: int = 3, **sources: tuple[DataFrame, str, str]) -> DataFrame:
    """(case_id, place, source, bullet): the first rows of each source in its own order, at most `limit` per case.

    sources: name=(rows, column that ranks them, largest first; SQL text of the bullet).
    """
    parts = None
    for number, (name, (rows, rank, text)) in enumerate(sources.items()):
        line = Window.partitionBy("case_id").orderBy(F.desc(rank), "bullet")
        part = rows.select("case_id", rank, F.expr(text).alias("bullet")).withColumn("k", F.row_number().over(line)).where(F.col("k") <= per_source)
        part = part.select("case_id", F.lit(number).alias("s"), "k", F.lit(name).alias("source"), "bullet")
        parts = part if parts is None else parts.union(part)
    line = Window.partitionBy("case_id").orderBy("s", "k")
    return parts.withColumn("place", F.row_number().over(line)).where(F.col("place") <= limit).select("case_id", "place", "source", "bullet")


def chunk_failures(results: DataFrame, size: int, bad_share: float = 0.8, in_a_row: int = 3) -> DataFrame:
    """(batch, chunk, ok, total, bad, run, abort) of capture results (batch, seq, ok): runs of bad chunks, and where a batch gives up."""
    per = results.groupBy("batch", F.floor(F.col("seq") / size).alias("chunk")).agg(F.count_if("ok").alias("ok"), F.count("*").alias("total"))
    per = per.withColumn("bad", (F.col("total") - F.col("ok")) / F.col("total") >= bad_share)
    line = Window.partitionBy("batch").orderBy("chunk")
    per = per.withColumn("island", F.sum((~F.col("bad")).cast("int")).over(line))
    run = F.sum(F.col("bad").cast("int")).over(Window.partitionBy("batch", "island").orderBy("chunk"))
    return per.withColumn("run", run).withColumn("abort", F.col("run") >= in_a_row).drop("island")


def capture_report(snapshots: DataFrame) -> DataFrame:
    """(capture_status, n, ip_hits): histogram of a batch."""
    hits = F.count_if(F.size(F.from_json(F.get_json_object("investigator_ip_json", "$.addresses"), "ARRAY<STRING>")) > 0)
    return snapshots.groupBy(F.coalesce("capture_status", F.lit("none")).alias("capture_status")).agg(F.count("*").alias("n"), hits.alias("ip_hits")).orderBy(F.desc("n"), "capture_status")


def evidence_by_domain(t: CaseTables, files: DataFrame, conf: Conf = Conf()) -> DataFrame:
    """Per case and landing domain: captures, screenshots, files that are gone, methods, directories, first samples. files: (path)."""
    of = t.url_artifacts.select(F.col("id").alias("url_artifact_id"), "case_id")
    scans = t.scan_runs.select(F.col("id").alias("scan_run_id"), "url_artifact_id").join(of, "url_artifact_id")
    rows = t.snapshots.where(filled("final_domain")).join(scans, "scan_run_id")
    paths = rows.select("case_id", F.lower("final_domain").alias("domain"), F.explode(F.array("screenshot_path", "html_path", "har_path")).alias("path")).where(filled("path"))
    lost = paths.join(files.select("path").distinct().withColumn("there", F.lit(1)), "path", "left")
    lost = lost.withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).groupBy("case_id", "domain").agg(F.count_if(F.col("there").isNull()).alias("missing"), F.array_sort(F.collect_set("dir")).alias("dirs"))
    per = rows.groupBy("case_id", F.lower("final_domain").alias("domain")).agg(F.count("*").alias("captures"), F.count_if(filled("screenshot_path")).alias("screenshots"), F.array_sort(F.collect_set("capture_method")).alias("methods"))
    out = per.join(lost, ["case_id", "domain"], "left").withColumn("sample", F.slice("dirs", 1, 3))
    return out.fillna(0, ["missing"]).orderBy("case_id", F.desc("captures"), "domain")


