"""Decision lists: the first condition that holds decides, and a null input never passes a gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelink.config import Conf

SUCCESS = ("ok", "wayback", "manual")
CLUSTER_ORDER = ["hash_disagrees", "body_mismatch", "wrong_scan_run", "wrong_kind", "body_missing", "truncated"]
VERDICT_RANK = ["template_match", "no_match", "no_ads_txt", "off_site_redirect", "unreachable"]


def holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def first_of(*cases: tuple[Column, str], otherwise: str | None = None) -> Column:
    found = F.lit(None).cast("string") if otherwise is None else F.lit(otherwise)
    for condition, name in reversed(cases):
        found = F.when(holds(condition), F.lit(name)).otherwise(found)
    return found


def rank_of(value: Column, order: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), value)


def opsec_level(light: Column, browser: Column, conf: Conf = Conf()) -> Column:
    return first_of(
        (light.isNull() | browser.isNull() | (browser < conf.opsec_browser), "indeterminate"), (light >= conf.opsec_high, "low"), (light >= conf.opsec_low, "medium"), otherwise="strong"
    )


def opsec_reason(light_total: Column, browser_total: Column, browser: Column, conf: Conf = Conf()) -> Column:
    return first_of(
        ((light_total == 0) & (browser_total == 0), "no_capture"), (light_total == 0, "no_lightweight"), (browser_total == 0, "no_playwright"), (browser < conf.opsec_browser, "playwright_unreliable")
    )


def cloaking(with_: Column, without: Column, stripped: Column, changed: Column, conf: Conf = Conf()) -> Column:
    """struct<verdict, diffs> of two fetch summaries struct<error, status_code, final_domain, body_sha256, body_size>."""
    largest = F.greatest(with_["body_size"], without["body_size"])
    size = (largest > 0) & (F.abs(with_["body_size"] - without["body_size"]) / largest > conf.cloaking_size)
    differs = lambda name: ~with_[name].eqNullSafe(without[name])
    diffs = F.array_compact(
        F.array(
            F.when(differs("status_code"), "status_code"), F.when(differs("final_domain"), "final_domain"), F.when(differs("body_sha256"), "body_content"), F.when(holds(size), "body_size")
        )
    )
    verdict = first_of(
        ((F.coalesce(F.size(stripped), F.lit(0)) == 0) | ~holds(changed), "no_tracking_params"), (with_["error"].isNotNull() | without["error"].isNotNull(), "fetch_error"), (F.size(diffs) > 0, "cloaking_suspect"), otherwise="no_cloaking"
    )
    return F.struct(verdict.alias("verdict"), F.when(verdict == "cloaking_suspect", diffs).otherwise(F.array().cast("array<string>")).alias("diffs"))


def capture_status(error: Column, has_shot: Column, has_html: Column, wayback: Column, blocked: Column) -> Column:
    """Status of a capture from what it left behind."""
    late = F.lower(F.coalesce(error, F.lit(""))).rlike("timed out|stalled")
    noted = F.coalesce(error, F.lit("")) != ""
    return first_of(
        (wayback & has_html, "wayback"), (late, "timeout"), (~has_shot & ~has_html, "file_missing"), (~has_shot & blocked, "cf_challenge"), (~has_shot, "error"),
        (has_html & blocked, "cf_challenge"), (has_html & noted, "error"), (has_html, "ok"), otherwise="error",
    )


def verification(row: Column, kind: Column, scan_run: Column, claim: Column, body: Column) -> Column:
    """State of retained bytes. row: the acquisition (null: none); body: struct<sha256> of the file (null: absent)."""
    return first_of(
        (row["id"].isNull(), "body_missing"), (~row["kind"].eqNullSafe(kind), "wrong_kind"), (~row["scan_run_id"].eqNullSafe(scan_run), "wrong_scan_run"),
        (F.coalesce(row["body_path"], F.lit("")) == "", "legacy_unverifiable"), (body.isNull(), "body_missing"), (~body.eqNullSafe(row["captured_sha256"]), "body_mismatch"),
        (F.coalesce(row["truncated"], F.lit(False)) | row["complete_sha256"].isNull(), "truncated"), (~row["complete_sha256"].eqNullSafe(claim), "hash_disagrees"), otherwise="verified",
    )


def screening(status: Column, records: Column, known: Column) -> Column:
    return first_of(
        (status.isNull(), "unreachable"), (((status != "ok") | (F.coalesce(records, F.lit(0)) == 0)) & (status == "error"), "unreachable"),
        (((status != "ok") | (F.coalesce(records, F.lit(0)) == 0)) & (status == "off_site_redirect"), "off_site_redirect"),
        ((status != "ok") | (F.coalesce(records, F.lit(0)) == 0), "no_ads_txt"), (known, "template_match"), otherwise="no_match",
    )
