"""Dates, headers, ads.txt bodies and other text formats as Column builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelink import config
from tracelink.functions.urls import hostname, identify_param, naive_apex, registrable_domain

_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"
#: Formats of a post's time besides ISO-8601, in the order in which they are tried.
POSTED_FORMATS = ["yyyy-MM-dd HH:mm:ss 'UTC'", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(text: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_col(text), r"^\s+|\s+$", "")


def openssl_date(text: Column | str) -> Column:
    """Timestamp of `Apr  7 00:00:00 2026 GMT`, with or without the zone."""
    one = F.regexp_replace(stripped(text), r"\s+", " ")
    zoned = F.try_to_timestamp(one, F.lit("MMM d HH:mm:ss yyyy z"))
    return F.coalesce(zoned, F.try_to_timestamp(one, F.lit("MMM d HH:mm:ss yyyy")))


def utc_text(text: Column | str) -> Column:
    """Timestamp of `2026-08-05 10:00:00 UTC`."""
    return F.try_to_timestamp(F.regexp_replace(_col(text), r"\s*UTC$", ""), F.lit("yyyy-MM-dd HH:mm:ss"))


def posted_at(text: Column | str) -> Column:
    """Timestamp in UTC of a post's time; blank and unreadable become null."""
    t = stripped(text)
    iso = F.when(t.rlike(_ISO), F.try_to_timestamp(F.regexp_replace(t, r"\s*UTC$", "Z")))
    return F.coalesce(iso, *[F.try_to_timestamp(t, F.lit(f)) for f in POSTED_FORMATS])


def whois_date(text: Column | str) -> Column:
    """Date of the first readable value: year first, or day-month-year with a month's name, or with dots."""
    t = F.coalesce(_col(text), F.lit(""))
    iso = F.regexp_extract(t, r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", 0)
    named = F.regexp_extract(t, r"(\d{1,2}-[A-Za-z]{3}-\d{4})", 1)
    dotted = F.regexp_extract(t, r"(\d{1,2}\.\d{1,2}\.\d{4})", 1)
    return F.coalesce(
        F.to_date(F.try_to_timestamp(F.regexp_replace(iso, "[/.]", "-"), F.lit("y-M-d"))),
        F.to_date(F.try_to_timestamp(F.initcap(named), F.lit("d-MMM-y"))), F.to_date(F.try_to_timestamp(dotted, F.lit("d.M.y"))),
    )


def is_new_domain(created: Column, reference: Column, days: int = config.Conf.new_domain_days) -> Column:
    """Under so many whole days old at the reference time; created later counts as new."""
    seconds = F.unix_timestamp(reference) - F.unix_timestamp(created.cast("timestamp"))
    return F.coalesce(F.floor(seconds / 86400) < days, F.lit(False))


def _first_of(value: Column) -> Column:
    """A value that may be a JSON list: its first element."""
    return F.when(value.startswith("["), F.coalesce(F.from_json(value, "ARRAY<STRING>")[0], value)).otherwise(value)


def issuer_label(issuer: Column) -> Column:
    """`Organisation (common name)`, or the one that is there or that both are; empty for neither."""
    org, name = (_first_of(F.try_element_at(issuer, F.lit(k))) for k in ("organizationName", "commonName"))
    both = F.concat(org, F.lit(" ("), name, F.lit(")"))
    return F.when((F.coalesce(org, F.lit("")) != "") & (F.coalesce(name, F.lit("")) != "") & (org != name), both).otherwise(F.coalesce(F.nullif(org, F.lit("")), name, F.lit("")))


def issuer_text(issuer: Column) -> Column:
    """The organisation, or else the common name."""
    org, name = (_first_of(F.try_element_at(issuer, F.lit(k))) for k in ("organizationName", "commonName"))
    return F.coalesce(F.nullif(org, F.lit("")), name, F.lit(""))


def set_cookie(value: Column | str) -> Column:
    """struct<domain, path, httponly, secure, samesite> of a Set-Cookie header's attributes."""
    v = _col(value)
    attribute = lambda name: F.lower(F.regexp_extract(v, rf"(?i);\s*{name}\s*=\s*\.?([^;]*)", 1))
    return F.struct(
        stripped(attribute("domain")).alias("domain"), stripped(F.regexp_extract(v, r"(?i);\s*path\s*=\s*([^;]*)", 1)).alias("path"),
        v.rlike(r"(?i);\s*httponly\s*(;|$)").alias("httponly"), v.rlike(r"(?i);\s*secure\s*(;|$)").alias("secure"), stripped(attribute("samesite")).alias("samesite"),
    )


def ads_txt_body(text: Column | str) -> Column:
    """struct<owner_domain, manager_domain, records> of an ads.txt body.

    A line is cut at `#`. One with `=` and no comma before it sets a variable (the last non-empty setting counts);
    others are records if they have three fields and the first two aren't empty.
    """
    lines = F.transform(F.split(F.coalesce(_col(text), F.lit("")), r"\R"), lambda x: stripped(F.regexp_replace(x, "(?s)#.*$", "")))
    is_variable = lambda x: x.rlike("^[^,=]*=")

    def variable(name: str) -> Column:
        values = F.transform(F.filter(lines, lambda x: is_variable(x) & (F.upper(stripped(F.regexp_extract(x, "^([^=]*)=", 1))) == name)), lambda x: stripped(F.regexp_extract(x, "^[^=]*=(.*)$", 1)))
        return F.lower(F.try_element_at(F.filter(values, lambda x: x != ""), F.lit(-1)))

    fields = F.transform(F.filter(lines, lambda x: ~is_variable(x)), lambda x: F.transform(F.split(x, ","), stripped))
    good = F.filter(fields, lambda p: (F.size(p) >= 3) & (p[0] != "") & (p[1] != ""))
    records = F.transform(
        good,
        lambda p: F.struct(F.lower(p[0]).alias("adsystem"), p[1].alias("seller_id"), F.upper(p[2]).alias("relationship"), F.nullif(F.coalesce(F.get(p, F.lit(3)), F.lit("")), F.lit("")).alias("cert_authority_id")),
    )
    manager = stripped(F.split(variable("MANAGERDOMAIN"), ",")[0])
    return F.struct(variable("OWNERDOMAIN").alias("owner_domain"), F.nullif(manager, F.lit("")).alias("manager_domain"), records.alias("records"))


def declared_url(html: Column | str) -> Column:
    """Canonical link, or else og:url, of the first 64 Ki characters."""
    head = F.left(_col(html), F.lit(65536))
    canonical = F.coalesce(F.nullif(F.regexp_extract(head, r"(?is)<link\b[^>]*\brel\s*=\s*['\"]canonical['\"][^>]*\bhref\s*=\s*['\"]([^'\"]+)", 1), F.lit("")), F.nullif(F.regexp_extract(head, r"(?is)<link\b[^>]*\bhref\s*=\s*['\"]([^'\"]+)['\"][^>]*\brel\s*=\s*['\"]canonical['\"]", 1), F.lit("")))
    graph = F.nullif(F.regexp_extract(head, r"(?is)<meta\b[^>]*\bproperty\s*=\s*['\"]og:url['\"][^>]*\bcontent\s*=\s*['\"]([^'\"]+)", 1), F.lit(""))
    return F.coalesce(canonical, graph)


def directory_time(name: Column | str) -> Column:
    """Timestamp of a capture directory `YYYYMMDDTHHMMSSffffff_rand`."""
    stamp = F.regexp_extract(_col(name), r"^(\d{8}T\d{12})_[0-9A-Za-z]{4}$", 1)
    return F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmssSSSSSS"))


#: Marks of an interstitial challenge page.
CHALLENGE_MARKS = [
    "just a moment", "checking your browser", "cf-browser-verification", "cf_chl_opt", "challenge-platform", "attention required! | cloudflare",
    "enable javascript and cookies to continue", "verify you are human", "ddos protection by cloudflare",
]


def is_challenge(html: Column | str, first: int = 5000, marks: Sequence[str] = CHALLENGE_MARKS) -> Column:
    head = F.lower(F.left(F.coalesce(_col(html), F.lit("")), F.lit(first)))
    return F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(head, m))


def merge_tags(a: Column, b: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none)))


def risk_tags(url: Column, hop_count: Column, request_hosts: Column, conf: config.Conf = config.Conf()) -> Column:
    """multi_hop, suspicious_extension, http, short_url, many_trackers: those that hold, in this order."""
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1))
    extension = F.exists(F.array(*map(F.lit, config.BAD_EXTENSIONS)), lambda e: F.endswith(path, e))
    apexes = F.array_distinct(F.transform(request_hosts, naive_apex))
    trackers = F.size(F.array_intersect(apexes, F.array(*map(F.lit, config.TRACKERS)))) >= conf.tracker_apexes
    tag = lambda when, name: F.when(F.coalesce(when, F.lit(False)), F.lit(name))
    return F.array_compact(
        F.array(
            tag(hop_count >= conf.hop_threshold, "multi_hop"), tag(extension, "suspicious_extension"), tag(F.lower(url).startswith("http://"), "http"),
            tag(hostname(url).isin(config.SHORTENERS), "short_url"), tag(trackers, "many_trackers"),
        )
    )


def list_domain(line: Column | str) -> Column:
    """Domain of a line of a plain, CSV, hosts or ad-block list; null where the line names none."""
    t = stripped(line)
    sinks = ["0.0.0.0", "127.0.0.1", "::", "::1", "255.255.255.255"]
    token = F.split(t, r"\s+")
    other = F.when(token[0].isin(sinks), F.get(token, F.lit(1))).otherwise(F.regexp_extract(t, "^([^;, \t]*)", 1))
    anchored = F.regexp_extract(t, r"^\|\|([^\^/$*:?]*)", 1)
    skipped = (t == "") | t.rlike(r"^(#|!|\[|@@)") | (~t.startswith("||") & (t.contains("##") | t.rlike(r"^[/|]")))
    found = F.lower(F.when(t.startswith("||"), anchored).otherwise(other))
    host = F.when(found.contains("://"), hostname(found)).otherwise(F.regexp_extract(found, "^([^/]*)", 1))
    return F.when(~skipped & ~host.isin("url", "domain", "host", "") & host.contains("."), host)


def list_apex(line: Column | str) -> Column:
    return registrable_domain(list_domain(line))


def known_params(pairs: Column) -> Column:
    return F.filter(pairs, lambda p: identify_param(p["key"]) != "")
