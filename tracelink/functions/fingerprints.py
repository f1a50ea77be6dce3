"""Tracking ids in HTML: an id counts only inside a real call, a vendor's URL or a named literal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink import config

#: Label, the pattern whose first group is the id, and a literal that every match holds. Which call, URL or literal of a vendor counts decides every result.
PATTERNS = [
    ("Meta Pixel", r"""fbq\s*\(\s*['"]init['"]\s*,\s*['"](\d{15,17})['"]""", "fbq"),
    ("Google Analytics 4", r"""(?:gtag|ga)\s*\(\s*['"](?:config|create)['"]\s*,\s*['"](G-[A-Z0-9]{6,12})['"]""", "G-"),
    ("Google Analytics 4", r"""(?:googletagmanager\.com|google-analytics\.com)[^"'<>\s]*?[?&](?:id|tid)=(G-[A-Z0-9]{6,12})\b""", "G-"),
    ("Google Analytics (UA)", r"""(?:gtag|ga)\s*\(\s*['"](?:config|create)['"]\s*,\s*['"](UA-\d{4,12}-\d{1,4})['"]""", "UA-"),
    ("Google Analytics (UA)", r"""(?:googletagmanager\.com|google-analytics\.com)[^"'<>\s]*?[?&]tid=(UA-\d{4,12}-\d{1,4})\b""", "UA-"),
    ("Google Tag Manager", r"""['"]dataLayer['"]\s*,\s*['"](GTM-[A-Z0-9]{4,8})['"]""", "GTM-"),
    ("Google Tag Manager", r"""googletagmanager\.com[^"'<>\s]*?[?&]id=(GTM-[A-Z0-9]{4,8})\b""", "GTM-"),
    ("Google Ads", r"""gtag\s*\(\s*['"]config['"]\s*,\s*['"](AW-\d{9,12})['"]""", "AW-"),
    ("Google Ads", r"""['"]send_to['"]\s*:\s*['"](AW-\d{9,12})(?:/[^'"]*)?['"]""", "AW-"),
    ("TikTok Pixel", r"""ttq\.load\s*\(\s*['"]([A-Z0-9]{15,25})['"]""", "ttq.load"),
    ("Microsoft Clarity", r"""clarity\.ms/tag/([a-z0-9]{6,20})\b""", "clarity.ms/tag/"),
    ("Microsoft Clarity", r"""clarity\s*\(\s*['"]set['"]\s*,\s*['"]project['"]\s*,\s*['"]([a-z0-9]{6,20})['"]""", "clarity"),
    ("Hotjar", r"""_hjSettings\s*=\s*\{\s*hjid\s*:\s*(\d{4,10})\s*,""", "_hjSettings"),
    ("LINE Tag", r"""_lt\s*\(\s*['"]init['"]\s*,\s*\{[^}]*tagId\s*:\s*['"]([A-Za-z0-9_-]{8,40})['"]""", "_lt"),
    ("X / Twitter Pixel", r"""twq\s*\(\s*['"](?:config|init)['"]\s*,\s*['"]([A-Za-z0-9]{4,20})['"]""", "twq"),
    ("Google AdSense", r"""data-ad-client\s*=\s*['"](ca-pub-\d{16})['"]""", "ca-pub-"),
    ("Google AdSense", r"""['"]?google_ad_client['"]?\s*[:=]\s*['"](ca-pub-\d{16})['"]""", "ca-pub-"),
    ("Google AdSense", r"""googlesyndication\.com[^"'<>\s]*?[?&]client=(ca-pub-\d{16})\b""", "ca-pub-"),
    ("Meta Facebook Page", r"""<meta\s+[^>]*property\s*=\s*['"]fb:pages['"][^>]*content\s*=\s*['"]([0-9,\s]+)['"]""", "fb:pages"),
]


def is_placeholder(value: Column) -> Column:
    """A segment after the first that is one letter over and over, or a known dummy."""
    parts = F.split(F.upper(value), "-")
    return F.exists(F.slice(parts, F.lit(2), F.size(parts)), lambda p: p.rlike(r"^([A-Z])\1{2,}$") | p.isin(config.PLACEHOLDERS))


#: Labels whose first group may hold several ids, with commas or blanks between.
LISTS = ["Meta Facebook Page"]
TABLE = "label STRING, pattern STRING, trigger STRING, list BOOLEAN"
#: A table of patterns becomes part of the plan; it may have so many rows.
MOST_PATTERNS = 1000


def pattern_table(spark: SparkSession) -> DataFrame:
    """The fixed patterns as TABLE rows; callers may add rows of their own."""
    return spark.createDataFrame([(label, pattern, trigger, label in LISTS) for label, pattern, trigger in PATTERNS], TABLE)


def _found(page: Column, pattern: str, trigger: str | None, many: bool) -> Column:
    found = F.regexp_extract_all(page, F.lit(pattern), F.lit(1))
    if many:
        found = F.filter(F.flatten(F.transform(found, lambda x: F.split(x, r"[,\s]+"))), lambda x: x.rlike("^[0-9]+$"))
    # looking for a literal is some ten times cheaper than running a pattern, and few pages hold one
    return F.when(F.contains(page, F.lit(trigger)), found).otherwise(F.array().cast("array<string>")) if trigger else found


def _by_label(page: Column, patterns: list[tuple[str, str, str | None, bool]]) -> Column:
    entries = []
    for label in dict.fromkeys(p[0] for p in patterns):
        found = F.concat(*[_found(page, pattern, trigger, many) for x, pattern, trigger, many in patterns if x == label])
        ids = F.array_sort(F.array_distinct(F.filter(found, lambda x: (x != "") & ~is_placeholder(x))))
        entries.append(F.struct(F.lit(label).alias("key"), ids.alias("value")))
    none = F.array().cast("array<struct<key:string,value:array<string>>>")
    return F.map_from_entries(F.filter(F.array(*entries) if entries else none, lambda e: F.size(e["value"]) > 0))


def tracking_ids(html: Column | str, patterns: DataFrame | None = None) -> Column:
    """map<label, sorted distinct ids> of a page by the fixed patterns, or by those of a table; empty for null.

    patterns: TABLE rows, at most MOST_PATTERNS. A pattern runs on the pages that hold its trigger, on all pages if that is null or empty; its label comes in the order of the
    table's labels. Of labels with several patterns the ids are put together.
    """
    page = F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit(""))
    if patterns is None:
        return _by_label(page, [(label, pattern, trigger, label in LISTS) for label, pattern, trigger in PATTERNS])
    rows = patterns.select("label", "pattern", "trigger", "list").orderBy("label", "pattern").limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    return _by_label(page, [(r.label, r.pattern, r.trigger or None, bool(r.list)) for r in rows])
