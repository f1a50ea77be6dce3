"""Hosts, apexes, query parameters: Column builders that stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelink import config

_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#]*)"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"
URL = r"https?://[^\s'\"<>\])]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hostname(url: Column | str) -> Column:
    """Lower-case host without user and port; empty where there is none."""
    host = F.regexp_replace(F.regexp_extract(_col(url), _HOST, 1), r"[\[\]]", "")
    return F.coalesce(F.lower(host), F.lit(""))


def is_ipv4(host: Column | str) -> Column:
    return F.coalesce(_col(host).rlike(IPV4), F.lit(False))


def is_direct_ip(host: Column | str) -> Column:
    """An IPv4 literal, or an IPv6 one: hex groups of which at most one run is left out."""
    h = F.lower(_col(host))
    tail = F.regexp_replace(h, rf":(?:{_OCTET}\.){{3}}{_OCTET}$", ":0:0")
    groups = F.filter(F.split(tail, ":"), lambda g: g != "")
    shaped = tail.rlike(r"^[0-9a-f:]+$") & F.forall(groups, lambda g: F.length(g) <= 4)
    gaps = F.size(F.split(tail, "::", -1)) - 1
    whole = (gaps == 0) & (F.size(F.split(tail, ":", -1)) == 8) & (F.size(groups) == 8)
    short = (gaps == 1) & ~tail.contains(":::") & (F.size(groups) <= 7) & ~tail.rlike("^:[^:]|[^:]:$")
    return is_ipv4(h) | F.coalesce(tail.contains(":") & shaped & (whole | short), F.lit(False))


def ascii_host(host: Column) -> Column:
    """The IDNA form of a name that isn't ASCII; a name that has none stays as it is. For readers: Spark takes the call for one that can't be repeated."""
    form = F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host))
    return F.when(host.rlike(r"[^\x00-\x7F]"), F.coalesce(form, host)).otherwise(host)


def registrable_domain(host: Column | str, private_suffixes: Sequence[str] = ()) -> Column:
    """Three labels under a two-label suffix, two elsewhere; addresses and short hosts as they are."""
    h = F.lower(F.rtrim(F.trim(_col(host)), F.lit(".")))
    labels = F.split(h, r"\.")
    two, three = F.array_join(F.slice(labels, -2, 2), "."), F.array_join(F.slice(labels, -3, 3), ".")
    suffixes = [*config.MULTI_LABEL_SUFFIXES, *private_suffixes]
    return F.when(is_direct_ip(h) | (F.size(labels) <= 2), h).when(two.isin(suffixes), three).otherwise(two)


def naive_apex(host: Column | str) -> Column:
    labels = F.split(_col(host), r"\.")
    return F.when(F.size(labels) <= 2, _col(host)).otherwise(F.array_join(F.slice(labels, -2, 2), "."))


def host_suffixes(host: Column | str) -> Column:
    """The host and everything after each of its dots: an equi-join on them is a suffix join."""
    labels = F.split(_col(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def is_noise_endpoint(host: Column | str) -> Column:
    return F.arrays_overlap(host_suffixes(F.lower(_col(host))), F.array(*map(F.lit, config.NOISE_HOSTS)))


def within(host: Column, domain: Column) -> Column:
    """The domain itself or a host below it."""
    return (host == domain) | host.endswith(F.concat(F.lit("."), domain))


def extract_urls(text: Column | str) -> Column:
    """Distinct URLs of a text in order, without trailing punctuation."""
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(URL), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)]+$", "")))


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), F.translate(x, "+", " "))


def query_pairs(url: Column | str) -> Column:
    """array<struct<key, value>> of the query; pairs without a key or a value are left out, malformed escapes stay as they are."""
    query = F.regexp_extract(F.coalesce(_col(url), F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (F.instr(p, "=") > 1) & (F.length(p) > F.instr(p, "=")))
    return F.transform(
        pairs, lambda p: F.struct(_decoded(F.regexp_extract(p, "^([^=]*)=", 1)).alias("key"), _decoded(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("value"))
    )


def comparison_value(value: Column | str, length: int = config.Conf.param_hash_length) -> Column:
    """Long values compare by digest."""
    v = _col(value)
    return F.when(F.length(v) > length, F.concat(F.lit("__hash__:"), F.substring(F.sha2(v, 256), 1, 12))).otherwise(v)


def identify_param(key: Column | str) -> Column:
    """Platform of a query key, empty where unknown."""
    low = F.lower(_col(key))
    exact = F.create_map(*[F.lit(x) for platform, keys in config.PARAM_KEYS.items() for k in keys for x in (k, platform)])
    found = F.try_element_at(exact, low)
    for prefix, platform in config.PARAM_PREFIXES:
        found = F.coalesce(found, F.when(low.startswith(prefix), platform))
    return F.coalesce(found, F.lit(""))


def owner_kind(platform: Column | str) -> Column:
    p = _col(platform)
    return F.when(p == "generic", "generic").when(F.coalesce(p, F.lit("")) == "", "unknown").otherwise("platform")


def strip_tracking_params(url: Column | str) -> Column:
    """struct<url, stripped>: the URL without the query keys that a platform is known for, and these keys sorted."""
    u = F.coalesce(_col(url), F.lit(""))
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    key = lambda p: _decoded(F.regexp_extract(p, "^([^=]*)", 1))
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    kept = F.array_join(F.filter(parts, lambda p: identify_param(key(p)) == ""), "&")
    gone = F.array_sort(F.array_distinct(F.transform(F.filter(parts, lambda p: identify_param(key(p)) != ""), key)))
    head, tail = F.regexp_extract(u, r"^([^?#]*)", 1), F.regexp_extract(u, r"(#.*)$", 1)
    return F.struct(F.concat(head, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""), tail).alias("url"), gone.alias("stripped"))


def ads_txt_url(url: Column | str) -> Column:
    origin = F.regexp_extract(_col(url), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)
    return F.when(origin != "", F.concat(origin, F.lit("/ads.txt")))
