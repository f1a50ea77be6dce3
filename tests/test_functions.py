import datetime as dt
from urllib.parse import parse_qsl, unquote_plus, urlparse

import pytest
from pyspark.sql import functions as F

from tracelink.functions import decisions as d
from tracelink.functions import parsing as ps
from tracelink.functions import urls as u
from tracelink.functions.fingerprints import tracking_ids
from tracelink.schema import header_pairs, string_list, tracking_map

URLS = [
    "https://user:pw@Www.Example.COM:8443/a/b?x=1&y=%E4%BD%A0+z&bad=%zz&empty=&=v&x=2#frag", "http://a_b.example.co.uk/?utm_source=n&fbclid=Q", "https://[2001:db8::1]:80/p?q=a=b", "not a url", "",
    "https://example.com", "ftp://host/file?a=1#?b=2", "https://例え.jp/パス?k=v", "https://h.example/x y|z?k=%41%zz",
]


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_host_and_query_agree_with_the_standard_library(spark):
    assert values(spark, URLS, u.hostname("x")) == [urlparse(x).hostname or "" for x in URLS]
    got = values(spark, URLS, u.query_pairs("x"))
    for x, pairs in zip(URLS, got, strict=True):
        want = [(k, v) for k, v in parse_qsl(urlparse(x).query) if k]
        assert [(p.key, p.value) for p in pairs if "%zz" not in p.value] == [(k, v) for k, v in want if "%zz" not in v and "%zz" not in unquote_plus(v)]


def test_apexes_stay_three_functions(spark):
    hosts = ["a.b.example.com", "www.example.co.uk", "example.com", "localhost", "10.0.0.1", "alice.github.io", "a.b.com.tw"]
    assert values(spark, hosts, u.registrable_domain("x")) == ["example.com", "example.co.uk", "example.com", "localhost", "10.0.0.1", "github.io", "b.com.tw"]
    assert values(spark, hosts, u.registrable_domain("x", ["github.io"]))[5] == "alice.github.io"
    assert values(spark, hosts, u.naive_apex("x"))[1] == "co.uk"


@pytest.mark.parametrize(("host", "want"), [("1.2.3.4", True), ("256.1.1.1", False), ("2001:db8::1", True), ("::", True), ("::1", True), ("1::2::3", False), ("fe80:::1", False), ("1:2:3:4:5:6:7:8", True), ("1:2:3", False), ("::ffff:1.2.3.4", True), ("abc", False), ("g::1", False)])
def test_direct_ip(spark, host, want):
    assert values(spark, [host], u.is_direct_ip("x")) == [want]


def test_params(spark):
    keys = ["UTM_Source", "utm_new", "hsa_cam", "hsa_x", "_ga", "af_x", "ref", "zzz", "gclid"]
    assert values(spark, keys, u.identify_param("x")) == ["google_analytics", "google_analytics", "hubspot", "hubspot", "google_analytics", "appsflyer", "generic", "", "google_ads"]
    got = values(spark, ["https://a.example/p?x=1&gclid=2&utm_source=3#t", "https://a.example/?gclid=1"], u.strip_tracking_params("x"))
    assert [(g.url, g.stripped) for g in got] == [("https://a.example/p?x=1#t", ["gclid", "utm_source"]), ("https://a.example/", ["gclid"])]
    assert values(spark, ["a" * 100, "a" * 101], F.length(u.comparison_value("x"))) == [100, 21]
    assert values(spark, ["https://a.example:8/x", "x"], u.ads_txt_url("x")) == ["https://a.example:8/ads.txt", None]


def test_extract_urls_and_noise(spark):
    text = "go http://a.example/x). and (https://b.example/y) <https://b.example/y> 'http://c.example'!"
    assert values(spark, [text, None], u.extract_urls("x")) == [["http://a.example/x", "https://b.example/y", "http://c.example"], []]
    assert values(spark, ["www.google.com", "google.com", "notgoogle.com", "google.com.evil.example"], u.is_noise_endpoint("x")) == [True, True, False, False]


PAGE = """<script>fbq( 'init' , "123456789012345"); gtag('config','G-ABC123'); gtag("config", 'AW-987654321'); ga('create', 'UA-12345-1');
(function(w,d,s,l,i){})(window,document,'script','dataLayer','GTM-AB12'); ttq.load('ABCDEFGHIJ1234567890'); clarity('set', 'project', 'abc123xyz');
h._hjSettings={hjid:123456,hjsv:6}; _lt('init', { customerType: 'x', tagId: 'abcd-1234_5' }); twq('config','o1abc');</script>
<script src="https://www.googletagmanager.com/gtag/js?id=G-ABC123"></script><script src='https://www.googletagmanager.com/gtm.js?id=GTM-ZZ99'></script>
<ins data-ad-client="ca-pub-1234567890123456"></ins><script src="https://pagead2.googlesyndication.com/x.js?client=ca-pub-9999999999999999"></script>
<meta property="fb:pages" content="111, 222"> In prose: G-PROSE1 and GTM-PROSE"""


def test_fingerprints(spark):
    got = values(spark, [PAGE, "gtag('config','G-XXXXXXX'); gtag('config','UA-12345678-1')", None, "text G-ABC123"], tracking_ids("x"))
    assert got[0] == {
        "Meta Pixel": ["123456789012345"], "Google Analytics 4": ["G-ABC123"], "Google Analytics (UA)": ["UA-12345-1"], "Google Tag Manager": ["GTM-AB12", "GTM-ZZ99"], "Google Ads": ["AW-987654321"],
        "TikTok Pixel": ["ABCDEFGHIJ1234567890"], "Microsoft Clarity": ["abc123xyz"], "Hotjar": ["123456"], "LINE Tag": ["abcd-1234_5"], "X / Twitter Pixel": ["o1abc"],
        "Google AdSense": ["ca-pub-1234567890123456", "ca-pub-9999999999999999"], "Meta Facebook Page": ["111", "222"],
    }
    assert got[1:] == [{}, {}, {}]


def test_ads_txt(spark):
    body = "# c\nOWNERDOMAIN=Old.example\nownerdomain = New.Example\nMANAGERDOMAIN=m.example, us\nEx.com, 12, direct, abc # x\nx.com,,DIRECT\na,b\nex.com , 13 ,Reseller\r\nOWNERDOMAIN=\ny.com,1,DIRECT,z=1"
    got = values(spark, [body, None], ps.ads_txt_body("x"))
    assert (got[0].owner_domain, got[0].manager_domain) == ("new.example", "m.example")
    assert [tuple(r) for r in got[0].records] == [("ex.com", "12", "DIRECT", "abc"), ("ex.com", "13", "RESELLER", None), ("y.com", "1", "DIRECT", "z=1")]
    assert got[1].records == [] and got[1].owner_domain is None


def test_dates(spark):
    t = lambda *a: dt.datetime(*a)
    assert values(spark, ["Apr  7 00:00:00 2026 GMT", "Apr 17 01:02:03 2026", "x", None], ps.openssl_date("x")) == [t(2026, 4, 7), t(2026, 4, 17, 1, 2, 3), None, None]
    assert values(spark, ["2026-01-02T03:04:05Z", "2026-01-02T03:04:05+02:00", "2026/01/02 03:04", "2026-01-02", " ", "junk", None], ps.posted_at("x")) == [t(2026, 1, 2, 3, 4, 5), t(2026, 1, 2, 1, 4, 5), t(2026, 1, 2, 3, 4), t(2026, 1, 2), None, None, None]
    assert values(spark, ["2020-1-2T00:00Z", "02-Jan-2020", "02.01.2020", "UNKNOWN", None], ps.whois_date("x")) == [dt.date(2020, 1, 2)] * 3 + [None, None]
    assert values(spark, ["20260102T030405123456_ab1Z", "x"], ps.directory_time("x")) == [t(2026, 1, 2, 3, 4, 5, 123456), None]


def test_list_lines(spark):
    lines = ["bad.example", "host;count", "a.example;3", "0.0.0.0 sink.example", "||ads.example^$third-party", "@@||ok.example", "x.example##.ad", "# c", "! c", "[Adblock]", "/regex/", "", "url", "https://U.example/p"]
    assert values(spark, lines, ps.list_domain("x")) == ["bad.example", None, "a.example", "sink.example", "ads.example", None, None, None, None, None, None, None, None, "u.example"]


def test_cookies_and_html(spark):
    c = values(spark, ["a=1; Domain=.O.test; Path=/x; HttpOnly; SameSite=Lax", "b=2"], ps.set_cookie("x"))
    assert tuple(c[0]) == ("o.test", "/x", True, False, "lax") and tuple(c[1]) == ("", "", False, False, "")
    html = ["<link rel='canonical' href='https://a.example/'>", '<meta property="og:url" content="https://b.example/">', "x"]
    assert values(spark, html, ps.declared_url("x")) == ["https://a.example/", "https://b.example/", None]
    assert values(spark, ["<title>Just a moment...</title>", "fine", None], ps.is_challenge("x")) == [True, False, False]


def test_json_tolerance(spark):
    assert values(spark, ['{"a":"x","b":["y"]}', "bad", None, "[]", ""], tracking_map("x")) == [{"b": ["y"]}, {}, {}, {}, {}]
    assert values(spark, ['["a"]', "no", None], string_list("x")) == [["a"], [], []]
    got = values(spark, ['[["Server","x"],["a"],["Server","y"]]', None], header_pairs("x"))
    assert [(p.header, p.value) for p in got[0]] == [("server", "x"), ("server", "y")] and got[1] == []


def test_issuers(spark):
    rows = [({"organizationName": "O", "commonName": "C"},), ({"commonName": "C"},), ({"organizationName": '["P","Q"]'},), ({},), (None,)]
    df = spark.createDataFrame(rows, "i map<string,string>")
    assert [r[0] for r in df.select(ps.issuer_label(F.col("i"))).collect()] == ["O (C)", "C", "P", "", ""]
    assert [r[0] for r in df.select(ps.issuer_text(F.col("i"))).collect()] == ["O", "C", "P", "", ""]


def test_decision_lists_fail_closed(spark):
    one = spark.range(1)
    n = F.lit(None)
    get = lambda c: one.select(c).first()[0]
    assert get(d.opsec_level(n.cast("double"), F.lit(0.9))) == "indeterminate" and get(d.opsec_level(F.lit(0.1), F.lit(0.9))) == "strong"
    assert get(d.capture_status(n.cast("string"), F.lit(True), F.lit(True), F.lit(False), F.lit(False))) == "ok"
    assert get(d.screening(n.cast("string"), n.cast("int"), F.lit(False))) == "unreachable"
    acq = lambda **k: F.struct(*[F.lit(v).cast(t).alias(x) for x, v, t in [("id", k.get("id", 1), "long"), ("kind", k.get("kind", "ads_txt"), "string"), ("scan_run_id", 5, "long"), ("body_path", k.get("path", "p"), "string"), ("truncated", k.get("truncated", False), "boolean"), ("captured_sha256", "h", "string"), ("complete_sha256", k.get("complete", "h"), "string")]])
    state = lambda a, claim="h", body="h": get(d.verification(a, F.lit("ads_txt"), F.lit(5).cast("long"), F.lit(claim), F.lit(body)))
    assert [state(acq()), state(acq(id=None)), state(acq(kind="x")), state(acq(path="")), state(acq(), body=None), state(acq(), body="z"), state(acq(truncated=True)), state(acq(complete=None)), state(acq(), claim="q"), state(acq(), claim=None)] == [
        "verified", "body_missing", "wrong_kind", "legacy_unverifiable", "body_missing", "body_mismatch", "truncated", "truncated", "hash_disagrees", "hash_disagrees",
    ]


def test_ids_in_every_form_of_call(spark):
    pages = {
        "gtag('event', 'conversion', {'send_to': 'AW-987654320'})": {"Google Ads": ["AW-987654320"]},
        "{\"send_to\": \"AW-987654320/abc-D\"}": {"Google Ads": ["AW-987654320"]},
        "window._fbq('init', '123456789012345')": {"Meta Pixel": ["123456789012345"]},
        "<meta name='x' property='fb:pages' content='12, 34'>": {"Meta Facebook Page": ["12", "34"]},
        "twq('config','abcd')": {"X / Twitter Pixel": ["abcd"]},
        "send_to AW-987654320": {},
    }
    assert values(spark, list(pages), tracking_ids("x")) == list(pages.values())


def test_both_spellings_of_a_name_are_one_domain(spark):
    got = values(spark, ["www.bücher.de", "WWW.BÜCHER.DE.", "xn--bcher-kva.de", "a.bücher.co.uk", "x" * 70 + "ü.de"], u.registrable_domain(u.ascii_host(F.rtrim(F.lower("x"), F.lit(".")))))
    assert got == ["xn--bcher-kva.de"] * 3 + ["xn--bcher-kva.co.uk", "x" * 70 + "ü.de"]


def test_every_pattern_needs_its_trigger_and_a_table_may_add_more(spark):
    import re

    from tracelink.functions import fingerprints as f
    from tracelink.plans.driver_queries import SNIPPETS

    shown = [(label, x.replace("{n}", "12345670").replace("{h7}", "ABCDEF1").replace("{h}", "ABCDEF12"), snippet) for label, x, snippet in SNIPPETS]
    pages = [snippet.replace("{id}", x) for _, x, snippet in shown]
    assert len(f.PATTERNS) == len(SNIPPETS) == 19
    for (label, pattern, trigger), (name, x, _), page in zip(f.PATTERNS, shown, pages, strict=True):
        assert label == name and re.search(pattern, page)[1] == x and trigger in re.search(pattern, page)[0]
        # the literal is part of what the pattern asks for: without it nothing is found
        assert trigger.replace(".", r"\.") in pattern
    got = values(spark, pages, tracking_ids("x"))
    assert got == [{label: sorted(x.split(", "))} for label, x, _ in shown]
    rows = f.pattern_table(spark).union(spark.createDataFrame([("Own", r"own-(\d+)", None, False), ("Hotjar", r"hj:(\d+)", "hj:", False)], f.TABLE))
    text = "own-12 hj:345678 " + pages[12]
    assert values(spark, [text, None, "nothing"], tracking_ids("x", rows)) == [{"Own": ["12"], "Hotjar": ["112345670", "345678"]}, {}, {}]
    assert values(spark, [text], tracking_ids("x", rows.limit(0))) == [{}]
    with pytest.raises(ValueError, match="more than 1000"):
        tracking_ids("x", spark.range(1001).selectExpr("string(id) AS label", "'x' AS pattern", "NULL AS trigger", "false AS list"))
