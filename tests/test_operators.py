import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tracelink.operators import ads, discovery, groups, headers, index, infra, insights, integrity, pins, url
from tracelink.plans import driver_queries
from tracelink.schema import OBSERVATION, empty_tables


@pytest.fixture(scope="module")
def pin_case(spark):
    urls = spark.createDataFrame([(1, 1, 1, "u"), (2, 2, 1, "u"), (3, 3, 1, "v"), (4, 4, 2, "u")], "id long, message_id long, case_id long, original_url string")
    posts = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 2)], "id long, case_id long")
    scans = spark.createDataFrame([(10, 1, "done"), (11, 2, "done"), (12, 3, "error"), (13, 4, "done"), (14, 1, "error"), (15, 3, "done")], "id long, url_artifact_id long, status string")
    return empty_tables(spark, url_artifacts=urls, message_evidence=posts, scan_runs=scans, cases=spark.createDataFrame([(1, "a"), (2, "b")], "id long, title string"))


def pairs(df):
    return sorted(tuple(r) for r in df.select("url_artifact_id", "scan_run_id").collect())


def test_pins(spark, pin_case):
    assert pairs(pins.own_scan(pin_case)) == [(1, 10), (2, 11), (3, 15), (4, 13)]
    assert pairs(pins.own_scan(pin_case, False)) == [(1, 14), (2, 11), (3, 15), (4, 13)]
    pin_case2 = empty_tables(spark, url_artifacts=pin_case.url_artifacts, scan_runs=pin_case.scan_runs.where("id <> 10"))
    assert pairs(pins.url_scan(pin_case2)) == [(1, 11), (2, 11), (3, 15), (4, 13)]
    assert pairs(pins.own_scan(pin_case2)) == [(2, 11), (3, 15), (4, 13)]
    assert [tuple(r) for r in pins.covered_by_sibling(pin_case2).orderBy("case_id").collect()] == [(1, 0), (2, 0)]
    assert pins.unscanned_urls(pin_case).count() == 0


def test_delete_keeps_acquisitions(spark, pin_case):
    t = empty_tables(spark, **{n: getattr(pin_case, n) for n in ("cases", "message_evidence", "url_artifacts", "scan_runs")}, acquisitions=spark.createDataFrame([(1, 10), (2, 13)], "id long, scan_run_id long"))
    left = pins.delete_case(t, 1)
    assert sorted((r.id, r.scan_run_id) for r in left.acquisitions.collect()) == [(1, None), (2, 13)]
    assert [r.id for r in left.cases.collect()] == [2] and left.scan_runs.count() == 1
    with pytest.raises(LookupError):
        pins.require_case(left, 1)


def test_browser_captures(spark):
    rows = [(1, "playwright", "ok", None), (2, "playwright", "error", None), (3, "manual", "manual", None), (4, "wayback", "wayback", None), (5, None, "ok", None), (6, None, None, "s.png"), (7, "http_only", "ok", "s.png"), (8, "cloaking_alt", "ok", None), (9, None, None, " "), (10, "manual", "error", "s.png"), (11, "playwright", "", "s.png")]
    t = empty_tables(spark, snapshots=spark.createDataFrame([(r[0], *r) for r in rows], "id long, scan_run_id long, capture_method string, capture_status string, screenshot_path string"))
    assert sorted(r[0] for r in pins.browser_captures(t).collect()) == [1, 3, 4, 5, 6, 11]


def test_greedy_windows_anchor_at_the_first(spark):
    rows = [(1, i, i, f"d{i}", "CA", str(i), f"2026-01-0{1 + h // 24} {h % 24:02d}:00:00") for i, h in enumerate([0, 20, 40, 60])]
    certs = spark.createDataFrame(rows, "case_id long, ua_id long, post_id long, domain string, issuer string, serial string, t string").withColumn("not_before", F.to_timestamp("t"))
    got = infra.issuance_windows(certs).collect()
    assert [(r.window_start.hour, r.cert_count) for r in got] == [(0, 2), (16, 2)]


def test_windows_match_a_walk_through_all_times(spark):
    rng = random.Random(5)
    base = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
    rows = []
    for case in range(3):
        at = 0
        for i in range(120):
            at += rng.choice([0, 1, 3600, 40_000, 86_400, 86_401, 200_000])
            rows.append((case, i, i, f"d{rng.randrange(9)}", f"CA {rng.randrange(3)}", f"s{i}", base + dt.timedelta(seconds=at)))
    want = set()
    for case in range(3):
        left = sorted((r for r in rows if r[0] == case), key=lambda r: r[6])
        while left:
            inside = [r for r in left if r[6] <= left[0][6] + dt.timedelta(hours=24)]
            domains = {r[3] for r in inside}
            if len(inside) >= 2 and len(domains) >= 2:
                want.add((case, len(inside), len(domains), ", ".join(sorted(domains))))
            left = left[len(inside) :]
    schema = "case_id long, ua_id long, post_id long, domain string, issuer string, serial string, not_before timestamp"
    certs = spark.createDataFrame(rows, schema).withColumns({"not_after": F.lit(None).cast("timestamp"), "sans": F.lit(1)})
    got = {(r.case_id, r.cert_count, r.domain_count, ", ".join(r.domains)) for r in infra.issuance_windows(certs).collect()}
    assert got == want and len(got) > 20


def test_tracking_counts_every_usable_capture(spark):
    ids = json.dumps({"Meta Pixel": ["1" * 15], "Bad": "x"})
    snaps = [(1, 10, "a.test", ids, "ok"), (2, 11, "b.test", ids, "ok"), (3, 11, "c.test", ids, "error"), (4, 10, "a2.test", ids, "ok")]
    t = empty_tables(
        spark, message_evidence=spark.createDataFrame([(1, 1), (2, 1)], "id long, case_id long"), url_artifacts=spark.createDataFrame([(1, 1, 1, "http://a.test/"), (2, 2, 1, "http://b.test/")], "id long, message_id long, case_id long, original_url string"),
        scan_runs=spark.createDataFrame([(10, 1, "done", "http://a.test/"), (11, 2, "done", "http://b.test/")], "id long, url_artifact_id long, status string, final_url string"),
        snapshots=spark.createDataFrame(snaps, "id long, scan_run_id long, final_domain string, tracking_ids_json string, capture_status string"),
    )
    row = infra.shared_tracking_ids(t).collect()
    assert len(row) == 1 and row[0].domains == ["a.test", "a2.test", "b.test"] and row[0].url_count == 2


def test_account_tiers(spark):
    def file(d, accounts, status="ok", manager=None):
        return (1, d, d, f"http://d{d}.test/", d, f"d{d}.test", f"d{d}.test", status, f"s{d}", manager, None, None, [("x.example" if ":" not in a else a.split(":")[0], a.split(":")[-1], "DIRECT", None) for a in accounts])

    schema = "case_id long, ua_id long, post_id long, original_url string, scan_run_id long, domain string, apex string, status string, sha string, manager string, owner string, acquisition_id long, records array<struct<adsystem:string,seller_id:string,relationship:string,cert_authority_id:string>>"
    files = [file(1, ["rare", "openx.com:1", "known", "all"]), file(2, ["rare", "openx.com:1", "known", "all"]), file(3, ["all", "managed"], manager="m"), file(4, ["all", "managed"], manager="m"), file(5, ["all"]), file(6, ["solo"], status="error")]
    prevalence = spark.createDataFrame([("x.example", "known", 10, 1000)], "adsystem string, seller_id string, hits long, site_count long")
    got = {r.seller_id: r for r in ads.shared_ad_accounts(spark.createDataFrame(files, schema), prevalence).collect()}
    assert {k: r.tier for k, r in got.items()} == {"rare": "operator", "1": "manager", "known": "manager", "all": "manager", "managed": "manager"}
    assert got["rare"].reference_prevalence is None and got["known"].reference_prevalence == 0.01


def test_pair_links_match_all_pairs(spark):
    import random

    rng = random.Random(6)
    sets = {}
    for d in range(24):
        base = list(range(40)) if d % 3 else list(range(30, 70))
        sets[f"d{d:02d}"] = set(sets["d00"]) if d in (3, 6) else set(rng.sample(base, rng.choice([4, 12, 20])))
    rows = [(1, d, "x", str(a)) for d, s in sets.items() for a in s]
    got = {r.seller_id: r.linked for r in ads.pair_link_counts(spark.createDataFrame(rows, "case_id long, domain string, adsystem string, seller_id string")).collect()}
    want = {}
    for d in sets:
        for e in sets:
            both = sets[d] & sets[e]
            if d < e and len(both) >= 8 and len(both) >= 0.4 * min(len(sets[d]), len(sets[e])):
                for a in both:
                    want[str(a)] = want.get(str(a), 0) + 1
    assert got == want


def test_templates_need_all_members_verified(spark):
    states = spark.createDataFrame([(1, "a", "s", "verified"), (1, "b", "s", "truncated"), (1, "c", "t", "verified"), (1, "d", "t", "verified"), (1, "e", "u", "verified")], "case_id long, domain string, sha string, verification string")
    assert {r.sha256: r.verification for r in ads.shared_templates(states).collect()} == {"s": "truncated", "t": "verified"}


def test_groups_containers_do_not_bind(spark):
    tracking = spark.createDataFrame([(1, "Meta Pixel", "1", ["a", "b"], 2), (1, "Meta Pixel", "2", ["c", "d"], 2), (1, "Google Tag Manager", "GTM-1", ["a", "c", "z"], 3), (2, "Meta Pixel", "1", ["a", "q"], 2)], "case_id long, platform string, tracking_id string, domains array<string>, domain_count long")
    certs = spark.createDataFrame([(1, "CA", "9", ["d", "e"])], "case_id long, issuer string, serial string, domains array<string>")
    files = spark.createDataFrame([(1, "s", ["a", "c"], "truncated")], "case_id long, sha256 string, domains array<string>, verification string")
    signals = groups.hard_signals(tracking, certs, files)
    members = groups.memberships(signals)
    assert sorted(tuple(r) for r in members.select("case_id", "gid", "domain").collect()) == [(1, 1, "c"), (1, 1, "d"), (1, 1, "e"), (1, 2, "a"), (1, 2, "b"), (2, 1, "a"), (2, 1, "q")]
    weak = groups.weak_containers(tracking, members).collect()
    assert len(weak) == 1 and weak[0].spans_groups and [(m.domain, m.group_id) for m in weak[0].members] == [("a", 2), ("c", 1), ("z", None)]
    fakes = spark.createDataFrame([(1, "e", "server", "PHP/9", "r")], "case_id long, domain string, header string, value string, reason string")
    got = groups.groups(signals, members, fakes).where("case_id = 1").collect()
    assert [(g.gid, g.domain_count, g.signal_count) for g in got] == [(1, 3, 2), (2, 2, 1)] and got[0].channels == ["html", "tls"] and got[0].fake_versions[0].domain == "e"
    assert groups.dot_lines(groups.groups(signals, members, fakes)).where("case_id = 2").count() == 5


def test_headers(spark):
    rows = [("a", "server", "X1"), ("a", "server", "X1"), ("b", "server", "X1"), ("b", "server", "X2"), ("a", "date", "1"), ("a", "date", "1"), ("a", "set-cookie", "k=1; Domain=.z.test; Path=/"), ("b", "set-cookie", "k=2; path=/")]
    df = spark.createDataFrame([(1, f"{d}.test", h, v) for d, h, v in rows], "case_id long, domain string, header string, value string")
    assert [(r.domain, r.header) for r in headers.per_domain_constants(df).collect()] == [("a.test", "server")]
    assert [(r.value, r.domain_count) for r in headers.shared_header_templates(df).collect()] == [("X1", 2)]
    assert [tuple(r)[1:] for r in headers.cookie_origin_leaks(df).collect()] == [("a.test", "z.test")]
    assert headers.shared_cookie_templates(df).first().domain_count == 2
    fake = spark.createDataFrame([(1, "a", "server", v) for v in ("Apache/2.4.1", "Apache/2.5", "nginx/1.9", "nginx/2.0 PHP/9.1", "OpenSSL/1.1.2")], "case_id long, domain string, header string, value string")
    assert headers.fake_versions(fake).count() == 4


def test_index(spark):
    row = lambda t, v, db, c, s, d: (t, v, None, db, c, f"case {c}", s, d, "2026", "2026")
    rows = [row("final_domain", "land.example", "a", 1, 1, "land.example"), row("har_endpoint", "land.example", "b", 2, 2, "x.other.test"), row("har_endpoint", "land.example", "b", 3, 3, "www.land.example"), row("tracking_id", "1", "a", 1, 1, "p"), row("tracking_id", "1", "b", 1, 4, "q")]
    df = spark.createDataFrame(rows, "signal_type string, signal_value string, platform string, source_db string, case_id long, case_title string, scan_run_id long, final_domain string, observed_at string, indexed_at string")
    link = index.operator_cross_links(df).collect()
    assert len(link) == 1 and link[0].called_by == ["x.other.test"] and (link[0].caller_count, link[0].case_count) == (1, 2)
    assert ("tracking_id", "1", 2, 2, 2) in [tuple(r)[:5] for r in index.recurring_signals(df).collect()]
    twice = df.union(df.where("signal_type = 'tracking_id'").withColumn("final_domain", F.lit("zz")))
    assert index.last_write(twice).count() == 5 and index.lookup(df, "1").count() == 2


def test_index_write_replaces_partitions(spark, tmp_path):
    row = lambda v, db, c: ("t", v, None, db, c, "x", 1, "d", "o", "i")
    schema = "signal_type string, signal_value string, platform string, source_db string, case_id long, case_title string, scan_run_id long, final_domain string, observed_at string, indexed_at string"
    path = str(tmp_path / "index")
    index.write_index(spark.createDataFrame([row("1", "a", 1), row("2", "a", 2)], schema), path)
    index.write_index(spark.createDataFrame([row("3", "a", 1)], schema), path)
    assert sorted(r.signal_value for r in spark.read.parquet(path).collect()) == ["2", "3"]


def test_discovery(spark):
    o = lambda d, status, sha, n: (d, None, status, 200, sha, n, [["x", str(i)] for i in range(n)], None, None, None, False, None, None, None)
    seen = spark.createDataFrame([o("a", "ok", "S1", 40), o("b", "ok", "S1", 40), o("c", "ok", "S2", 40), o("d", "error", "S2", 0), o("e", "ok", "S3", 900), o("f", "ok", "S3", 900), o("g", "ok", "S4", 0), o("h", "ok", "S4", 0), o("i", "off_site_redirect", None, 0)], OBSERVATION)
    assert [(r.domains, r.kind) for r in discovery.cluster_by_template(seen).collect()] == [(["a", "b"], "portfolio"), (["e", "f"], "platform")]
    known = spark.createDataFrame([("S1", ["m"])], "sha string, matched_domains array<string>")
    candidates = spark.createDataFrame([("i", 0), ("a", 1), ("zz", 2), ("a", 3), ("c", 4), ("g", 5)], "domain string, pos int")
    got = [(r.domain, r.verdict) for r in discovery.screen_domains(candidates, seen, known).collect()]
    assert got == [("a", "template_match"), ("c", "no_match"), ("g", "no_ads_txt"), ("i", "off_site_redirect"), ("zz", "unreachable")]
    assert discovery.build_prevalence(seen).where("seller_id = '0'").first().asDict() == {"adsystem": "x", "seller_id": "0", "hits": 5, "site_count": 7}
    jobs = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2), ("a", 3), ("b", 4)], "apex string, pos int")
    assert [r.pos for r in discovery.round_robin(jobs).collect()] == [0, 2, 1, 4, 3]


def test_integrity(spark):
    files = [("c/20260101T000000000000_abcd/s.png", 9, b"\x89PNG\r\n\x1a\n1"), ("c/20260101T000000000000_abcd/p.html", 3, b"abc"), ("c/x/capture.json", 2, b"{}"), ("c/y/p.html", 0, b"")]
    dirs = integrity.store_directories(spark.createDataFrame(files, "path string, length long, content binary"))
    refs = spark.createDataFrame([("c/x", ["db"])], "dir string, dbs array<string>")
    got = {r.dir: (r.kind, r.owned) for r in integrity.reconcile(dirs, refs).collect()}
    assert got == {"c/20260101T000000000000_abcd": ("capture", False), "c/x": ("manifest_only", True), "c/y": ("empty", False)}
    text = spark.createDataFrame([("a 1.2.3.4 b 1.2.3.45", ["1.2.3.4", "1.2.3.45"])], "t string, a array<string>")
    row = text.select(integrity.redact(F.col("t"), F.col("a"), "X").alias("r"), integrity.occurrences(F.col("t"), F.col("a")).alias("n")).first()
    assert row.r == "a X b X" and row.n == 3
    fill = spark.createDataFrame([(b"\0\0\0",), (b"\0\1",), (b"",)], "c binary").select(integrity.is_single_byte_fill(F.col("c"))).collect()
    assert [r[0] for r in fill] == [True, False, False]


def test_insights(spark):
    rows = spark.createDataFrame([(1, "d", m, ok) for m, ok in [("http_only", True), ("http_only", False), ("playwright", True)]] + [(1, "e", "http_only", True)], "case_id long, domain string, capture_method string, ok boolean")
    got = {r.domain: r for r in insights.opsec_profile(rows).collect()}
    assert got["d"].level == "medium" and got["e"].level == "indeterminate" and got["e"].indeterminate_reason == "no_playwright" and got["e"].pw_rate is None
    summary = insights.signal_summary(tracking=rows, strong_opsec=rows.where("domain = 'e'"))
    cover = insights.evidence_coverage(summary).first()
    assert cover.score == 70 and insights.verdicts(insights.evidence_coverage(summary)).first().verdict == "coordinated"
    bullets = insights.insight_bullets(2, 1, a=(rows.withColumn("n", F.lit(1)), "n", "domain"), b=(rows.withColumn("n", F.lit(1)), "n", "capture_method")).collect()
    assert [(b.place, b.source, b.bullet) for b in bullets] == [(1, "a", "d"), (2, "b", "http_only")]


def test_urls_count_observed(spark):
    rows = spark.createDataFrame([(1, 1, 1, "u1", "a", "k", "v", "v"), (1, 1, 1, "u2", "b", "k", "v", "v"), (1, 2, 2, "u1", "a", "k", "v", "v"), (1, 3, 3, "u3", "c", "k", "w", "w")], "case_id long, ua_id long, post_id long, url string, domain string, param_key string, param_value string, compared string")
    r = url.shared_params(rows).collect()
    assert len(r) == 1 and (r[0].url_count, r[0].post_count, r[0].domains, r[0].owner_kind) == (2, 2, "a, b", "unknown")
    k = url.shared_param_keys(rows).collect()
    assert len(k) == 1 and k[0].top_values == ["v", "w"]


def test_every_query_has_rows_or_columns(spark):
    for name in ("operator_groups", "evidence_gaps"):
        assert driver_queries.QUERIES[name](spark, "/root/testdata/sf0.001").columns


def test_hubs_are_not_paired_and_count_alike(spark, monkeypatch):
    # d0 to d5 share ten accounts or more by two; all carry a hub, and each has one of its own
    rows = [(1, f"d{i}", "s", a) for i in range(6) for a in ["hub", f"own{i}", *[f"a{i // 2}-{k}" for k in range(10)], *[f"b{i % 3}-{k}" for k in range(3)]]]
    accounts = spark.createDataFrame(rows, "case_id long, domain string, adsystem string, seller_id string")
    got = []
    for most in (64, 5, 1):
        monkeypatch.setattr(ads, "LIGHT_CARRIERS", most)
        light, heavy = ads.by_carriers(ads.account_classes(accounts)[1])
        assert ads.light_pairs(light).where("seller_id = 'hub'").count() == (15 if most == 64 else 0) and heavy.where("seller_id = 'hub'").count() == (0 if most == 64 else 6)
        got.append(sorted((r.seller_id, r.linked) for r in ads.pair_link_counts(accounts).collect()))
    assert got[0] == got[1] == got[2] and dict(got[0])["hub"] == 3 and dict(got[0])["a1-4"] == 1
