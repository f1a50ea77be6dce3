"""Signals of hand-made cases, kind by kind."""

import json

import pytest

from tracelink.config import Conf
from tracelink.operators import ads, index, infra, insights, url
from tracelink.schema import DDL, CaseTables, empty_tables


def case(spark, scans=(), snapshots=(), hops=(), acquisitions=(), urls=None, posts=None) -> CaseTables:
    """Tables from dictionaries; artifact n has scan 10 n unless told otherwise."""
    frame = lambda table, rows: spark.createDataFrame([tuple(r.get(c.split()[0]) for c in DDL[table].split(", ")) for r in rows], DDL[table])
    scans = [{"id": 10 * s["url_artifact_id"], "status": "done", "run_at": "2026-01-01"} | s for s in scans]
    urls = urls or [{"id": a, "message_id": a, "case_id": 1, "original_url": f"http://short.test/{a}"} for a in {s["url_artifact_id"] for s in scans}]
    posts = [{"id": u["message_id"], "case_id": u["case_id"]} for u in urls] if posts is None else posts
    snapshots = [{"capture_status": "ok", "capture_method": "playwright"} | s for s in snapshots]
    given = {"cases": [{"id": 1, "title": "one"}, {"id": 2, "title": "two"}], "url_artifacts": urls, "message_evidence": posts, "scan_runs": scans, "snapshots": snapshots, "redirect_hops": list(hops), "acquisitions": list(acquisitions)}
    return empty_tables(spark, **{k: frame(k, v) for k, v in given.items()})


def signals(spark, t, kind, **more):
    rows = index.extract_signals(t, "db", "now", **more).where(f"signal_type = '{kind}'").collect()
    return sorted((r.signal_value, r.platform, r.final_domain, r.scan_run_id) for r in rows)


def test_scan_kinds_name_their_owner(spark):
    tls = json.dumps({"serialNumber": " 0A ", "issuer": {"organizationName": ["Org"], "commonName": "cn"}})
    t = case(spark, [{"url_artifact_id": 1, "final_url": "https://Land.test/x", "whois_registrar": " R ", "asn": "AS1", "as_org": "Net ", "tls_info_json": tls}, {"url_artifact_id": 2, "asn": " ", "tls_info_json": "broken"}, {"url_artifact_id": 3, "status": "error", "final_url": "http://no.test/"}])
    assert signals(spark, t, "final_domain") == [("land.test", None, "land.test", 10)]
    assert signals(spark, t, "registrar") == [("R", None, "land.test", 10)]
    assert signals(spark, t, "asn") == [("AS1", "Net", "land.test", 10)]
    assert signals(spark, t, "cert_serial") == [("0A", "Org", "land.test", 10)]


def test_ids_belong_to_the_capture_and_the_last_one_stays(spark):
    ids = json.dumps({"Meta Pixel": ["1" * 15, " "], "Google Tag Manager": ["GTM-1"], "Odd": "x"})
    shots = [{"id": 1, "scan_run_id": 10, "final_domain": "Visitor.test", "tracking_ids_json": ids}, {"id": 2, "scan_run_id": 10, "final_domain": "crawler.test", "tracking_ids_json": ids}, {"id": 3, "scan_run_id": 10, "final_domain": "late.test", "tracking_ids_json": ids, "capture_status": "error"}]
    t = case(spark, [{"url_artifact_id": 1, "final_url": "https://land.test/"}], shots)
    assert signals(spark, t, "tracking_id") == [("1" * 15, "Meta Pixel", "crawler.test", 10)]
    assert signals(spark, t, "gtm_container") == [("GTM-1", "Google Tag Manager", "crawler.test", 10)]


def test_header_values(spark):
    pairs = [["X-Origin", " host/a "], ["Server", "nginx"], ["X-Short", "abc"], ["X-Long", "distinctive"], ["X-Frame-Options", "DENY-ALWAYS"], ["Via", "1.1 some/proxy"], ["Date", "d/1"]]
    hop = lambda i, s, extra=(): {"id": i, "scan_run_id": s, "url": "https://land.test/a", "response_headers_json": json.dumps([*pairs, *extra])}
    t = case(spark, [{"url_artifact_id": 2, "final_url": "https://land.test/"}, {"url_artifact_id": 1, "final_url": "https://land.test/"}], hops=[hop(1, 10, [["X-Varies", "value/1"]]), hop(2, 20, [["X-Varies", "value/2"]])])
    assert signals(spark, t, "header_value") == [("distinctive", "x-long", "land.test", 10), ("host/a", "x-origin", "land.test", 10)]


def test_endpoints_are_apexes_of_other_owners(spark):
    hosts = json.dumps(["cdn.land.test", "a.Other.test ", "b.other.test", "www.google.com", "", "203.0.113.9"])
    shots = [{"id": 1, "scan_run_id": 10, "final_domain": "www.land.test", "request_domains_json": hosts}, {"id": 2, "scan_run_id": 20, "final_domain": "", "request_domains_json": hosts}]
    t = case(spark, [{"url_artifact_id": 1, "final_url": "https://x.test/"}, {"url_artifact_id": 2, "final_url": "https://y.test/"}], shots)
    assert signals(spark, t, "har_endpoint") == [("203.0.113.9", None, "www.land.test", 10), ("other.test", None, "www.land.test", 10)]


def ads_txt(accounts, status="ok", **more):
    return json.dumps({"status": status, "raw_sha256": "s", "records": [{"adsystem": a, "seller_id": s, "relationship": r} for a, s, r in accounts]} | more)


def test_accounts(spark):
    own = [("Rare.test", " 7 ", "direct"), ("other.test", "7", "DIRECT"), ("openx.com", "1", "DIRECT"), ("rare.test", "r", "RESELLER"), ("rare.test", "", "DIRECT"), ("known.test", "k", "DIRECT"), ("pair.test", "p", "DIRECT")]
    files = [own, [("pair.test", "p", "DIRECT")], [("x.test", "1", "DIRECT")], [("y.test", "1", "DIRECT")]]
    scans = [{"url_artifact_id": i, "final_url": f"https://d{i}.test/", "ads_txt_json": ads_txt(f, owner_domain=" Own.test ", manager_domain="M.test")} for i, f in enumerate(files, 1)]
    scans.append({"url_artifact_id": 9, "final_url": "https://e.test/", "ads_txt_json": ads_txt([("unserved.test", "u", "DIRECT")], status="error", owner_domain="no.test")})
    prevalence = spark.createDataFrame([("known.test", "k", 10, 1000)], "adsystem string, seller_id string, hits long, site_count long")
    t = case(spark, scans)
    got = signals(spark, t, "ads_txt_seller", prevalence=prevalence)
    # of two systems with one account id in one file the last stays; pair.test is carried by managed domains only
    assert got == [("1", "x.test", "d3.test", 30), ("1", "y.test", "d4.test", 40), ("7", "other.test", "d1.test", 10), ("u", "unserved.test", "e.test", 90)]
    assert {x[0] for x in signals(spark, t, "ads_txt_owner")} == {"own.test"} and len(signals(spark, t, "ads_txt_manager")) == 4
    assert signals(spark, t, "ads_txt_seller", conf=Conf(carrier_max_accounts=4)) == [("1", "x.test", "d3.test", 30), ("1", "y.test", "d4.test", 40), ("u", "unserved.test", "e.test", 90)]


def test_templates_need_their_bytes(spark):
    scans = [{"url_artifact_id": i, "final_url": f"https://d{i}.test/", "ads_txt_json": ads_txt([("a", "1", "DIRECT")], **({"acquisition_id": i} if i < 4 else {}))} for i in (1, 2, 3, 4)]
    got = [{"id": i, "kind": "ads_txt", "scan_run_id": 10 * i, "body_path": f"b{i}", "captured_sha256": "s", "complete_sha256": "s", "truncated": i == 2} for i in (1, 2, 3)]
    bodies = spark.createDataFrame([("b1", "s"), ("b2", "s"), ("b3", "other")], "body_path string, body_sha256 string")
    t = case(spark, scans, acquisitions=got)
    assert signals(spark, t, "ads_txt_template", bodies=bodies) == [("s", None, "d1.test", 10)]
    states = {r.domain: r.verification for r in ads.domain_states(ads.acquisition_states(ads.ads_rows(t), t.acquisitions, bodies)).collect()}
    assert states == {"d1.test": "verified", "d2.test": "truncated", "d3.test": "body_mismatch", "d4.test": "legacy_unverifiable"}


@pytest.fixture
def pushed(spark):
    """One link in three posts, of which one has a scan, and another link."""
    urls = [{"id": i, "message_id": i, "case_id": 1, "original_url": "http://l.test/" if i < 4 else "http://m.test/"} for i in (1, 2, 3, 4)]
    ids = json.dumps({"Meta Pixel": ["9" * 15], "Hotjar": []})
    tls = json.dumps({"serialNumber": "1", "issuer": {}})
    scans = [{"url_artifact_id": i, "final_url": f"https://w{i}.test/?fbclid=1", "asn": "AS1", "intel_risk_tags": '["http"]', "tls_info_json": tls, "ads_txt_json": ads_txt([("a", "1", "DIRECT")])} for i in (1, 4)]
    shots = [{"id": i, "scan_run_id": 10 * i, "final_domain": f"W{i}.test", "tracking_ids_json": ids} for i in (1, 4)]
    return case(spark, scans, shots, urls=urls)


def test_one_link_in_many_posts_is_one_url(spark, pushed):
    asn = infra.asn_clusters(pushed).first()
    assert (asn.url_count, asn.post_count, asn.domain_count, asn.flagged_url_count, asn.tag_counts, asn.as_country) == (2, 4, 2, 2, {"http": 2}, "—")
    ids = infra.shared_tracking_ids(pushed).first()
    assert (ids.url_count, ids.post_count, ids.domains) == (2, 4, ["w1.test", "w4.test"])
    cert = infra.shared_certificates(infra.certificates(pushed)).first()
    assert (cert.url_count, cert.post_count, cert.domain_count) == (2, 4, 2)
    authority = infra.certificate_authorities(infra.certificates(pushed, "own_done")).first()
    assert (authority.issuer, authority.url_count) == ("—", 2)
    account = ads.shared_ad_accounts(ads.ads_rows(pushed)).first()
    assert (account.url_count, account.post_count, account.domain_count) == (2, 4, 2)
    platforms = {r.platform_id: r for r in infra.ad_tracking_platforms(pushed).collect()}
    meta = platforms["meta_facebook"]
    assert (meta.signal_source, meta.url_count, meta.post_count, meta.domains, meta.param_keys) == ("both", 2, 4, ["w1.test", "w4.test"], ["fbclid"])
    assert platforms["hotjar"].signal_source == "html_embedded" and platforms["hotjar"].tracking_ids == []


def test_artifacts_without_a_post_are_in_the_index_only(spark):
    t = case(spark, [{"url_artifact_id": 1, "final_url": "https://land.test/", "asn": "AS1"}], posts=[])
    assert signals(spark, t, "asn") == [("AS1", None, "land.test", 10)] and infra.asn_clusters(t).isEmpty()


def test_histogram_counts_tags_of_all_artifacts(spark):
    urls = [{"id": i, "message_id": i, "case_id": 1, "original_url": "http://l.test/" if i < 4 else "http://m.test/"} for i in (1, 2, 3, 4)]
    tags = {1: '["http"]', 2: '["new_domain","http"]', 3: None, 4: '["http"]'}
    t = case(spark, [{"url_artifact_id": i, "final_url": "https://w.test/", "intel_risk_tags": tags[i]} for i in tags], urls=urls)
    assert sorted((r.case_id, r.tag, r.n) for r in insights.risk_tag_histogram(url.destination_rows(t)).collect()) == [(1, "http", 2), (1, "new_domain", 1)]
