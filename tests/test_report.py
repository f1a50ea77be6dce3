import json

from tests.test_signals import ads_txt, case
from tracelink.operators import insights, pins, report
from tracelink.schema import empty_tables


def told(df):
    return {(r.case_id, r.key): (r.place, dict(r.numbers), [dict(i) for i in r["items"]]) for r in df.collect()}


def pages(spark):
    """Case 1: two sites with shared ids, endpoints and files, a shortener, a cloaking link; case 2 has no URL."""
    ids = json.dumps({"Meta Pixel": ["9" * 15], "Google Tag Manager": ["GTM-1"]})
    tls = json.dumps({"serialNumber": "1", "notBefore": "Apr  7 00:00:00 2026 GMT", "issuer": {"organizationName": "CA"}})
    scans = [{"url_artifact_id": i, "final_url": f"https://d{i}.test/?ref=x&key={i}", "asn": "AS1", "as_org": "Net", "tls_info_json": tls, "intel_risk_tags": '["new_domain"]' if i == 1 else None, "ads_txt_json": ads_txt([("a.test", str(k), "DIRECT") for k in range(3)]), "cloaking_signal_json": '{"verdict":"cloaking_suspect"}' if i == 2 else None, "hop_count": 2} for i in (1, 2)]
    scans.append({"url_artifact_id": 3, "final_url": "https://bit.ly/x"})
    scans.append({"url_artifact_id": 4, "status": "error"})
    shots = [{"id": i, "scan_run_id": 10 * i, "final_domain": f"d{i}.test", "tracking_ids_json": ids, "request_domains_json": json.dumps(["203.0.113.7", "cdn.other.test"])} for i in (1, 2)]
    pairs = json.dumps([["Server", "PHP/9.1"], ["X-Powered-By", "Express"]])
    hops = [{"id": i, "scan_run_id": 10 * i, "url": f"https://d{i}.test/", "response_headers_json": pairs} for i in (1, 2)]
    return case(spark, scans, shots, hops)


def captures(spark):
    rows = [(1, "d1.test", m, ok) for m, ok in [("http_only", False), ("playwright", True)]] + [(1, "d2.test", "playwright", True), (1, "d3.test", "http_only", True), (1, "d4.test", "http_only", True)]
    return spark.createDataFrame(rows, "case_id long, domain string, capture_method string, ok boolean")


def test_bullets_of_a_case(spark):
    t = pages(spark)
    found, counted = report.findings(t, captures(spark)), report.counts(t)
    got = told(report.bullets(found, counted))
    assert {k: v[1].get("n") for k, v in got.items()} == {
        (1, "cloaking"): "1", (1, "fake_version"): "2", (1, "header_template"): "2", (1, "opsec_strong"): "1", (1, "landing"): None, (1, "risk"): None, (1, "unresolved"): "1", (1, "wrapper"): "3", (1, "param"): None,
        (1, "tracking_id"): "1", (1, "endpoint_direct_ip"): "2", (1, "tls_cert"): "1", (1, "infra"): "1", (2, "no_scans"): None,
    }
    assert [v[0] for k, v in sorted(got.items(), key=lambda x: x[1][0]) if k[0] == 1] == list(range(1, 14))
    assert got[1, "tracking_id"][1] == {"n": "1", "platform": "Meta Pixel", "tracking_id": "9" * 15, "domains": "2"}
    assert got[1, "param"][1] == {"key": "ref", "value": "x", "posts": "2", "owner_kind": "generic", "platform_id": "generic"}
    assert got[1, "landing"][2] == [{"domain": "d1.test", "posts": "1", "urls": "1"}, {"domain": "d2.test", "posts": "1", "urls": "1"}]
    assert got[1, "risk"][1:] == ({"flagged": "1"}, [{"tag": "new_domain", "n": "1"}]) and got[1, "opsec_strong"][2] == [{"domain": "d1.test"}]
    assert got[1, "endpoint_direct_ip"][1] == {"n": "2", "endpoint": "203.0.113.7", "domains": "2"} and got[1, "infra"][1]["org"] == "Net"
    assert len(told(report.bullets(found, counted, most=3))) == 4
    head = {r.case_id: tuple(r)[1:] for r in report.headline(found, counted).collect()}
    assert head == {1: (4, 3, 2, 1, 1, 1), 2: (0, 0, 0, 0, 0, 0)}


def test_narrative_and_gaps(spark):
    t = pages(spark)
    found, counted = report.findings(t, captures(spark)), report.counts(t)
    got = {r.case_id: r for r in report.narrative(report.signal_counts(found), counted).collect()}
    one, two = got[1], got[2]
    assert (one.grouping, one.behaviour, one.summary, one.partial, one.url_count, one.scanned) == ("strong", True, "grouping_and_behaviour", True, 4, 3)
    # the same file on both sites has no retained bytes, and its accounts are on two apexes only
    assert [(r.tier, r.key, r.n) for r in one.reasons] == [("strong", "tracking_account", 1), ("strong", "certificate", 1), ("strong", "header_template", 2), ("behaviour", "cloaking", 1), ("behaviour", "fake_version", 2), ("behaviour", "opsec", 1)]
    assert one.coverage == 90 and (two.summary, two.has_signal, two.coverage, two.partial) == ("no_signal", False, 0, False)
    gaps = {(r.case_id, r.key): (r.place, r.n) for r in report.gaps(t, counted, insights.opsec_profile(captures(spark))).collect()}
    assert gaps == {(1, "intel"): (1, 3), (1, "snap"): (2, 1), (1, "tls"): (3, 1), (1, "corr"): (4, 3), (1, "unscanned"): (5, 1), (1, "opsec_no_lightweight"): (6, 1), (1, "opsec_no_playwright"): (7, 2)}


def test_nothing_to_tell(spark):
    t = empty_tables(spark)
    assert report.bullets(report.findings(t), report.counts(t)).isEmpty() and report.narrative(report.signal_counts(report.findings(t)), report.counts(t)).isEmpty()


def test_counts_ask_for_the_newest_scan(spark):
    t = case(spark, [{"url_artifact_id": 1, "id": 10, "final_url": "https://a.test/"}, {"url_artifact_id": 1, "id": 11, "status": "error"}, {"url_artifact_id": 2, "id": 20, "status": "error"}, {"url_artifact_id": 2, "id": 21}])
    assert tuple(pins.case_counts(t).first()) == (1, 2, 1)
    shown = pins.case_show(t).first()
    assert (shown.url_count, shown.scanned, shown.unscanned, shown.pending) == (2, 1, 1, 4)
