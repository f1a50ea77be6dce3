from tracelink.plans import driver_queries


def test_queries_read_whole_pages(spark, tmp_path):
    filler = "<p>text</p>" * 500
    rows = [
        (1, "https://a.example/", f"{filler}<script>gtag('config', 'G-REALPAGE99');</script>"), (2, "https://b.example/", None),
        (3, "https://c.example/", f'<title>Just a moment...</title><link rel="canonical" href="https://real.example/">{filler}'),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {(r.page_id, r.tracking_id) for r in driver_queries.QUERIES["extract_tracking_ids"](spark, str(tmp_path)).collect()}
    assert (1, "G-REALPAGE99") in found and {p for p, _ in found} == {1, 2, 3} and len(found) == 58
    declared = {r.page_id: (r.declared, r.challenged) for r in driver_queries.QUERIES["page_declarations"](spark, str(tmp_path)).collect()}
    assert declared == {1: ("https://c1.example/", False), 2: ("https://c2.example/", True), 3: ("https://real.example/", True)}
