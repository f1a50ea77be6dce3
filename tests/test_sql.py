from pyspark.sql import functions as F

from tests.test_signals import case
from tracelink import sql
from tracelink.operators import infra

TEXTS = ["https://user@Www.Example.COM:8443/a?x=1", "", None, "it's \\ \"quoted\"", "utm_source", "UTM_x", "ref", "10.0.0.1", "a" * 101, "Apr  7 00:00:00 2026 GMT", "2026-01-02 03:04:05", "a.b.example.org", "Meta Pixel", "generic"]


def test_functions_are_their_columns(spark):
    names = sql.register_functions(spark)
    rows = spark.createDataFrame([(x,) for x in TEXTS], "x string")
    rows.createOrReplaceTempView("texts")
    assert len(names) == len(sql.SCALARS)
    for name, (build, _) in sql.SCALARS.items():
        assert rows.select(build(F.col("x")).alias("y")).collect() == spark.sql(f"SELECT tl_{name}(x) AS y FROM texts").collect(), name


def test_views_are_plans(spark):
    t = case(spark, [{"url_artifact_id": i, "final_url": f"https://d{i}.test/", "asn": "AS1"} for i in (1, 2)])
    names = sql.register_case(spark, t)
    assert spark.sql("SELECT asn, domain_count FROM tl_asn_clusters WHERE case_id = 1").collect() == infra.asn_clusters(t).select("asn", "domain_count").collect()
    for name in names:
        assert spark.table(name).columns
    plan = spark.sql("SELECT case_id, tl_url_host(original_url) AS h FROM tl_unscanned_urls")._jdf.queryExecution().optimizedPlan().toString()
    assert "tl_url_host" not in plan and "regexp_extract" in plan
