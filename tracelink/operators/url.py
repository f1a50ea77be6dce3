"""Landing hosts, redirect relations and query parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelink import config
from tracelink.config import Conf
from tracelink.functions.urls import comparison_value, hostname, identify_param, owner_kind, query_pairs
from tracelink.operators.infra import sorted_set
from tracelink.operators.pins import latest_snapshot, pinned
from tracelink.schema import CaseTables, filled, string_list


def destination_rows(t: CaseTables) -> DataFrame:
    """(case_id, ua_id, post_id, original_url, final_domain, tags) of artifacts that landed on a host; tags are those of the pinned scan and of its newest capture."""
    snaps = latest_snapshot(t).select("scan_run_id", F.col("risk_tags").alias("s_tags"))
    rows = pinned(t, "url_done", "final_url", "intel_risk_tags").join(snaps, "scan_run_id", "left")
    tags = F.array_distinct(F.concat(string_list("s_tags"), string_list("intel_risk_tags")))
    return rows.select("case_id", "ua_id", "post_id", "original_url", hostname("final_url").alias("final_domain"), tags.alias("tags")).where("final_domain <> ''")


def shared_destinations(t: CaseTables) -> DataFrame:
    """Landing hosts of a case with their URLs, posts and tags; is_resolved is false for known shorteners. Resolved ones come first, most tags first."""
    posts = t.message_evidence.select(F.col("id").alias("post_id"), "platform", F.col("actor_label").alias("actor"))
    rows = destination_rows(t).join(posts, "post_id", "left")
    per = rows.groupBy("case_id", "final_domain").agg(
        F.count_distinct("original_url").alias("url_count"), F.count_distinct("post_id").alias("post_count"), sorted_set("original_url").alias("urls"), sorted_set(F.struct("post_id", "platform", "actor")).alias("posts"),
    )
    # a URL counts once, with the tags of its first artifact
    urls = rows.groupBy("case_id", "final_domain", "original_url").agg(F.min_by("tags", "ua_id").alias("tags"))
    flagged = urls.groupBy("case_id", "final_domain").agg(F.count_if(F.size("tags") > 0).alias("flagged_url_count"))
    tags = urls.select("case_id", "final_domain", F.explode("tags").alias("tag")).groupBy("case_id", "final_domain", "tag").agg(F.count("*").alias("n"))
    tags = tags.groupBy("case_id", "final_domain").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "n")))).alias("tag_counts"))
    out = per.join(flagged, ["case_id", "final_domain"]).join(tags, ["case_id", "final_domain"], "left").withColumn("is_resolved", ~F.col("final_domain").isin(config.SHORTENERS))
    return out.orderBy("case_id", F.desc("is_resolved"), F.desc(F.coalesce(F.size("tag_counts"), F.lit(0))), F.desc("flagged_url_count"), F.desc("post_count"), "final_domain")


def wrapper_relationships(t: CaseTables, conf: Conf = Conf()) -> DataFrame:
    """(original host, landing host) that differ, with hop counts and the first URLs by artifact."""
    rows = pinned(t, "url_done", "final_url", "hop_count").withColumns({"original_domain": hostname("original_url"), "final_domain": hostname("final_url")})
    rows = rows.where("original_domain <> '' AND final_domain <> '' AND original_domain <> final_domain")
    key = ["case_id", "original_domain", "final_domain"]
    first = rows.groupBy(*key, "original_url").agg(F.min("ua_id").alias("first"))
    sample = first.groupBy(*key).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("first", "original_url"))), 1, conf.sample_size), lambda x: x["original_url"]).alias("sample_urls"))
    per = rows.groupBy(*key).agg(
        F.count_distinct("original_url").alias("url_count"), F.count_distinct("post_id").alias("post_count"), F.coalesce(F.min("hop_count"), F.lit(0)).alias("min_hops"), F.coalesce(F.max("hop_count"), F.lit(0)).alias("max_hops")
    )
    return per.join(sample, key).orderBy("case_id", F.desc("url_count"), F.desc("post_count"), "original_domain", "final_domain")


def param_rows(t: CaseTables, conf: Conf = Conf()) -> DataFrame:
    """(case_id, ua_id, post_id, url, domain, param_key, param_value, compared) of the original and the final URLs."""
    base = pinned(t, "url_any", "final_url", how="left")
    urls = base.select("case_id", "ua_id", "post_id", F.explode(F.array_distinct(F.array("original_url", "final_url"))).alias("url")).where(filled("url"))
    pairs = urls.withColumn("p", F.explode(query_pairs("url")))
    return pairs.select("case_id", "ua_id", "post_id", "url", hostname("url").alias("domain"), F.col("p.key").alias("param_key"), F.col("p.value").alias("param_value"), comparison_value("p.value", conf.param_hash_length).alias("compared"))


def _owner(key: Column) -> dict[str, Column]:
    platform = identify_param(key)
    return {"platform_id": platform, "owner_kind": owner_kind(platform), "purpose_key": F.lower(key)}


def shared_params(rows: DataFrame, conf: Conf = Conf()) -> DataFrame:
    """(key, value) pairs that several posts of a case carry."""
    per = rows.groupBy("case_id", "param_key", "compared").agg(
        F.min_by("param_value", F.struct("ua_id", "url")).alias("param_value"), F.array_join(sorted_set("domain"), ", ").alias("domains"), F.count_distinct("post_id").alias("post_count"), F.count_distinct("url").alias("url_count")
    )
    per = per.where(F.col("post_count") >= conf.param_min_posts).withColumns(_owner(F.col("param_key"))).drop("compared")
    return per.orderBy("case_id", F.desc("post_count"), F.desc("url_count"), "param_key", "param_value")


def shared_param_keys(rows: DataFrame, conf: Conf = Conf()) -> DataFrame:
    """Keys that many posts carry with several values on few domains: an operator's own tracking."""
    per = rows.groupBy("case_id", "param_key").agg(
        F.count_distinct("post_id").alias("distinct_posts"), F.count_distinct("compared").alias("distinct_values"), F.count_distinct("domain").alias("distinct_domains"), F.array_join(sorted_set("domain"), ", ").alias("domains")
    )
    per = per.where((F.col("distinct_posts") >= conf.key_min_posts) & (F.col("distinct_values") >= conf.key_min_values) & (F.col("distinct_domains") <= conf.key_max_domains))
    first = rows.groupBy("case_id", "param_key", "compared").agg(F.min(F.struct("ua_id", "param_value")).alias("first"))
    top = first.groupBy("case_id", "param_key").agg(F.transform(F.slice(F.array_sort(F.collect_list("first")), 1, conf.sample_size), lambda x: x["param_value"]).alias("top_values"))
    return per.join(top, ["case_id", "param_key"]).withColumns(_owner(F.col("param_key"))).orderBy("case_id", F.desc("distinct_posts"), "param_key")
