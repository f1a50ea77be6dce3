"""Screening candidates in bulk and clustering what was observed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelink.config import Conf
from tracelink.functions.decisions import VERDICT_RANK, rank_of, screening
from tracelink.functions.suffixes import SuffixRules, apexes
from tracelink.operators.infra import sorted_set
from tracelink.schema import filled


def known_templates(rows: DataFrame) -> DataFrame:
    """(sha, matched_domains) of good ads.txt files of cases."""
    good = rows.where((F.col("status") == "ok") & (F.size("records") > 0) & filled("sha"))
    return good.groupBy("sha").agg(sorted_set("domain").alias("matched_domains"))


def screen_ads_txt(observations: DataFrame, templates: DataFrame) -> DataFrame:
    """Observations with their verdict: does a candidate serve a file that a case knows."""
    joined = observations.drop("verdict").join(templates, observations.raw_sha256 == templates.sha, "left")
    verdict = screening(F.col("status"), F.col("record_count"), F.col("matched_domains").isNotNull())
    none = F.array().cast("array<string>")
    return joined.withColumns({
        "verdict": verdict, "matched_sha": F.when(verdict == "template_match", F.col("raw_sha256")), "matched_domains": F.when(verdict == "template_match", F.col("matched_domains")).otherwise(none)
    }).drop("sha")


def screen_domains(candidates: DataFrame, observations: DataFrame, templates: DataFrame) -> DataFrame:
    """Verdicts of distinct candidates (domain, pos), template matches first; a candidate nobody reached is unreachable."""
    first = candidates.groupBy("domain").agg(F.min("pos").alias("pos"))
    return screen_ads_txt(first.join(observations, "domain", "left"), templates).orderBy(rank_of(F.col("verdict"), VERDICT_RANK), "domain")


def direct_pairs(records):
    """Sorted distinct [adsystem, seller] pairs of DIRECT records."""
    direct = F.filter(records, lambda r: F.upper(r["relationship"]) == "DIRECT")
    return F.array_sort(F.array_distinct(F.transform(direct, lambda r: F.array(r["adsystem"], r["seller_id"]))))


def cluster_by_template(observations: DataFrame, conf: Conf = Conf()) -> DataFrame:
    """Files that several observed domains serve byte for byte; one with very many accounts is a platform's, others are portfolios."""
    good = observations.where((F.col("status") == "ok") & filled("raw_sha256"))
    size = F.coalesce(F.size("accounts"), F.lit(0))
    per = good.groupBy(F.col("raw_sha256").alias("sha256")).agg(sorted_set("domain").alias("domains"), F.count_distinct("domain").alias("domain_count"), F.max(size).alias("account_count"))
    per = per.where((F.col("domain_count") >= conf.min_domains) & (F.col("account_count") >= 1))
    per = per.withColumns({"sha256_short": F.substring("sha256", 1, 12), "kind": F.when(F.col("account_count") >= conf.platform_accounts, "platform").otherwise("portfolio")})
    return per.orderBy(F.desc(F.col("kind") == "portfolio"), F.desc("domain_count"), "sha256")


def build_prevalence(observations: DataFrame) -> DataFrame:
    """(adsystem, seller_id, hits, site_count): on how many of the good sites an account is listed."""
    good = observations.where(F.col("status") == "ok")
    pairs = good.select("domain", F.explode("accounts").alias("a")).select("domain", F.col("a")[0].alias("adsystem"), F.col("a")[1].alias("seller_id")).distinct()
    sites = good.agg(F.count_distinct("domain").alias("site_count"))
    return pairs.groupBy("adsystem", "seller_id").agg(F.count("*").alias("hits")).crossJoin(F.broadcast(sites)).orderBy(F.desc("hits"), "adsystem", "seller_id")


def verdict_histogram(screened: DataFrame) -> DataFrame:
    return screened.groupBy("verdict").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "verdict")


def portfolios(clusters: DataFrame) -> DataFrame:
    return clusters.where("kind = 'portfolio'")


def without_scanned(candidates: DataFrame, scanned_apexes: DataFrame, rules: SuffixRules | None = None) -> DataFrame:
    """Candidates (domain) whose apex no case has scanned."""
    return apexes(candidates, rules, apex="domain").join(scanned_apexes.select("apex").distinct(), "apex", "left_anti").drop("apex")


def distinct_in_order(rows: DataFrame, column: str, pos: str = "pos") -> DataFrame:
    return rows.groupBy(column).agg(F.min(pos).alias(pos)).orderBy(pos)


def round_robin(jobs: DataFrame, apex: str = "apex", pos: str = "pos") -> DataFrame:
    """Jobs interleaved over apexes in the order in which these first occur."""
    from pyspark.sql import Window

    firsts = F.min(pos).over(Window.partitionBy(apex))
    line = F.row_number().over(Window.partitionBy(apex).orderBy(pos))
    return jobs.withColumns({"_turn": line, "_first": firsts}).orderBy("_turn", "_first").drop("_turn", "_first")
