"""ads.txt accounts and templates: who carries what, and how much that says about the operator.

Accounts of an exchange are carried by most domains, often in files that are alike. Domains with the same account set are one
class; pairs of classes that may share enough come from a self-join on each class's rarest accounts, weigh as many pairs of domains as they stand
for, and are joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelink import config
from tracelink.config import Conf
from tracelink.functions.decisions import CLUSTER_ORDER, rank_of, verification
from tracelink.functions.suffixes import SuffixRules, apexes
from tracelink.functions.urls import hostname
from tracelink.operators.infra import sorted_set
from tracelink.operators.pins import pinned
from tracelink.schema import CaseTables, ads_txt, filled
from tracelink.storage import materialise

ACCOUNT = ["adsystem", "seller_id"]
#: An account set's digest is that of so many parts.
SET_PARTS = 1024
#: Classes that hold an account are paired where there are at most so many.
LIGHT_CARRIERS = 64


def ads_rows(t: CaseTables, pin: str = "url_done", rules: SuffixRules | None = None) -> DataFrame:
    """(case_id, ua_id, post_id, original_url, scan_run_id, domain, apex, status, sha, manager, owner, acquisition_id, records) of pinned scans that landed somewhere and have ads.txt."""
    rows = pinned(t, pin, "final_url", "ads_txt_json", posts=pin != "own_done").where(filled("ads_txt_json")).withColumn("ads", ads_txt())
    rows = rows.where(F.col("ads").isNotNull()).withColumn("domain", hostname("final_url")).where("domain <> ''")
    return apexes(rows, rules, apex="domain").select(
        "case_id", "ua_id", "post_id", "original_url", "scan_run_id", "domain", "apex", "ads.status", F.col("ads.raw_sha256").alias("sha"), F.lower(F.trim("ads.manager_domain")).alias("manager"),
        F.lower(F.trim("ads.owner_domain")).alias("owner"), "ads.acquisition_id", F.coalesce("ads.records", F.array().cast("array<struct<adsystem:string,seller_id:string,relationship:string,cert_authority_id:string>>")).alias("records"),
    )


def direct_accounts(rows: DataFrame) -> DataFrame:
    """One row per DIRECT record that names a system and an account; `place` is its place in the file."""
    each = rows.select("*", F.posexplode("records").alias("place", "r")).where(F.upper("r.relationship") == "DIRECT")
    named = each.select(*[c for c in rows.columns if c != "records"], "place", F.lower("r.adsystem").alias("adsystem"), F.trim("r.seller_id").alias("seller_id"))
    return named.where("adsystem <> '' AND seller_id <> ''")


def account_footprint(accounts: DataFrame) -> DataFrame:
    """(adsystem, seller_id, global_apex_count): apexes in all cases that list an account DIRECT in a good file."""
    return accounts.where("status = 'ok'").groupBy(*ACCOUNT).agg(F.count_distinct("apex").alias("global_apex_count"))


def account_classes(accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Domains of a case with the same account set are one class, named by its first domain: (case_id, class, members, size) and the classes' accounts."""
    own = accounts.select("case_id", "domain", *ACCOUNT).distinct()
    # digests of parts, so that no set is held whole
    parts = own.groupBy("case_id", "domain", F.pmod(F.xxhash64(*ACCOUNT), F.lit(SET_PARTS)).alias("part")).agg(F.array_sort(F.collect_list(F.struct(*ACCOUNT))).alias("set"))
    parts = parts.select("case_id", "domain", F.size("set").alias("n"), F.struct("part", F.sha2(F.to_json("set"), 256).alias("digest")).alias("p"))
    sets = parts.groupBy("case_id", "domain").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("p"))), 256).alias("set"), F.sum("n").alias("size"))
    classes = sets.groupBy("case_id", "set").agg(F.min("domain").alias("class"), F.count("*").alias("members"), F.max("size").alias("size")).drop("set")
    classes = materialise(classes, "classes")
    held = own.withColumnRenamed("domain", "class").join(classes.select("case_id", "class"), ["case_id", "class"])
    return classes, materialise(held, "held")


def by_carriers(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes' accounts that up to LIGHT_CARRIERS classes of the case hold, and those that more do; accounts of one class are in neither."""
    counted = held.join(held.groupBy("case_id", *ACCOUNT).agg(F.count("*").alias("carriers")), ["case_id", *ACCOUNT])
    light = counted.where((F.col("carriers") > 1) & (F.col("carriers") <= LIGHT_CARRIERS)).drop("carriers")
    return light, counted.where(F.col("carriers") > LIGHT_CARRIERS).drop("carriers")


def light_pairs(light: DataFrame) -> DataFrame:
    """(case_id, account, c1, c2), c1 < c2: each two classes that hold an account; bounded, since few classes hold one."""
    side = lambda name: light.withColumnRenamed("class", name)
    return side("c1").join(side("c2"), ["case_id", *ACCOUNT]).where("c1 < c2")


def heavy_pairs(pairs: DataFrame, heavy: DataFrame) -> DataFrame:
    """Rows of pairs (case_id, c1, c2, more) with each account that both classes hold: those of the first, kept if the second has them, so that carriers of a hub aren't paired."""
    first = pairs.join(heavy.withColumnRenamed("class", "c1"), ["case_id", "c1"])
    return first.join(heavy.withColumnRenamed("class", "c2"), ["case_id", "c2", *ACCOUNT], "left_semi")


def linked_classes(classes: DataFrame, held: DataFrame, conf: Conf = Conf()) -> DataFrame:
    """(case_id, c1, c2, pairs), c1 < c2: classes whose domains share enough accounts for one template, and how many pairs of domains that is."""
    # of a link's shared accounts one stands among the rarest of either class: a class leaves out fewer than must be shared
    carried = held.groupBy("case_id", *ACCOUNT).agg(F.count("*").alias("carriers"))
    rarest = Window.partitionBy("case_id", "class").orderBy("carriers", *ACCOUNT)
    ranked = held.join(carried, ["case_id", *ACCOUNT]).join(classes.select("case_id", "class", "size"), ["case_id", "class"]).withColumn("place", F.row_number().over(rarest))
    ranked = ranked.where((F.col("carriers") > 1) & (F.col("size") >= conf.template_min_shared))
    need = F.greatest(F.lit(conf.template_min_shared), F.ceil(conf.template_overlap * F.col("size") - 1e-9))
    small = ranked.where(F.col("place") <= F.col("size") - need + 1).select("case_id", *ACCOUNT, F.col("class").alias("x"), F.col("size").alias("sx"))
    large = ranked.where(F.col("place") <= F.col("size") - conf.template_min_shared + 1).select("case_id", *ACCOUNT, F.col("class").alias("y"), F.col("size").alias("sy"))
    order = (F.col("sx") < F.col("sy")) | (F.col("sx") == F.col("sy")) & (F.col("x") < F.col("y"))
    pairs = small.join(large, ["case_id", *ACCOUNT]).where(order).select("case_id", F.least("x", "y").alias("c1"), F.greatest("x", "y").alias("c2")).distinct()
    pairs = materialise(pairs, "pairs")
    light, heavy = by_carriers(held)
    key = ["case_id", "c1", "c2"]
    few = light_pairs(light).groupBy(*key).agg(F.count("*").alias("few"))
    many = heavy_pairs(pairs, heavy).groupBy(*key).agg(F.count("*").alias("many"))
    shared = pairs.join(few, key, "left").join(many, key, "left").select(*key, (F.coalesce("few", F.lit(0)) + F.coalesce("many", F.lit(0))).alias("shared"))
    shared = shared.where(F.col("shared") >= conf.template_min_shared)
    side = lambda n: classes.select("case_id", F.col("class").alias(f"c{n}"), F.col("members").alias(f"m{n}"), F.col("size").alias(f"s{n}"))
    sized = shared.join(side(1), ["case_id", "c1"]).join(side(2), ["case_id", "c2"])
    return sized.where(F.col("shared") >= conf.template_overlap * F.least("s1", "s2")).select("case_id", "c1", "c2", (F.col("m1") * F.col("m2")).alias("pairs"))


def pair_link_counts(accounts: DataFrame, conf: Conf = Conf()) -> DataFrame:
    """(case_id, account, linked): linked pairs among an account's carriers, counted by classes of equal files and never listed."""
    classes, held = account_classes(accounts)
    links = materialise(linked_classes(classes, held, conf), "links")
    linked = links.select("case_id", F.explode(F.array("c1", "c2")).alias("class")).distinct()
    light, heavy = by_carriers(held.join(linked, ["case_id", "class"], "left_semi"))
    both = light_pairs(light).join(links, ["case_id", "c1", "c2"]).unionByName(heavy_pairs(links, heavy)).select("case_id", *ACCOUNT, "pairs")
    # domains of one class share all they have
    alike = classes.where((F.col("members") > 1) & (F.col("size") >= conf.template_min_shared)).select("case_id", "class", (F.col("members") * (F.col("members") - 1) / 2).cast("long").alias("pairs"))
    within = held.join(alike, ["case_id", "class"]).select("case_id", *ACCOUNT, "pairs")
    return both.union(within).groupBy("case_id", *ACCOUNT).agg(F.sum("pairs").alias("linked"))


def shared_ad_accounts(rows: DataFrame, prevalence: DataFrame | None = None, conf: Conf = Conf()) -> DataFrame:
    """DIRECT accounts on several domains of a case, with the tier that their breadth, links, footprint and rarity give.

    Records count whatever the file's status; breadth, footprint and a domain's manager need a good file. A domain whose files name several managers has that of
    the largest artifact id. An account that the prevalence table does not know has null prevalence, which demotes nothing.
    """
    accounts = materialise(direct_accounts(rows).select("case_id", "domain", "apex", "status", "original_url", "post_id", *ACCOUNT), "accounts")
    served = rows.where((F.col("status") == "ok") & (F.size("records") > 0))
    good = served.groupBy("case_id").agg(F.count_distinct("domain").alias("denominator"))
    managers = served.where(filled("manager")).groupBy("case_id", "domain").agg(F.max_by("manager", "ua_id").alias("named"))
    per = accounts.join(managers, ["case_id", "domain"], "left").groupBy("case_id", *ACCOUNT).agg(
        F.count_distinct("domain").alias("domain_count"), F.count_distinct("original_url").alias("url_count"), F.count_distinct("post_id").alias("post_count"), sorted_set("domain").alias("domains"),
        sorted_set("named").alias("declared_managers"), F.count_distinct(F.when(F.col("named").isNotNull(), F.col("domain"))).alias("managed"),
    ).where(F.col("domain_count") >= conf.min_domains)
    joined = per.join(good, "case_id", "left").join(account_footprint(accounts), ACCOUNT, "left").join(pair_link_counts(accounts, conf), ["case_id", *ACCOUNT], "left")
    if prevalence is None:
        joined = joined.withColumns({"hits": F.lit(None).cast("long"), "site_count": F.lit(None).cast("long")})
    else:
        joined = joined.join(prevalence, ACCOUNT, "left")
    pairs = F.col("domain_count") * (F.col("domain_count") - 1) / 2
    joined = joined.withColumns({
        "breadth_ratio": F.col("domain_count") / F.greatest(F.coalesce("denominator", F.lit(0)), F.lit(1)), "pair_link_ratio": F.coalesce("linked", F.lit(0)) / pairs,
        "reference_prevalence": F.col("hits") / F.col("site_count"), "all_carriers_managed": F.col("managed") == F.col("domain_count"),
        "global_apex_count": F.coalesce("global_apex_count", F.lit(0)), "linked_pairs": F.coalesce("linked", F.lit(0)).cast("long"),
    })
    manager = (
        F.col("all_carriers_managed") | F.coalesce(F.col("reference_prevalence") >= conf.commodity_prevalence, F.lit(False)) | F.col("adsystem").isin(config.EXCHANGES)
        | (F.col("breadth_ratio") >= conf.manager_breadth) | (F.col("pair_link_ratio") >= conf.manager_pair_ratio) | (F.col("global_apex_count") >= conf.manager_min_apexes)
    )
    tier = F.when(manager, "manager").when(F.col("global_apex_count") <= conf.operator_max_apexes, "operator").otherwise("uncertain")
    out = joined.withColumns({"tier": tier, "platform_id": F.lit("ads_txt_seller")}).drop("managed", "linked", "denominator", "hits", "site_count")
    return out.orderBy("case_id", rank_of(F.col("tier"), ["operator", "uncertain", "manager"]), F.desc("domain_count"), *ACCOUNT)


def acquisition_states(rows: DataFrame, acquisitions: DataFrame, bodies: DataFrame | None) -> DataFrame:
    """(case_id, ua_id, scan_run_id, domain, sha, acquisition_id, verification): the state of the bytes behind each good ads.txt. bodies: (body_path, body_sha256)."""
    good = rows.where((F.col("status") == "ok") & (F.size("records") > 0) & filled("sha"))
    kept = acquisitions.select(F.col("id").alias("acquisition_id"), F.struct("id", "kind", "scan_run_id", "body_path", "truncated", "captured_sha256", "complete_sha256").alias("acq"))
    joined = good.join(kept, "acquisition_id", "left").withColumn("body_path", F.col("acq.body_path"))
    joined = joined.join(bodies, "body_path", "left") if bodies is not None else joined.withColumn("body_sha256", F.lit(None).cast("string"))
    state = verification(F.col("acq"), F.lit("ads_txt"), F.col("scan_run_id"), F.col("sha"), F.col("body_sha256"))
    return joined.select("case_id", "ua_id", "scan_run_id", "domain", "sha", "acquisition_id", F.when(F.col("acquisition_id").isNull(), "legacy_unverifiable").otherwise(state).alias("verification"))


def domain_states(states: DataFrame) -> DataFrame:
    """(case_id, domain, sha, verification): one state for a domain and file, that of the largest artifact id with an acquisition."""
    held = F.col("acquisition_id").isNotNull()
    per = states.groupBy("case_id", "domain", "sha").agg(F.max_by("verification", F.when(held, F.col("ua_id"))).alias("verification"))
    return per.withColumn("verification", F.coalesce("verification", F.lit("legacy_unverifiable")))


def shared_templates(states: DataFrame, conf: Conf = Conf()) -> DataFrame:
    """ads.txt files served byte for byte by several domains of a case, with the worst state of their members. states: of `domain_states`."""
    order = [*CLUSTER_ORDER, "legacy_unverifiable"]
    worst = F.min(F.when(F.col("verification") != "verified", F.array_position(F.array(*map(F.lit, order)), F.col("verification"))))
    per = states.groupBy("case_id", "sha").agg(F.count_distinct("domain").alias("domain_count"), sorted_set("domain").alias("domains"), worst.alias("worst"), sorted_set(F.struct("domain", "verification")).alias("verification_by_domain"))
    per = per.where(F.col("domain_count") >= conf.min_domains).withColumn("verification", F.coalesce(F.get(F.array(*map(F.lit, order)), (F.col("worst") - 1).cast("int")), F.lit("verified")))
    return per.select("case_id", F.col("sha").alias("sha256"), F.substring("sha", 1, 12).alias("sha256_short"), "domains", "domain_count", "verification", "verification_by_domain").orderBy("case_id", F.desc("domain_count"), "sha256")
