"""Identity of a pack as a hash tree, so that members are proven and verified one by one and in parallel.

A member's place in the tree is the hash of its name: buckets are the first hex digits of it, and each level above takes the digits away one by one. So no order over
all members is needed; a node has sixteen children at most, a bucket some sixteen members, and every level is one partially aggregated grouping. The root
changes with any name, content or number of members; a proof is a member's bucket and its nodes' children on the way up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "case_id BIGINT, level INT, prefix STRING, digest STRING, children ARRAY<STRING>"
FAN = 16


def leaf(sha256: Column, arcname: Column) -> Column:
    """Digest of a member: its content's digest and its name."""
    return F.sha2(F.concat(F.lit("leaf:"), sha256, F.lit("  "), arcname), 256)


def node(children: Column) -> Column:
    """Digest of a node from its children's digests in order."""
    return F.sha2(F.concat(F.lit("node:"), F.array_join(children, "")), 256)


def levels_for(members: int) -> int:
    """So many digits as leave some sixteen members in a bucket."""
    return max(0, math.ceil(math.log(max(1, members) / FAN, FAN)))


def leaves(members: DataFrame) -> DataFrame:
    """(case_id, arcname, place, leaf) of (case_id, arcname, sha256). A name that a case has twice is two members."""
    return members.select("case_id", "arcname", F.sha2("arcname", 256).alias("place"), leaf(F.col("sha256"), F.col("arcname")).alias("leaf"))


def tree(members: DataFrame, levels: int) -> DataFrame:
    """NODE rows of each case from its buckets (level `levels`) to its root (level 0, an empty prefix). Members without a name or digest make no tree: drop or refuse them first."""
    prefix = F.substring("place", 1, levels) if levels else F.lit("")
    buckets = leaves(members).groupBy("case_id", prefix.alias("prefix")).agg(F.array_sort(F.collect_list("leaf")).alias("children"))
    row = buckets.select("case_id", F.lit(levels).alias("level"), "prefix", node(F.col("children")).alias("digest"), "children")
    out = row
    for level in range(levels - 1, -1, -1):
        above = F.substring("prefix", 1, level) if level else F.lit("")
        row = row.groupBy("case_id", above.alias("_above")).agg(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda c: c["digest"]).alias("children"))
        row = row.select("case_id", F.lit(level).alias("level"), F.col("_above").alias("prefix"), node(F.col("children")).alias("digest"), "children")
        out = out.unionByName(row)
    return out


def roots(nodes: DataFrame) -> DataFrame:
    """(case_id, root)."""
    return nodes.where("level = 0").select("case_id", F.col("digest").alias("root"))


def proofs(nodes: DataFrame, members: DataFrame, levels: int) -> DataFrame:
    """(case_id, arcname, leaf, path) of members (case_id, arcname, sha256): the children of the member's bucket and of each node above it, from the bucket up."""
    wanted = leaves(members)
    each = wanted.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("prefix", F.when(F.col("level") > 0, F.expr("substring(place, 1, level)")).otherwise(""))
    found = each.join(nodes.select("case_id", "level", "prefix", "children"), ["case_id", "level", "prefix"])
    path = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("level", "children")))), lambda s: s["children"])
    return found.groupBy("case_id", "arcname", "leaf").agg(path.alias("path"))


def verified(proofs_: DataFrame, roots_: DataFrame) -> DataFrame:
    """(case_id, arcname, ok): whether the path leads from the member to the case's root. It is worked out in the row; neither tree nor other members are read."""
    step = lambda at, children: F.when(F.array_contains(children, at), node(children))
    top = F.aggregate("path", F.col("leaf"), step)
    joined = proofs_.join(roots_, "case_id", "left")
    return joined.select("case_id", "arcname", F.coalesce((F.size("path") > 0) & (top == F.col("root")), F.lit(False)).alias("ok"))


def verified_members(nodes: DataFrame, members: DataFrame, roots_: DataFrame, levels: int) -> DataFrame:
    """(case_id, arcname, ok) of many members (case_id, arcname, sha256) at once: what `verified` says of their proofs, without a path for each of them.

    Members of a bucket share their path, so each node is hashed and found in the one above it once, from the root down. A member is then looked up among the leaves of
    its case's sound buckets: rows of one digest, however many members a bucket has.
    """
    sound = nodes.where(F.col("digest") == node(F.col("children"))).select("case_id", "level", "prefix", "digest", "children")
    held = sound.where("level = 0").join(roots_, "case_id").where("digest = root").select("case_id", "prefix", "children")
    for level in range(1, levels + 1):
        above = held.select("case_id", F.col("prefix").alias("_above"), F.col("children").alias("_digests"))
        below = sound.where(F.col("level") == level).withColumn("_above", F.expr(f"substring(prefix, 1, {level - 1})"))
        held = below.join(above, ["case_id", "_above"]).where(F.array_contains("_digests", F.col("digest"))).select("case_id", "prefix", "children")
    known = held.select("case_id", "prefix", F.explode(F.array_distinct("children")).alias("leaf")).withColumn("ok", F.lit(True))
    wanted = leaves(members).withColumn("prefix", F.expr(f"substring(place, 1, {levels})")).drop("place")
    return wanted.join(known, ["case_id", "prefix", "leaf"], "left").select("case_id", "arcname", F.coalesce("ok", F.lit(False)).alias("ok"))
