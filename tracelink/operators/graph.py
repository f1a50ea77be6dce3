"""Connected components by contraction."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelink.storage import discard, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is the smallest node reachable.

    Each round puts the nodes in another order, by a hash of the round and the node; sends every node to the first among itself and
    its neighbours, jumps once along those pointers, and renames the edges. The last node of a component never stays, so
    rounds go on until no edge is left; the edge list is expected to shrink geometrically whatever order the ids have, and a hub costs
    one partially aggregated minimum. At the end representatives give way to the smallest node of each component. Nodes of edges with a
    null end are ignored. A loop edge (x, x) makes x a component of its own.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    edges = materialise(ends.distinct(), "edges")
    live = edges.where("u <> v")
    labels = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("component", F.col("node"))
    labels = materialise(labels, "labels")
    if live.isEmpty():
        discard(edges)
        return labels
    for turn in count():
        place = lambda node: F.xxhash64(F.lit(turn), node)  # noqa: B023, E731
        both = live.union(live.select("v", "u")).withColumn("at", place("v"))
        step = both.groupBy("u").agg(F.min("at").alias("at"), F.min_by("v", "at").alias("v"))
        step = step.select("u", F.when(F.col("at") < place("u"), F.col("v")).otherwise(F.col("u")).alias("p"))
        jump = step.alias("s").join(step.alias("t"), F.col("s.p") == F.col("t.u"), "left")
        jump = materialise(jump.select(F.col("s.u").alias("u"), F.coalesce("t.p", "s.p").alias("p")), "jump")
        before = labels, edges, jump
        labels = materialise(
            labels.join(jump, labels.component == jump.u, "left").select("node", F.coalesce("p", "component").alias("component")),
            "labels",
        )
        left, right = jump.select("u", F.col("p").alias("pu")), jump.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        renamed = live.join(left, "u").join(right, "v").where("pu <> pv")
        edges = live = materialise(renamed.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
        discard(*before)
        if live.isEmpty():
            break
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    found = materialise(labels.join(least, "component").select("node", F.col("least").alias("component")), "labels")
    discard(labels, edges)
    return found
