"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelink.storage import materialise

#: A row per source is gathered on the driver; more sources than this are refused, not cut.
MAX_SOURCES = 100_000
#: Seeded positions fall into this many ranges, so that no window holds a whole source.
RANGES = 4096
WORDS = r"[^\x20\x09-\x0D]+"


def share_out(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Split `total` by weight; none gets over `most` times its size, and what is over is shared anew by weight."""
    found, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    rest = float(total)
    while open_:
        weight = sum(weights[i] for i in sorted(open_))
        full = [i for i in sorted(open_) if rest * weights[i] / weight >= most * sizes[i]]
        if not full:
            for i in open_:
                found[i] = rest * weights[i] / weight
            break
        for i in full:
            found[i] = most * float(sizes[i])
            open_.discard(i)
        rest = total - sum(found[i] for i in range(len(sizes)) if i not in open_)
    return found


def apportion(targets: Sequence[float], blocks: int) -> list[int]:
    """Seats by the highest quotients target / (2 seats + 1); ties go to the earlier source.

    Starts from the seats of a divisor that surely gives too few, all of which the quotients would grant first.
    """
    seats, total = [0] * len(targets), sum(targets)
    if not total or not blocks:
        return seats
    divisor = total / blocks
    while True:
        seats = [int(t / divisor + 0.5) for t in targets]
        if sum(seats) <= blocks:
            break
        divisor *= 1 + max(1e-12, (sum(seats) - blocks) / (2 * blocks + 2))
    heap = [(-t / (2 * s + 1), i) for i, (t, s) in enumerate(zip(targets, seats, strict=True)) if t > 0]
    heapq.heapify(heap)
    for _ in range(blocks - sum(seats)):
        _, i = heap[0]
        seats[i] += 1
        heapq.heapreplace(heap, (-targets[i] / (2 * seats[i] + 1), i))
    return seats


def shard_quotas(targets: Sequence[float], blocks: int, shards: int) -> list[list[int]]:
    """Blocks of each source per shard. Apportionment never takes a seat back as blocks grow, so differences are quotas."""
    totals = [apportion(targets, blocks * (s + 1) // shards) for s in range(shards)]
    return [[b - a for a, b in zip(before, now, strict=True)] for before, now in zip([[0] * len(targets), *totals], totals, strict=False)]


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
    block: int = 64, shards: int = 64, seed: int = 17, text: str = "text",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, shard) for every row of `docs`.

    size counts the words of the text (null or empty: 0). Sources in code-point order, null last, weigh `weights`
    in turn. A source's documents stand in a seeded order end to end; its quota of blocks is taken from the front,
    round and round, so a document is taken at most `most` times. shard is the first shard that takes from the
    document (null: none does). Rows are treated singly, so repeated rows and ids each count; rows alike in id and size are
    interchangeable. Null ids are ordered first. No rows give no rows.
    """
    spark = docs.sparkSession
    sized = materialise(docs.select("doc_id", "source", F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long").alias("size")), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    sizes = [r.n for r in totals]
    targets = share_out(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), most)
    quotas = shard_quotas(targets, round(sum(targets) / block), shards)
    plan = []
    for i, row in enumerate(totals):
        ends, end = [], 0
        for quota in quotas:
            end = min(end + quota[i] * block, int(most * row.n))
            ends.append(end)
        plan.append((row.source, row.n, targets[i], ends[-1], ends))
    sources = spark.createDataFrame(plan, "source string, source_size long, target double, quota long, ends array<long>")
    key = F.xxhash64(F.lit(seed), "doc_id", "size")
    placed = sized.withColumn("_key", key).withColumn("_range", F.shiftrightunsigned("_key", 64 - RANGES.bit_length() + 1))
    ranges = placed.groupBy("source", "_range").agg(F.sum("size").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_range")) - F.col("_n")
    ranges = ranges.select(F.col("source").alias("_source"), F.col("_range").alias("_r"), before.alias("_before"))
    order = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    lined = placed.withColumn("_start", F.sum("size").over(order) - F.col("size"))
    lined = lined.join(ranges, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_r")))
    lined = lined.join(F.broadcast(sources.withColumnRenamed("source", "_of")), F.col("source").eqNullSafe(F.col("_of")))
    start = F.col("_before") + F.col("_start")
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("quota") - rounds * F.col("source_size")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    first = F.size(F.filter("ends", lambda e: e <= start))
    return lined.withColumn("taken", taken.cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "taken", F.when(F.col("taken") > 0, first).alias("shard")
    )
