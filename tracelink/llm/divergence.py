"""Audit of how sources of a language differ in their words.

Terms are counted per language and source in one shuffle. A language's kept terms are cut into chunks by their hash; per group (language, source) and chunk
the counts are packed into one row. Groups are dealt into blocks: a packed row is replicated to the tiles (block, block) that its
block is in, and a task takes a tile through a slab of successive chunks, expanding one chunk at a time. A pair's sum over terms that neither group has is
its value for a count of zero times their number, so that tiles add up only the differences from it.

All numbers are exact integers: shares are per billion, and products stay below 2^63 as long as a language has under 9 * 10^15 words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelink.llm.hashing import bounded_batches, byte_table, slices
from tracelink.storage import materialise

#: Groups of a block, terms of a chunk (as many as hashes make it), chunks of a slab.
BLOCK, CHUNK, SLAB = 8, 4096, 4
#: Entries that a task holds before it hands them on.
HELD = 400_000
#: Bytes of text cut into terms at a time.
PIECE = 4 << 20
#: So many groups at most go to all tasks (some 100 bytes each); more are joined.
BROADCAST_GROUPS = 200_000
COUNTS = "lang string, source string, term string, n long, docs long"


def _letters() -> bytes:
    """Maps bytes of terms to themselves, A-Z to lower case and all others to a blank."""
    table = byte_table("alnum")
    table[48:58] = 0
    table[table == 0] = 32
    return table.tobytes()


def term_pieces(text: bytes, table: bytes, most: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text; a long text in pieces that end behind a term."""
    start = 0
    while start < len(text):
        low = text[start : start + most].translate(table)
        stop = len(text) if start + most >= len(text) else start + low.rfind(b" ") + 1
        if stop <= start:  # one term longer than a piece
            low = text[start:].translate(table)
            end = low.find(b" ", most)
            stop = len(text) if end < 0 else start + end + 1
        yield low[: stop - start].split()
        start = stop


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of terms per (lang, source) of a task, and a row with a null term for each of these."""
    table = _letters()
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    seen: set[tuple[str, str]] = set()
    size = lambda: sum(len(n) for n, _ in held.values())

    def emit() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for at in range(0, len(terms), 50_000):
                some = terms[at : at + 50_000]
                columns = [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in COUNTS.split(", ")])
        held.clear()

    for batch in (p for batch in batches for p in slices(batch)):
        texts = batch.column("text")
        texts = texts if pa.types.is_binary(texts.type) else pc.cast(texts, pa.binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            seen.add((lang, source))
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            distinct: set[bytes] = set()
            for terms in term_pieces(text.as_py(), table):
                n.update(terms)
                distinct.update(terms)
            docs.update(distinct)
        if size() > HELD:
            yield from emit()
    yield from emit()
    for at in range(0, len(every := sorted(seen)), 50_000):
        some = every[at : at + 50_000]
        none = pa.nulls(len(some), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in some]), pa.array([g[1] for g in some]), none, pa.array([0] * len(some), pa.int64()), pa.array([0] * len(some), pa.int64())], [c.split()[0] for c in COUNTS.split(", ")])


def term_counts(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """(lang, source, term, n, total, first) of terms in at least `min_docs` documents of their language, written once; total is over the language, and one row of each of its terms is first.

    Each group has a row with a null term besides.
    """
    bounded_batches(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_counted, COUNTS)
    # one shuffle: both sums are by keys that hold lang and term
    per = rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    per = per.withColumns({"total": F.sum("n").over(whole), "in_docs": F.sum("docs").over(whole), "first": F.row_number().over(whole.orderBy("source")) == 1})
    kept = per.where((F.col("in_docs") >= min_docs) | F.col("term").isNull())
    return materialise(kept.select("lang", "source", "term", "n", "total", (F.col("first") & F.col("term").isNotNull()).alias("first")), "term-counts")


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / total), by long division with three digits at a time."""
    left, found = count + 2, F.lit(0).cast("long")
    for _ in range(3):
        left = left * 1000
        found, left = found * 1000 + F.call_function("div", left, total), left % total
    return found + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """`share` of arrays."""
    left, found = counts + 2, np.zeros_like(counts)
    for _ in range(3):
        left = left * 1000
        found, left = found * 1000 + left // total, left % total
    return found + 1


def groups_of(counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, source, total, lang_total, v, place, blocks), written once: the divisors of a group's and its language's shares, and the group's place in the language."""
    langs = counts.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("v"), F.sum("n").alias("lang_n"))
    per = counts.groupBy("lang", "source").agg(F.sum("n").alias("n")).join(langs, "lang")
    line = Window.partitionBy("lang")
    per = per.withColumns({"place": F.row_number().over(line.orderBy("source")) - 1, "members": F.count("*").over(line)})
    blocks = F.ceil(F.col("members") / block).cast("int")
    return materialise(per.select("lang", "source", (F.col("n") + 2 * F.col("v")).alias("total"), (F.col("lang_n") + 2 * F.col("v")).alias("lang_total"), "v", "place", blocks.alias("blocks")), "groups")


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    if groups.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), ["lang", "source"])
    # written, so that later steps deal the rows anew and a large group can be split here
    return materialise(rows.join(groups, ["lang", "source"]), "rows-of-groups")


def tiles(counts: DataFrame, groups: DataFrame, block: int = BLOCK, chunk: int = CHUNK, slab: int = SLAB) -> DataFrame:
    """Packed counts of a group's chunk, once for each tile of its block; and each group itself (chunk -1), once for each slab of its tiles."""
    kept = counts.where("term IS NOT NULL AND n > 0")
    chunks = groups.groupBy("lang").agg(F.ceil(F.max("v") / chunk).alias("chunks"))
    placed = kept.join(chunks, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), "chunks").cast("int"))
    at = F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1
    packed = placed.select("lang", "source", "chunk", at.alias("at"), "n").groupBy("lang", "chunk", "source").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("c"))
    packed = materialise(packed.select("lang", "source", "chunk", F.floor(F.col("chunk") / slab).cast("int").alias("slab"), F.col("c.at").alias("at"), F.col("c.n").alias("n")), "packed")
    slabs = F.sequence(F.lit(0), F.greatest(F.ceil(F.ceil(F.col("v") / chunk) / slab), F.lit(1)).cast("int") - 1)
    none = [F.array().cast(f"array<{kind}>").alias(name) for name, kind in (("at", "int"), ("n", "long"))]
    heads = groups.select("lang", "source", F.lit(-1).alias("chunk"), F.explode(slabs).alias("slab"), *none)
    rows = _with_groups(packed.union(heads), groups)
    each = rows.withColumn("own", F.floor(F.col("place") / block).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.select("lang", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "slab", "chunk", "place", "source", "total", "v", "at", "n")


def _differences(rows: list[tuple], low: int, high: int, block: int) -> Iterator[tuple[str, str, int]]:
    """What the terms that some row of a chunk holds add to the pairs of a tile, beyond what they would with a count of zero. rows: (place, source, total, at, n)."""
    columns, inverse = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True)
    counts = np.zeros((len(rows), len(columns)), np.int64)
    counts[np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows]), inverse] = np.concatenate([r[4] for r in rows])
    total = np.array([r[2] for r in rows])[:, None]
    p, none = shares(counts, total), shares(np.zeros_like(total), total)
    for i, one in enumerate(rows):
        others = [j for j, other in enumerate(rows) if other[0] // block == high and other[0] > one[0]] if one[0] // block == low else []
        if others:
            f = (p[others] - p[i]) ** 2 // (p[others] + p[i])
            zero = (none[others] - none[i]) ** 2 // (none[others] + none[i])
            yield from zip([one[1]] * len(others), [rows[j][1] for j in others], (f - zero).sum(1).tolist(), strict=True)


def _tile(low: int, high: int, slab: int, rows: Iterator[tuple], block: int) -> Counter:
    """Sums of a tile's slab by pair of sources; the first slab has the value for counts of zero of all terms besides."""
    found: Counter = Counter()
    groups: dict[int, tuple] = {}
    empty = np.zeros(0, np.int64)
    for chunk, members in groupby(rows, key=lambda r: r[0]):
        if chunk < 0:
            groups = {place: (place, source, total, v) for _, place, source, total, v, *_ in members}
            if slab == 0:
                for one in groups.values():
                    for other in groups.values():
                        if one[0] // block == low and other[0] // block == high and one[0] < other[0]:
                            p, q = (int(shares(np.zeros(1, np.int64), np.array([g[2]]))[0]) if g[3] else 1 for g in (one, other))
                            found[one[1], other[1]] += one[3] * ((p - q) ** 2 // (p + q))
            continue
        part = {place: (place, source, total, at, n) for _, place, source, total, _, at, n in members}
        every = [part.get(place) or (*group[:3], empty, empty) for place, group in groups.items()]
        for one, other, value in _differences(every, low, high, block):
            found[one, other] += value
    return found


def _values(column: pa.Array) -> list:
    """Values of a column; lists of numbers as arrays."""
    if pa.types.is_list(column.type):
        values, offsets = column.values.to_numpy().astype(np.int64), column.offsets.to_numpy()
        return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return column.to_pylist()


def _sums(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "low", "high", "slab", "chunk", "place", "source", "total", "v", "at", "n"]
        rows = (row for batch in batches for row in zip(*[_values(batch.column(c)) for c in names], strict=True))
        for (lang, low, high, slab), members in groupby(rows, key=lambda r: r[:4]):
            found = _tile(low, high, slab, (r[4:] for r in members), block)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a)), pa.array(a), pa.array(b), pa.array(list(found.values()), pa.int64())], ["lang", "a", "b", "value"])

    return run


def pair_values(counts: DataFrame, groups: DataFrame, block: int = BLOCK, chunk: int = CHUNK, slab: int = SLAB) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of a language's sources."""
    key = ["lang", "low", "high", "slab"]
    dealt = tiles(counts, groups, block, chunk, slab).repartition(*key).sortWithinPartitions(*key, "chunk", "place")
    sums = dealt.mapInArrow(_sums(block), "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return sums.select("lang", F.explode(ways).alias("w"), "value").select("lang", "w.source", "w.item", "value")


def term_values(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a group has more of than its language."""
    rows = _with_groups(counts.where("term IS NOT NULL AND n > 0").select("lang", "source", F.col("term").alias("item"), "n", F.col("total").alias("lang_count")), groups)
    rows = rows.withColumns({"p": share(F.col("n"), F.col("total")), "q": share(F.col("lang_count"), F.col("lang_total"))})
    return rows.where("p > q").select("lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value"))


def audit_sources(docs: DataFrame, min_docs: int = 10, top: int = 10, block: int = BLOCK, chunk: int = CHUNK, slab: int = SLAB) -> DataFrame:
    """lang, source, part, item, value, rank of every group (lang, source) that occurs: its distance from each other source of the language (part `pair`) and its `top` terms (`term`).

    Null text, lang and source count as empty. A group without kept terms has pairs, whose values follow from counts of zero; a language without kept terms has pairs of value 0; one
    with a single source has no pairs. Equal values rank by item. Repeated rows are documents of their own; ids aren't read, nor are other columns, whatever their names. An empty table
    gives no rows. block, chunk and slab change the work of a task, not the result.
    """
    counts = term_counts(docs, min_docs)
    groups = groups_of(counts, block)
    line = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.withColumn("rank", F.row_number().over(line)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pair_values(counts, groups, block, chunk, slab), "pair").unionByName(ranked(term_values(counts, groups), "term").where(F.col("rank") <= top))
