"""Benchmark decontamination by SimHash over item-sized windows.

For every size that items have, the windows of that size are compared with the items of that size: SimHashes over the weighted
shingles of either are looked up in multi-index Hamming blocks, which hold all items within the radius, and what is
within the radius is verified by the exact weighted-shingle similarity. Fingerprints of neighbouring windows come from running sums of votes.

A window can only be similar to an item where four fifths of its shingles are the benchmark's, so one pass over the documents, with
a Bloom filter of the benchmark's shingles, leaves the stretches where that holds; no similar window is lost. Weights are counted over the whole
benchmark and joined to these stretches. The benchmark itself is read in slabs of bounded size, each compared with the stretches; how many
there are changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelink.llm.hashing import U64, bounded_batches, byte_table, chunks, mix, shingles, slices, word_hashes
from tracelink.storage import materialise

K, SIMILAR = 5, 0.8
#: At similarity 0.8 two 64-bit fingerprints differ in 9.7 bits, give or take 2.9; near the threshold 0.2 in 100 are missed.
RADIUS = 18
SLAB_BYTES = 8 << 20
#: Starts of windows in one row of a stretch, which then holds so many shingles and the longest item's.
STEP = 4096
#: Stretches in a task that matches them, and tasks at most.
STRETCHES, MOST_TASKS = 250, 20_000
#: Bits per shingle of the Bloom filter, and the most it may have (256 MB); beyond that it lets more through.
BLOOM_BITS, BLOOM_MOST = 32, 31
#: So many leaking documents at most go to all tasks (some 64 MB); more are joined with the documents.
BROADCAST_IDS = 2_000_000
FIXED_POINT = 1 << 16
BITS = np.arange(64, dtype=U64)
MATCH = "item_id long, similarity double, start_word long, n_words long, distance int"


def blocks(radius: int = RADIUS) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 blocks: fingerprints within the radius agree entirely in one."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


class Windows:
    """Sums of columns over the distinct shingles of every window of a run."""

    def __init__(self, values: np.ndarray, columns: np.ndarray):
        order = np.argsort(values, kind="stable")
        same = values[order[1:]] == values[order[:-1]]
        self.again, self.before, self.columns = order[1:][same], order[:-1][same], columns
        self.total = np.zeros((len(columns) + 1, columns.shape[1]), np.int64)
        np.cumsum(columns, axis=0, out=self.total[1:])

    def sums(self, size: int) -> np.ndarray:
        """Row per start of a window of `size`; a shingle counts where it comes first in the window."""
        n = len(self.columns)
        found = self.total[size:] - self.total[: n - size + 1]
        if len(self.again):
            first, last = np.maximum(0, self.again - size + 1), np.minimum(self.before, n - size)
            some = first <= last
            change = np.zeros((n - size + 2, self.columns.shape[1]), np.int64)
            np.add.at(change, first[some], self.columns[self.again[some]])
            np.subtract.at(change, last[some] + 1, self.columns[self.again[some]])
            found -= np.cumsum(change[:-1], axis=0)
        return found


def _dense(sums: np.ndarray) -> np.ndarray:
    """Rows whose second column, the weight of the benchmark's shingles, may be SIMILAR of the first, the weight of all."""
    return np.flatnonzero((sums[:, 1] > 0) & (sums[:, 1] >= (SIMILAR - 1e-6) * sums[:, 0]))


def _votes(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    bits = ((mix(values)[:, None] >> BITS) & U64(1)).astype(np.int64)
    return (2 * bits - 1) * weights[:, None]


def _prints(votes: np.ndarray) -> np.ndarray:
    return np.bitwise_or.reduce(np.where(votes > 0, U64(1) << BITS, U64(0)), axis=1)


def _fixed(weights: np.ndarray) -> np.ndarray:
    """Weights as integers, so that votes summed in any order give one fingerprint."""
    return np.rint(weights * FIXED_POINT).astype(np.int64)


@dataclass
class Item:
    place: int
    id: int
    words: int
    shingles: np.ndarray
    total: float


class Slab:
    """A part of the benchmark: items, their fingerprints, and the multi-index over these, a table of each size's blocks."""

    def __init__(self, by: dict[int, list[tuple[Item, np.ndarray]]]):
        self.sizes = sorted(by)
        self.items = [item for size in self.sizes for item, _ in by[size]]
        of = np.repeat(np.arange(len(self.sizes)), [len(by[size]) for size in self.sizes])
        self.prints = np.concatenate([_prints(_votes(item.shingles, _fixed(w)).sum(0, keepdims=True)) for size in self.sizes for item, w in by[size]])
        keys = self._keys(of, self.prints)
        order = np.argsort(keys, axis=None, kind="stable")
        self.keys, self.owner = keys.reshape(-1)[order], order // keys.shape[1]

    @staticmethod
    def _keys(size: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Size, block and the block's bits, of each fingerprint and block."""
        parts = blocks()
        shifts, widths = (np.array(c, U64) for c in zip(*parts, strict=True))
        bits = (prints[:, None] >> shifts) & ((U64(1) << widths) - U64(1))
        return ((size[:, None] * len(parts) + np.arange(len(parts))) << 8) + bits.astype(np.int64)

    def near(self, size: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of fingerprints of a size within the radius, each pair once."""
        wanted = self._keys(size, prints)
        low, high = np.searchsorted(self.keys, wanted.reshape(-1), "left"), np.searchsorted(self.keys, wanted.reshape(-1), "right")
        sizes = high - low
        window = np.repeat(np.arange(wanted.size) // wanted.shape[1], sizes)
        item = self.owner[np.repeat(low, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return np.divmod(np.unique(window[close] * len(self.prints) + item[close]), len(self.prints))


def _runs(texts: list[str | None]) -> Iterator[tuple[np.ndarray, int]]:
    """(shingles in order, words) of each text; under K words they are one shingle."""
    table = byte_table("alnum")
    for _, encoded in chunks([(t or "").lower() for t in texts]):
        hashes, offsets = word_hashes(encoded, table)
        yield from zip(shingles(hashes, offsets, K), np.diff(offsets).tolist(), strict=True)


def slab_of(rows: list[tuple[int, str | None]], held: dict[int, int], total: int) -> Slab | None:
    """held: how many of the benchmark's `total` items hold a shingle, whose weight falls with it. Items without words are left out."""
    by: dict[int, list] = {}
    for place, ((id_, _), (run, words)) in enumerate(zip(rows, _runs([t for _, t in rows]), strict=True)):
        if len(run):
            values = np.unique(run)
            weights = 1 + np.log(total / np.array([held[x] for x in values.tolist()]))
            by.setdefault(len(run), []).append((Item(place, id_, words, values, float(weights.sum())), weights))
    return Slab(by) if by else None


@dataclass
class Filter:
    """Bloom filter of the benchmark's shingles, and the sizes of its items."""

    bits: np.ndarray
    power: int
    sizes: list[int]

    def _places(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (values >> U64(64 - self.power)).astype(np.int64), (mix(values) >> U64(64 - self.power)).astype(np.int64)

    def add(self, values: np.ndarray) -> None:
        for places in self._places(values):
            np.bitwise_or.at(self.bits, places >> 3, np.uint8(1) << (places & 7).astype(np.uint8))

    def hits(self, values: np.ndarray) -> np.ndarray:
        first, second = self._places(values)
        found = (self.bits[first >> 3] >> (first & 7).astype(np.uint8) & 1).astype(bool)
        some = np.flatnonzero(found)
        at = second[some]
        found[some] = self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1
        return found

    def stretches(self, run: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, end) of what the windows cover, of any size, that may be similar to an item."""
        hit = self.hits(run)
        if not hit.any():
            return
        longest = self.sizes[-1]
        covered = np.zeros(len(run) + 1, np.int64)
        places = np.flatnonzero(hit)
        # hits further apart than the longest item share no window
        cuts = np.flatnonzero(np.diff(places) > longest) + 1
        for own in np.split(places, cuts):
            a, b = max(0, int(own[0]) - longest), min(len(run), int(own[-1]) + longest + 1)
            part = run[a:b]
            windows = Windows(part, np.stack([np.ones(len(part), np.int64), hit[a:b].astype(np.int64)], 1))
            for size in self.sizes:
                width = min(size, len(run))
                # of a window's shingles at most the repeats don't count
                if len(own) < (SIMILAR - 1e-6) * (width - len(windows.again)):
                    continue
                starts = _dense(windows.sums(width)) + a
                np.add.at(covered, starts, 1)
                np.subtract.at(covered, starts + width, 1)
                if width < size:
                    break
        edges = np.diff((np.cumsum(covered[:-1]) > 0).view(np.int8), prepend=np.int8(0), append=np.int8(0))
        yield from zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True)


STRETCH = "row long, doc_id long, tag long, start long, n long, n_words long, values array<long>"


def _stretch_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Filter = shared.value
        for part in (p for batch in batches for p in slices(batch)):
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, (values, words) in enumerate(_runs(part.column("text").to_pylist())):
                for start, end in known.stretches(values):
                    for at in range(start, end, STEP):
                        row = i, at, len(values), words, values[at : min(end, at + STEP + known.sizes[-1] - 1)].view(np.int64)
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
            of = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c).take(of) for c in ("row", "doc_id", "tag")], *[pa.array(c, pa.int64()) for c in out[1:4]], pa.array(out[4], pa.list_(pa.int64()))],
                ["row", "doc_id", "tag", "start", "n", "n_words", "values"],
            )

    return run


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (number, shingle, size): each item's distinct shingles, the first with the size of the item."""
    for part in (p for batch in batches for p in slices(batch)):
        for number, (run, _) in zip(part.column("number").to_pylist(), _runs(part.column("text").to_pylist()), strict=True):
            values = np.unique(run)
            size = pa.array([len(run), *[None] * (len(values) - 1)][: len(values)], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(values), pa.int64()), pa.array(values.view(np.int64)), size], ["number", "shingle", "size"])


def _best(slab: Slab, values: np.ndarray, held: np.ndarray, n: int, total: int) -> Iterator[tuple[Item, float, int, int]]:
    """(item, similarity, start, distance) of the verified windows of one stretch, the best one of each item."""
    weights = 1 + np.log(total / np.maximum(held, 1))
    fixed = _fixed(weights)
    windows = Windows(values, np.column_stack([fixed, fixed * (held > 0), _votes(values, fixed)]))
    sizes, starts, prints = [], [], []
    for number, size in enumerate(slab.sizes):
        # an item longer than the document is compared with the whole of it
        if (width := min(size, n)) <= len(values):
            sums = windows.sums(width)
            own = _dense(sums)
            starts.append(own)
            sizes.append(np.full(len(own), number))
            prints.append(_prints(sums[own, 2:]))
    if not starts:
        return
    start, size, print_ = np.concatenate(starts), np.concatenate(sizes), np.concatenate(prints)
    best: dict[int, tuple] = {}
    for at, item in zip(*(x.tolist() for x in slab.near(size, print_)), strict=True):
        a = int(start[at])
        own, first = np.unique(values[a : a + slab.sizes[size[at]]], return_index=True)
        mine = weights[a + first]
        shared = mine[np.isin(own, slab.items[item].shingles, assume_unique=True)].sum()
        similar = float(shared / (slab.items[item].total + mine.sum() - shared))
        if similar >= SIMILAR - 1e-12 and similar > best.get(item, (0.0,))[0]:
            best[item] = similar, a, (int(print_[at]) ^ int(slab.prints[item])).bit_count()
    yield from ((slab.items[item], *found) for item, found in best.items())


FOUND = f"row long, doc_id long, tag long, place long, {MATCH}"


def _match_rows(shared, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, names = shared.value, [x.split()[0] for x in FOUND.split(", ")]
        types = [pa.int64()] * 5 + [pa.float64(), pa.int64(), pa.int64(), pa.int32()]
        for batch in batches:
            out = []
            for row in zip(*[batch.column(c) for c in ("row", "doc_id", "tag", "start", "n", "n_words", "values", "held")], strict=True):
                *key, start, n, words = (x.as_py() for x in row[:6])
                values, held = (x.values.to_numpy(zero_copy_only=False) for x in row[6:])
                for item, similar, at, distance in _best(slab, values.view(U64), held, n, total):
                    out.append((*key, item.place, item.id, similar, start + at, min(item.words, words), distance))
            columns = zip(*out, strict=True) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


def _matches(docs: DataFrame, benchmark: DataFrame, slab_bytes: int) -> DataFrame:
    """FOUND rows of docs (doc_id, tag, text): one per document row and item."""
    spark = bounded_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // slab_bytes)
    items = items.withColumn("number", F.pmod(F.xxhash64("item_id", "text"), F.lit(count or 1)))
    rows = materialise(items.mapInArrow(_shingle_rows, "number long, shingle long, size long"), "benchmark-shingles")
    held = materialise(rows.groupBy("shingle").agg(F.count("*").alias("held")), "benchmark-counts")
    sizes = sorted(r.size for r in rows.select("size").where("size IS NOT NULL").distinct().collect())
    if not sizes:
        return spark.createDataFrame([], FOUND)
    total, kinds = rows.where("size IS NOT NULL").count(), held.count()
    power = min(BLOOM_MOST, max(10, (BLOOM_BITS * kinds - 1).bit_length()))
    known = Filter(np.zeros(1 << power >> 3, np.uint8), power, sizes)
    parts = -(-kinds * 8 // slab_bytes)
    for part in range(parts):
        known.add(held.where(F.pmod("shingle", F.lit(parts)) == part).select("shingle").toArrow().column("shingle").to_numpy().view(U64))

    shared = spark.sparkContext.broadcast(known)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "tag", "text")
    found = materialise(texts.mapInArrow(_stretch_rows(shared), STRETCH), "stretches")
    shared.unpersist()
    each = found.select("row", "start", F.posexplode("values").alias("i", "shingle")).join(held, "shingle", "left")
    each = each.groupBy("row", "start").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("held", F.lit(0)).alias("held")))).alias("of"))
    weighed = found.join(each.select("row", "start", F.col("of.held").alias("held")), ["row", "start"])
    weighed = materialise(weighed, "weighed-stretches")
    # stretches are few bytes and much work
    tasks = max(1, min(-(-weighed.count() // STRETCHES), MOST_TASKS))

    matches = []
    for number in range(count):
        here = sorted(items.where(F.col("number") == number).collect(), key=lambda r: (r.item_id is None, r.item_id, r.text))
        counts = held.join(rows.where(F.col("number") == number).select("shingle").distinct(), "shingle").toArrow()
        counts = dict(zip(counts.column("shingle").to_numpy().view(U64).tolist(), counts.column("held").to_pylist(), strict=True))
        made = slab_of([(r.item_id, r.text) for r in here], counts, total)
        if made is None:
            continue
        slab = spark.sparkContext.broadcast(made)
        one = weighed.repartition(tasks).mapInArrow(_match_rows(slab, total), FOUND)
        # stretches overlap, and one document may hold an item twice
        best = F.max_by(F.struct("similarity", "start_word", "n_words", "distance"), F.struct("similarity", -F.col("start_word")))
        one = one.groupBy("row", "doc_id", "tag", "place", "item_id").agg(best.alias("m"))
        matches.append(one.select("row", "doc_id", "tag", "place", "item_id", "m.*"))
    found = matches[0]
    for one in matches[1:]:
        found = found.unionByName(one)
    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words, distance): a row per document row and item found in it.

    Words are runs of lower-cased letters and digits; an item of fewer than five words is found only in a document of the same
    words. start_word counts from 0, for the item's most similar window, the first of equal ones. Null and empty texts and items
    match nothing; repeated rows are matched each; null ids are kept as null. An empty table on either side gives no rows.
    Other columns of either table, whatever their names, are not read.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("tag"), "text")
    return _matches(plain, benchmark, slab_bytes).select("doc_id", *[x.split()[0] for x in MATCH.split(", ")])


def drop_leaks(docs: DataFrame, benchmark: DataFrame, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """The rows of `docs`, all columns, in which find_leaks finds no item. Texts are only shuffled where over BROADCAST_IDS rows leak."""
    tag = F.xxhash64("text")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag.alias("tag"), "text")
    leaks = _matches(plain, benchmark, slab_bytes).select(F.col("doc_id").alias("_leak"), F.col("tag").alias("_leak_tag")).distinct()
    leaks = materialise(leaks, "leaks")
    leaks = F.broadcast(leaks) if leaks.count() <= BROADCAST_IDS else leaks
    return docs.join(leaks, docs.doc_id.cast("long").eqNullSafe(F.col("_leak")) & (tag == F.col("_leak_tag")), "left_anti")
