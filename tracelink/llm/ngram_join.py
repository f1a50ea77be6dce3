"""Exact n-gram Jaccard join through count-vector R-trees.

A document is the set of its k-word shingles. Hashing the shingles into groups makes it a point of group counts, and two
sets overlap by at most the summed coordinate minima of their points: R-trees over the points, whose boxes hold the
largest coordinates, leave the pairs that may be similar, and these are verified by their sets.

One R-tree over a whole corpus finds no near neighbours cheaply: in so many dimensions the points of unlike documents of one size
lie closer together than a box is wide. So the corpus is cut into blocks first, without losing a link: of sets with
Jaccard similarity t each shares at least t of its shingles, so in any common order of all shingles the first n - ceil(t n) + 1 of the n
of one and of the other have one in common. The order is by how often a shingle's bucket of a fixed-size count sketch over the
corpus occurs, rare ones first, so that passages which many documents share seldom name a block.

In a block only its smallest id is compared with the others (no pairs within a group) and the links found are closed
transitively. Blocks that still hold several components are cut by size; after a round with other leaders what is left of
them goes into an R-tree each, whose search leaves out what is linked already. So
groups of copies cost about as many comparisons as they have members, and no link between different texts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelink.llm.hashing import U64, bounded_batches, byte_table, chunks, mix, shingles, slices, word_hashes
from tracelink.operators.graph import connected_components
from tracelink.storage import discard, materialise

#: Coordinates of the points at least; larger sets have so many that a group holds two to four shingles, up to MOST_GROUPS.
GROUPS = 128
MOST_GROUPS = 4096
#: Members of one side of an R-tree join; larger blocks are joined part by part.
PART = 1024
LEAF = 32
#: Bytes of text in which ids with one key are put together before the shuffle.
BLOCK_BYTES = 8 << 20
#: Bits of the count sketch: 262,144 counters, however large the corpus is.
SKETCH = 18
#: Rounds of leaders before the R-trees.
ROUNDS = 1
#: So many ids of documents to verify at most go to all tasks (some 64 MB); more are joined with the texts.
BROADCAST_IDS = 2_000_000


def _bucket(values: np.ndarray) -> np.ndarray:
    return (values >> U64(64 - SKETCH)).astype(np.int64)


def block_keys(values: np.ndarray, held: np.ndarray, tenths: int) -> np.ndarray:
    """The first shingles of a set in the common order: as many as leave fewer than a similar set must share.

    `held` has the sketch's counts; shingles of equal counts follow by hash.
    """
    first = len(values) - -(-tenths * len(values) // 10) + 1
    return mix(values[np.lexsort((values, held[_bucket(values)]))[:first]])


def point(values: np.ndarray) -> np.ndarray:
    """Counts of the shingles per group.

    The number of groups is a power of two and the group a shingle's leading bits, so that pairs of neighbours add up to the
    counts of half as many groups.
    """
    bits = min(MOST_GROUPS.bit_length() - 1, max(GROUPS.bit_length() - 1, (max(1, len(values) // 4) - 1).bit_length()))
    return np.bincount((mix(values) >> U64(64 - bits)).astype(np.int64), minlength=1 << bits).astype("<u2")


def fold_points(points: list[bytes]) -> np.ndarray:
    """Points, as they are stored, with as many groups as the one with the fewest."""
    least = min(map(len, points)) // 2
    return np.array([np.frombuffer(p, "<u2").reshape(least, -1).sum(1) for p in points], np.int32)


def _sets(texts: list[str], k: int, kind: str, lower: bool) -> Iterator[tuple[int, np.ndarray]]:
    table = byte_table(kind)
    for first, encoded in chunks([(t or "").lower() for t in texts] if lower else texts):
        words, offsets = word_hashes(encoded, table)
        for i, values in enumerate(shingles(words, offsets, k)):
            yield first + i, np.unique(values)


def _sketched(k: int, kind: str, lower: bool):
    """Rows (bucket, n): how many shingles of a task's documents fall into each bucket of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH, np.int64)
        for part in (p for batch in batches for p in slices(batch)):
            values = [v for _, v in _sets(part.column("text").to_pylist(), k, kind, lower)]
            counts += np.bincount(_bucket(np.concatenate(values)), minlength=len(counts))
        used = np.flatnonzero(counts)
        for at in range(0, len(used), 50_000):
            some = used[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["bucket", "n"])

    return run


def _sketch(plain: DataFrame, k: int, kind: str, lower: bool) -> np.ndarray:
    rows = plain.where("text <> ''").mapInArrow(_sketched(k, kind, lower), "bucket int, n long")
    total = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(1 << SKETCH, np.int64)
    held[total.column("bucket").to_numpy()] = total.column("n").to_numpy()
    return held


def _blocks(k: int, kind: str, lower: bool, tenths: int, sketch):
    """Rows (key, sig, doc, up, n, point): a row with n and its point per document, and rows of its keys.

    up: the smallest id of this slice with the same key, which stands for the others in the shuffle. A row of such another gets a
    key that nothing shares. The row with n has the two halves of the set's digest as key and sig.
    """

    def slice_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("doc").to_pylist()
        whole: dict[bytes, int] = {}
        sigs, docs = [], []
        one: tuple[list, ...] = ([], [], [], [], [], [])

        def add(*row):
            for column, value in zip(one, row, strict=True):
                column.append(value)

        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        texts = batch.column("text").to_pylist()
        lonely = mix(np.arange(len(ids), dtype=U64) + U64(hash(str(ids[:3])) & (2**63 - 1))).view(np.int64)
        for at, values in _sets([texts[i] for i in order], k, kind, lower):
            doc, n = ids[order[at]], len(values)
            if doc is None or n == 0:
                add(int(lonely[at]), -1, doc, doc, n, None)
                continue
            halves = np.array([np.sum(mix(values + U64(n)), dtype=U64), np.sum(mix(values ^ U64(0x5851F42D4C957F2D)), dtype=U64)])
            key, sig = mix(halves).view(np.int64).tolist()
            up = whole.setdefault(halves.tobytes(), doc)
            if up != doc:
                add(int(lonely[at]), sig, doc, up, n, None)
                continue
            add(key, sig, doc, None, n, point(values).tobytes())
            found = block_keys(values, sketch.value, tenths)
            sigs.append(found)
            docs.append(np.full(len(found), doc, np.int64))
        columns = [*[pa.array(c, pa.int64()) for c in one[:5]], pa.array(one[5], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "sig", "doc", "up", "n", "point"])
        if sigs:
            sig, doc = np.concatenate(sigs).view(np.int64), np.concatenate(docs)
            by = np.lexsort((doc, sig))
            sig, doc = sig[by], doc[by]
            head = np.concatenate([[True], sig[1:] != sig[:-1]])
            up = doc[np.flatnonzero(head)][np.cumsum(head) - 1]
            same = ~head & (doc != up)
            key = np.where(same, mix(sig.view(U64) + mix(doc.view(U64))).view(np.int64), sig)
            use = head | same
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[use]), pa.array(sig[use]), pa.array(doc[use]), pa.array(up[use], mask=~same[use]), pa.nulls(int(use.sum()), pa.int64()), pa.nulls(int(use.sum()), pa.binary())],
                ["key", "sig", "doc", "up", "n", "point"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=BLOCK_BYTES):
                yield from slice_rows(part)

    return run


def _set_rows(k: int, kind: str, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch)):
            ids = part.column("doc").to_pylist()
            rows = [(ids[i], v.view(np.int64)) for i, v in _sets(part.column("text").to_pylist(), k, kind, lower)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["doc", "set"])

    return run


def _bounded(tenths: int):
    """Pairs whose summed coordinate minima may be overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()).tolist()
            keep = []
            for total, a, b in zip(sizes, batch.column("point_a"), batch.column("point_b"), strict=True):
                p = fold_points([a.as_py(), b.as_py()])
                shared = int(np.minimum(p[0], p[1]).sum())
                keep.append(10 * shared >= tenths * (total - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class Verifier:
    """Finds which pairs of documents are similar: by summed minima of the points, then by the sets, made of the texts of what is left."""

    def __init__(self, plain: DataFrame, points: DataFrame, k: int, tenths: int, kind: str, lower: bool):
        self.plain, self.points, self.tenths, self.sets_of = plain, points, tenths, _set_rows(k, kind, lower)

    def _sides(self, pairs: DataFrame, rows: DataFrame) -> DataFrame:
        a, b = (rows.select(*[F.col(c).alias(f"{c}_{side}") for c in rows.columns]) for side in "ab")
        return pairs.join(a, pairs.a == a.doc_a).join(b, F.col("b") == F.col("doc_b"))

    def _similar(self, both, a, b):
        return 10 * both >= self.tenths * (a + b - both)

    def links(self, pairs: DataFrame) -> DataFrame:
        """The similar ones of distinct pairs (a, b)."""
        sized = 10 * F.least("n_a", "n_b") >= self.tenths * F.greatest("n_a", "n_b")
        # sizes alone decide most pairs that share a shingle by chance; points, which are larger, join the others
        sizes = self._sides(pairs, self.points.select("doc", "n")).where(sized).select("a", "b", "n_a", "n_b")
        sides = self._sides(materialise(sizes, "ngram-sized"), self.points.select("doc", "point")).select("a", "b", "n_a", "n_b", "point_a", "point_b")
        near = sides.mapInArrow(_bounded(self.tenths), "a long, b long").distinct()
        near = materialise(near, "ngram-near")
        needed = materialise(near.select(F.col("a").alias("doc")).union(near.select("b")).distinct(), "ngram-needed")
        if needed.count() <= BROADCAST_IDS:
            some = self.plain.join(F.broadcast(needed), "doc", "left_semi")
        else:
            some = self.plain.join(needed, "doc", "left_semi")
        sets = materialise(some.mapInArrow(self.sets_of, "doc long, set array<long>"), "ngram-sets", compression="lz4")
        both = F.size(F.array_intersect("set_a", "set_b"))
        found = self._sides(near, sets).where(self._similar(both, F.size("set_a"), F.size("set_b"))).select("a", "b").distinct()
        found = materialise(found, "ngram-links")
        discard(near, needed, sets)
        return found


class RTree:
    """Count-vector boxes, packed by recursive sorting: leaves of LEAF points, then LEAF boxes to a box."""

    def __init__(self, points: np.ndarray):
        self.points = points
        order = self._pack(np.arange(len(points)))
        self.levels = [[np.array(x) for x in np.array_split(order, max(1, -(-len(order) // LEAF)))]]
        self.boxes = [np.array([points[x].max(0) for x in self.levels[0]])]
        while len(self.boxes[-1]) > 1:
            count = len(self.boxes[-1])
            nodes = np.array_split(np.arange(count), -(-count // LEAF))
            self.levels.append(nodes)
            self.boxes.append(np.array([self.boxes[-1][x].max(0) for x in nodes]))

    def _pack(self, rows: np.ndarray) -> np.ndarray:
        if len(rows) <= LEAF:
            return rows
        axis = int(np.argmax(self.points[rows].var(0)))
        rows = rows[np.argsort(self.points[rows, axis], kind="stable")]
        return np.concatenate([self._pack(rows[: len(rows) // 2]), self._pack(rows[len(rows) // 2 :])])

    def search(self, query: np.ndarray, least: float) -> np.ndarray:
        """Rows whose summed coordinate minima with `query` reach `least`; a box holds its points' largest coordinates."""
        level = len(self.levels) - 1
        nodes = np.arange(len(self.levels[level]))
        while len(nodes):
            nodes = nodes[np.minimum(self.boxes[level][nodes], query).sum(1) >= least]
            if not len(nodes):
                break
            below = np.concatenate([self.levels[level][i] for i in nodes])
            if level == 0:
                return below[np.minimum(self.points[below], query).sum(1) >= least]
            nodes, level = below, level - 1
        return nodes


def _candidates(tenths: int, sig: int, rows: list[tuple]) -> tuple[list, list]:
    """Candidate pairs of one part of block `sig` (side, doc, n, component, point, sigs) against another: different components, bound reached, and no earlier block that both are in.

    sigs: the open blocks of a document. Near copies share many blocks; the first of these has the pair.
    """
    a, b = ([r for r in rows if r[0] != other] for other in (1, 0))
    found: tuple[list, list] = ([], [])
    if a and b:
        points = fold_points([r[4] for r in a + b])
        mine, other = points[: len(a)], points[len(a) :]
        doc, size, comp = (np.array([r[i] for r in b]) for i in (1, 2, 3))
        # a tree of a leaf or two is its points
        tree = RTree(other) if len(other) > 2 * LEAF else None
        whole = all(r[0] == 2 for r in rows)
        earlier = [frozenset(s for s in r[5] if s < sig) for r in b]
        for (_, d, n, c, _, sigs), p in zip(a, mine, strict=True):
            hit = np.flatnonzero((comp != c) & ((doc > d) | (not whole)) & (10 * size >= tenths * n) & (10 * n >= tenths * size)) if tree is None else tree.search(p, tenths * n / 10 - 1e-9)
            if not len(hit):
                continue
            hit = hit[(comp[hit] != c) & ((doc[hit] > d) | (not whole))]
            shared = np.minimum(other[hit], p).sum(1)
            hit = hit[10 * shared >= tenths * (n + size[hit] - shared)]
            before = [s for s in sigs if s < sig]
            hit = np.array([h for h in hit.tolist() if earlier[h].isdisjoint(before)], np.int64)
            found[0].extend(np.minimum(doc[hit], d).tolist())
            found[1].extend(np.maximum(doc[hit], d).tolist())
    return found


def _tree_join(tenths: int):
    """Candidate pairs (a, b) of sorted rows (sig, i, j, side, doc, n, component, point, sigs)."""
    names = ["sig", "i", "j", "side", "doc", "n", "component", "point", "sigs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*[batch.column(c).to_pylist() for c in names], strict=True))
        a, b = [], []
        for (sig, _, _), group in groupby(rows, key=lambda r: r[:3]):
            found = _candidates(tenths, sig, [r[3:] for r in group])
            a.extend(found[0])
            b.extend(found[1])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _sized_blocks(members: DataFrame, points: DataFrame, tenths: int) -> DataFrame:
    """Blocks (sig, doc) cut by size: sets within the similarity are in one class of size or in neighbouring ones. Of blocks with the same members one stays."""
    grade = F.floor(F.log(F.col("n")) / F.log(F.lit(10 / tenths)) + 1e-9)
    cut = members.join(points.select("doc", "n"), "doc").withColumn("grade", F.explode(F.array(grade, grade + 1)))
    cut = cut.select(F.xxhash64("sig", "grade").alias("sig"), "doc")
    alike = cut.groupBy("sig").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y"))
    alike = alike.where("n > 1").groupBy("n", "x", "y").agg(F.min("sig").alias("sig")).select("sig")
    return cut.join(alike, "sig", "left_semi")


def _split(members: DataFrame, components: DataFrame) -> DataFrame:
    """(sig, doc, component) of the blocks that hold several components."""
    known = members.join(components, F.col("doc") == F.col("node"), "left").select("sig", "doc", F.coalesce("component", "doc").alias("component"))
    several = known.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return known.join(several.select("sig"), "sig", "left_semi")


def _merged(components: DataFrame, links: DataFrame) -> DataFrame:
    """Components with further links (a, b)."""
    if links.isEmpty():
        return components
    of = lambda side: components.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    renamed = connected_components(ends).withColumnsRenamed({"node": "was", "component": "now"})
    old = components.join(renamed, components.component == renamed.was, "left").select("node", F.coalesce("now", "component").alias("component"))
    new = renamed.join(components, renamed.was == components.node, "left_anti").select("was", "now")
    merged = materialise(old.union(new), "ngram-components")
    discard(components, renamed, links)
    return merged


def ngram_components(
    docs: DataFrame, k: int = 3, tenths: int = 9, id: str = "doc_id", text: str = "text", kind: str = "space", lower: bool = False,
) -> DataFrame:
    """(id, n_shingles, component_id) for every row of `docs`.

    Two documents link when 10 * |A and B| >= tenths * |A or B| for their sets of distinct k-word shingles (fewer words: the
    whole sequence as one). component_id is the smallest id reachable by links, itself included. Null and empty
    texts, and texts without words, have an empty set that links with nothing. Rows with the same id are one document in the
    links, each with its own count; a null id links with nothing and has a null component. Other columns are not read.
    """
    plain = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text"))
    sketch = bounded_batches(docs.sparkSession).sparkContext.broadcast(_sketch(plain, k, kind, lower))
    rows = plain.mapInArrow(_blocks(k, kind, lower, tenths, sketch), "key long, sig long, doc long, up long, n long, point binary")
    block = Window.partitionBy("key", "sig")
    stars = rows.withColumn("leader", F.coalesce("up", F.min("doc").over(block)))
    stars = stars.where("n IS NOT NULL OR leader <> doc").select("sig", "doc", "leader", "n", "point")
    stars = materialise(stars, "ngram-stars", compression="zstd")
    sketch.unpersist()

    equal = stars.where("n IS NOT NULL AND leader <> doc").select(F.col("leader").alias("a"), F.col("doc").alias("b"))
    near = stars.where("n IS NULL").select("sig", F.col("leader").alias("a"), F.col("doc").alias("b"))
    pairs = materialise(near.select("a", "b").distinct(), "ngram-pairs")
    points = stars.where("point IS NOT NULL").select("doc", "n", "point")
    verifier = Verifier(plain, points, k, tenths, kind, lower)
    links = verifier.links(pairs)
    components = connected_components(equal.union(links))

    # blocks of three and more that hold several components have pairs that weren't compared
    members = near.select("sig", F.col("a").alias("doc")).union(near.select("sig", "b")).distinct()
    large = materialise(members.groupBy("sig").count().where("count > 2").select("sig"), "ngram-large")
    open_ = materialise(_split(members.join(large, "sig", "left_semi"), components), "ngram-open")
    members = materialise(_sized_blocks(open_.select("sig", "doc"), points, tenths), "ngram-members")
    discard(open_, large)
    for number in range(ROUNDS):
        open_ = materialise(_split(members, components), "ngram-open")
        if open_.isEmpty():
            break
        first = F.min_by(F.struct(F.col("doc").alias("leader"), F.col("component").alias("of")), F.xxhash64("doc", F.lit(number)))
        led = open_.join(materialise(open_.groupBy("sig").agg(first.alias("l")), "ngram-leaders"), "sig").where("component <> l.of")
        fresh = led.select(F.least("doc", "l.leader").alias("a"), F.greatest("doc", "l.leader").alias("b")).distinct()
        fresh = materialise(fresh.join(pairs, ["a", "b"], "left_anti"), "ngram-pairs")
        components = _merged(components, verifier.links(fresh))
        pairs = pairs.union(fresh)
        discard(open_)
    open_ = materialise(_split(members, components), "ngram-open")
    if not open_.isEmpty():
        sized = open_.groupBy("sig").agg(F.ceil(F.count("*") / PART).alias("parts"))
        dealt = open_.join(sized, "sig").withColumn("part", F.pmod(F.xxhash64("doc"), "parts"))
        blocks_of = open_.groupBy("doc").agg(F.collect_set("sig").alias("sigs"))
        dealt = dealt.join(points, "doc").join(blocks_of, "doc")
        # a pair of parts (i, j), i <= j, meets in one group; side 0: of part i, 1: of part j, 2: of both
        later = F.transform(F.sequence("part", F.col("parts") - 1), lambda j: F.struct(F.col("part").alias("i"), j.alias("j"), F.when(j == F.col("part"), 2).otherwise(0).alias("side")))
        earlier = F.when(F.col("part") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("part") - 1), lambda i: F.struct(i.alias("i"), F.col("part").alias("j"), F.lit(1).alias("side"))))
        to = F.concat(later, F.coalesce(earlier, F.array().cast("array<struct<i:bigint,j:bigint,side:int>>")))
        keys = ["sig", "i", "j"]
        dealt = dealt.withColumn("to", F.explode(to)).select("sig", "to.*", "doc", "n", "point", "component", "sigs")
        more = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_tree_join(tenths), "a long, b long")
        more = materialise(more.where("a <> b").distinct().join(pairs, ["a", "b"], "left_anti"), "ngram-more")
        components = _merged(components, verifier.links(more))
    listed = stars.where("n IS NOT NULL").select(F.col("doc").alias(id), F.col("n").alias("n_shingles"))
    joined = listed.join(components, listed[id] == components.node, "left")
    return joined.select(id, "n_shingles", F.coalesce("component", id).alias("component_id"))
