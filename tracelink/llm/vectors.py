"""Embedding near-duplicates by randomised-rotation binary codes.

A unit vector is turned by seeded random rotations; the signs of its coordinates are its code, and the inner product of the
turned vector with its own signs is stored as a correction factor. <signs of x, turned y> over that factor is an unbiased
estimate of <x, y> whose error has a known bound; only pairs whose estimate may reach the threshold are recomputed exactly
in double precision. Runs of code bits are the keys of bands in which pairs meet; a pair counts in the first band that it shares. Through the bands
goes a vector's code with its coordinates as single bytes, whose rounding the bound allows for; the exact vector is fetched only for the buckets in
which it has a likely partner.

How many bits a band has follows from the number of vectors, how many bands from the recall that is asked for at the
threshold itself, so pairs above it are found more often still.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelink.operators.graph import connected_components
from tracelink.storage import materialise

RECALL = 0.97
#: Standard deviations that an estimate may be off.
SURE = 4.0
#: Rotations that the estimates use.
ESTIMATES = 2
PART = 1024
#: So many large buckets at most go to all tasks (some 32 MB); more are joined.
BROADCAST_BUCKETS = 1_000_000
#: Vectors that a band's bucket should hold on average.
BUCKET = 16


@lru_cache(maxsize=4)
def rotations(dim: int, count: int, seed: int) -> np.ndarray:
    """Random orthogonal matrices."""
    rng = np.random.default_rng([seed, dim])
    return np.array([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)])


def bands_for(n: int, least: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a band, bands) for n vectors: a pair at cosine `least` shares a band with probability `recall`."""
    bits = min(24, max(6, math.ceil(math.log2(max(1, n) / BUCKET))))
    agree = (1 - math.acos(least) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, scaled first so that squares neither overflow nor vanish."""
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(1, keepdims=True))


def _usable(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
    """Places of usable vectors by dimension: no null, no null or non-finite component, not all zero."""
    column = batch.column("embedding")
    by: dict[int, list[int]] = {}
    for i, x in enumerate(column.to_pylist()):
        if x and all(v is not None and math.isfinite(v) for v in x) and any(x):
            by.setdefault(len(x), []).append(i)
    return {d: np.array(p) for d, p in by.items()}


CODED = "cls long, dim int, slot long, body binary"


def _quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one signed byte per coordinate, scale, length of what that leaves out) of unit vectors."""
    scale = np.abs(units).max(1, keepdims=True) / 127
    small = np.rint(units / scale).astype(np.int8)
    return small, scale[:, 0], np.sqrt(((units - small * scale) ** 2).sum(1))


def _turned(units: np.ndarray, bits: int, bands: int, seed: int) -> np.ndarray:
    """Rotated vectors: row, rotation, coordinate."""
    dim = units.shape[1]
    return np.einsum("nd,kde->nke", units, rotations(dim, max(ESTIMATES, -(-bits * bands // dim)), seed))


def _code_bytes(dim: int, bits: int, band: int) -> int:
    """Bytes of code that a band needs: for the estimates, and for the keys of the bands before it."""
    return -(-max(ESTIMATES * dim, bits * band) // 8)


def _code(bits: int, bands: int, seed: int):
    """Rows (cls, dim, slot, body) of every band: slot is the band and its key; body the quantised vector, the code, and scale, rest and factors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, places in _usable(batch).items():
                for at in range(0, len(places), 256):
                    part = pa.array(places[at : at + 256])
                    units = unit(np.array(batch.column("embedding").take(part).to_pylist(), np.float64))
                    turned = _turned(units, bits, bands, seed)
                    flat = (turned > 0).reshape(len(units), -1)
                    factors = np.abs(turned[:, :ESTIMATES]).sum(2) / math.sqrt(dim)
                    small, scale, rest = _quantised(units)
                    code, tail = np.packbits(flat, axis=1), np.column_stack([scale, rest, factors]).astype("<f4")
                    slots = _keys(flat, bits, bands) + (np.arange(bands, dtype=np.int64) << 32)
                    body = [small[i].tobytes() + code[i, : _code_bytes(dim, bits, band)].tobytes() + tail[i].tobytes() for i in range(len(units)) for band in range(bands)]
                    cls = batch.column("cls").take(part).take(pa.array(np.repeat(np.arange(len(units)), bands)))
                    yield pa.RecordBatch.from_arrays([cls, pa.array(np.full(len(body), dim, np.int32)), pa.array(slots.reshape(-1)), pa.array(body, pa.binary())], ["cls", "dim", "slot", "body"])

    return run


def _keys(flat: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """Key of each band: a run of `bits` of the code."""
    powers = 1 << np.arange(bits, dtype=np.int64)
    return flat[:, : bits * bands].reshape(len(flat), bands, bits).astype(np.int64) @ powers


def _labels(links: np.ndarray) -> np.ndarray:
    """Smallest index reachable by the links of a symmetric matrix."""
    label = np.arange(len(links))
    while True:
        now = np.minimum(label, np.where(links, label[None, :], len(links)).min(1))
        now = np.minimum(now, now[now])
        if (now == label).all():
            return label
        label = now


def _meet(side: np.ndarray) -> np.ndarray:
    """Which rows of two parts of a bucket are compared."""
    return (side[:, None] != side[None, :]) | (side[:, None] == 2)


def _likely(dim: int, band: int, side: np.ndarray, bodies: list[bytes], least: float, bits: int, bands: int, seed: int) -> np.ndarray:
    """Which members of a bucket have an estimate that may reach `least` with one they meet here first."""
    raw = np.array([np.frombuffer(b, np.uint8) for b in bodies])
    tail = np.ascontiguousarray(raw[:, -4 * (2 + ESTIMATES) :]).view("<f4").astype(np.float64)
    scale, rest, factors = tail[:, :1], tail[:, 1], tail[:, 2:]
    units = raw[:, :dim].view(np.int8) * scale
    flat = np.unpackbits(raw[:, dim : dim + _code_bytes(dim, bits, band)], axis=1)
    estimate, wrong = np.zeros((len(raw), len(raw))), np.zeros(len(raw))
    for k in range(ESTIMATES):
        signs = flat[:, k * dim : (k + 1) * dim] * 2.0 - 1
        turned = units @ rotations(dim, max(ESTIMATES, -(-bits * bands // dim)), seed)[k]
        # what the bytes leave out of a vector changes its product with a code by its length at most
        estimate += (signs @ turned.T / math.sqrt(dim) + rest[None, :]) / factors[:, k : k + 1] / ESTIMATES
        square = np.minimum(1, factors[:, k] ** 2)
        wrong += np.sqrt((1 - square) / square / max(1, dim - 1)) / ESTIMATES
    # the looser of both directions decides, so that the order of a pair doesn't matter
    bound = estimate + SURE * wrong[:, None] / math.sqrt(ESTIMATES)
    maybe = _meet(side) & (np.maximum(bound, bound.T) >= least - 1e-5)
    np.fill_diagonal(maybe, False)
    return (maybe & ~_met(_keys(flat, bits, band))).any(1)


def _met(keys: np.ndarray) -> np.ndarray:
    """Pairs with an equal key in one of the bands given."""
    found = np.zeros((len(keys), len(keys)), bool)
    for column in keys.T:
        found |= column[:, None] == column[None, :]
    return found


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], names: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of runs of rows with one key."""
    rows = (r for batch in batches for r in zip(*[batch.column(c).to_pylist() for c in (*keys, *names)], strict=True))
    for key, group in groupby(rows, key=lambda r: r[: len(keys)]):
        yield key, [r[len(keys) :] for r in group]


BUCKET_KEYS = ["dim", "slot", "i", "j"]


def _survivors(least: float, bits: int, bands: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, members in _groups(batches, BUCKET_KEYS, ["side", "cls", "body"]):
            if len(members) > 1:
                side = np.array([m[0] for m in members])
                keep = _likely(key[0], key[1] >> 32, side, [m[2] for m in members], least, bits, bands, seed)
                out.extend((*key, *members[i][:2]) for i in np.flatnonzero(keep).tolist())
            if len(out) > 5000:
                yield _batch(out, [*BUCKET_KEYS, "side", "cls"])
                out = []
        if out:
            yield _batch(out, [*BUCKET_KEYS, "side", "cls"])

    return run


def _exact(dim: int, band: int, rows: list[tuple], least: float, bits: int, bands: int, seed: int) -> Iterator[tuple[int, int, int]]:
    """(cls, rows linked to, an id reached) of the members (side, cls, id, n, embedding) of a bucket, for pairs that meet here first."""
    rows = sorted(rows, key=lambda r: r[2])
    side, count = np.array([r[0] for r in rows]), np.array([r[3] for r in rows])
    units = unit(np.array([r[4] for r in rows]))
    keys = _keys((_turned(units, bits, bands, seed) > 0).reshape(len(rows), -1), bits, band)
    a, b = np.nonzero(np.triu(_meet(side) & ~_met(keys), 1))
    links = np.zeros((len(rows), len(rows)), bool)
    for at in range(0, len(a), 1 << 16):
        x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        close = np.einsum("nd,nd->n", units[x], units[y]) >= least
        links[x[close], y[close]] = links[y[close], x[close]] = True
    label, total = _labels(links), links @ count
    for i in np.flatnonzero(total).tolist():
        yield rows[i][1], int(total[i]), rows[label[i]][2]


def _linked(least: float, bits: int, bands: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, members in _groups(batches, BUCKET_KEYS, ["side", "cls", "id", "n", "embedding"]):
            out.extend(_exact(key[0], key[1] >> 32, members, least, bits, bands, seed))
            if len(out) > 5000:
                yield _batch(out, ["cls", "n_links", "to"])
                out = []
        if out:
            yield _batch(out, ["cls", "n_links", "to"])

    return run


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def near_vectors(vectors: DataFrame, least: float = 0.9, recall: float = RECALL, seed: int = 23) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors` (vec_id, embedding).

    Rows link at cosine `least` or more in double precision. n_links counts the other rows linked directly, copies included;
    component_id is the smallest id reachable, itself included. Vectors that are null, empty or zero or hold null or non-finite
    components link with nothing, nor do vectors of different dimensions; a row with a null id links with
    nothing, and has a null component and kept false. Rows that repeat an id are counted each and are one node of the components. Exact copies are
    compared once. Other columns are not read. Every pair found is exact; of pairs at the threshold about `recall` are found.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumns({"h1": F.xxhash64(F.lit(1), "embedding"), "h2": F.xxhash64(F.lit(2), F.reverse("embedding"))})
    distinct = rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").groupBy("h1", "h2")
    distinct = distinct.agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    distinct = materialise(distinct.withColumn("cls", F.monotonically_increasing_id()), "vectors")
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    distinct = distinct.where(usable)
    bits, bands = bands_for(distinct.count(), least, recall)
    coded = materialise(distinct.select("cls", "embedding").mapInArrow(_code(bits, bands, seed), CODED), "vector-codes", compression="zstd")
    large = coded.groupBy("dim", "slot").count().where(F.col("count") > PART)
    large = materialise(large.select("dim", "slot", F.ceil(F.col("count") / PART).cast("long").alias("parts")), "large-buckets")
    dealt = coded.join(F.broadcast(large) if large.count() <= BROADCAST_BUCKETS else large, ["dim", "slot"], "left")
    dealt = dealt.withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))).withColumn("part", F.pmod(F.xxhash64("cls"), "parts"))
    later = F.transform(F.sequence("part", F.col("parts") - 1), lambda j: F.struct(F.col("part").alias("i"), j.alias("j"), F.when(j == F.col("part"), 2).otherwise(0).alias("side")))
    earlier = F.when(F.col("part") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("part") - 1), lambda i: F.struct(i.alias("i"), F.col("part").alias("j"), F.lit(1).alias("side"))))
    to = F.concat(later, F.coalesce(earlier, F.array().cast("array<struct<i:bigint,j:bigint,side:int>>")))
    dealt = dealt.withColumn("_to", F.explode(to)).select("dim", "slot", "_to.*", "cls", "body")
    met = dealt.repartition(*BUCKET_KEYS).sortWithinPartitions(*BUCKET_KEYS)
    names = ", ".join(f"{c} long" for c in (*BUCKET_KEYS, "side", "cls"))
    likely = materialise(met.mapInArrow(_survivors(least, bits, bands, seed), names), "likely-vectors")
    # only what is recomputed gets its vector, in the buckets where it is
    again = likely.join(distinct.select("cls", "id", "n", "embedding"), "cls").repartition(*BUCKET_KEYS).sortWithinPartitions(*BUCKET_KEYS)
    found = materialise(again.mapInArrow(_linked(least, bits, bands, seed), "cls long, n_links long, to long"), "vector-links")
    linked = found.groupBy("cls").agg(F.sum("n_links").alias("other"))
    edges = found.join(distinct.select("cls", "id"), "cls")
    components = connected_components(edges.select(F.col("id").alias("a"), F.col("to").alias("b")))
    classes = distinct.select("cls", "h1", "h2", "id", "n").join(linked, "cls", "left").join(components, F.col("id") == F.col("node"), "left")
    classes = classes.select("h1", "h2", (F.col("n") - 1 + F.coalesce("other", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("to"))
    joined = rows.select("vec_id", "h1", "h2").join(classes, ["h1", "h2"], "left")
    own = F.col("vec_id").isNotNull()
    result = joined.select("vec_id", F.when(own, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(own, F.coalesce("to", "vec_id")).alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
