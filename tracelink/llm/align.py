"""Alignment of two tokenizers' tokens, and how often each pair of ids is aligned in the corpus.

Both tokenizers cut the same bytes. NumPy cumulative sums give the byte ends of their tokens, `intersect1d` the cuts that both share, `searchsorted` the group
between cuts that a token is in and the range of tokens of the other side that it overlaps; repeating by these ranges lists all links of a text.
A text's distinct links are stored with their number once. Pairs are counted by a salted shuffle in two stages, and the counts of the frequent pairs, at most
HEAD of them, go to all tasks; links of all other pairs are joined with their counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelink.llm.hashing import bounded_batches, slices
from tracelink.llm.tokens import encoder, tokenizer_path
from tracelink.storage import materialise

#: Pairs whose counts go to all tasks: 17 bytes each.
HEAD = 1 << 21
#: Distinct pairs that a task holds before it hands them on.
HELD = 1 << 20
#: Tasks that share a pair's first stage.
SALTS = 16
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


class Tokenizers:
    """Ids and bytes of a byte-level BPE file (A) and a SentencePiece model (B)."""

    def __init__(self, a: str, b: str):
        from sentencepiece import SentencePieceProcessor

        self.path_a, self.a, self.b = tokenizer_path(a), encoder(a), SentencePieceProcessor(model_file=tokenizer_path(b))
        size = self.b.get_piece_size()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(size)))]
        ids_a = range(self.a.fast.n_vocab)
        self.bytes_a = [self._bytes_of_a(i) for i in ids_a]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.shift = max(1, (size - 1).bit_length())
        #: stored pairs have so many bytes
        self.width = 4 if (len(ids_a) - 1).bit_length() + self.shift <= 32 else 8

    def _bytes_of_a(self, i: int) -> bytes:
        try:
            return self.a.fast.decode_single_token_bytes(i)
        except KeyError:  # an id without a token
            return b""

    def ids_a(self, text: str) -> np.ndarray:
        """Ids of space + text; special tokens' strings are plain text."""
        try:
            return self.a.fast.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)
        except BaseException as error:  # a panic of the native code is no Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit)):
                raise
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(self.path_a)
            library.encode_special_tokens = True
            return np.array(library.encode(" " + text, add_special_tokens=False).ids, np.int64)

    def both(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides; None for texts without tokens: null, empty, or not what either side's bytes join to."""
        if not text:
            return None
        a, b, whole = self.ids_a(text), self.b.encode(text), b" " + text.encode()
        if b"".join([self.bytes_a[i] for i in a.tolist()]) != whole or b"".join([self.bytes_b[i] for i in b]) != whole:
            return None
        return a, np.array(b, np.int64)


@lru_cache(maxsize=1)
def tokenizers(a: str, b: str) -> Tokenizers:
    """One per worker process."""
    return Tokenizers(a, b)


def overlaps(len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(group of each A token, of each B token, A place and B place of each link, number of groups) from the tokens' byte lengths."""
    ends_a, ends_b = np.cumsum(len_a), np.cumsum(len_b)
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    groups_a, groups_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    first, stop = np.searchsorted(ends_b, ends_a - len_a, "right"), np.searchsorted(ends_b - len_b, ends_a, "left")
    n = stop - first
    at_a = np.repeat(np.arange(len(n)), n)
    at_b = np.arange(len(at_a)) - np.repeat(np.cumsum(n) - n - first, n)
    return groups_a, groups_b, at_a, at_b, len(cuts)


@lru_cache(maxsize=8)
def _digits(size: int) -> np.ndarray:
    """Each number's decimal digits, zero bytes before them and one place after."""
    width = len(str(max(1, size - 1)))
    return np.array([[0] * (width - len(s)) + list(s.encode()) + [0] for s in map(str, range(size))], np.uint8)


def groups_text(a: np.ndarray, b: np.ndarray, groups_a: np.ndarray, groups_b: np.ndarray) -> bytes:
    """`a1,a2|b1;a3|b2,b3`: ids of both sides, group by group."""
    table = _digits(1 << int(max(a.max(initial=0), b.max(initial=0), 255)).bit_length())
    # a token stands after all of its own side before it, and after the other side's tokens of the groups before (A) or up to its own (B)
    place_a = np.arange(len(a)) + np.searchsorted(groups_b, groups_a, "left")
    place_b = np.arange(len(b)) + np.searchsorted(groups_a, groups_b, "right")
    out = np.empty((len(a) + len(b), table.shape[1]), np.uint8)
    for ids, place, groups, end in ((a, place_a, groups_a, ord("|")), (b, place_b, groups_b, ord(";"))):
        rows = table[ids]
        rows[:, -1] = ord(",")
        rows[np.flatnonzero(np.diff(groups, append=-1)), -1] = end
        out[place] = rows
    flat = out.ravel()
    return flat[flat != 0].tobytes()[:-1]


def pack(values: np.ndarray, width: int) -> bytes:
    """Little-endian numbers, all lowest bytes first: what is small compresses."""
    return values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def _aligned(a_name: str, b_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, row = tokenizers(a_name, b_name), TaskContext.get().partitionId() << 40
        for batch in (p for batch in batches for p in slices(batch)):
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = both.both(text.as_py())
                if ids is None:
                    out.append((row, doc, 0, 0, 0, 0, "", b"", b""))
                else:
                    a, b = ids
                    groups_a, groups_b, at_a, at_b, n_groups = overlaps(both.len_a[a], both.len_b[b])
                    pairs, times = np.unique((a[at_a] << both.shift) | b[at_b], return_counts=True)
                    sha = hashlib.sha256(groups_text(a, b, groups_a, groups_b)).hexdigest()
                    out.append((row, doc, len(a), len(b), n_groups, len(at_a), sha, pack(np.diff(pairs, prepend=0), both.width), pack(times, 4)))
                row += 1
            types = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [c.split()[0] for c in ALIGNED.split(", ")])

    return run


def aligned_texts(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """ALIGNED rows of `docs`, written once: a text's numbers, its digest of groups, and its distinct pairs with how often they are linked."""
    bounded_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(plain.mapInArrow(_aligned(a, b), ALIGNED), "aligned", compression="zstd")


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Equal pairs once, with their sums."""
    pairs = np.concatenate([p for p, _ in parts])
    order = np.argsort(pairs, kind="stable")
    pairs, times = pairs[order], np.concatenate([t for _, t in parts])[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[first], np.add.reduceat(times, first) if len(first) else times


def _stored(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for pairs, times in zip(batch.column("pairs"), batch.column("times"), strict=True):
        yield np.cumsum(unpack(pairs.as_py(), width)), unpack(times.as_py(), 4)


def _counted(width: int):
    """Rows (pair, salt, n): a task's pairs, put together as far as HELD allows."""

    def emit(pairs: np.ndarray, times: np.ndarray, salt: int) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(pairs), 100_000):
            some = pairs[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), salt, np.int32)), pa.array(times[at : at + 100_000])], ["pair", "salt", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % SALTS
        parts, size, least = [], 0, HELD
        for batch in batches:
            for part in _stored(batch, width):
                parts.append(part)
                size += len(part[0])
                if size >= 2 * least:
                    parts = [_merged(parts)]
                    size = len(parts[0][0])
                    if size >= HELD:
                        yield from emit(*parts[0], salt)
                        parts, size = [], 0
        if parts:
            yield from emit(*_merged(parts), salt)

    return run


def pair_counts(aligned: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """(pair, a, b, n, best): links of each pair of ids in all texts; best where no pair with the same B id has more. pair is a << bits of B | b."""
    both = tokenizers(a, b)
    rows = aligned.where("n_links > 0").select("pairs", "times").mapInArrow(_counted(both.width), "pair long, salt int, n long")
    salted = rows.groupBy("pair", "salt").agg(F.sum("n").alias("n"))
    counts = salted.groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialise(counts.select("pair", F.shiftright("pair", both.shift).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << both.shift) - 1)).cast("int").alias("b"), "n"), "pair-counts")
    # at most one row per id of B's vocabulary
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "b").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _floor(counts: DataFrame, head: int) -> int:
    """The least power of two that at most `head` pairs reach."""
    by = counts.groupBy(F.floor(F.log2(F.col("n").cast("double") + 0.5)).cast("int").alias("bits")).count()
    total, floor = 0, 1 << 62
    for row in sorted(by.collect(), reverse=True):  # at most 63 rows
        total += row["count"]
        if total > head:
            break
        floor = 1 << row.bits
    return floor


def _looked_up(head, width: int):
    """Rows (row, n_best, count_sum): what the frequent pairs add up to in a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = head.value
        for batch in batches:
            sums = []
            for pairs, times in _stored(batch, width):
                at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
                hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
                at, times = at[hit], times[hit]
                sums.append((int(times[best[at]].sum()), int((times * n[at]).sum())))
            kept = [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([s[0] for s in sums], pa.int64()), pa.array([s[1] for s in sums], pa.int64()), batch.column("groups_sha256")],
                ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    return run


def _others(head, width: int):
    """Rows (row, pair, times): a text's pairs that aren't among the frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value[0]
        for batch in batches:
            for row, (pairs, times) in zip(batch.column("row").to_pylist(), _stored(batch, width), strict=True):
                other = ~np.isin(pairs, known, assume_unique=True)
                if other.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(other.sum()), row)), pa.array(pairs[other]), pa.array(times[other])], ["row", "pair", "times"])

    return run


def align_tokens(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    Null and empty texts, and those that one tokenizer doesn't give back byte by byte (control characters that B drops, U+2581), have no tokens: zeros, and an
    empty digest. Pairs with equal counts are all best. Repeated rows, ids and null ids count like others, row by row. Other columns, whatever their names, are not read. An empty
    table gives no rows. A text is tokenised whole: some 100 bytes of memory per byte. `head` changes what is broadcast, not the result.
    """
    spark, both = docs.sparkSession, tokenizers(a, b)
    aligned = aligned_texts(docs, a, b)
    counts = materialise(pair_counts(aligned, a, b), "pairs")
    floor = _floor(counts, head)
    known = counts.where(F.col("n") >= floor).select("pair", "n", "best").toArrow()
    order = np.argsort(known.column("pair").to_numpy())
    table = spark.sparkContext.broadcast(tuple(known.column(c).to_numpy()[order] for c in ("pair", "n", "best")))
    out = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    found = aligned.mapInArrow(_looked_up(table, both.width), out)
    if counts.where(F.col("n") < floor).isEmpty():
        return found.drop("row")
    tail = materialise(counts.where(F.col("n") < floor).select("pair", "n", "best"), "rare-pairs")
    rare = aligned.where("n_links > 0").select("row", "pairs", "times").mapInArrow(_others(table, both.width), "row long, pair long, times long")
    per = rare.join(tail, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    joined = found.join(per, "row", "left")
    more = lambda to, by: (F.col(to) + F.coalesce(by, F.lit(0))).alias(to)
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", more("n_best", "more_best"), more("count_sum", "more_sum"), "groups_sha256")
