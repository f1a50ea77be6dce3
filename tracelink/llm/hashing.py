"""Vectorised word and shingle hashes over UTF-8 bytes, for use inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_FOLD = U64(0xD6E8FEB86659FD93)
#: Bytes hashed in one go; a longer text is hashed in pieces of so many that end between words.
CHUNK_BYTES = 256 << 10
#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20
#: Bytes of text that a task turns into Python objects at a time; a longer text comes alone.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 bits."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xA0761D6478BD642F)
    return x ^ (x >> U64(32))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=U64) | U64(1)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    return tuple(_power_run(base, CHUNK_BYTES + 1024) for base in (_BASE, pow(_BASE, -1, 2**64)))


def _power_run(base: int, n: int) -> np.ndarray:
    run = np.full(n, base, U64)
    run[0] = 1
    return np.multiply.accumulate(run)


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session, with batches to Python of BATCH_BYTES at most, or one row: both sides hold several of them at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) != str(BATCH_BYTES):
        spark.conf.set(name, BATCH_BYTES)
    return spark


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most so many bytes in `column`, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def byte_table(kind: str) -> np.ndarray:
    """Maps a byte to its lower-case form, or to 0 where it separates words.

    space: words are runs outside \\x20 and \\x09-\\x0D; alnum: runs of ASCII letters, digits and bytes over 127.
    Both fold A-Z only; a caller that wants more lower-cases its text first.
    """
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    if kind == "space":
        table[[32, *range(9, 14)]] = 0
        table[0] = 1  # NUL is an ordinary character of a word; \x01 then shares its value
    else:
        keep = np.zeros(256, bool)
        keep[48:58] = keep[65:91] = keep[97:123] = keep[128:] = True
        table[~keep] = 0
    return table


def chunks(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, encoded texts) of runs of texts of about CHUNK_BYTES together."""
    start, run, size = 0, [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if run and size + len(data) > CHUNK_BYTES:
            yield start, run
            start, run, size = i, [], 0
        run.append(data)
        size += len(data) + 1
    if run:
        yield start, run


def _pieces(low: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about CHUNK_BYTES that end behind a separator; a longer word stays whole. The last byte separates."""
    start = 0
    while start < len(low):
        stop = min(start + CHUNK_BYTES, len(low))
        gaps = np.flatnonzero(low[start:stop] == 0)
        while not len(gaps):
            begin, stop = stop, min(2 * stop - start, len(low))
            gaps = np.flatnonzero(low[begin:stop] == 0)[:1] + (begin - start)
        yield start, (start := start + int(gaps[-1]) + 1)


def word_hashes(encoded: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, offsets: words of text i are at offsets[i]:offsets[i + 1])."""
    low = table[np.frombuffer(b" ".join(encoded) + b" ", np.uint8)]
    ends = np.cumsum([len(x) + 1 for x in encoded])
    low[ends - 1] = 0
    hashes, starts = [], []
    for a, b in _pieces(low):
        part = low[a:b]
        edge = np.diff((part != 0).view(np.int8), prepend=np.int8(0))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _powers() if len(part) <= CHUNK_BYTES else (_power_run(base, len(part)) for base in (_BASE, pow(_BASE, -1, 2**64)))
        terms = _byte_values()[part] * up[: len(part)]
        terms[part == 0] = 0
        total = np.cumsum(terms, dtype=U64)
        before = np.where(first > 0, total[first - 1], U64(0))
        hashes.append(mix((total[last - 1] - before) * down[first]))
        starts.append(first + a)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), np.concatenate([[0], ends]))


def fold(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words of one run; empty where there are fewer."""
    n = len(words) - k + 1
    if n < 1:
        return words[:0]
    value = words[:n].copy()
    for j in range(1, k):
        value = mix(value * _FOLD + words[j : j + n])
    return value


def shingles(words: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Hashes of each text's k-word shingles in order; a text with fewer words has one of all its words."""
    value = fold(words, k)
    found = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= k:
            found.append(value[a : b - k + 1])
        else:
            found.append(fold(words[a:b], b - a) if b > a else words[:0])
    return found
