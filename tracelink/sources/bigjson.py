"""Records of one large JSON array, read by many tasks.

A byte range of a JSON text can't tell by itself whether it begins inside a string, nor how deep. But what it does to either state can be told: a first pass gives,
per range, whether its quotes flip the state, and how the depth changes if it began outside or inside a string. Adding these up in order of the ranges gives each range's
true beginning, a second pass tells which array it ends in, and a third reads the records that begin in each range, to their ends wherever these are. Past its end
a range is read on for a record that began in it only, so each pass reads a file about once, however small the ranges and however long the records.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a range, of what a task looks at in one go, and of the first look past a range's end.
RANGE_BYTES = 32 << 20
PIECE_BYTES = 4 << 20
PAST_BYTES = 8 << 10
#: Bytes before an array in which its key is looked for.
KEY_BYTES = 1 << 16
#: A task gets ranges of so many bytes together, if there are enough tasks for all cores.
TASK_BYTES = 32 << 20
MOST_TASKS = 4096
_QUOTE, _BACKSLASH, _COMMA = 34, 92, 44
#: What a byte outside strings adds to the depth.
_STEP = np.zeros(256, np.int64)
_STEP[[91, 123]], _STEP[[93, 125]] = 1, -1


class _File:
    """A file's bytes by place, in pieces; knows of each place whether it is escaped."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.path = path
        store, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
        self.file = store.open_input_file(at)
        self.size = self.file.size()

    def bytes(self, low: int, high: int) -> bytes:
        low, high = max(0, low), min(high, self.size)
        return self.file.read_at(high - low, low) if high > low else b""

    def slashes_before(self, at: int) -> int:
        """How many backslashes stand right before a place."""
        n, step = 0, 64
        while at - n > 0:
            part = self.bytes(at - n - step, at - n)
            run = len(part) - len(part.rstrip(b"\\"))
            n += run
            if run < len(part):
                break
        return n

    def pieces(self, low: int, high: int, unfinished: Callable[[], bool] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place, bytes, where in them quotes begin or end a string); beyond `high` as long as something is unfinished, by growing steps."""
        odd, past = self.slashes_before(low) % 2, PAST_BYTES
        while low < self.size and (low < high or unfinished and unfinished()):
            step = high - low
            if low >= high:
                step, past = past, past * 2
            data = np.frombuffer(self.bytes(low, low + min(step, PIECE_BYTES)), np.uint8)
            quotes, slashes = np.flatnonzero(data == _QUOTE), np.flatnonzero(data == _BACKSLASH)
            if odd:
                slashes = np.concatenate([[-1], slashes])
            odd = 0
            if len(slashes):
                # where the run of backslashes begins that each is in
                begins = slashes[np.maximum.accumulate(np.where(np.diff(slashes, prepend=-3) != 1, np.arange(len(slashes)), 0))]
                k = np.minimum(np.searchsorted(slashes, quotes - 1), len(slashes) - 1)
                quotes = quotes[(slashes[k] != quotes - 1) | ((quotes - begins[k]) % 2 == 0)]
                if slashes[-1] == len(data) - 1:
                    odd = int(len(data) - begins[-1]) % 2
            yield low, data, quotes
            low += len(data)


def _brackets(data: np.ndarray) -> np.ndarray:
    """Which bytes are brackets: two pairs that differ in one bit."""
    folded = data | 32
    return (folded == 123) | (folded == 125)


def _effect(file: _File, low: int, high: int) -> tuple[int, int, int]:
    """(1 if the range flips inside and outside, change of depth if it begins outside a string, or inside)."""
    flips, changes = 0, [0, 0]
    for _, data, quotes in file.pieces(low, high):
        at = _brackets(data).nonzero()[0]
        inside = (np.searchsorted(quotes, at) + flips) % 2
        changes[0] += int(_STEP[data[at[inside == 0]]].sum())
        changes[1] += int(_STEP[data[at[inside == 1]]].sum())
        flips = (flips + len(quotes)) % 2
    return flips, changes[0], changes[1]


def _events(file: _File, low: int, high: int, inside: bool, depth: int, level: int, unfinished: Callable[[], bool] | None = None) -> Iterator[tuple[int, int]]:
    """(place, byte) of the brackets that open or close something of depth `level`, and of the commas in it; beyond `high` as `pieces` does."""
    for at, data, quotes in file.pieces(low, high, unfinished):
        found = np.flatnonzero(_brackets(data) | (data == _COMMA))
        found = found[(np.searchsorted(quotes, found) + inside) % 2 == 0]
        step = _STEP[data[found]]
        after = depth + np.cumsum(step)
        hit = after == np.where(step < 0, level - 1, level)
        yield from zip((found[hit] + at).tolist(), data[found[hit]].tolist(), strict=True)
        depth, inside = int(after[-1]) if len(after) else depth, (len(quotes) + inside) % 2 == 1


def _is_array(file: _File, at: int, byte: int, key: str | None) -> bool:
    """Whether the bracket at a place opens the array that is asked for."""
    if byte != 91 or key is None:
        return byte == 91
    return re.search(rb'"' + re.escape(key.encode()) + rb'"\s*:\s*$', file.bytes(at - KEY_BYTES, at)) is not None


def _last_array(file: _File, low: int, high: int, inside: bool, depth: int, level: int, key: str | None) -> bool | None:
    """Whether the last thing of depth `level` that a range opens is the array; None where it opens none."""
    last = None
    for at, byte in _events(file, low, high, inside, depth, level):
        if byte in (91, 123):
            last = (at, byte)
    return _is_array(file, *last, key) if last else None


def _records(file: _File, low: int, high: int, inside: bool, depth: int, level: int, key: str | None, within: bool) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the array's elements that begin in a range."""
    start, ours = None, within
    for at, byte in _events(file, low, high, inside, depth, level, lambda: start is not None):
        if start is not None and byte not in (91, 123):
            if text := file.bytes(start, at).strip():
                yield start, text
            start = None
        if at >= high:
            return
        if byte in (91, 123):
            ours = _is_array(file, at, byte, key)
        if ours and byte in (91, _COMMA):
            start = at + 1
        elif byte in (93, 125):
            ours = False


def _each(rows: Callable, names: list[str], types: list[pa.DataType], *args):
    def made(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, file = [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if file is None or file.path != row["path"]:
                    file = _File(row["path"])
                for found in rows(file, row, *args):
                    held.append((row["path"], row["range"], *found))
                    size += len(found[-1]) if isinstance(found[-1], bytes) else 16
                    if size >= PIECE_BYTES:
                        yield made(held)
                        held, size = [], 0
        if held:
            yield made(held)

    return run


_AT = ["path", "range"]
_AT_TYPES = [pa.string(), pa.int64()]


def json_records(spark: SparkSession, path: str | list[str], key: str | None = None, level: int = 1, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, at, record): the text of each element of a file's array, and the byte it begins at.

    key: the array is the value of this key, at a depth of `level` brackets, its own included (sellers of {"sellers": [...]}: 2); without one it is what the file
    holds. A file without it gives none. Elements may hold anything; what isn't JSON is cut by its brackets and quotes. Several arrays with the key at that depth give all their elements.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    last = F.floor((F.col("length") - 1) / range_bytes)
    n, size = files.where("length > 0").agg(F.sum(last + 1), F.sum("length")).first()
    if not n:
        return spark.createDataFrame([], "path STRING, at BIGINT, record STRING")
    ranges = files.where("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("range"))
    # so few rows would be put into one task, and a task for each small range would cost more than its bytes
    tasks = min(n, MOST_TASKS, max(3 * spark.sparkContext.defaultParallelism, size // TASK_BYTES + 1))
    dealt = lambda df: df.repartition(tasks, "path", "range").sortWithinPartitions("path", "range")
    low = lambda r: r["range"] * range_bytes
    effects = dealt(ranges).mapInArrow(_each(lambda f, r: [_effect(f, low(r), low(r) + range_bytes)], [*_AT, "flips", "out", "in"], [*_AT_TYPES, *[pa.int64()] * 3]), "path string, range long, flips long, out long, in long")
    before = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begun = effects.withColumn("inside", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2 == 1)
    begun = begun.withColumn("change", F.when(F.col("inside"), F.col("in")).otherwise(F.col("out")))
    begun = begun.select("path", "range", "inside", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"))
    state = lambda r: (low(r), low(r) + range_bytes, r["inside"], r["depth"])
    ends = dealt(begun).mapInArrow(_each(lambda f, r: [(r["inside"], r["depth"], _last_array(f, *state(r), level, key))], [*_AT, "inside", "depth", "last"], [*_AT_TYPES, pa.bool_(), pa.int64(), pa.bool_()]), "path string, range long, inside boolean, depth long, last boolean")
    known = ends.select("path", "range", "inside", "depth", F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(False)).alias("within"))
    read = _each(lambda f, r: _records(f, *state(r), level, key, r["within"]), [*_AT, "at", "record"], [*_AT_TYPES, pa.int64(), pa.binary()])
    found = dealt(known).mapInArrow(read, "path string, range long, at long, record binary")
    return found.select("path", "at", F.make_valid_utf8(F.col("record").cast("string")).alias("record"))


def array_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file): files that hold an array, by their first character that is no blank and no line's end; no more of them is read."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [name for at, name in zip(batch["path"].to_pylist(), batch["file"].to_pylist(), strict=True) if _first(_File(at)) == b"["]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["file"])

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", F.col("_metadata.file_path").alias("file"))
    return files.mapInArrow(heads, "file string")


def _first(file: _File) -> bytes:
    for at in range(0, file.size, KEY_BYTES):
        if text := file.bytes(at, at + KEY_BYTES).lstrip(b" \r\n"):
            return text[:1]
    return b""
