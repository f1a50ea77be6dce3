"""Token shards in training order.

Documents are tokenised once into fixed-stride sequences. A keyed Feistel permutation with cycle-walking sends a sequence's
index to its slot in the training order; range partitions of slots write shards of so many strides, so that a reader
finds any slot by arithmetic and resumes there.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.llm.hashing import U64, bounded_batches, mix, slices
from tracelink.llm.tokens import encoder
from tracelink.storage import materialise

LENGTH = 512
#: Sequences of a shard: 256 KB of two-byte ids.
PER_SHARD = 256
TASK_BYTES = 24 << 20
ROUNDS = 6
SHARD = "shard long, first_slot long, n_sequences int, stride int, id_bytes int, doc_ids array<long>, parts array<int>, lengths array<int>, crc32 long, payload binary"


class Permutation:
    """Keyed bijection of 0 .. n - 1."""

    def __init__(self, n: int, key: int):
        self.n, self.key = n, key
        self.half = max(1, ((max(1, n - 1)).bit_length() + 1) // 2)
        self.mask = U64((1 << self.half) - 1)

    def _rounds(self, x: np.ndarray, order: Iterator[int], back: bool) -> np.ndarray:
        left, right = x >> U64(self.half), x & self.mask
        for r in order:
            salt = U64((self.key * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F) % 2**64)
            if back:
                left, right = right ^ (mix(left + salt) & self.mask), left
            else:
                left, right = right, left ^ (mix(right + salt) & self.mask)
        return (left << U64(self.half)) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        """Values outside the range walk on along their cycle until they are back in it."""
        order = list(range(ROUNDS))[:: -1 if back else 1]
        value = self._rounds(np.asarray(x).astype(U64), order, back)
        while (out := value >= U64(self.n)).any():
            value[out] = self._rounds(value[out], order, back)
        return value.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, False)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


def _sequences(name: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(name)
        end = next(iter(coder.special.values()))
        kind = np.dtype("<u2" if coder.fast.n_vocab <= 1 << 16 else "<u4")
        for batch in (p for batch in batches for p in slices(batch)):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for doc, text in zip(ids, texts, strict=True):
                if not (text := text.as_py()):
                    continue
                tokens = np.array([*coder.encode(text), end], kind)
                parts = -(-len(tokens) // length)
                padded = np.full(parts * length, end, kind)
                padded[: len(tokens)] = tokens
                data, step = padded.tobytes(), length * kind.itemsize
                for p in range(parts):
                    for column, value in zip(rows, (doc, p, min(length, len(tokens) - p * length), data[p * step : (p + 1) * step]), strict=True):
                        column.append(value)
            for at in range(0, len(rows[0]), 4000):
                part = [c[at : at + 4000] for c in rows]
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int32()), pa.array(part[2], pa.int32()), pa.array(part[3], pa.binary())], ["doc_id", "part", "n", "tokens"])

    return run


def _slots(starts, n: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Permutation(n, key)
        for batch in batches:
            task = batch.column("task").to_numpy()
            index = starts.value[task] + batch.column("row").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(order.slot(index)), *[batch.column(c) for c in ("doc_id", "part", "n", "tokens")]], ["slot", "doc_id", "part", "n", "tokens"])

    return run


def _pack(per_shard: int, length: int):
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.binary()]
    names = ["shard", "first_slot", "n_sequences", "stride", "id_bytes", "doc_ids", "parts", "lengths", "crc32", "payload"]

    def shard_row(number: int, rows: list[tuple]) -> list:
        payload = b"".join(r[4] for r in rows)
        return [number, number * per_shard, len(rows), len(rows[0][4]), len(rows[0][4]) // length, [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], zlib.crc32(payload), payload]

    def emit(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, done = -1, [], []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("slot", "doc_id", "part", "n", "tokens")], strict=True):
                if row[0] // per_shard != number:
                    if rows:
                        done.append(shard_row(number, rows))
                    number, rows = row[0] // per_shard, []
                rows.append(row)
            if len(done) >= 16:
                yield emit(done)
                done = []
        if rows:
            done.append(shard_row(number, rows))
        if done:
            yield emit(done)

    return run


def token_shards(docs: DataFrame, key: int = 20240229, length: int = LENGTH, per_shard: int = PER_SHARD, name: str = "byte_bpe_50k.json") -> DataFrame:
    """SHARD rows: shard s holds slots s * per_shard on, each of `stride` bytes of little-endian ids of `id_bytes`.

    A text's tokens and one end token fill sequences of `length`; the last is padded with end tokens (`lengths` tell).
    Null and empty texts have no sequence. Repeated rows and ids, and null ids, have sequences of their own. No rows give no
    shards. A sequence's index is its place in the token table that is written once: by the task that wrote it, then by row.
    Columns other than doc_id and text, whatever their names, are not read.
    """
    spark = bounded_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = materialise(plain.mapInArrow(_sequences(name, length), "doc_id long, part int, n int, tokens binary"), "tokens", compression="zstd")
    task = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("int")
    placed = table.select("doc_id", "part", "n", "tokens", task.alias("task"), F.col("_metadata.row_index").alias("row"))
    # one number per task that wrote the table
    counts = {r.task: r["count"] for r in placed.groupBy("task").count().collect()}
    per_task = np.zeros(max(counts, default=0) + 2, np.int64)
    for number, count in counts.items():
        per_task[number + 1] = count
    total = int(per_task.sum())
    if not total:
        return spark.createDataFrame([], SHARD)
    starts = spark.sparkContext.broadcast(np.cumsum(per_task))
    slotted = placed.mapInArrow(_slots(starts, total, key), "slot long, doc_id long, part int, n int, tokens binary")
    shards = -(-total // per_shard)
    tasks = max(-(-total * length * 2 // TASK_BYTES), min(shards, 2 * spark.sparkContext.defaultParallelism))
    into = F.floor(F.floor(F.col("slot") / per_shard) * tasks / shards).cast("int")
    ordered = slotted.repartitionById(int(tasks), into).sortWithinPartitions("slot")
    return ordered.mapInArrow(_pack(per_shard, length), SHARD)


INDEX = "shard long, first_slot long, n_sequences int, stride int, id_bytes int, doc_ids array<long>, parts array<int>, lengths array<int>, crc32 long, file string"


def _write_files(path: str):
    """Writes each shard's payload as a file; a task that runs again replaces it with the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        for batch in batches:
            files = []
            for shard, payload in zip(batch.column("shard").to_pylist(), batch.column("payload"), strict=True):
                files.append(f"shard-{shard:012d}.bin")
                draft = f"{base}/.{files[-1]}-{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(payload.as_buffer())
                store.move(draft, f"{base}/{files[-1]}")
            kept = batch.drop_columns(["payload"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(files, pa.string())], [*kept.schema.names, "file"])

    return run


def write_shards(shards: DataFrame, path: str) -> None:
    """Binary files of fixed stride below `path`/data, a URI that all executors reach, and their index as Parquet in `path`/index."""
    columns = [c.split()[0] for c in SHARD.split(", ")]
    rows = shards.select(*columns)
    index = rows.mapInArrow(_write_files(f"{path}/data"), INDEX)
    index.write.parquet(f"{path}/index")


def read_slots(spark: SparkSession, path: str, first: int, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) of `count` slots from `first` on, in order; where a run stopped is where the next one starts.

    The index is listed once, for the shards asked for; of each file only the bytes of the slots are read.
    """
    from pyarrow import fs

    stop = first + count
    store, base = fs.FileSystem.from_uri(f"{path}/data")
    wanted = spark.read.parquet(f"{path}/index").where((F.col("first_slot") < stop) & (F.col("first_slot") + F.col("n_sequences") > first))
    for row in wanted.select("first_slot", "n_sequences", "stride", "id_bytes", "file").orderBy("first_slot").toLocalIterator():
        low, high = max(first, row.first_slot), min(stop, row.first_slot + row.n_sequences)
        with store.open_input_file(f"{base}/{row.file}") as file:
            file.seek((low - row.first_slot) * row.stride)
            for slot in range(low, high):
                yield slot, np.frombuffer(file.read(row.stride), f"<u{row.id_bytes}")
