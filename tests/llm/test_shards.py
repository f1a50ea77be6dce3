import zlib

import numpy as np
import pytest

from tests.llm.conftest import AWKWARD
from tracelink.llm.shards import SHARD, Permutation, read_slots, token_shards, write_shards
from tracelink.llm.tokens import encoder


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation_is_keyed_and_invertible(n):
    order = Permutation(n, 7)
    slots = order.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and (order.index(slots) == np.arange(n)).all()
    if n > 60:
        assert (Permutation(n, 8).slot(np.arange(n)) != slots).any() and (slots != np.arange(n)).mean() > 0.9


def texts_of(rows, length):
    """Token runs of all sequences, put together per (doc, text)."""
    parts = {}
    for r in rows:
        ids = np.frombuffer(r.payload, "<u2").reshape(r.n_sequences, length)
        assert zlib.crc32(r.payload) == r.crc32 and r.stride == 2 * length and r.n_sequences == len(r.doc_ids)
        for doc, part, n, tokens in zip(r.doc_ids, r.parts, r.lengths, ids, strict=True):
            parts.setdefault(doc, []).append((part, tokens[:n].tolist()))
    return parts


def test_round_trip(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5, "doc_id")
    made = token_shards(docs, length=64, per_shard=10)
    path = str(tmp_path / "shards")
    write_shards(made, path)
    rows = sorted(made.collect(), key=lambda r: r.shard)
    files = {r.shard: (tmp_path / "shards" / "data" / r.file).read_bytes() for r in spark.read.parquet(f"{path}/index").collect()}
    assert files == {r.shard: r.payload for r in rows}
    assert [r.shard for r in rows] == list(range(len(rows))) and all(r.n_sequences == 10 for r in rows[:-1])
    coder = encoder("byte_bpe_50k.json")
    got = {doc: [t for _, ts in sorted(p) for t in ts] for doc, p in texts_of(rows, 64).items()}
    assert got == {r.doc_id: [*coder.encode(r.text), 50256] for r in docs.collect() if r.text}
    assert sum(r.n_sequences for r in rows) == sum(-(-len(t) // 64) for t in got.values())
    flat = np.concatenate([np.frombuffer(r.payload, "<u2").reshape(-1, 64) for r in rows])
    resumed = list(read_slots(spark, path, 15, 23))
    assert [s for s, _ in resumed] == list(range(15, 38)) and all((flat[s] == t).all() for s, t in resumed)


def test_awkward_rows(awkward, nothing):
    rows = token_shards(awkward, length=512, per_shard=4).collect()
    assert {d for r in rows for d in r.doc_ids} == {d for d, t, *_ in AWKWARD if t}
    ends = sum(1 for r in rows for n in r.lengths for _ in [0] if n)
    assert ends == sum(r.n_sequences for r in rows)
    assert token_shards(nothing).count() == 0


def test_wide_ids_are_read_as_they_were_written(spark, tmp_path):
    ids = np.arange(65_530, 65_542, dtype="<u4").reshape(3, 4)
    row = (0, 0, 3, 16, 4, [1, 1, 1], [0, 1, 2], [4, 4, 4], zlib.crc32(ids.tobytes()), ids.tobytes())
    write_shards(spark.createDataFrame([row], SHARD), str(tmp_path / "wide"))
    assert [(s, t.tolist()) for s, t in read_slots(spark, str(tmp_path / "wide"), 1, 9)] == [(1, ids[1].tolist()), (2, ids[2].tolist())]
