import json
import random

import pytest

from tracelink.sources import bigjson, readers
from tracelink.sources.bigjson import json_records

ODD = ["", "\\", "\\\\", '"', 'a"b', '\\"', "[", "]", "{,}", "é𝔘", "x" * 300, "\n\t", '","', "\\" * 70 + '"']


def thing(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind == 0:
        return rng.choice(ODD)
    if kind == 1:
        return rng.choice([0, -1.5, True, None, 10**12])
    if kind == 2:
        return rng.choice(ODD) + rng.choice(ODD)
    if kind == 3:
        return [thing(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(ODD) + str(i): thing(rng, depth + 1) for i in range(rng.randrange(4))}


def found(spark, path, **more):
    return [json.loads(r.record) for r in json_records(spark, f"file://{path}", **more).orderBy("path", "at").collect()]


@pytest.mark.parametrize("size", [7, 64, 1000, bigjson.RANGE_BYTES])
def test_elements_of_any_kind(spark, tmp_path, size, monkeypatch):
    rng = random.Random(6)
    items = [thing(rng) for _ in range(12 if size == 7 else 60)]
    (tmp_path / "a.json").write_text(json.dumps(items, indent=rng.choice([None, 2]), ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps(items[:5]) + "\n ")
    assert found(spark, tmp_path, range_bytes=size) == items + items[:5]


def test_small_pieces(tmp_path, monkeypatch):
    monkeypatch.setattr(bigjson, "PIECE_BYTES", 5)
    rng = random.Random(8)
    items = [thing(rng) for _ in range(80)]
    (tmp_path / "a.json").write_text(json.dumps(items))
    file = bigjson._File(f"file://{tmp_path}/a.json")
    assert [json.loads(t) for _, t in bigjson._records(file, 0, file.size, False, 0, 1, None, False)] == items
    # a range's effect is the same however it is cut
    for at in range(0, file.size, 37):
        flips, out, _ = bigjson._effect(file, 0, at)
        more, out2, in2 = bigjson._effect(file, at, file.size)
        assert (flips + more) % 2 == 0 and out + (in2 if flips else out2) == 0


@pytest.mark.parametrize("size", [11, 200, bigjson.RANGE_BYTES])
def test_arrays_by_key(spark, tmp_path, size):
    rng = random.Random(7)
    wanted = [thing(rng) for _ in range(15)]
    doc = {"version": 1, "other": [1, [2], {"sellers": [3]}], "sellers\\": [4], "nested": {"sellers": [5]}, "sellers": wanted, "after": [6, {"x": [7]}], 'text "sellers": [': [8]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    assert found(spark, tmp_path, key="sellers", level=2, range_bytes=size) == wanted
    assert found(spark, tmp_path, key="sellers", level=3, range_bytes=size) == [5]
    assert found(spark, tmp_path, key="none", level=2, range_bytes=size) == []


def test_small_ranges_read_a_file_a_few_times(tmp_path, monkeypatch):
    """Also ranges within one long record: none but the first reads to its end."""
    items = [f"{i} " + "x" * 300 for i in range(5000)] + ["y" * 2_000_000 + '"'] + [[i] for i in range(3000)]
    (tmp_path / "a.json").write_text(json.dumps(items))
    file, size, plain, read = bigjson._File(f"file://{tmp_path}/a.json"), 1 << 16, bigjson._File.bytes, []
    monkeypatch.setattr(bigjson._File, "bytes", lambda self, low, high: read.append(max(0, min(high, self.size) - max(0, low))) or plain(self, low, high))
    got, inside, depth = [], False, 0
    for low in range(0, file.size, size):
        got += bigjson._records(file, low, low + size, inside, depth, 1, None, low > 0)
        flips, out, into = bigjson._effect(file, low, low + size)
        inside, depth = inside != bool(flips), depth + (into if inside else out)
    assert [json.loads(t) for _, t in got] == items
    assert sum(read) < 5 * file.size


def test_small_ranges_share_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(list(range(20_000))))
    records = json_records(spark, f"file://{tmp_path}/a.json", range_bytes=100)
    assert records.rdd.getNumPartitions() <= 3 * spark.sparkContext.defaultParallelism
    assert sorted(int(r.record) for r in records.collect()) == list(range(20_000))


def test_what_holds_no_array(spark, tmp_path):
    for i, text in enumerate(["", "{}", "[]", " [ ] ", '"[1,2]"', "7"]):
        (tmp_path / f"{i}.json").write_text(text)
    assert found(spark, tmp_path, range_bytes=3) == []


def test_readers_split_large_files(spark, tmp_path):
    sellers = [{"domain": f"d{i % 40}.example", "name": "]\\\""} for i in range(500)] + [{"seller_id": 1}]
    (tmp_path / "s.json").write_text(json.dumps({"identifiers": [{"domain": "not.this"}], "sellers": sellers}))
    assert [r.domain for r in readers.sellers_json(spark, f"file://{tmp_path}/s.json", range_bytes=500).collect()] == sorted(f"d{i}.example" for i in range(40))
    entries = [{"request": {"url": f"https://h{i}.example/x"}, "response": {"status": 200, "headers": [{"name": "Server", "value": "s"}], "content": {"text": "b" * i}}, "serverIPAddress": "1.1.1.1"} for i in range(50)]
    (tmp_path / "a.har").write_text(json.dumps({"log": {"pages": [{"id": 1}], "entries": entries}}))
    got = readers.har_entries(spark, f"file://{tmp_path}/a.har", range_bytes=900).collect()
    assert sorted(r.host for r in got) == sorted(f"h{i}.example" for i in range(50)) and {r.status for r in got} == {200} and len({r.capture for r in got}) == 1


def test_query_reads_every_document_back(spark, tmp_path):
    from tracelink.plans.driver_queries import QUERIES

    texts = spark.range(2000).selectExpr("id AS doc_id", "CASE WHEN id % 50 <> 0 THEN repeat(sha2(string(id), 256), 4) END AS text")
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    # partitions of a few KB, so that tables of different sizes fall into different numbers of them
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1KB")
    try:
        got = QUERIES["split_json_arrays"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert sorted((r.doc_id, r.sha256) for r in got) == sorted((r.doc_id, r.sha256) for r in texts.selectExpr("doc_id", "sha2(text, 256) AS sha256").collect())
