import pytest

import corpus_pipeline as p
from tests.llm.conftest import AWKWARD
from tests.llm.test_ngram_join import brute as components
from tracelink.llm.decontaminate import find_leaks
from tracelink.llm.tokens import encoder

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def staged(spark):
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in p.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        found.append((before, docs))
    return found


def test_columns(staged):
    assert [len(p.STAGES), p.ORACLE_SQL] == [5, None]
    assert all(after.columns == p.COLUMNS for _, after in staged[:-1])


def test_language_stage_keeps_clean_documents(staged):
    before, after = staged[0]
    gone = before.join(after, "doc_id", "left_anti").collect()
    assert len(gone) <= 0.02 * before.count()


def test_one_document_of_each_group_stays(staged):
    before, after = staged[1]
    groups = components([(r.doc_id, r.text) for r in before.collect()], 5, 8)
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, _, c in groups})


def test_no_leak_stays(spark, staged):
    before, after = staged[2]
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaks = {r.doc_id for r in find_leaks(before, items).collect()}
    assert leaks and {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - leaks


def test_mix_repeats_whole_documents(staged):
    before, after = staged[3]
    count = {}
    for r in after.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert max(count.values()) == 2 and set(count) <= {r.doc_id for r in before.collect()}


def test_shards_hold_all_tokens(staged):
    before, after = staged[4]
    coder = encoder("byte_bpe_50k.json")
    assert sum(n for r in after.collect() for n in r.lengths) == sum(len(coder.encode(r.text)) + 1 for r in before.collect() if r.text)


def test_awkward_rows(spark, nothing):
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, nothing):
        now = start
        for _, stage in p.STAGES:
            now = stage(spark, now, SF)
            now.count()
    clashing = docs.selectExpr("*", "1 AS size", "'x' AS n_tokens")
    for _, stage in p.STAGES:
        stage(spark, clashing, SF).count()
