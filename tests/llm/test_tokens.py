from tests.llm.conftest import AWKWARD
from tracelink.llm.tokens import CACHE, compact_cache, encoder, fresh_cache, token_counts, tokenizer_path


def library_count(text):
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids)


def test_counts_match_the_library(spark, awkward):
    got = token_counts(awkward, fresh_cache(spark)).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    want = [(d, len((t or "").encode()), n := library_count(t), n > 512) for d, t, *_ in AWKWARD]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_ids_match_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert encoder("byte_bpe_50k.json").encode(r.text) == library.encode(r.text, add_special_tokens=False).ids


def test_only_misses_are_encoded(spark, awkward):
    path = fresh_cache(spark)
    first = sorted(map(str, token_counts(awkward, path).collect()))
    stored = spark.read.schema(CACHE).parquet(path)
    n = stored.count()
    assert n == len({t or "" for _, t, *_ in AWKWARD}) == stored.select("digest").distinct().count()
    again = sorted(map(str, token_counts(awkward, path).collect()))
    assert again == first and spark.read.schema(CACHE).parquet(path).count() == n


def test_empty_table(spark, nothing):
    assert token_counts(nothing, fresh_cache(spark)).count() == 0


def test_a_digest_stored_twice_counts_once_and_columns_stay(spark):
    path = fresh_cache(spark)
    docs = spark.createDataFrame([(1, "one two", "d", "s"), (2, "three", "d", "s")], "doc_id long, text string, _digest string, digest string")
    first = token_counts(docs, path)
    rows = sorted(map(tuple, first.collect()))
    spark.read.schema(CACHE).parquet(path).write.mode("append").parquet(path)
    again = token_counts(docs, path)
    assert sorted(map(tuple, again.collect())) == rows and again.columns == ["doc_id", "_digest", "digest", "n_bytes", "n_tokens", "over_limit"]
    compact_cache(spark, path, path + "-compact")
    assert spark.read.schema(CACHE).parquet(path + "-compact").count() == 2
    assert sorted(map(tuple, token_counts(docs, path + "-compact").collect())) == rows
