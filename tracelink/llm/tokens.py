"""Token counts through a digest cache.

Normalised content (null counts as the empty text; the tokenizer has no normaliser of its own, so nothing
else may change) and the tokenizer file are digested; documents join the stored counts on both digests,
only distinct contents without a stored count are encoded, and their counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cached_property, lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelink.llm.hashing import bounded_batches, slices
from tracelink.storage import materialise, shared_dir

CACHE = T.StructType([
    T.StructField("tokenizer", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType()),
])


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; executors hold the same installation as the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(name: str) -> str:
    return hashlib.sha256(Path(tokenizer_path(name)).read_bytes()).hexdigest()


def _byte_of() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Token ids of a text as the tokenizers library gives them for a byte-level BPE file.

    The library itself is slow on words it has not met, so a byte-level file whose ids follow its merges is
    run by tiktoken over the same vocabulary; texts that this refuses go to the library.
    """

    def __init__(self, name: str):
        import tiktoken
        from public_tokenizers import PATTERN

        path = tokenizer_path(name)
        data = json.loads(Path(path).read_text())
        special = {x["content"]: x["id"] for x in data["added_tokens"]}
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in word): i for word, i in data["model"]["vocab"].items() if word not in special}
        self.path, self.special = path, special
        self.fast = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> list[int]:
        try:
            if any(x in text for x in self.special):
                return self.fast.encode(text, allowed_special="all")
            return self.fast.encode_ordinary(text)
        except BaseException as error:  # a panic of the native code is no Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit)):
                raise
            return self._library.encode(text, add_special_tokens=False).ids

    @cached_property
    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)


@lru_cache(maxsize=1)
def encoder(name: str) -> Encoder:
    """One per worker process."""
    return Encoder(name)


def _encode_counts(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name).encode
        for batch in (p for batch in batches for p in slices(batch, "content")):
            counts = [len(encode(x.as_py())) for x in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, cache_path: str, name: str = "byte_bpe_50k.json", text: str = "text", limit: int = 512) -> DataFrame:
    """Every row of `docs` without its text, with n_bytes, n_tokens and over_limit (n_tokens > limit).

    Null text counts as empty: 0 bytes, 0 tokens. Repeated contents are encoded once and never again while
    `cache_path` is kept; another tokenizer file has another digest and so its own counts. Rows, ids and other
    columns pass unchanged whatever they hold, except that columns named n_bytes, n_tokens or over_limit are replaced.
    A content that the cache holds more than once, as after runs side by side, counts once.
    A hot content costs one row per map task: the distinct step combines before it shuffles.
    """
    spark = bounded_batches(docs.sparkSession)
    version, key, count = tokenizer_digest(name), free_name(docs, "digest"), free_name(docs, "stored")
    content = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumn(key, F.unhex(F.sha2(content, 256)))
    cache = spark.read.schema(CACHE).parquet(cache_path) if _exists(spark, cache_path) else spark.createDataFrame([], CACHE)
    known = cache.where(F.col("tokenizer") == version).select("digest", "n_tokens")
    distinct = keyed.select(F.col(key).alias("digest"), content.alias("content")).dropDuplicates(["digest"])
    misses = distinct.join(known.select("digest"), "digest", "left_anti")
    fresh = misses.mapInArrow(_encode_counts(name), "digest binary, n_tokens long")
    fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    stored = spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer") == version)
    # runs side by side may both have appended a digest
    stored = stored.groupBy(F.col("digest").alias(key)).agg(F.min("n_tokens").alias(count))
    sized = keyed.withColumn("n_bytes", F.octet_length(content).cast("long")).drop("n_tokens", "over_limit", text)
    counted = sized.join(stored, key, "left").drop(key).withColumnRenamed(count, "n_tokens")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def compact_cache(spark: SparkSession, cache_path: str, into: str) -> None:
    """Each stored count once, in few files, at a new path."""
    rows = spark.read.schema(CACHE).parquet(cache_path)
    rows.groupBy("tokenizer", "digest").agg(F.min("n_tokens").alias("n_tokens")).write.parquet(into)


def _exists(spark, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def fresh_cache(spark) -> str:
    """A cache of its own in the shared folder."""
    import uuid

    return f"{shared_dir(spark)}/tracelink/token-cache-{uuid.uuid4().hex}"


__all__ = ["Encoder", "encoder", "fresh_cache", "materialise", "token_counts", "tokenizer_digest", "tokenizer_path"]
