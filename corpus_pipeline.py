"""Corpus pipeline: language ID, near-duplicate join, decontamination, mixing, token shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of `documents`, and read these only: other columns, whatever their names, are left out.
Rows may hold nulls anywhere, repeat ids and texts, and be none at all; what each stage makes of that is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.llm import decontaminate, langid, mixing, ngram_join, shards
from tracelink.storage import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows that aren't held out, and drops what the models reject.

    A null or empty text, one without a letter, and one far from all languages go; where no row has both lang and text all
    go. A null id counts as not held out. Rows that repeat an id or a text are judged each, by the text alone.
    """
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, model, COLUMNS).where(~F.col("rejected")).select(*COLUMNS)


#: So many ids at most go to all tasks (some 64 MB); more are joined with the documents.
BROADCAST_IDS = 2_000_000


def _by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """left_semi or left_anti join on doc_id; texts aren't shuffled for a list of ids whose size is known to be small."""
    ids = materialise(ids, "stage-ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8: of each component the document with the smallest id stays, once.

    Rows with a null id stay, whatever their text. Rows that share an id are one document: one of them stays, of the rows
    alike or unlike in text any. Texts without words are like nothing and stay.
    """
    found = materialise(ngram_join.ngram_components(docs.select("doc_id", "text"), k=5, tenths=8), "stage-components")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    repeated = materialise(docs.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1").select("doc_id"), "stage-repeated")
    kept = _by_id(docs, gone.union(repeated).distinct(), "left_anti")
    once = _by_id(docs, repeated.join(gone, "doc_id", "left_anti"), "left_semi").dropDuplicates(["doc_id"])
    return kept.select(*COLUMNS).unionByName(once.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which an item of `benchmark` is found go. Null and empty texts stay; rows that repeat an id or have none are judged each by their text."""
    return decontaminate.drop_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix takes it, to the nearest whole: not at all, once or twice.

    Texts without words are never taken. A null source is one more source; null ids are taken like others. Rows alike in id and source are one for the join, so their takes are summed and shared evenly.
    """
    taken = mixing.mix_sources(docs).where("size > 0").groupBy("doc_id", "source").agg((F.sum("taken") / F.sum("size")).alias("times"))
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.round("times").cast("int").alias("_times")).where("_times > 0")
    rows = docs.join(taken, docs.doc_id.eqNullSafe(F.col("_id")) & docs.source.eqNullSafe(F.col("_source")))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).select(*[docs[c] for c in COLUMNS])


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of all rows' tokens in training order. Null and empty texts have no sequence; each of several rows with one id, or none, has its own."""
    return shards.token_shards(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix),
    ("token-ID output", token_shards),
]
#: Tokenisation and language models are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
