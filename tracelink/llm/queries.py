"""Registered queries of the training-text operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelink.llm import align, chat, decontaminate, divergence, langid, licenses, mixing, ngram_join, pii, shards, tokens, vectors, warc
from tracelink.storage import scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so that every call does the whole work."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, tokens.fresh_cache(spark)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shard")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_read(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"{chat.END}{chat.START}assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.format_chats(turns))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_read(spark, sf_dir, "documents"), k=3, tenths=9)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.token_shards(_read(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_read(spark, sf_dir, "embeddings"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(_read(spark, sf_dir, "pages"), path)
    return warc.page_table(warc.read_archives(spark, f"{path}/archives"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_tokens(_read(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op2_token_counts": op2_token_counts,
    "op1_pii": op1_pii,
    "op6_license_scan": op6_license_scan,
    "op8_chat_format": op8_chat_format,
    "op5_language_id": op5_language_id,
    "op9_ngram_join": op9_ngram_join,
    "op7_decontaminate": op7_decontaminate,
    "op3_token_shards": op3_token_shards,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op4_mix_sources": op4_mix_sources,
    "op11_warc": op11_warc,
    "op12_token_alignment": op12_token_alignment,
    "op13_source_divergence": op13_source_divergence,
}
ORACLES: dict[str, str] = {
    "op11_warc": """
        WITH sized AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest, coalesce(html, '') AS payload FROM pages
        ), kept AS (
            SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS kept FROM sized
        )
        SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN kept <> page_id THEN kept END AS refers_to, CAST(NULL AS VARCHAR) AS problem
        FROM kept
    """,
    "op13_source_divergence": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
        ), words AS (
            SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
        ), kept AS (
            SELECT lang, term, count(*) AS n FROM words GROUP BY 1, 2 HAVING count(DISTINCT d) >= 10
        ), langs AS (
            SELECT l.lang, coalesce(sum(n), 0) + 2 * count(term) AS total, count(term) AS v FROM (SELECT DISTINCT lang FROM docs) l LEFT JOIN kept USING (lang) GROUP BY 1
        ), counts AS (
            SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY 1, 2, 3
        ), sources AS (
            SELECT g.lang, g.source, coalesce(sum(c), 0) + 2 * any_value(v) AS total FROM (SELECT DISTINCT lang, source FROM docs) g JOIN langs USING (lang) LEFT JOIN counts USING (lang, source) GROUP BY 1, 2
        ), p AS (
            SELECT s.lang, s.source, k.term, coalesce(c, 0) AS c, CAST(1 + (1000000000 * (coalesce(c, 0) + 2)::HUGEINT) // s.total AS BIGINT) AS p
            FROM sources s JOIN kept k USING (lang) LEFT JOIN counts USING (lang, source, term)
        ), f AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 4
        ), pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
            FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
        ), q AS (
            SELECT lang, term, CAST(1 + (1000000000 * (n + 2)::HUGEINT) // total AS BIGINT) AS q FROM kept JOIN langs USING (lang)
        ), terms AS (
            SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
        )
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
    "op9_ngram_join": r"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) < 3 THEN [x for x in [array_to_string(w, ' ')] if x <> '']
                ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS g
            FROM worded
        ), each AS (
            SELECT doc_id, unnest(g) AS x FROM sets
        ), pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT a, b FROM pairs JOIN sets sa ON sa.doc_id = a JOIN sets sb ON sb.doc_id = b WHERE 100 * n >= 90 * (len(sa.g) + len(sb.g) - n)
        ), reach(a, b) AS (
            SELECT doc_id, doc_id FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        )
        SELECT doc_id, len(g) AS n_shingles, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id FROM sets
    """,
    "op10_embedding_near_dedup": """
        WITH RECURSIVE wide AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM wide a JOIN wide b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.9
        ), reach(a, b) AS (
            SELECT vec_id, vec_id FROM wide UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        ), found AS (
            SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, (SELECT min(b) FROM reach WHERE a = vec_id) AS component_id FROM wide
        )
        SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM found
    """,
}
