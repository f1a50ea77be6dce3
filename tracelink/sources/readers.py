"""Readers. Every one states its schema; malformed input gives fewer rows, never an error."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracelink.functions.fingerprints import tracking_ids
from tracelink.functions.parsing import ads_txt_body, list_apex, list_domain
from tracelink.functions.suffixes import SuffixRules, apexes
from tracelink.functions.urls import ascii_host, extract_urls, hostname
from tracelink.schema import OBSERVATION, PREVALENCE, filled
from tracelink.sources.bigjson import RANGE_BYTES, array_files, json_records

POST_COLUMNS = ["platform", "permalink", "actor_label", "posted_at", "message_text"]


def posts_csv(spark: SparkSession, path: str) -> DataFrame:
    """Posts of a CSV with a header, with or without a byte order mark; columns that aren't there are null."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    named = raw.toDF(*[c.replace("﻿", "").strip() for c in raw.columns])
    return named.select(*[(F.col(c) if c in named.columns else F.lit(None).cast("string")).alias(c) for c in POST_COLUMNS]).where(filled("message_text"))


def post_urls(posts: DataFrame, rules: SuffixRules | None = None) -> DataFrame:
    """(message_id, case_id, original_url, url_order, domain) of posts (id, case_id, message_text): each URL of a post once."""
    each = posts.select(F.col("id").alias("message_id"), "case_id", F.posexplode(extract_urls("message_text")).alias("url_order", "original_url"))
    each = apexes(each.withColumn("_host", ascii_host(hostname("original_url"))), rules, domain="_host").drop("_host")
    return each.dropDuplicates(["message_id", "original_url"])


def suffix_list(spark: SparkSession, path: str) -> DataFrame:
    """(rule, private) of a public-suffix list: a rule per line, comments after //, the private section between its two marker lines. Without markers no rule is private."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("lines"))
    marks = [F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit(f"==={edge} PRIVATE DOMAINS==="))), True) for edge in ("BEGIN", "END")]
    each = lines.select(*[m.alias(name) for m, name in zip(marks, ("begin", "end"), strict=True)], F.posexplode("lines").alias("pos", "line"))
    rule = F.regexp_extract("line", r"^\s*(\S*)", 1)
    private = (F.col("begin") > 0) & (F.col("pos") >= F.col("begin")) & ((F.col("end") == 0) | (F.col("pos") < F.col("end")))
    return each.where((rule != "") & ~rule.startswith("//")).select(rule.alias("rule"), private.alias("private"))


def html_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, html, tracking_ids) of files; bytes that are no UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("html")).withColumn("tracking_ids", tracking_ids("html"))


HAR = "request STRUCT<url: STRING>, response STRUCT<status: INT, headers: ARRAY<STRUCT<name: STRING, value: STRING>>, content: STRUCT<text: STRING>>, serverIPAddress STRING"


def har_entries(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(capture, url, host, status, server_ip, response_headers_json, body) of each entry of HAR files; unreadable ones give none. A large file is read by several tasks."""
    raw = json_records(spark, path, "entries", 3, range_bytes).select(F.col("path").alias("capture"), F.from_json("record", HAR).alias("e")).where("e.request.url IS NOT NULL")
    headers = F.to_json(F.transform(F.coalesce("e.response.headers", F.array().cast("array<struct<name:string,value:string>>")), lambda h: F.array(h["name"], h["value"])))
    return raw.select(
        "capture", F.col("e.request.url").alias("url"), hostname("e.request.url").alias("host"), F.col("e.response.status").alias("status"), F.col("e.serverIPAddress").alias("server_ip"),
        headers.alias("response_headers_json"), F.col("e.response.content.text").alias("body"),
    )


def ads_txt_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw_sha256, owner_domain, manager_domain, records) of ads.txt bodies."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("raw_sha256"), ads_txt_body(F.make_valid_utf8(F.col("content").cast("string"))).alias("a"))
    return files.select("path", "raw_sha256", "a.*")


def sellers_json(spark: SparkSession, path: str, rules: SuffixRules | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Sorted distinct apexes of publishers in sellers.json files; confidential sellers name none. A large file is read by several tasks."""
    raw = json_records(spark, path, "sellers", 2, range_bytes).select(F.from_json("record", "domain STRING").alias("s"))
    host = F.lower(F.trim("s.domain"))
    bare = F.when(host.contains("://"), hostname(host)).otherwise(F.regexp_extract(host, "^([^/:]*)", 1))
    hosts = raw.select(ascii_host(bare).alias("host"))
    return apexes(hosts, rules, domain="host").where("domain LIKE '%.%'").select("domain").distinct().orderBy("domain")


def domain_list(spark: SparkSession, path: str, apex: bool = True) -> DataFrame:
    """Sorted distinct domains of a plain, CSV, hosts or ad-block list."""
    lines = spark.read.text(path)
    return lines.select((list_apex if apex else list_domain)("value").alias("domain")).where("domain IS NOT NULL").distinct().orderBy("domain")


def observations(spark: SparkSession, path: str) -> DataFrame:
    """Observations of JSON lines, or of one JSON array: each file's first character tells. A line that is no record gives no row."""
    arrays = [r.file for r in array_files(spark, path).collect()]
    # an array in one line would be read to its end by the task of each of its blocks
    lines = spark.read.text(path).where(~F.col("_metadata.file_path").isin(arrays)) if arrays else spark.read.text(path)
    plain = lines.select(F.from_json(F.ltrim("value"), OBSERVATION).alias("o"))
    rows = plain.where("o IS NOT NULL AND o.domain IS NOT NULL").select("o.*")
    for at in range(0, len(arrays), 1000):
        each = json_records(spark, arrays[at : at + 1000]).select(F.from_json("record", OBSERVATION).alias("o"))
        rows = rows.unionByName(each.where("o IS NOT NULL AND o.domain IS NOT NULL").select("o.*"))
    return rows


def prevalence(spark: SparkSession, path: str, schema_name: str = "prevalence/1") -> DataFrame:
    """(adsystem, seller_id, hits, site_count) of a JSON table; no rows where anything in it is wrong: another schema, a count that is no
    whole number, negative or over the number of sites."""
    raw = spark.read.text(path, wholetext=True)
    doc = raw.select(F.from_json("value", "schema STRING, site_count STRING, accounts MAP<STRING, STRING>").alias("d")).select("d.*")
    whole = lambda c: F.coalesce(c.rlike("^[0-9]+$"), F.lit(False))
    counts_ok = F.forall(F.map_values("accounts"), lambda v: whole(v) & F.coalesce(v.try_cast("bigint") <= F.col("site_count").try_cast("bigint"), F.lit(False)))
    good = doc.where(F.coalesce((F.col("schema") == schema_name) & whole(F.col("site_count")) & counts_ok, F.lit(False)))
    each = good.select("site_count", F.explode("accounts").alias("k", "hits"))
    parts = F.split("k", r"\|", 2)
    rows = each.select(parts[0].alias("adsystem"), parts[1].alias("seller_id"), F.col("hits").cast("bigint").alias("hits"), F.col("site_count").cast("bigint").alias("site_count"))
    return rows.select(*[c.split()[0] for c in PREVALENCE.split(", ")])


def store_files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(path, length, modified, content or null) of every file below `path`, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = path.rstrip("/").split("://")[-1]
    relative = F.regexp_replace("path", r"^(?:file:|[a-z]+://)?.*?" + base.replace(".", r"\."), "")
    body = F.col("content") if content else F.lit(None).cast("binary")
    return files.select(F.ltrim(relative, F.lit("/")).alias("path"), "length", F.col("modificationTime").alias("modified"), body.alias("content"))


def body_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(body_path, body_sha256) of retained bodies."""
    return store_files(spark, path, content=True).select(F.col("path").alias("body_path"), F.sha2("content", 256).alias("body_sha256"))


def evidence_pack(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of an unpacked evidence pack: a CSV file, or folder of part files, per table, and its bodies with fresh hashes."""
    names = ["message_evidence", "url_artifacts", "scan_runs", "redirect_hops", "snapshots", "acquisitions"]
    parts = store_files(spark, path).select(F.regexp_extract("path", r"^([^/]+\.csv)(?:/|$)", 1).alias("name"))
    found = {r.name for r in parts.where(F.col("name").isin([f"{n}.csv" for n in names])).distinct().collect()}
    tables = {n: spark.read.csv(f"{path}/{n}.csv", header=True, multiLine=True, escape='"') for n in names if f"{n}.csv" in found}
    return tables | {"files": store_files(spark, path, content=True).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))}


class _RowRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.options = schema, options

    def _connect(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        """Ranges of row ids, so that a large table is read by several tasks."""
        with self._connect() as db:
            low, high = db.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{self.options["table"]}"').fetchone()
        step = max(1, int(self.options.get("rows", 100_000)))
        return [_RowRange(a, min(a + step - 1, high)) for a in range(low, high + 1, step)] or [_RowRange(0, -1)]

    def read(self, partition: _RowRange) -> Iterator[tuple]:
        columns = ", ".join(f'"{c.name}"' for c in self.schema)
        with self._connect() as db:
            yield from db.execute(f'SELECT {columns} FROM "{self.options["table"]}" WHERE rowid BETWEEN ? AND ?', (partition.low, partition.high))


class SqliteSource(DataSource):
    """Tables of a case database on a file system that all executors see: spark.read.format("sqlite_table").schema(...).option("table", ...)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self):
        raise ValueError("state the schema")

    def reader(self, schema) -> DataSourceReader:
        if not self.options["table"].replace("_", "").isalnum():
            raise ValueError("table must be a plain name")
        return _SqliteReader(schema, self.options)


def sqlite_table(spark: SparkSession, path: str, table: str, ddl: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").schema(ddl).option("table", table).option("path", path).load()
