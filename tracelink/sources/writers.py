"""Writers: immutable runs, append-only logs, packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.operators.integrity import export_manifest, manifest_hmac
from tracelink.schema import conform, filled


def bank_observations(rows: DataFrame, path: str) -> None:
    """An immutable run: refuses a path that is there."""
    rows.write.mode("errorifexists").json(path)


def bank_bodies(bodies: DataFrame, path: str) -> DataFrame:
    """Bodies (domain, content) with their hashes, written once; returns (domain, body_sha256)."""
    hashed = bodies.withColumn("body_sha256", F.sha2("content", 256))
    hashed.write.mode("errorifexists").parquet(path)
    return hashed.select("domain", "body_sha256")


def append_acquisitions(rows: DataFrame, path: str) -> None:
    """Append-only; a truncated body has no complete hash."""
    whole = F.when(~F.coalesce("truncated", F.lit(False)), F.col("complete_sha256"))
    conform(rows.sparkSession, rows.withColumn("complete_sha256", whole), "acquisitions").write.mode("append").parquet(path)


def append_audit(spark: SparkSession, path: str, case_id: int, action: str, detail: str, at: str) -> None:
    append_audit_rows(spark.createDataFrame([(case_id, action, detail, at)], AUDIT), path)


AUDIT = "case_id long, action string, detail string, at string"


def append_audit_rows(rows: DataFrame, path: str) -> None:
    """Adds what many cases did; rows that are there stay as they are."""
    rows.select("case_id", "action", "detail", "at").write.mode("append").parquet(path)


def write_prevalence(rows: DataFrame, path: str, schema_name: str = "prevalence/1") -> None:
    """One JSON document: the schema's name, the number of sites and the hits of every account."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("|", "adsystem", "seller_id").alias("k"), F.col("hits").alias("v")))))
    doc = rows.agg(F.lit(schema_name).alias("schema"), F.max("site_count").alias("site_count"), pairs.alias("accounts"))
    doc.select(F.to_json(F.struct("schema", "site_count", "accounts"))).coalesce(1).write.mode("errorifexists").text(path)


def failed_capture_csv(pending: DataFrame, path: str) -> None:
    """Part files in order, each with a header."""
    pending.select("case_id", "scan_run_id", "final_url").orderBy("case_id", "scan_run_id").write.mode("errorifexists").csv(path, header=True)


def write_graph(lines: DataFrame, path: str) -> None:
    """Part files that make the graph when read one after the other."""
    lines.orderBy("case_id", "place", "line").select("line").write.mode("errorifexists").text(path)


def to_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))


def corpus_manifest(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256) of a store's files (path, length, content)."""
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def write_pack(tables: dict[str, DataFrame], bodies: DataFrame, path: str, key: bytes) -> str:
    """A case's pack: a CSV per table, its bodies (arcname, content), the manifest; returns the manifest's HMAC.

    Fails closed: a body without content stops it before anything is written.
    """
    if not bodies.where("content IS NULL").isEmpty():
        raise ValueError("a member has no content")
    for name, df in tables.items():
        df.write.mode("errorifexists").csv(f"{path}/{name}.csv", header=True, escape='"', quoteAll=True)
    bodies.write.mode("errorifexists").parquet(f"{path}/bodies")
    manifest = export_manifest(bodies)
    manifest.write.mode("errorifexists").csv(f"{path}/manifest", header=True)
    return manifest_hmac(manifest, key)


def browse_tree(snapshots: DataFrame) -> DataFrame:
    """(domain, link_name, target): the links of a browse tree by landing domain; a name that repeats is numbered."""
    from pyspark.sql import Window

    rows = snapshots.where(filled("final_domain") & filled("screenshot_path"))
    rows = rows.select(F.lower("final_domain").alias("domain"), F.coalesce("capture_method", F.lit("capture")).alias("method"), F.coalesce("captured_at", F.lit("unknown")).alias("at"), F.regexp_extract("screenshot_path", "^(.*)/[^/]*$", 1).alias("target")).distinct()
    name = F.regexp_replace(F.concat_ws("_", F.col("at"), F.col("method")), r"[^0-9A-Za-z._-]+", "-")
    number = F.row_number().over(Window.partitionBy("domain", "base").orderBy("target"))
    named = rows.withColumn("base", name).withColumn("n", number)
    return named.select("domain", F.when(F.col("n") > 1, F.concat_ws("-", "base", F.col("n").cast("string"))).otherwise(F.col("base")).alias("link_name"), "target").orderBy("domain", "link_name")


def capture_captions(snapshots: DataFrame, scans: DataFrame) -> DataFrame:
    """(dir, caption): the JSON sidecar of each capture directory, once."""
    rows = snapshots.withColumn("dir", F.regexp_extract(F.coalesce("screenshot_path", "html_path", "har_path"), "^(.*)/[^/]*$", 1)).where(filled("dir"))
    joined = rows.join(scans.select(F.col("id").alias("scan_run_id"), F.col("final_url").alias("scan_url"), "run_at"), "scan_run_id", "left")
    caption = F.to_json(F.struct("scan_run_id", "scan_url", "run_at", "final_url", "final_domain", "captured_at", "capture_status", "capture_method"))
    return joined.groupBy("dir").agg(F.max_by(caption, F.col("id")).alias("caption")).orderBy("dir")
