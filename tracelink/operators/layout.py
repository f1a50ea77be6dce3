"""Pins stored once per load: which scan and captures an artifact reads, bucketed and sorted by scan.

Every aggregate over pinned scans joins artifacts, pins, scans and captures. Here the artifacts are written with the columns of their pinned scan, one table per
pin, and the captures with a mark on the newest of each scan, both in the same number of buckets of the scan's id. Joins of them need no shuffle and no sort.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelink.operators.pins import PINS, latest_snapshot
from tracelink.schema import CaseTables
from tracelink.storage import scratch

#: Rows of a bucket, about.
BUCKET_ROWS = 1_000_000


@dataclass
class StoredCases(CaseTables):
    """Case tables whose pins and captures are stored; operators read them like others. `names` are the tables in the session's catalog."""

    pin_tables: dict[str, DataFrame] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)

    def drop(self) -> None:
        """Takes the tables out of the catalog; their files go when the driver ends."""
        spark = self.snapshots.sparkSession
        for name in self.names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def _stored(df: DataFrame, kind: str, buckets: int, names: list[str]) -> DataFrame:
    spark, name = df.sparkSession, f"tracelink_{kind}_{uuid.uuid4().hex}"
    # one file per bucket: the rows are dealt as the buckets are
    dealt = df.repartition(buckets, "scan_run_id")
    dealt.write.format("parquet").bucketBy(buckets, "scan_run_id").sortBy("scan_run_id").option("path", scratch(spark, kind)).saveAsTable(name)
    names.append(name)
    return spark.table(name)


def store_pins(t: CaseTables, pins: tuple[str, ...] = ("own_done", "url_done", "url_any"), buckets: int | None = None) -> StoredCases:
    """The tables of `t` with stored pins and captures.

    Artifacts without a pinned scan stay apart, where only left joins read them; so buckets hold no pile of nulls. A capture without a scan is in no join and is left out.
    """
    names: list[str] = []
    if buckets is None:
        buckets = max(1, -(-max(t.url_artifacts.count(), t.snapshots.count()) // BUCKET_ROWS))
    urls = t.url_artifacts.select(F.col("id").alias("ua_id"), F.col("message_id").alias("post_id"), "case_id", "original_url")
    posts = t.message_evidence.select(F.col("id").alias("post_id"), F.lit(True).alias("has_post")).distinct()
    urls = urls.join(posts, "post_id", "left").withColumn("has_post", F.coalesce("has_post", F.lit(False)))
    scans = t.scan_runs.withColumnRenamed("id", "scan_run_id").drop("url_artifact_id")
    tables = {}
    for pin in pins:
        chosen = PINS[pin](t).withColumnRenamed("url_artifact_id", "ua_id")
        tables[pin] = _stored(urls.join(chosen, "ua_id").join(scans, "scan_run_id"), pin, buckets, names)
        tables[f"{pin}_none"] = urls.join(chosen, "ua_id", "left_anti")
    newest = latest_snapshot(t).select("id", F.lit(True).alias("newest"))
    captures = t.snapshots.where("scan_run_id IS NOT NULL").join(newest, "id", "left").withColumn("newest", F.coalesce("newest", F.lit(False)))
    rest = {f.name: getattr(t, f.name) for f in fields(CaseTables) if f.name != "snapshots"}
    return StoredCases(**rest, snapshots=_stored(captures, "captures", buckets, names), pin_tables=tables, names=names)
