"""Continuous screening of banked observations: an extension, batch semantics are in operators.discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelink.operators.discovery import screen_ads_txt
from tracelink.schema import OBSERVATION


def stream_observations(spark: SparkSession, bank_dir: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(OBSERVATION).option("maxFilesPerTrigger", files_per_trigger).json(bank_dir)


def screen_stream(observations: DataFrame, templates: DataFrame, delay: str = "1 day") -> DataFrame:
    """Verdicts of observations as they come, one per domain and file within the delay: a stream-static join with known templates."""
    timed = observations.withColumn("at", F.coalesce(F.try_to_timestamp(F.regexp_replace("fetched_at", r"\s*UTC$", "")), F.current_timestamp()))
    once = timed.withWatermark("at", delay).dropDuplicatesWithinWatermark(["domain", "raw_sha256"])
    return screen_ads_txt(once, templates)


def append_hits(screened: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Template matches to Parquet; a batch that is run again after a failure overwrites its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.where("verdict = 'template_match'").write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return screened.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
