"""Batches that stall: session windows and keyed state over progress records as they come.

A batch reports each unit it has finished. It has stalled where nothing more is reported for longer than its cap: the unit that held it up is the one after those
finished by then. A silence counts once the watermark is past its end, so that the order in which records arrive within the delay changes nothing; records
later than that are left out by Spark. A record after a silence ends it, and the next one is a stall of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STALL = "batch STRING, position BIGINT, ok BIGINT, failed BIGINT, last_at TIMESTAMP, stalled_at TIMESTAMP"


def stall_cap(timeout: float, shot: float, headed_only: bool = False) -> int:
    """Seconds that one unit may take without a report: the worst path through a capture, with half of it and a minute more. shot: seconds that a screenshot may take."""
    shots = shot * 4 / 3
    worst = timeout + 25 + 8 + shots + 7 if headed_only else 2 * (timeout + 6 + 8 + shots) + 55 + 5
    return int(worst * 1.5) + 60


def _running_counts():
    """A processor whose state is a batch's counts up to its last silence; a silence comes with the counts since the one before."""
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    class RunningCounts(StatefulProcessor):
        def init(self, handle) -> None:
            self.total = handle.getValueState("total", "ok BIGINT, failed BIGINT")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            ok, failed = self.total.get() or (0, 0)
            for _, last, more_ok, more_failed in sorted(tuple(r) for r in rows):
                ok, failed = ok + more_ok, failed + more_failed
                yield Row(batch=key[0], ok=ok, failed=failed, last_us=last)
            self.total.update((ok, failed))

        def close(self) -> None:
            pass

    return RunningCounts()


def stalls(progress: DataFrame, cap_seconds: int, delay: str = "1 minute") -> DataFrame:
    """STALL rows of a stream of progress (batch, at, ok): each silence of a batch that lasts longer than the cap, with the number of units reported before it.

    A null batch or time reports nothing; a null ok is a failure. State of a batch is a few numbers and the reports that the watermark hasn't passed. Python is called
    once for a batch with silences told in a micro-batch, not for its reports.
    """
    timed = progress.where("batch IS NOT NULL AND at IS NOT NULL").select(F.col("batch").cast("string").alias("batch"), F.col("at").cast("timestamp").alias("at"), F.coalesce(F.col("ok").cast("boolean"), F.lit(False)).alias("good"))
    # reports wait here for the watermark, and those behind it are left out: a session alone would take them as long as it could be open
    passed = timed.withWatermark("at", delay).groupBy("batch", "at").agg(F.count_if("good").alias("ok"), F.count_if(~F.col("good")).alias("failed"))
    sessions = passed.groupBy("batch", F.session_window("at", f"{cap_seconds} seconds")).agg(F.unix_micros(F.max("at")).alias("last_us"), F.sum("ok").alias("ok"), F.sum("failed").alias("failed"))
    # an exchange that batch alone doesn't ask for: Spark 4.1 fails where keyed state follows that of sessions in one stage
    told = sessions.select("batch", "last_us", "ok", "failed").repartition("batch", "last_us")
    counted = told.groupBy("batch").transformWithState(_running_counts(), outputStructType="batch STRING, ok BIGINT, failed BIGINT, last_us BIGINT", outputMode="Append", timeMode="None")
    return counted.select("batch", (F.col("ok") + F.col("failed")).alias("position"), "ok", "failed", F.timestamp_micros("last_us").alias("last_at"), F.timestamp_micros(F.col("last_us") + cap_seconds * 1_000_000).alias("stalled_at"))


def write_stalls(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Stalls to Parquet, with what there is to read now; a batch that runs again overwrites its own folder."""
    spark, name = found.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    try:
        return found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def in_name_order(spark: SparkSession, path: str) -> None:
    """Gives the data files of a folder times in the order of their names, which is the order that a stream of files reads them in; for replays of what was written by range."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = sorted((s.getPath() for s in files.listStatus(target) if not s.getPath().getName().startswith(("_", "."))), key=lambda f: f.getName())
    for number, file in enumerate(listed):
        files.setTimes(file, 1_600_000_000_000 + number * 1000, -1)


def read_stalls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STALL + ", epoch INT").parquet(path).drop("epoch")
