"""Where intermediate tables live: the shared folder named by spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a private one is set only where none is configured and all of Spark runs in one process."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tracelink-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there when the driver ends is deleted."""
    path = f"{shared_dir(spark)}/tracelink/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back.

    Cuts the lineage without keeping anything on one machine; the files go by `discard`, or when the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing will read again."""
    for table in tables:
        if path := vars(table).get("written_to"):
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone by now; the cluster's own cleaning takes over
        pass
