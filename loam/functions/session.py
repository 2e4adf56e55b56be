"""Session settings the engine relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; in local mode a temporary folder of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loam-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def tidy_shuffles(spark: SparkSession) -> None:
    """From now on a finished query's shuffle files go at once; without it they stay until the driver collects garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet below the checkpoint folder and read back; ``discard`` removes it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/loam-table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._loam_path = path
    return back


def discard(*frames: DataFrame) -> None:
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._loam_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
