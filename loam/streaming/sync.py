"""Incremental sync of files as a stream: each micro-batch is merged into a state table by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators.tables import sync_classes


def merge_batch(state_dir: str):
    """A foreachBatch function that keeps (name, md5, batch) under ``state_dir``, one folder for each batch.

    The state is the newest row of each name. A repeated batch overwrites its own folder, so a restart
    changes nothing.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = "name string, md5 string, batch long"
        paths = f"{state_dir}/*"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(state_dir)
        there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
        state = spark.read.schema(schema).parquet(paths).where(F.col("batch") < batch_id) if there else spark.createDataFrame([], schema)
        newest = state.groupBy("name").agg(F.max_by("md5", "batch").alias("md5"))
        once = batch.groupBy("name").agg(F.max("content").alias("content"))
        changed = sync_classes(once, newest).where("class <> 'unchanged'").select("name", "md5", F.lit(batch_id).cast("long").alias("batch"))
        changed.write.mode("overwrite").parquet(f"{state_dir}/batch={batch_id}-rows")

    return merge


def sync_stream(spark: SparkSession, source: str, state_dir: str, checkpoint: str):
    """Start the sync of JSON lines (name, content) below ``source``, as far as there are files now."""
    rows = spark.readStream.schema("name string, content string").json(source)
    return rows.writeStream.foreachBatch(merge_batch(state_dir)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
