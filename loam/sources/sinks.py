"""Sinks: datasets, texts, state and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Raw UTF-8 JSON lines; null fields are left out."""
    rows.write.mode("overwrite").json(path)


def write_stages(raw_and_clean: DataFrame, path: str) -> None:
    """Raw and clean texts of documents side by side."""
    raw_and_clean.write.mode("overwrite").parquet(path)


def write_index(chunks: DataFrame, path: str) -> None:
    """The index: one wide table of chunks, vectors and metadata, so that no positional join is needed."""
    chunks.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str, build) -> DataFrame:
    """The index at ``path``; where there is none, ``build()`` is written there first."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        write_index(build(), path)
    return spark.read.parquet(path)


def replace_table(rows: DataFrame, path: str) -> None:
    """Overwrite a table that rows may be read from: written beside it, then swapped in."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(path + ".next")
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path + ".next", path))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    fs.rename(new, old)


def write_notes(docs: DataFrame, path: str) -> None:
    """Documents (title, tags, body) as Markdown texts with front matter, one row a document."""
    head = F.concat(F.lit("---\ntitle: "), "title", F.lit("\ntags: ["), F.array_join("tags", ", "), F.lit("]\n---\n"), "body")
    docs.select(head.alias("value")).write.mode("overwrite").option("lineSep", "\u0000").text(path)


def report(spark: SparkSession, steps: list[tuple[str, str, str]]) -> DataFrame:
    """A run's steps: (step, status, message)."""
    return spark.createDataFrame(steps, "step string, status string, message string")
