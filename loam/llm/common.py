"""Shared plumbing of the training-data operators: stage tables, words, global ranks, prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.session import tidy_shuffles

#: A word is a maximal run of characters other than the space and the controls \\x09-\\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; set here only where a local session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loam-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows of a batch that goes to a Python worker. Texts are long: Spark's default of 10,000 rows holds tens of
#: megabytes several times over, in the executor and in each worker.
BATCH_ROWS = "2000"


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to ``BATCH_ROWS``, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= int(BATCH_ROWS):
        spark.conf.set(name, BATCH_ROWS)


_kept: dict = {}


def in_worker(kind, make: Callable[[], object] = lambda: None):
    """What this Python worker keeps for its next tasks of a kind. A worker outlives its stage, so only the last kind's is kept."""
    if kind not in _kept:
        _kept.clear()
        _kept[kind] = make()
    return _kept[kind]


#: Stage tables in a local folder are written without checksum files: without Hadoop's native library every file of
#: either kind costs an executor processes of its own (chmod), and the tables are read once or twice. Other stores don't see this.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


class Workspace:
    """Stage tables of one operator run, written as Parquet below the shared folder.

    A written table cuts the lineage: a lost executor costs a re-read, not a recomputation of every
    earlier round. ``drop`` removes a table that no later plan reads. Shuffle files go with the query that wrote them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        tidy_shuffles(spark)
        self.root = f"{shared_dir(spark)}/loam-{name}-{uuid.uuid4().hex}"
        self._n = 0

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the frame that reads it back."""
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        df.write.options(**PLAIN_FILES).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._loam_path = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._loam_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text as a long; 0 for null. Counts word ends, so no array of the words is built.

    The replacement leaves one mark for each word, and the length of that string is the count.
    """
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, WORD, "\x01"), r"[^\x01]+", "")), F.lit(0)).cast("long")


def running_totals(ws: Workspace, df: DataFrame, group: list[str], order: list[Column], value: str, names: tuple[str, str]) -> DataFrame:
    """Global rank (from 0) and exclusive running sum of ``value`` inside each ``group``, by ``order``.

    A window partitioned by the group would put a hot group into one task. Here rows are range
    partitioned over (group, order), so a group spans as many tasks as it needs; each task ranks its
    own rows, and the totals of earlier tasks are added from a table with one row for each
    (task, group) that occurs. ``order`` must be total, else ties get an arbitrary order.

    Returns the written table of df's columns with ``names`` = (rank, sum before) added.
    """
    from pyspark.sql import Window as W

    keys = [F.col(c) for c in group]
    sliced = ws.table(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    totals = sliced.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_v"))
    # Groups meet here with one row a task: its size is tasks x groups they share, not rows.
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1) if group else W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(
        F.col("_part").alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_v0"),
    )
    # Inside a task the order is that of the rows written; the partition id comes first so that no task's window mixes with another's.
    inside = W.partitionBy("_part", *group).orderBy("_at")
    ranked = sliced.withColumn("_r", F.row_number().over(inside) - 1).withColumn("_s", F.coalesce(F.sum(value).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    on = (F.col("_part") == F.col("_p"))
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    out = ranked.join(base, on, "inner").withColumn(names[0], (F.col("_r") + F.col("_n0")).cast("long")).withColumn(names[1], F.col("_s") + F.col("_v0"))
    return out.select(*df.columns, *names)
