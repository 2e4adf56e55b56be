"""Intervals, graphs, incremental sync, upserts, evaluation and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import constants as K


def overlaps(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """(a_id, b_id) of closed intervals (id, start, end) that overlap.

    Intervals are exploded into bins of ``width``, joined on the bin and filtered; a pair that shares
    several bins counts in the first of them, so nothing needs to be made distinct. The width should be
    near the longer intervals' length.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    left = a.select(F.col("id").alias("a_id"), F.col("start").alias("s1"), F.col("end").alias("e1")).withColumn("bin", bins("s1", "e1"))
    right = b.select(F.col("id").alias("b_id"), F.col("start").alias("s2"), F.col("end").alias("e2")).withColumn("bin", bins("s2", "e2"))
    meet = F.greatest("s1", "s2")
    return left.join(right, "bin").where((meet <= F.least("e1", "e2")) & (F.floor(meet / width) == F.col("bin"))).select("a_id", "b_id")


def regions_hit(ranges: DataFrame, regions: list[tuple[int, int, str]]) -> DataFrame:
    """ranges (id, start, end) with ``conflicts``: names of the literal regions that each overlaps, in their order."""
    table = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e"), F.lit(n).alias("n")) for s, e, n in regions])
    hit = F.filter(table, lambda r: F.greatest(F.col("start"), r["s"]) <= F.least(F.col("end"), r["e"]))
    return ranges.withColumn("conflicts", F.transform(hit, lambda r: r["n"]))


def first_collision(ranges: DataFrame, taken: list[tuple[int, int, str]]) -> DataFrame:
    """ranges with ``collision``: the first allocation met, else the first system vector inside, else null."""
    rows = [(s, e, n) for s, e, n in taken] + [(v, v, n) for v, n in K.VECTORS]
    return regions_hit(ranges, rows).withColumn("collision", F.get("conflicts", 0)).drop("conflicts")


def safe_area(spark, taken: list[tuple[int, int, str]]) -> DataFrame:
    """(place, start): the first proposed 4 KiB area that nothing taken touches; no row where all are."""
    rows = spark.createDataFrame([(i, s, s + 0x0FFF) for i, s in enumerate(K.PROPOSED)], "id int, start int, end int")
    return first_collision(rows, taken).where("collision is null").orderBy("id").limit(1).select(F.col("id").alias("place"), "start")


def sync_classes(incoming: DataFrame, state: DataFrame) -> DataFrame:
    """incoming (name, content) with md5 and class: new, updated or unchanged against state (name, md5)."""
    fresh = incoming.withColumn("md5", F.md5(F.col("content").cast("binary")))
    met = fresh.join(state.select("name", F.col("md5").alias("old")), "name", "left")
    return met.withColumn("class", F.when(F.col("old").isNull(), "new").when(F.col("old") != F.col("md5"), "updated").otherwise("unchanged")).drop("old")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with rows in place of those that share their key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in)."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def existing_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends exist."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def proxy_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct edges between a group's name and a node outside every group: exactly one end is grouped."""
    g = groups.select("node", "group")
    met = edges.join(g.select(F.col("node").alias("src"), F.col("group").alias("fg")), "src", "left").join(g.select(F.col("node").alias("dst"), F.col("group").alias("tg")), "dst", "left")
    return met.where(F.col("fg").isNull() != F.col("tg").isNull()).select(F.coalesce("fg", "src").alias("src"), F.coalesce("tg", "dst").alias("dst")).distinct()


def coverage(rows: DataFrame, text: str, words: list[str]) -> DataFrame:
    """rows with passed (the words that the text holds) and coverage in percent."""
    table = F.array(*[F.lit(w) for w in words])
    passed = F.filter(table, lambda w: F.contains(F.lower(F.col(text)), w))
    return rows.withColumn("passed", passed).withColumn("coverage", F.try_divide(100.0 * F.size("passed"), F.lit(float(len(words)))))


def throughput(chars: Column, seconds: Column) -> Column:
    """Tokens a second, at four characters a token; null for no time."""
    return F.try_divide(chars / 4.0, seconds)
