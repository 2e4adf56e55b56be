"""Instruction pairs: tasks, variations by swaps, comparisons, staged union with a target; tokens and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.operators.corpus import first_of_each, pair_key


def distill_tasks(chunks: DataFrame, types: list[str], langs: list[str], qa_per_chunk: int) -> DataFrame:
    """A task for each chunk, type and language, asking for at least one pair: two literal dimensions exploded, no join."""
    each = max(1, qa_per_chunk // max(1, len(langs)))
    rows = chunks.withColumn("qa_type", F.explode(F.array(*[F.lit(t) for t in types]))).withColumn("lang", F.explode(F.array(*[F.lit(x) for x in langs])))
    return rows.withColumn("n_pairs", F.lit(each))


def fill(template: Column, **values: Column) -> Column:
    """A template with {name} replaced, literally: braces elsewhere mean nothing."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def swap_variations(seeds: DataFrame, swaps: DataFrame) -> DataFrame:
    """Each factual or code seed with the first swap (by place) whose old text its output holds.

    swaps is a literal table; its rows are packed into an array, so no pairs are formed.
    """
    table = [tuple(r) for r in swaps.orderBy("place").collect()]  # a literal dimension
    pack = F.array(*[F.struct(F.lit(o).alias("old"), F.lit(n).alias("new")) for _, o, n in table])
    hit = F.get(F.filter(pack, lambda s: F.contains(F.col("output"), s["old"]) & (s["old"] != s["new"])), 0)
    rows = seeds.where(F.col("type").isin("factual", "code")).withColumn("_s", hit).where("_s is not null")
    return rows.select("ord", "type", F.replace("instruction", F.col("_s.old"), F.col("_s.new")).alias("instruction"), F.replace("output", F.col("_s.old"), F.col("_s.new")).alias("output"))


def adjacent_compare(rows: DataFrame) -> DataFrame:
    """Rows 2i and 2i + 1 (ix) side by side, by a self join on half the index."""
    left = rows.where("ix % 2 = 0").select((F.col("ix") / 2).cast("long").alias("pair"), F.col("name").alias("first"), F.col("output").alias("first_output"))
    right = rows.where("ix % 2 = 1").select(F.floor(F.col("ix") / 2).cast("long").alias("pair"), F.col("name").alias("second"), F.col("output").alias("second_output"))
    return left.join(right, "pair")


def quick_reference(rows: DataFrame, group: str, order: str, text: str, first: int = 3, chars: int = 80, least: int = 2) -> DataFrame:
    """The first texts of each group, joined; groups with fewer than ``least`` rows go."""
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("_r") <= first)
    held = ranked.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(F.struct(F.col("_r"), F.substring(text, 1, chars).alias("t")))).alias("_l"))
    return held.where(F.col("_n") >= least).select(group, F.array_join(F.transform("_l", lambda x: x["t"]), " | ").alias("reference"))


def staged_union(stages: list[DataFrame], target: int) -> DataFrame:
    """Union of stages (instruction, output, seq), the first of each pair kept by (stage, seq).

    The target only limits the last stage: earlier ones always count in full.
    """
    rows = None
    for i, s in enumerate(stages):
        s = s.select(F.lit(i).alias("stage"), F.col("seq").cast("long").alias("seq"), "instruction", "output")
        rows = s if rows is None else rows.unionByName(s)
    once = first_of_each(rows, pair_key(F.col("instruction"), F.col("output")), "stage", "seq")
    last = len(stages) - 1
    early = once.where(F.col("stage") < last)
    room = max(0, target - early.count())
    late = once.where(F.col("stage") == last).orderBy("seq").limit(room)
    return early.unionByName(late)


def seeded_order(key: Column, seed: str) -> Column:
    """A shuffle's sort key that reruns and other engines share."""
    return F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary"))


def char_vocab(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, n, id): characters in code-point order with dense ids; counted before the shuffle."""
    counts = docs.select(F.explode(F.split(F.col(text), "")).alias("token")).where("token <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("id", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("token")) - 1)  # a row a symbol


def corpus_offsets(docs: DataFrame, order: str, length: Column) -> DataFrame:
    """docs with ``start``: lengths before, in order. Each range partition sums its own rows, then the sums of earlier ones are added."""
    rows = docs.withColumn("_len", length.cast("long")).repartitionByRange(F.col(order)).sortWithinPartitions(order)
    rows = rows.withColumn("_p", F.spark_partition_id()).checkpoint()
    totals = rows.groupBy("_p").agg(F.sum("_len").alias("_t"))  # a row a partition
    base = totals.select("_p", F.coalesce(F.sum("_t").over(W.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = W.partitionBy("_p").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("_in", F.coalesce(F.sum("_len").over(inside), F.lit(0))).join(base, "_p").withColumn("start", F.col("_base") + F.col("_in")).drop("_p", "_in", "_base")


def tail_split(offsets: DataFrame, total: int, ratio: float) -> DataFrame:
    """offsets (start, _len) with train and val: how much of each document lies before and in the tail.

    The tail is the last ``int(total * ratio)`` positions; where that is 0 the validation part is empty.
    """
    cut = total - int(total * ratio)
    train = F.greatest(F.lit(0), F.least(F.col("_len"), F.lit(cut) - F.col("start")))
    return offsets.withColumn("train", train.cast("long")).withColumn("val", (F.col("_len") - train).cast("long"))


def hash_split(docs: DataFrame, key: str, percent: int, seed: str = "split") -> DataFrame:
    bucket = F.pmod(F.conv(F.substring(seeded_order(F.col(key), seed), 1, 8), 16, 10).cast("bigint"), F.lit(100))
    return docs.withColumn("part", F.when(bucket < percent, "test").otherwise("train"))
