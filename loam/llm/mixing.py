"""Operator 10: mixing sources to target weights, by Pareto order sampling.

Targets: sources get their weight's share of ``share`` times all words; a target stops at ``most``
times the source's words, and what it can't take is shared by weight among the others, until none is
above. Sources by code point, null last, take the weights in turn.

Selection inside a source with target T and W words: every document gets ``floor(T / W)`` certain
whole copies. The rest of T is a sample of documents, fixed in size (words): each document has an
inclusion probability p and a uniform u drawn from its doc_id, and documents are ranked by
``(u / (1 - u)) / (p / (1 - p))``. p is the rest's share of the source; a document that would hold
more than 1 / ``EVEN`` of the rest has it reduced in proportion, so inclusion is unequal and one long
document seldom decides a source's sample. Documents are taken in rank order while they fit into the
rest; further passes over those left fill what a long document left open, until none fits, and one document
more is taken where that comes nearer to the target. So a sum is off by half a document at most, the one
that comes nearest among those left. The passes after the first prefer short documents, so inclusion is a
little above p for these; what they fill is less than the document that ended the first pass.

Rank and sums come from range-partitioned running totals, so a source with a third of all rows
spreads over as many tasks as it needs. Null texts have size 0. Reruns agree: u depends on seed and
doc_id alone. Rows that repeat a doc_id share u and are ranked by size; identical ones in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import Workspace, running_totals
from loam.llm.words import size_in_words

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
EVEN, SEED = 16, "loam"


def targets(ws: Workspace, sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) of every source in sized (source, size)."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_source = ws.table(running_totals(ws, by_source.withColumn("last", F.col("source").isNull()), [], [F.col("last"), F.col("source")], "source_size", ("at", "_")))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    by_source = by_source.select("source", "source_size", F.get(turn, F.pmod("at", F.lit(len(weights))).cast("int")).alias("weight"))
    total = by_source.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, None
    while True:  # each turn caps more sources, or ends
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= F.lit(most) * F.col("source_size")
        n, taken, free = by_source.agg(F.count_if(over), F.sum(F.when(over, most * F.col("source_size")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, level = n, (share * total - taken) / free
    level = level or 0.0
    return by_source.withColumn("target", F.least(F.col("weight") * F.lit(level), (F.lit(most) * F.col("source_size")).cast("double")))


def uniform(seed: str = SEED):
    """A number inside (0, 1) from the doc_id: 52 bits of an MD5."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix(ws: Workspace, sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sized (doc_id, source, size, ...) with source_size, target and copies."""
    goal = targets(ws, sized, weights, share, most)
    rows = sized.join(F.broadcast(goal) if goal.count() <= 10_000 else goal, sized["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    even = F.col("rest") / EVEN
    p = F.col("rest") / F.col("source_size") * F.when(F.col("size") > even, even / F.col("size")).otherwise(1.0)
    u = uniform()
    rows = ws.table(rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("rank", F.when((F.col("rest") >= 1) & (F.col("size") > 0), (u / (1 - u)) / (p / (1 - p)))).withColumn("copies", F.col("whole")))
    fit, won = rows.where("rank is not null").select("_row", "doc_id", "source", "size", "rank", "rest"), None

    def filled(some: DataFrame, by: DataFrame) -> DataFrame:
        """some with ``rest`` less what the rows ``by`` fill of their source."""
        sums = by.groupBy("source").agg(F.sum("size").alias("_sum")).withColumnRenamed("source", "_source")
        met = some.join(sums, some["source"].eqNullSafe(sums["_source"]), "left")
        return met.withColumn("rest", F.col("rest") - F.coalesce("_sum", F.lit(0))).select(*some.columns)

    left = fit.where("size <= rest")
    while won is None or not left.isEmpty():  # each pass takes what ranks first, or drops what is too long
        placed = running_totals(ws, left, ["source"], [F.col("rank"), F.col("doc_id"), F.col("size")], "size", ("_n", "_before"))
        placed = ws.table(placed.withColumn("taken", F.col("_before") + F.col("size") <= F.col("rest")))
        took = placed.where("taken").select(*fit.columns)
        won = took if won is None else won.unionByName(took)
        left = ws.table(filled(placed.where("not taken").select(*fit.columns), took).where("size <= rest"))
    # One document more where that comes nearer: the one that leaves the least, over or under.
    won = ws.table(won.select("_row", "source", "size"))
    over = filled(fit.join(won.select("_row"), "_row", "left_anti"), won).withColumn("_off", F.abs(F.col("size") - F.col("rest"))).where("_off < rest")
    nearest = over.groupBy("source").agg(F.min(F.struct("_off", "rank", "doc_id", "_row")).alias("m")).select(F.col("m._row").alias("_row"))
    more = won.select("_row").unionByName(nearest).withColumn("_more", F.lit(1))
    out = rows.join(more, "_row", "left").withColumn("copies", F.col("copies") + F.coalesce("_more", F.lit(0)))
    return out.select(*sized.columns, "source_size", "target", "copies")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """docs with each row as often as the mix takes it: not at all, or up to ``most`` times."""
    ws = Workspace(docs.sparkSession, "mix")
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id"), F.col("source").cast("string").alias("source"), size_in_words(F.col("text")).alias("size"))
    # Whole rows are written once with their size; ranks and sums run on narrow rows.
    held = ws.table(keyed.withColumn("_key", F.monotonically_increasing_id()))
    copies = mix(ws, held.select("_key", "doc_id", "source", "size"), weights, share, most).where("copies > 0").select("_key", "copies")
    again = held.join(copies, "_key").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return again.select("_row.*")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws = Workspace(spark, "mix")
    sized = ws.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_in_words(F.col("text")).alias("size")))
    return mix(ws, sized).select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS w, CAST(list_value(3, 1, 2)[CAST(1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS INT)] AS DOUBLE) AS weight
  FROM d GROUP BY source
), turns AS (
  SELECT 0 AS turn, CAST(0 AS DOUBLE) AS level
  UNION ALL
  SELECT turn + 1, (SELECT (1.5 * sum(w) - sum(CASE WHEN weight * level >= 2 * w THEN 2 * w ELSE 0 END)) / sum(CASE WHEN weight * level >= 2 * w THEN 0.0 ELSE weight END) FROM s)
  FROM turns WHERE turn < (SELECT count(*) + 1 FROM s)
), lv AS (SELECT level FROM turns ORDER BY turn DESC LIMIT 1),
t AS (SELECT source, w, least(weight * level, CAST(2 * w AS DOUBLE)) AS target FROM s, lv),
r AS (
  SELECT doc_id, d.source, size, w, target, CASE WHEN w > 0 THEN CAST(floor(target / w) AS BIGINT) ELSE 0 END AS whole,
    (CAST(CAST(concat('0x', substr(md5(concat('loam:', CAST(doc_id AS VARCHAR))), 1, 13)) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, target - whole * w AS rest FROM r
), p AS (
  SELECT *, rest / w * CASE WHEN size > rest / 16 THEN (rest / 16) / size ELSE 1.0 END AS p FROM q
), k AS (
  SELECT *, CASE WHEN rest >= 1 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM p
), fill AS (
  SELECT doc_id, source, size, rank, rest, FALSE AS taken FROM k WHERE rank IS NOT NULL
  UNION ALL
  SELECT doc_id, source, size, rank, rest - sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source) AS rest, fits AS taken
  FROM (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size) <= rest AS fits FROM fill WHERE NOT taken AND size <= rest)
), won AS (SELECT doc_id, source, size FROM fill WHERE taken)
, o AS (SELECT doc_id, k.source, size, rank, rest - coalesce(f, 0) AS rest FROM k LEFT JOIN (SELECT source, sum(size) AS f FROM won GROUP BY source) x ON k.source IS NOT DISTINCT FROM x.source
  WHERE rank IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM won))
, more AS (SELECT doc_id FROM won UNION ALL SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY abs(size - rest), rank, doc_id) AS n FROM o WHERE abs(size - rest) < rest) WHERE n = 1)
SELECT doc_id, source, size, w AS source_size, target, CAST((whole + (doc_id IN (SELECT doc_id FROM more))::INT) * size AS BIGINT) AS taken FROM q
"""
