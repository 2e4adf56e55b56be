"""Cleaning, chunking, gates, classifiers and exact duplicates of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions import constants as K
from loam.functions import text as T


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``clean``: lines stripped, runs of blank lines collapsed."""
    stripped = docs.withColumn("_l", F.transform(T.lines(F.col(text)), T.strip))
    return stripped.withColumn("clean", F.array_join(T.collapse_blank_runs(F.col("_l")), "\n")).drop("_l")


def chunk(docs: DataFrame, text: str = "text", size: int = 60, most: int = 3000, least_doc: int = 100, least_chunk: int = 80) -> DataFrame:
    """doc_id, chunk_id, line_no and chunk: ``size`` lines each, ``most`` characters kept for the model."""
    held = docs.where(F.length(T.strip(F.col(text))) >= least_doc).withColumn("_l", T.lines(F.col(text)))
    parts = held.select("doc_id", "_l", F.explode(F.sequence(F.lit(0), F.size("_l") - 1, F.lit(size))).alias("_at"))
    parts = parts.select("doc_id", (F.col("_at") + 1).alias("line_no"), F.array_join(F.slice("_l", F.col("_at") + 1, F.lit(size)), "\n").alias("_c"))
    parts = parts.where(F.length(T.strip(F.col("_c"))) >= least_chunk)
    return parts.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("#L"), F.col("line_no").cast("string")).alias("chunk_id"), "line_no", F.substring("_c", 1, most).alias("chunk"))


def text_key(c: Column) -> Column:
    return F.md5(F.lower(T.strip(c)).cast("binary"))


def pair_key(instruction: Column, output: Column) -> Column:
    return F.md5(F.concat(F.lower(T.strip(instruction)), F.lit("|||"), F.lower(T.strip(output))).cast("binary"))


def first_of_each(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key: an aggregate with partial sums, so a key with a third of all rows is no hot task."""
    rest = [c for c in rows.columns if c not in order]
    best = rows.groupBy(key.alias("_key")).agg(F.min(F.struct(*order, *rest)).alias("_row"))
    return best.select(*[F.col("_row")[c].alias(c) for c in rows.columns])


def source_weight(source: Column) -> Column:
    out = None
    s = F.coalesce(source, F.lit(""))
    for how, needle, weight in K.SOURCE_WEIGHTS:
        fits = F.endswith(s, F.lit(needle)) if how == "ends" else F.contains(s, F.lit(needle))
        out = F.when(fits, weight) if out is None else out.when(fits, weight)
    return out.otherwise(1.0)


def is_asm(line: Column) -> Column:
    """A line whose text after its leading word, before a comment, starts with a mnemonic."""
    rest = T.strip(F.regexp_replace(T.strip(line), "^[A-Za-z0-9_]+", ""))
    return T.strip(F.split(rest, ";")[0]).rlike("(?i)^(" + "|".join(K.BLOCK_MNEMONICS) + ")")


def is_basic(line: Column) -> Column:
    return T.strip(line).rlike(r"^\d+\s+")


def line_kind(line: Column) -> Column:
    return F.when(is_asm(line), "asm").when(is_basic(line), "basic")


def code_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, pos, kind and line of the lines that are code; the others go before any shuffle."""
    rows = docs.select("doc_id", F.posexplode(T.lines(F.col(text))).alias("pos", "line"))
    return rows.withColumn("kind", line_kind(F.col("line"))).where("kind is not null")


def code_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, kind, first_line, n_lines and block: runs of neighbouring lines of a kind.

    Among the code lines of one kind, position less rank is constant exactly inside a run.
    """
    rows = code_lines(docs, text)
    rank = F.row_number().over(W.partitionBy("doc_id", "kind").orderBy("pos"))
    runs = rows.withColumn("_run", F.col("pos") - rank).groupBy("doc_id", "kind", "_run")
    held = runs.agg(F.min("pos").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.sort_array(F.collect_list(F.struct("pos", T.strip(F.col("line")).alias("line")))).alias("_l"))
    return held.select("doc_id", "kind", "first_line", "n_lines", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("block"))


def _pick(key: Column, salt: str, n: Column | int) -> Column:
    """A number from 0 to n - 1 that follows from the key: reruns and other engines agree."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(salt), key).cast("binary")), 1, 8), 16, 10).cast("bigint"), n.cast("bigint")).cast("int")


#: Our own instruction templates and constraints, by kind.
INSTRUCTIONS = {"asm": ["Write a 6502 routine", "Express this in assembly", "Code this for the processor"], "basic": ["Write a line-numbered program", "Express this in BASIC", "List this program"]}
CONSTRAINTS = ["few cycles", "few bytes", "no self-modification", "zero page where it helps"]


def block_examples(blocks: DataFrame) -> DataFrame:
    """An instruction example for each block, and a repair example (one line reversed) for blocks of several lines."""
    key = F.concat_ws(":", F.col("doc_id").cast("string"), "kind", F.col("first_line").cast("string"))
    lists = {k: F.array(*[F.lit(x) for x in v]) for k, v in INSTRUCTIONS.items()}
    pick = F.when(F.col("kind") == "asm", F.get(lists["asm"], _pick(key, "i", 3))).otherwise(F.get(lists["basic"], _pick(key, "i", 3)))
    rules = F.array(*[F.lit(x) for x in CONSTRAINTS])
    first = _pick(key, "c", len(CONSTRAINTS))
    second = F.pmod(first + 1 + _pick(key, "d", len(CONSTRAINTS) - 1), F.lit(len(CONSTRAINTS)))
    made = blocks.select("doc_id", "kind", "first_line", F.lit("write").alias("task"), pick.alias("instruction"), F.array_join(F.array(F.get(rules, first), F.get(rules, second)), "; ").alias("constraints"), F.lit(None).cast("string").alias("input"), F.col("block").alias("output"))
    several = blocks.where("n_lines > 1").withColumn("_l", T.lines(F.col("block")))
    at = _pick(key, "r", F.size("_l"))
    broken = F.array_join(F.transform("_l", lambda x, i: F.when(i == at, F.reverse(x)).otherwise(x)), "\n")
    repair = several.select("doc_id", "kind", "first_line", F.lit("repair").alias("task"), F.concat(F.lit("Repair this "), "kind", F.lit(" code")).alias("instruction"), F.lit(None).cast("string").alias("constraints"), broken.alias("input"), F.col("block").alias("output"))
    return made.unionByName(repair)


def pair_type(instruction: Column, output: Column, given: Column) -> Column:
    out = F.when(given.isNotNull(), given)
    for side, kind, needles in K.TYPE_RULES:
        out = out.when(T.any_of(F.lower(instruction if side == "instruction" else output), needles), kind)
    return out.otherwise("factual")


def hints(message: Column) -> Column:
    m = F.lower(message)
    return F.array_compact(F.array(*[F.when(T.any_of(m, needles), label) for label, needles in K.HINTS]))


def route(message: Column) -> Column:
    """The personality that answers a message: basic before assembly; null for neither."""
    m = F.lower(message)
    return F.when(F.contains(m, F.lit("basic")), "basic").when(T.any_of(m, ["assembly", "asm"]), "assembly")


def code_kind(code: Column) -> Column:
    """asm before basic; null for text that looks like neither."""
    upper = F.upper(code)
    return F.when(T.any_of(upper, K.ASM_NEEDLES), "asm").when(T.any_of(upper, K.BASIC_NEEDLES) | T.strip(code).rlike(r"^\d+\s"), "basic")


def search(rows: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows of which a column holds the query, whatever its case; every row for an empty one."""
    if not query:
        return rows
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(query.lower())), F.lit(False))
    return rows.where(found)


def page(rows: DataFrame, number: int, size: int, *order: str) -> DataFrame:
    """One page, the number clamped into what there is; row_no counts over all pages."""
    last = max(0, -(-rows.count() // size) - 1)
    at = min(max(0, number), last)
    got = rows.orderBy(*order).offset(at * size).limit(size)
    return got.withColumn("row_no", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)) + at * size)
