"""File sources: scans that become documents, with front matter, gates and provenance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import constants as K
from loam.functions import text as T


def scan(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, ending, bytes, content) of every text file below ``path``; ordered use sorts by path."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    meta = F.col("_metadata")
    name = meta["file_name"]
    return rows.select(meta["file_path"].alias("path"), name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("ending"), meta["file_size"].alias("bytes"), F.col("value").alias("content"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, size) of every file, largest first; contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))
    return rows.withColumn("size", T.human_size(F.col("bytes"))).orderBy(F.desc("bytes"), "path")


def allowed(rows: DataFrame, endings: list[str] | None = None, asm_most: int = 500 * 1024, false_ending: str = r"\.(?:html?|php|aspx?)\.[a-z]+$") -> DataFrame:
    """Scanned rows with an allowed ending (default: any that isn't skipped), without oversized assembly and doubled endings."""
    keep = F.col("ending").isin(endings) if endings else ~F.col("ending").isin(K.SKIPPED_ENDINGS)
    return rows.where(keep & ~F.contains("path", F.lit("vectorstore")) & ~((F.col("ending") == ".asm") & (F.col("bytes") > asm_most)) & ~F.lower("name").rlike(false_ending))


def front_matter(rows: DataFrame, default_tags: tuple[str, ...] = ("imported", "note")) -> DataFrame:
    """Markdown rows with title, tags and body.

    Front matter is the block between two lines of three hyphens at the start. Its ``title`` and
    ``tags`` (an inline list, a scalar or a block list) are read; a missing title comes from the file's
    stem, missing tags are the default.
    """
    head = F.regexp_extract("content", r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n", 1)
    body = F.regexp_replace("content", r"(?s)\A---\r?\n.*?\r?\n---\r?\n", "")
    plain = lambda c: F.regexp_replace(T.strip(c), "^[\"']|[\"']$", "")
    title = plain(F.regexp_extract("_head", r"(?m)^title:[ \t]*(.+)$", 1))
    inline = F.regexp_extract("_head", r"(?m)^tags:[ \t]*(\S.*)$", 1)
    block = F.regexp_extract_all(F.regexp_extract("_head", r"(?m)^tags:[ \t]*\n((?:[ \t]*-[ \t]+.*\n?)+)", 1), F.lit(r"(?m)^[ \t]*-[ \t]+(.+)$"), F.lit(1))
    listed = F.split(F.regexp_replace(inline, r"^\[|\]$", ""), ",")
    tags = F.when(F.startswith(inline, F.lit("[")), F.transform(listed, plain)).when(inline != "", F.array(plain(inline))).when(F.size(block) > 0, F.transform(block, plain)).otherwise(F.array(*[F.lit(t) for t in default_tags]))
    stem = F.regexp_replace("name", r"\.[^.]+$", "")
    rows = rows.withColumn("_head", head).withColumn("body", body)
    return rows.withColumn("title", F.when(title != "", title).otherwise(T.title_case(stem))).withColumn("tags", tags).drop("_head")


def labelled(rows: DataFrame, label: str = "Source: ") -> Column:
    """A document's text for the index: its source first, its tags last."""
    return F.concat(F.lit(label), "name", F.lit("\n\n"), "body", F.when(F.size("tags") > 0, F.concat(F.lit("\nTags: "), F.array_join("tags", ", "))).otherwise(""))


@dataclass(frozen=True)
class Source:
    """One entry of a corpus: where, which endings, and the prefix of its documents' headings."""

    path: str
    endings: tuple[str, ...]
    prefix: str


def gather(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """(source_ix, path, wrapped) of all sources' files, in the order (source_ix, path)."""
    out = None
    for i, s in enumerate(sources):
        rows = allowed(scan(spark, s.path), list(s.endings))
        wrapped = F.concat(F.lit(f"\n\n--- {s.prefix}: "), "name", F.lit(" ---\n\n"), "content", F.lit("<|endoftext|>"))
        rows = rows.select(F.lit(i).alias("source_ix"), "path", wrapped.alias("wrapped"))
        out = rows if out is None else out.unionByName(rows)
    return out


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine): JSON lines of a schema, and the lines that don't parse. Blank lines are neither."""
    lines = spark.read.text(path).where(T.strip(F.col("value")) != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r._bad is null").select("r.*").drop("_bad"), parsed.where("r._bad is not null").select("value")


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def first_filled(spark: SparkSession, candidates: list[str], glob: str = "*.md") -> str | None:
    """The first of several folders that holds a matching file; ``README.md`` doesn't count."""
    jvm = spark._jvm
    for c in candidates:
        pattern = jvm.org.apache.hadoop.fs.Path(f"{c}/{glob}")
        found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
        if any(f.getPath().getName() != "README.md" for f in found or []):
            return c
    return None


def programs(spark: SparkSession, path: str) -> DataFrame:
    """(path, address, body) of binary programs: a little-endian load address and what follows."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.prg").load(path)
    byte = lambda i: F.conv(F.hex(F.substring("content", i, 1)), 16, 10).cast("int")
    return rows.where("length >= 2").select("path", (byte(1) + 256 * byte(2)).alias("address"), F.expr("substring(content, 3)").alias("body"))
