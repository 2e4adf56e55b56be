"""Static validation of generated programs, their sizes, cycles, byte layout and pixels."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions import constants as K
from loam.functions import text as T


def numbered_lines(programs: DataFrame) -> DataFrame:
    """code_id, line_no (from 1), line (stripped), num and content (null without a number), blank lines left out."""
    rows = programs.select("code_id", F.posexplode(T.lines(T.strip(F.col("code")))).alias("pos", "line"))
    rows = rows.select("code_id", (F.col("pos") + 1).alias("line_no"), T.strip(F.col("line")).alias("line")).where("line <> ''")
    fits = F.col("line").rlike(r"^\d+\s+")
    return rows.select("*", F.when(fits, F.regexp_extract("line", r"^(\d+)", 1).cast("long")).alias("num"), F.when(fits, F.regexp_extract("line", r"^\d+\s+(.*)", 1)).alias("content"))


def line_order(programs: DataFrame) -> DataFrame:
    """Findings (code_id, line_no, num, finding): lines without a number, and numbers not above the one before."""
    rows = numbered_lines(programs)
    earlier = F.last("num", ignorenulls=True).over(W.partitionBy("code_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1))
    found = F.when(F.col("num").isNull(), "no line number").when(F.col("num") <= earlier, "not in sequence")
    return rows.withColumn("finding", found).where("finding is not null").select("code_id", "line_no", "num", "finding")


def name_collisions(programs: DataFrame) -> DataFrame:
    """Findings (code_id, num, word, owner, short): names that share two characters with another name met before.

    Words inside quotes count too. A suffix counts where a word character follows it.
    """
    rows = numbered_lines(programs.withColumn("code", F.upper("code"))).where("num is not null")
    words = rows.select("code_id", "line_no", "num", F.posexplode(F.regexp_extract_all("content", F.lit(r"\b[A-Z][A-Z0-9]*[%$]?\b"), F.lit(0))).alias("at", "word"))
    words = words.withColumn("base", F.regexp_replace("word", "[%$]+$", "")).where(~F.col("base").isin(K.BASIC_WORDS) & (F.col("base") != ""))
    suffix = F.regexp_extract("word", "([%$])$", 1)
    words = words.withColumn("short", F.concat(F.substring(F.expr("left(word, length(word) - length(regexp_extract(word, '([%$])$', 1)))"), 1, 2), suffix))
    owner = F.first("word").over(W.partitionBy("code_id", "short").orderBy("line_no", "at"))
    return words.withColumn("owner", owner).where("owner <> word").select("code_id", "num", "word", "owner", "short")


def _bare(line: Column) -> Column:
    return T.strip(F.regexp_replace(line, ";.*", ""))


def plain_size(line: Column) -> Column:
    """Bytes of an instruction by the branch check's rough rule."""
    s = _bare(line)
    return (
        F.when((s == "") | F.endswith(s, F.lit(":")) | s.rlike(r"^[*!]"), 0).when(s.rlike("^[a-zA-Z]{3}$"), 1).when(F.contains(s, F.lit("#")), 2).when(F.contains(s, F.lit("$")), F.when(s.rlike(r"\$[0-9A-Fa-f]{3,4}"), 3).otherwise(2)).otherwise(3)
    )


def lint_size(text: Column) -> Column:
    """Bytes of an instruction or data directive by the linter's rule."""
    s = F.upper(T.strip(text))
    parts = F.size(F.split(s, ","))
    op = F.regexp_extract(s, r"^(\S+)", 1)
    rest = T.strip(F.regexp_replace(s, r"^\S+", ""))
    digits = F.length(F.regexp_extract(rest, r"\$([0-9A-F]+)", 1))
    quoted = F.regexp_extract(s, '"([^"]*)"', 1)
    return (
        F.when((s == "") | F.startswith(s, F.lit(";")), 0)
        .when(F.startswith(s, F.lit("!BYTE")), parts)
        .when(F.startswith(s, F.lit("!WORD")), 2 * parts)
        .when(F.startswith(s, F.lit("!TEXT")), F.when(s.rlike('"[^"]*"'), F.length(quoted)).otherwise(1))
        .when(~op.isin(list(K.CYCLES)), 0)
        .when(rest == "", 1)
        .when(F.startswith(rest, F.lit("#")), 2)
        .when(F.contains(rest, F.lit("(")), 3)
        .when((digits > 0) & (digits <= 2), 2)
        .otherwise(3)
    )


def _laid_out(programs: DataFrame, label: str, text: Column, size) -> DataFrame:
    """code_id, line_no, raw, label (or null), text, size and offset of every line."""
    rows = programs.select("code_id", F.posexplode(T.lines(F.col("code"))).alias("pos", "raw"))
    rows = rows.select("code_id", (F.col("pos") + 1).alias("line_no"), "raw", _bare(F.col("raw")).alias("bare"))
    found = F.regexp_extract("bare", label, 1)
    rows = rows.withColumn("label", F.when(found != "", found)).withColumn("text", text).withColumn("size", size(F.col("text")))
    before = W.partitionBy("code_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))


def branch_findings(programs: DataFrame) -> DataFrame:
    """(code_id, line_no, finding, target, distance): branches to labels out of range or undefined.

    A label's last definition counts; numbers are no labels.
    """
    rows = _laid_out(programs, r"^([a-zA-Z0-9_]+):", F.col("bare"), plain_size)
    labels = rows.where("label is not null").groupBy("code_id", F.col("label").alias("target")).agg(F.max_by("offset", "line_no").alias("at"))
    op = F.upper(F.substring("text", 1, 3))
    jumps = rows.where((F.col("size") > 0) & op.isin(K.BRANCHES)).withColumn("target", F.regexp_extract(T.strip(F.expr("substring(text, 4)")), r"\b([a-zA-Z0-9_]+)\b", 1)).where("target <> ''")
    return _judged(jumps.select("code_id", "line_no", "target", "offset"), labels)


def _judged(jumps: DataFrame, labels: DataFrame) -> DataFrame:
    met = jumps.join(labels, ["code_id", "target"], "left").withColumn("distance", F.col("at") - F.col("offset") - 2)
    finding = F.when(F.col("at").isNull() & ~F.col("target").rlike(r"^\d+$"), "undefined").when(~F.col("distance").between(-128, 127), "out of range")
    return met.withColumn("finding", finding).where("finding is not null").select("code_id", "line_no", "finding", "target", "distance")


def lint(programs: DataFrame) -> DataFrame:
    """(code_id, line_no, severity, finding, subject) of duplicate and undefined labels, unknown mnemonics, far branches."""
    label = r"^([a-zA-Z_][a-zA-Z0-9_]*):"
    rows = _laid_out(programs, label, T.strip(F.regexp_replace("bare", label, "")), lint_size).where("bare <> ''")
    again = F.row_number().over(W.partitionBy("code_id", "label").orderBy("line_no"))
    twice = rows.where("label is not null").withColumn("_n", again).where("_n > 1").select("code_id", "line_no", F.lit("error").alias("severity"), F.lit("duplicate label").alias("finding"), F.col("label").alias("subject"))
    op = F.upper(F.regexp_extract("text", r"^(\S+)", 1))
    code = rows.where("text <> ''").withColumn("op", op)
    known = F.col("op").isin(list(K.CYCLES)) | F.col("op").isin(K.DIRECTIVES) | F.startswith("op", F.lit("*"))
    unknown = code.where(~known & ~F.contains("text", F.lit("="))).select("code_id", "line_no", F.lit("warning").alias("severity"), F.lit("unknown mnemonic").alias("finding"), F.col("op").alias("subject"))
    target = T.strip(F.regexp_replace(F.regexp_extract("text", r"^\S+\s+(\S+)", 1), r"[,#+\-\d].*", ""))
    jumps = code.where(F.col("op").isin(K.BRANCHES)).withColumn("target", target).where("target <> '' and not startswith(target, '$')")
    labels = rows.where("label is not null").groupBy("code_id", F.col("label").alias("target")).agg(F.max_by("offset", "line_no").alias("at"))
    far = _judged(jumps.select("code_id", "line_no", "target", "offset"), labels).select("code_id", "line_no", F.lit("error").alias("severity"), "finding", F.col("target").alias("subject"))
    return twice.unionByName(unknown).unionByName(far)


def cycles(programs: DataFrame, raster_lines: int = 262, sprites: int = 0) -> DataFrame:
    """(code_id, cpu, vic, combined) estimates: base cycles, an addressing extra, and what the video chip takes."""
    rows = programs.select("code_id", F.explode(F.transform(T.lines(F.col("code")), _bare)).alias("line"))
    base = F.create_map(*[x for op, n in K.CYCLES.items() for x in (F.lit(op), F.lit(n))])
    counted = ~((F.col("line") == "") | F.endswith("line", F.lit(":")) | F.col("line").rlike(r"^[*!]"))
    after = F.get(F.split("line", r"\$"), 1)
    capitals = F.length(F.regexp_replace(F.coalesce(after, F.lit("")), "[^0-9A-F]", ""))
    extra = F.when(F.contains("line", F.lit("(")), 3).when(F.contains("line", F.lit(",")), 1).when(capitals > 2, 1).otherwise(0)
    n = F.try_element_at(base, F.upper(F.substring("line", 1, 3)))
    vic = raster_lines * K.STOLEN_LINE + raster_lines * sprites * K.STOLEN_SPRITE
    out = rows.groupBy("code_id").agg(F.coalesce(F.sum(F.when(counted & n.isNotNull(), n + extra)), F.lit(0)).alias("cpu"))
    return out.select("code_id", F.col("cpu").cast("long"), F.lit(vic).cast("long").alias("vic"), (F.col("cpu") + vic).cast("long").alias("combined"))


def opcode_ratio(programs: DataFrame, least: float = 0.7) -> DataFrame:
    """(code_id, n_lines, n_valid, valid): share of code lines that start with a mnemonic or a dot directive."""
    rows = programs.select("code_id", F.explode(F.transform(T.lines(T.strip(F.col("code"))), T.strip)).alias("line"))
    rows = rows.withColumn("counts", (F.col("line") != "") & ~F.col("line").rlike("^[;*]"))
    rest = F.when(F.contains("line", F.lit(":")), T.strip(F.regexp_replace("line", r"^[^:]*:", ""))).otherwise(F.col("line"))
    rows = rows.withColumn("rest", rest).withColumn("counts", F.col("counts") & ~F.startswith("rest", F.lit(";")))
    op = F.upper(F.regexp_extract(F.replace(F.replace(F.get(F.split("rest", ";"), 0), F.lit(","), F.lit(" ")), F.lit("#"), F.lit(" # ")), r"^\s*(\S+)", 1))
    good = op.isin(list(K.CYCLES)) | F.startswith(op, F.lit("."))
    out = rows.groupBy("code_id").agg(F.count_if("counts").alias("n_lines"), F.count_if(F.col("counts") & good).alias("n_valid"))
    return out.withColumn("valid", (F.col("n_lines") > 0) & (F.col("n_valid") * 10 >= F.col("n_lines") * int(10 * least)))


#: Linters by kind: each turns programs into findings with a code_id.
LINTERS: dict[str, list[Callable[[DataFrame], DataFrame]]] = {"basic": [line_order, name_collisions], "asm": [branch_findings]}


def validate_responses(responses: DataFrame, kind) -> DataFrame:
    """(id, ok, n_blocks, n_findings): fenced blocks found, their kind told, linted, and combined for each response."""
    blocks = responses.select("id", F.posexplode(T.fenced(F.col("text"))).alias("block_no", "code"))
    blocks = blocks.withColumn("code_id", F.concat_ws(":", "id", "block_no")).withColumn("kind", kind(F.col("code")))
    found = [check(blocks.where(F.col("kind") == k)).select("code_id") for k, checks in LINTERS.items() for check in checks]
    counts = reduce(DataFrame.unionByName, found).groupBy("code_id").agg(F.count(F.lit(1)).alias("n"))
    per = blocks.select("id", "code_id").join(counts, "code_id", "left").groupBy("id").agg(F.count(F.lit(1)).alias("n_blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_findings"))
    out = responses.select("id").join(per, "id", "left")
    return out.select("id", (F.coalesce("n_findings", F.lit(0)) == 0).alias("ok"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


def crunch(content: str) -> bytes:
    """A program line's bytes: keywords outside quotes become their codes, the longest keyword first."""
    import re

    keywords = re.compile("|".join(re.escape(k) for k in sorted(K.BASIC_TOKENS, key=lambda k: (-len(k), k))))
    out = bytearray()
    for i, part in enumerate(re.split('("[^"]*")', content)):
        if i % 2:
            out += part.encode("ascii", "replace")
            continue
        part, at = part.upper(), 0
        for m in keywords.finditer(part):
            out += part[at : m.start()].encode("latin-1", "replace")
            out.append(K.BASIC_TOKENS[m[0]])
            at = m.end()
        out += part[at:].encode("latin-1", "replace")
    return bytes(out)


def program_layout(programs: DataFrame, start: int = 0x0801) -> DataFrame:
    """(code_id, num, address, next_address, body) of every numbered line, in the order of numbers."""

    @F.pandas_udf("binary")
    def body(content):
        return content.map(crunch)

    rows = numbered_lines(programs).where("num is not null").withColumn("body", body(F.col("content"))).withColumn("size", F.octet_length("body") + 5)
    upto = W.partitionBy("code_id").orderBy("num", "line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("next_address", F.lit(start) + F.sum("size").over(upto))
    return rows.select("code_id", "num", "line_no", (F.col("next_address") - F.col("size")).alias("address"), "next_address", "body")


def program_files(programs: DataFrame) -> DataFrame:
    """(code_id, prg): load address, linked lines, and the end mark, as one binary."""
    word = lambda c: F.concat(F.unhex(F.lpad(F.hex(c.bitwiseAND(255)), 2, "0")), F.unhex(F.lpad(F.hex(F.shiftright(c, 8).bitwiseAND(255)), 2, "0")))
    rows = program_layout(programs)
    line = F.concat(word(F.col("next_address")), word(F.col("num")), F.col("body"), F.unhex(F.lit("00")))
    held = rows.groupBy("code_id").agg(F.sort_array(F.collect_list(F.struct("num", "line_no", F.hex(line).alias("x")))).alias("l"))
    return held.select("code_id", F.unhex(F.concat(F.lit("0108"), F.array_join(F.transform("l", lambda r: r["x"]), ""), F.lit("0000"))).alias("prg"))


def pixels(bitmaps: DataFrame, width_bytes: int, rows: int, bits: int = 1) -> DataFrame:
    """(id, x, y, color_ix) of every pixel; short data reads as zeros; with two bits a pixel is twice as wide."""
    per = 8 // bits
    n = width_bytes * rows
    hexed = F.rpad(F.hex("data"), 2 * n, "0")
    cells = bitmaps.select("id", hexed.alias("h"), F.explode(F.sequence(F.lit(0), F.lit(n * per - 1))).alias("i"))
    byte = F.conv(F.substring("h", F.floor(F.col("i") / per).cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int")
    place = F.pmod(F.col("i"), F.lit(per))
    color = F.floor(byte / F.pow(F.lit(2), (per - 1 - place) * bits)).cast("int").bitwiseAND((1 << bits) - 1)
    line = width_bytes * per
    return cells.select("id", F.pmod(F.col("i"), F.lit(line)).alias("x"), F.floor(F.col("i") / line).cast("int").alias("y"), color.alias("color_ix"))


def addresses(text: Column) -> Column:
    """Memory ranges that code claims: 256 bytes from each origin, and the program area where lines are numbered."""
    origins = F.transform(F.regexp_extract_all(text, F.lit(r"\*\s*=\s*\$([0-9A-Fa-f]{4})"), F.lit(1)), lambda h: F.struct(F.conv(h, 16, 10).cast("int").alias("start"), (F.conv(h, 16, 10).cast("int") + 255).alias("end")))
    area = F.array(F.struct(F.lit(0x0801).alias("start"), F.lit(0x9FFF).alias("end")))
    return F.when(text.rlike(r"(?m)^\d+\s+"), F.concat(origins, area)).otherwise(origins)
