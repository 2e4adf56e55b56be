"""Text made from structured rows: findings, memory summaries, bitmap listings, normalised sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import text as T


def findings_text(findings: DataFrame) -> DataFrame:
    """(code_id, report) of lint findings, one line each in the order of lines."""
    line = F.format_string("[%s] line %d: %s '%s'", F.upper("severity"), "line_no", "finding", "subject")
    held = findings.groupBy("code_id").agg(F.sort_array(F.collect_list(F.struct("line_no", line.alias("s")))).alias("l"))
    return held.select("code_id", F.array_join(F.transform("l", lambda x: x["s"]), "\n").alias("report"))


def memory_summary(allocations: DataFrame) -> DataFrame:
    """One row: the allocations (start, end, purpose) as lines in the order of addresses."""
    line = F.format_string("- $%04X-$%04X: %s", "start", "end", "purpose")
    held = allocations.agg(F.sort_array(F.collect_list(F.struct("start", "end", line.alias("s")))).alias("l"))
    return held.select(F.array_join(F.transform("l", lambda x: x["s"]), "\n").alias("summary"))


def bytes_listing(bitmaps: DataFrame, kind: str = "asm", each: int = 8, first: int = 1000, step: int = 10) -> DataFrame:
    """(id, listing): a bitmap's bytes as data lines, ``each`` to a line: hexadecimal directives, or numbered DATA."""
    hexed = F.hex("data")
    value = lambda i: F.substring(hexed, i * 2 + 1, F.lit(2))
    show = (lambda i: F.concat(F.lit("$"), value(i))) if kind == "asm" else (lambda i: F.conv(value(i), 16, 10))
    rows = bitmaps.withColumn("n", F.octet_length("data")).where("n > 0").select("id", "data", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / each).cast("int"))).alias("row"))
    one = F.array_join(F.transform(F.sequence(F.col("row") * each, F.least(F.col("row") * each + each, F.col("n")) - 1), show), ", " if kind == "asm" else ",")
    lead = F.lit("!byte ") if kind == "asm" else F.concat((F.col("row") * step + first).cast("string"), F.lit(" DATA "))
    held = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("row", F.concat(lead, one).alias("s")))).alias("l"))
    return held.select("id", F.array_join(F.transform("l", lambda x: x["s"]), "\n").alias("listing"))


def normalised_source(code: Column) -> Column:
    """Assembly for a strict assembler: comments and blanks go, origins become org, labels stand alone, instructions are indented."""
    bare = F.filter(F.transform(T.lines(code), lambda x: T.strip(F.regexp_replace(x, ";.*", ""))), lambda x: x != "")
    label = r"^([A-Za-z_][A-Za-z0-9_]*):\s*"

    def one(x):
        name, rest = F.regexp_extract(x, label, 1), F.regexp_replace(x, label, "")
        origin = F.concat(F.lit("org "), T.strip(F.regexp_replace(x, r"^\*\s*=?", "")))
        return (
            F.when(x.rlike(r"^\*.*="), origin)
            .when((name != "") & (rest != ""), F.concat(name, F.lit("\n        "), rest))
            .when(name != "", name)
            .when(F.lower(x).rlike("^(org|!)"), x)
            .otherwise(F.concat(F.lit("        "), x))
        )

    return F.array_join(F.transform(bare, one), "\n")


def facts(rows: DataFrame, instruction: str, output: str, kind: str = "factual") -> DataFrame:
    """Pairs from a fact table by two templates of {column}s; a template is plain text otherwise."""

    def filled(template: str) -> Column:
        out = F.lit(template)
        for c in rows.columns:
            out = F.replace(out, F.lit("{" + c + "}"), F.col(c).cast("string"))
        return out

    return rows.select(F.lit(kind).alias("type"), filled(instruction).alias("instruction"), filled(output).alias("output"))


def clock_notes(notes: DataFrame, clocks: dict[str, float]) -> DataFrame:
    """Notes (note, hertz) unpivoted into a row for each clock system: the 16-bit frequency number."""
    rows = notes.select("note", F.explode(F.create_map(*[x for k, v in clocks.items() for x in (F.lit(k), F.round(F.col("hertz") * float(1 << 24) / v).cast("int"))])).alias("clock", "number"))
    return rows.withColumn("hex", F.format_string("$%04X", "number"))


def first_sentence(text: Column) -> Column:
    """A text of over 100 characters up to its first full stop, or its first 100 characters."""
    at = F.instr(text, ".")
    return F.when(F.length(text) <= 100, text).when(at > 0, F.substring(text, F.lit(1), at)).otherwise(F.substring(text, 1, 100))


def inverted(question: Column, answer: Column) -> Column:
    """"What is X?" with its answer turned round: which thing is described; null for other questions."""
    thing = F.regexp_extract(question, r"(?i)^what (?:is|does) (?:the )?(.+?)(?: do)?\?$", 1)
    return F.when(thing != "", F.concat(F.lit("Which thing is this: "), first_sentence(answer)))
