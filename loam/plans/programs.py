"""Queries on generated programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import constants as K
from loam.operators import corpus as C
from loam.operators import programs as P
from loam.plans.corpus import STRIP
from loam.plans.registry import query, read, values

BASIC = [
    (1, "10 PRINT A\n20 GOTO 10"),
    (2, "10 LET SCORE=1\n20 LET SCALE=2\n20 PRINT SC\nno number\n15 NAME$=\"X\""),
    (3, '100 REM TOTAL TORQUE\n90 A1=2: A2=3\n\n95 PRINT "TOWN"'),
    (4, "5 X%=1\n6 XX=2\n7 XY=3"),
]
ASM = [
    (1, "start: lda #$01\n sta $d020\n bne start\n rts"),
    (2, "loop: inx\n bne missing\n jmp nowhere\n foo #1\nloop: rts"),
    (3, "top: nop\n" + " lda $1234\n" * 50 + " beq top\n bcc end\n" + " sta $0400,x\n" * 40 + "end: rts ; done"),
    (4, "* = $c000\n!byte 1,2,3\nval = 5\n lda ($fb),y\n adc $D0FF\n; comment\n\n jsr val"),
]
RESPONSES = [(1, "```asm\nstart: LDA #1\n BNE start\n```"), (2, "```basic\n10 PRINT 1\n5 PRINT 2\n```"), (3, "plain"), (4, "```\nLDA #1\nBNE away\n```\n```\n10 GOTO 10\n```")]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "code_id int, code string")


def _rows(rows):
    return f"(SELECT * FROM ({values(rows)}) AS t(code_id, code))"


_NUMBERED = rf"""(SELECT code_id, line_no, line, CASE WHEN regexp_matches(line, '^\d+\s+') THEN CAST(regexp_extract(line, '^(\d+)', 1) AS BIGINT) END AS num, regexp_extract(line, '^\d+\s+(.*)', 1) AS content FROM (
    SELECT code_id, CAST(generate_subscripts(string_split({STRIP("code")}, chr(10)), 1) AS INT) AS line_no, {STRIP("x")} AS line FROM (SELECT *, unnest(string_split({STRIP("code")}, chr(10))) AS x, code AS c2 FROM {{}}) ) WHERE line <> '')"""
_NUMBERED = rf"""(SELECT code_id, line_no, line, CASE WHEN regexp_matches(line, '^\d+\s+') THEN CAST(regexp_extract(line, '^(\d+)', 1) AS BIGINT) END AS num, regexp_extract(line, '^\d+\s+(.*)', 1) AS content FROM (
    SELECT code_id, i AS line_no, {STRIP("l[i]")} AS line FROM (SELECT code_id, l, CAST(unnest(range(1, len(l) + 1)) AS INT) AS i FROM (SELECT code_id, string_split({STRIP("code")}, chr(10)) AS l FROM {{}}))) WHERE line <> '')"""


@query("basic_line_order", f"SELECT code_id, line_no, num, finding FROM (SELECT *, CASE WHEN num IS NULL THEN 'no line number' WHEN num <= last_value(num IGNORE NULLS) OVER (PARTITION BY code_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'not in sequence' END AS finding FROM {_NUMBERED.format(_rows(BASIC))}) WHERE finding IS NOT NULL")
def basic_line_order(spark, sf_dir):
    return P.line_order(_frame(spark, BASIC))


_UPPER = [(i, c.upper()) for i, c in BASIC]


@query(
    "basic_collisions",
    rf"""SELECT code_id, num, word, owner, short FROM (SELECT *, first_value(word) OVER (PARTITION BY code_id, short ORDER BY line_no, i) AS owner FROM (
    SELECT *, substr(substr(word, 1, length(word) - length(suffix)), 1, 2) || suffix AS short FROM (SELECT *, regexp_extract(word, '([%$])$', 1) AS suffix, regexp_replace(word, '[%$]+$', '') AS base FROM (
    SELECT code_id, line_no, num, i, w[i] AS word FROM (SELECT code_id, line_no, num, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT *, regexp_extract_all(content, '\b[A-Z][A-Z0-9]*[%$]?\b') AS w FROM {_NUMBERED.format(_rows(_UPPER))} WHERE num IS NOT NULL))))
    WHERE base <> '' AND base NOT IN ({", ".join(f"'{w}'" for w in K.BASIC_WORDS)}))) WHERE owner <> word""",
)
def basic_collisions(spark, sf_dir):
    return P.name_collisions(_frame(spark, BASIC))


_BARE = STRIP("regexp_replace(raw, ';.*', '')")
_LINES = f"(SELECT code_id, i AS line_no, l[i] AS raw FROM (SELECT code_id, l, CAST(unnest(range(1, len(l) + 1)) AS INT) AS i FROM (SELECT code_id, string_split(code, chr(10)) AS l FROM {_rows(ASM)})))"
_PLAIN = r"CASE WHEN s = '' OR ends_with(s, ':') OR regexp_matches(s, '^[*!]') THEN 0 WHEN regexp_matches(s, '^[a-zA-Z]{3}$') THEN 1 WHEN contains(s, '#') THEN 2 WHEN contains(s, '$') THEN CASE WHEN regexp_matches(s, '\$[0-9A-Fa-f]{3,4}') THEN 3 ELSE 2 END ELSE 3 END"
_LAID = f"l AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY code_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM (SELECT code_id, line_no, s, regexp_extract(s, '^([a-zA-Z0-9_]+):', 1) AS label, {_PLAIN} AS size FROM (SELECT *, {_BARE} AS s FROM {_LINES})))"


@query(
    "asm_offsets_branches",
    rf"""WITH {_LAID}, b AS (SELECT code_id, label, arg_max(off, line_no) AS spot FROM l WHERE label <> '' GROUP BY ALL),
    j AS (SELECT code_id, line_no, off, regexp_extract({STRIP("substr(s, 4)")}, '\b([a-zA-Z0-9_]+)\b', 1) AS target FROM l WHERE size > 0 AND upper(substr(s, 1, 3)) IN ({", ".join(f"'{x}'" for x in K.BRANCHES)}))
    SELECT code_id, line_no, finding, target, distance FROM (SELECT *, CASE WHEN spot IS NULL AND NOT regexp_matches(target, '^\d+$') THEN 'undefined' WHEN distance NOT BETWEEN -128 AND 127 THEN 'out of range' END AS finding FROM (
      SELECT j.*, spot, CAST(spot - off - 2 AS BIGINT) AS distance FROM j LEFT JOIN b ON b.code_id = j.code_id AND b.label = j.target WHERE target <> '')) WHERE finding IS NOT NULL""",
)
def asm_offsets_branches(spark, sf_dir):
    return P.branch_findings(_frame(spark, ASM)).withColumn("distance", F.col("distance").cast("bigint"))


@query("asm_lint", f"""SELECT * FROM ({values([(2, 5, 'error', 'duplicate label', 'loop'), (2, 4, 'warning', 'unknown mnemonic', 'FOO'), (2, 2, 'error', 'undefined', 'missing'), (3, 52, 'error', 'out of range', 'top')])}) AS t(code_id, line_no, severity, finding, subject)""")
def asm_lint(spark, sf_dir):
    return P.lint(_frame(spark, ASM))


_CYCLES = "CASE upper(substr(s, 1, 3)) " + " ".join(f"WHEN '{op}' THEN {n}" for op, n in K.CYCLES.items()) + " END"


@query(
    "cycle_estimate",
    rf"""SELECT code_id, CAST(coalesce(sum(n + extra), 0) AS BIGINT) AS cpu, CAST({262 * 43 + 262 * 2 * 2} AS BIGINT) AS vic, CAST(coalesce(sum(n + extra), 0) + {262 * 43 + 262 * 2 * 2} AS BIGINT) AS combined FROM (
    SELECT code_id, CASE WHEN s = '' OR ends_with(s, ':') OR regexp_matches(s, '^[*!]') THEN NULL ELSE {_CYCLES} END AS n,
      CASE WHEN contains(s, '(') THEN 3 WHEN contains(s, ',') THEN 1 WHEN length(regexp_replace(split_part(s, '$', 2), '[^0-9A-F]', '', 'g')) > 2 THEN 1 ELSE 0 END AS extra FROM (SELECT *, {_BARE} AS s FROM {_LINES})) GROUP BY code_id""",
)
def cycle_estimate(spark, sf_dir):
    return P.cycles(_frame(spark, ASM), 262, 2)


@query(
    "opcode_ratio",
    rf"""SELECT code_id, CAST(count_if(c) AS BIGINT) AS n_lines, CAST(count_if(c AND (starts_with(op, '.') OR op IN ({", ".join(f"'{x}'" for x in K.CYCLES)}))) AS BIGINT) AS n_valid, count_if(c) > 0 AND count_if(c AND (starts_with(op, '.') OR op IN ({", ".join(f"'{x}'" for x in K.CYCLES)}))) * 10 >= count_if(c) * 7 AS valid FROM (
    SELECT code_id, s <> '' AND NOT regexp_matches(s, '^[;*]') AND NOT starts_with(rest, ';') AS c, upper(regexp_extract(replace(replace(split_part(rest, ';', 1), ',', ' '), '#', ' # '), '^\s*(\S+)', 1)) AS op FROM (
    SELECT *, CASE WHEN contains(s, ':') THEN {STRIP("regexp_replace(s, '^[^:]*:', '')")} ELSE s END AS rest FROM (SELECT *, {STRIP("raw")} AS s FROM {_LINES}))) GROUP BY code_id""",
)
def opcode_ratio(spark, sf_dir):
    return P.opcode_ratio(_frame(spark, ASM))


@query("validate_responses", f"SELECT * FROM ({values([(1, True, 1, 0), (2, False, 1, 1), (3, True, 0, 0), (4, False, 2, 1)])}) AS t(id, ok, n_blocks, n_findings)")
def validate_responses(spark, sf_dir):
    rows = P.validate_responses(spark.createDataFrame(RESPONSES, "id int, text string"), C.code_kind)
    return rows.select("id", "ok", F.col("n_blocks").cast("int"), F.col("n_findings").cast("int"))


@query("prg_layout")
def prg_layout(spark, sf_dir):
    return P.program_layout(_frame(spark, BASIC))


@query("prg_files")
def prg_files(spark, sf_dir):
    return P.program_files(_frame(spark, BASIC))


SPRITES = [(1, "FF00AA" * 21), (2, "8001" * 10), (3, "")]


def _pixel_sql(bits: int) -> str:
    per = 8 // bits
    return f"""SELECT id, CAST(i % {3 * per} AS INT) AS x, CAST(i // {3 * per} AS INT) AS y, CAST((CAST(concat('0x', substr(rpad(h, 126, '0'), CAST(i // {per} AS INT) * 2 + 1, 2)) AS INT) >> ({8 - bits} - {bits} * (i % {per}))::INT) & {(1 << bits) - 1} AS INT) AS color_ix
    FROM (SELECT id, h, unnest(range({63 * per})) AS i FROM ({values(SPRITES)}) AS t(id, h))"""


def _sprites(spark):
    return spark.createDataFrame(SPRITES, "id int, h string").select("id", F.unhex("h").alias("data"))


@query("sprite_pixels", _pixel_sql(1))
def sprite_pixels(spark, sf_dir):
    return P.pixels(_sprites(spark), 3, 21)


@query("sprite_pixels_multicolor", _pixel_sql(2))
def sprite_pixels_multicolor(spark, sf_dir):
    return P.pixels(_sprites(spark), 3, 21, 2)


@query("code_addresses", f"SELECT * FROM ({values([(1, 0xC000, 0xC0FF), (2, 0x0801, 0x9FFF)])}) AS t(id, start, \"end\")")
def code_addresses(spark, sf_dir):
    rows = spark.createDataFrame([(1, "*=$C000\n lda #1"), (2, "10 PRINT"), (3, "x")], "id int, text string")
    return rows.select("id", F.inline(P.addresses(F.col("text"))))
