"""Queries on cleaning, chunks, gates, classifiers and exact duplicates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions import constants as K
from loam.functions import text as T
from loam.operators import corpus as C
from loam.plans.registry import query, read, sql_any, values

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')".format
ROUGH = "replace(text, '. ', '.  ' || chr(10) || chr(10) || chr(10) || ' ')"


@query(
    "clean_text",
    rf"""SELECT doc_id, array_to_string(list_filter(l, lambda x, i: x <> '' OR (i > 1 AND l[i - 1] <> '')), chr(10)) AS clean
    FROM (SELECT doc_id, list_transform(string_split({ROUGH}, chr(10)), lambda x: {STRIP("x")}) AS l FROM documents)""",
)
def clean_text(spark, sf_dir):
    rough = read(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".  \n\n\n ")).alias("text"))
    return C.clean(rough).select("doc_id", "clean")


_CHUNKS = rf"""SELECT doc_id, source, doc_id || '#L' || (i + 1) AS chunk_id, i + 1 AS line_no, substr(c, 1, 3000) AS chunk FROM (
    SELECT doc_id, source, i, array_to_string(l[i + 1 : i + 60], chr(10)) AS c FROM (SELECT doc_id, source, l, unnest(range(0, len(l), 60)) AS i FROM (
      SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents WHERE length({STRIP("text")}) >= 100)))
    WHERE length({STRIP("c")}) >= 80"""


@query("chunk_lines60", f"SELECT doc_id, chunk_id, CAST(line_no AS INT) AS line_no, chunk FROM ({_CHUNKS})")
def chunk_lines60(spark, sf_dir):
    return C.chunk(read(spark, sf_dir, "documents"))


@query(
    "clean_chunks",
    f"""SELECT source, count(*) AS n_chunks, CAST(sum(length(chunk)) AS BIGINT) AS n_chars FROM (
    SELECT md5(lower({STRIP("chunk")})) AS k, arg_min(source, doc_id * 100000 + line_no) AS source, arg_min(chunk, doc_id * 100000 + line_no) AS chunk FROM ({_CHUNKS}) GROUP BY k) GROUP BY source""",
)
def clean_chunks(spark, sf_dir):
    """Chunks of documents, the first of each distinct one, counted by source."""
    docs = read(spark, sf_dir, "documents")
    parts = C.chunk(docs).join(docs.select("doc_id", "source"), "doc_id")
    once = C.first_of_each(parts, C.text_key(F.col("chunk")), "doc_id", "line_no")
    return once.groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("chunk")).alias("n_chars"))


@query("exact_dedup_first", f"SELECT md5(lower({STRIP('text')})) AS k, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def exact_dedup_first(spark, sf_dir):
    return C.first_of_each(read(spark, sf_dir, "documents").select("doc_id", C.text_key(F.col("text")).alias("k")), F.col("k"), "doc_id")


@query("dup_cluster_sizes", f"SELECT n AS cluster_size, count(*) AS clusters FROM (SELECT count(*) AS n FROM documents GROUP BY md5(lower({STRIP('text')}))) GROUP BY n")
def dup_cluster_sizes(spark, sf_dir):
    sizes = read(spark, sf_dir, "documents").groupBy(C.text_key(F.col("text")).alias("k")).agg(F.count(F.lit(1)).alias("cluster_size"))
    return sizes.groupBy("cluster_size").agg(F.count(F.lit(1)).alias("clusters"))


#: Our own words for the gate on this corpus.
COMMON = ["the", "of", "and", "der", "die", "und", "le", "la", "que", "de", "en", "los", "ing", "tion", "ent", "ung", "eau", "ción", "with", "from", "ich", "sch", "mente", "ado", "ere", "oui", "dans", "para"]


@query(
    "keyword_gate",
    f"""SELECT doc_id, CAST({" + ".join(f"contains(lower(text), '{w}')::INT" for w in COMMON)} AS INT) AS hits, ({" + ".join(f"contains(lower(text), '{w}')::INT" for w in COMMON)}) >= 12 AS passes,
    ({" + ".join(f"contains(lower(text), '{w}')::INT" for w in K.GATE_WORDS)}) >= {K.GATE_LEAST} AS technical FROM documents""",
)
def keyword_gate(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("low", F.lower("text"))
    hits = docs.select("doc_id", "low", T.distinct_hits(F.col("low"), COMMON).alias("hits"))
    return hits.select("doc_id", "hits", (F.col("hits") >= 12).alias("passes"), (T.distinct_hits(F.col("low"), K.GATE_WORDS) >= K.GATE_LEAST).alias("technical"))


_PATH = "source || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '_clean.txt' WHEN 2 THEN '.asm' ELSE '.PDF' END"


@query(
    "size_gates",
    f"""SELECT path, bytes FROM (SELECT {_PATH} AS path, strlen(text) AS bytes FROM documents)
    WHERE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) NOT IN ({", ".join(f"'{e}'" for e in K.SKIPPED_ENDINGS)})
    AND ((ends_with(path, '.md') AND bytes >= 512) OR (ends_with(path, '_clean.txt') AND bytes >= 1024) OR (ends_with(path, '.asm') AND bytes <= 512000))""",
)
def size_gates(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.expr(_PATH).alias("path"), F.octet_length("text").cast("bigint").alias("bytes"))
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    ends = lambda x: F.endswith("path", F.lit(x))
    gates = (ends(".md") & (F.col("bytes") >= 512)) | (ends("_clean.txt") & (F.col("bytes") >= 1024)) | (ends(".asm") & (F.col("bytes") <= 512_000))
    return rows.where(~ending.isin(K.SKIPPED_ENDINGS) & gates)


PATHS = ["/x/knowledge_base/a.md", "data/src/b.asm", "docs/c.md", "data/docs/d.txt", "data/output/e.md", "data/output/f_clean.txt", "/marker_md/g", "h.txt", ""]
_WEIGHT = "CASE " + " ".join(f"WHEN {'ends_with' if how == 'ends' else 'contains'}(s, '{x}') THEN {w}" for how, x, w in K.SOURCE_WEIGHTS) + " ELSE 1.0 END"


@query("source_boost", f"SELECT s AS source, CAST({_WEIGHT} AS DOUBLE) AS weight FROM (SELECT DISTINCT coalesce(source, '') AS s FROM documents UNION SELECT * FROM ({values([(p,) for p in PATHS])}))")
def source_boost(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("source")).union(spark.createDataFrame([(p,) for p in PATHS], "source string")).distinct()
    return rows.withColumn("weight", C.source_weight(F.col("source")))


_ASM = "regexp_matches(" + STRIP("split_part(" + STRIP("regexp_replace(" + STRIP("line") + ", '^[A-Za-z0-9_]+', '')") + ", ';', 1)") + ", '(?i)^(" + "|".join(K.BLOCK_MNEMONICS) + ")')"
_LINES = rf"""SELECT * FROM (SELECT doc_id, pos, line, CASE WHEN {_ASM} THEN 'asm' WHEN regexp_matches({STRIP("line")}, '^\d+\s+') THEN 'basic' END AS kind FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS pos FROM documents)) WHERE kind IS NOT NULL"""


@query("code_lines", f"SELECT doc_id, pos, kind FROM ({_LINES})")
def code_lines(spark, sf_dir):
    return C.code_lines(read(spark, sf_dir, "documents")).select("doc_id", "pos", "kind")


_BLOCKS = f"""SELECT doc_id, kind, CAST(min(pos) AS INT) AS first_line, count(*) AS n_lines, string_agg({STRIP("line")}, chr(10) ORDER BY pos) AS block
    FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) AS run FROM ({_LINES})) GROUP BY doc_id, kind, run"""


@query("code_blocks", _BLOCKS)
def code_blocks(spark, sf_dir):
    return C.code_blocks(read(spark, sf_dir, "documents"))


def _sql_pick(key: str, salt: str, n) -> str:
    return f"CAST(CAST(concat('0x', substr(md5(concat('{salt}', {key})), 1, 8)) AS BIGINT) % ({n}) AS INT)"


_KEY = "concat_ws(':', doc_id, kind, first_line)"
_RULES = "[" + ", ".join(f"'{c}'" for c in C.CONSTRAINTS) + "]"


def _sql_instruction() -> str:
    lists = {k: "[" + ", ".join(f"'{x}'" for x in v) + "]" for k, v in C.INSTRUCTIONS.items()}
    return f"(CASE WHEN kind = 'asm' THEN {lists['asm']} ELSE {lists['basic']} END)[1 + {_sql_pick(_KEY, 'i', 3)}]"


@query(
    "block_examples",
    f"""WITH b AS ({_BLOCKS})
    SELECT doc_id, kind, first_line, 'write' AS task, {_sql_instruction()} AS instruction,
      {_RULES}[1 + {_sql_pick(_KEY, "c", 4)}] || '; ' || {_RULES}[1 + ({_sql_pick(_KEY, "c", 4)} + 1 + {_sql_pick(_KEY, "d", 3)}) % 4] AS constraints, NULL AS input, block AS output FROM b
    UNION ALL
    SELECT doc_id, kind, first_line, 'repair', 'Repair this ' || kind || ' code', NULL,
      array_to_string(list_transform(l, lambda x, i: CASE WHEN i - 1 = spot THEN reverse(x) ELSE x END), chr(10)), block
    FROM (SELECT *, {_sql_pick(_KEY, "r", "len(l)")} AS spot FROM (SELECT *, string_split(block, chr(10)) AS l FROM b WHERE n_lines > 1))""",
)
def block_examples(spark, sf_dir):
    return C.block_examples(C.code_blocks(read(spark, sf_dir, "documents")))


PAIRS = [("Why does this crash?", "x", None), ("Explain the stack", "y", None), ("Set the border", "lda #$00\nsta $d020", None), ("Name a register", "plain", None), ("Explain a bug", "rts", "code"), ("It doesn't work", "lda", None)]


def _sql_type(instruction: str, output: str, given: str) -> str:
    rules = " ".join(f"WHEN {sql_any(f'lower({instruction if side == "instruction" else output})', needles)} THEN '{kind}'" for side, kind, needles in K.TYPE_RULES)
    return f"CASE WHEN {given} IS NOT NULL THEN {given} {rules} ELSE 'factual' END"


@query(
    "infer_type",
    f"""SELECT instruction, output, {_sql_type("instruction", "output", "given")} AS kind FROM (
    SELECT split_part(text, chr(10), 1) AS instruction, text AS output, CAST(NULL AS VARCHAR) AS given FROM documents
    UNION ALL SELECT * FROM ({values(PAIRS)}))""",
)
def infer_type(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(F.substring_index("text", "\n", 1).alias("instruction"), F.col("text").alias("output"), F.lit(None).cast("string").alias("given"))
    rows = rows.union(spark.createDataFrame(PAIRS, "instruction string, output string, given string"))
    return rows.select("instruction", "output", C.pair_type(F.col("instruction"), F.col("output"), F.col("given")).alias("kind"))


MESSAGES = ["Set the border colour of a sprite with a raster irq", "Play audio on the SID while the joystick moves", "Call CHROUT of the kernal", "hello", "BASIC or assembly?", "some asm please", "10 PRINT 1", "LDA #1"]
_ALL = f"SELECT text AS message FROM conversations UNION ALL SELECT * FROM ({values([(m,) for m in MESSAGES])})"


def _messages(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select(F.col("text").alias("message")).union(spark.createDataFrame([(m,) for m in MESSAGES], "message string"))


@query(
    "hints_multilabel",
    f"SELECT message, array_to_string(list_filter([{', '.join(f"CASE WHEN {sql_any('lower(message)', n)} THEN '{k}' END" for k, n in K.HINTS)}], lambda x: x IS NOT NULL), ',') AS labels FROM ({_ALL})",
)
def hints_multilabel(spark, sf_dir):
    return _messages(spark, sf_dir).select("message", F.array_join(C.hints(F.col("message")), ",").alias("labels"))


@query(
    "language_route",
    rf"""SELECT message, personality, CASE personality WHEN 'basic' THEN 0.4 WHEN 'assembly' THEN 0.2 END AS temperature, kind FROM (SELECT message,
    CASE WHEN contains(lower(message), 'basic') THEN 'basic' WHEN {sql_any("lower(message)", ["assembly", "asm"])} THEN 'assembly' END AS personality,
    CASE WHEN {sql_any("upper(message)", K.ASM_NEEDLES)} THEN 'asm' WHEN {sql_any("upper(message)", K.BASIC_NEEDLES)} OR regexp_matches({STRIP("message")}, '^\d+\s') THEN 'basic' END AS kind FROM ({_ALL}))""",
)
def language_route(spark, sf_dir):
    rows = _messages(spark, sf_dir).select("message", C.route(F.col("message")).alias("personality"), C.code_kind(F.col("message")).alias("kind"))
    return rows.select("message", "personality", F.when(F.col("personality") == "basic", 0.4).when(F.col("personality") == "assembly", 0.2).alias("temperature"), "kind")


@query("substring_search_multi", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'blue') OR contains(lower(p_brand), 'blue') OR contains(lower(p_type), 'blue')")
def substring_search_multi(spark, sf_dir):
    return C.search(read(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"], "BLUE").select("p_partkey", "p_name")


@query("paginate", "WITH n AS (SELECT greatest(0, (count(*) + 19) // 20 - 1) AS last FROM documents) SELECT doc_id, CAST(row_no AS BIGINT) AS row_no FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS row_no FROM documents), n WHERE row_no > least(7, last) * 20 AND row_no <= least(7, last) * 20 + 20")
def paginate(spark, sf_dir):
    return C.page(read(spark, sf_dir, "documents").select("doc_id"), 7, 20, "doc_id").select("doc_id", F.col("row_no").cast("bigint"))


@query(
    "head_preview",
    """SELECT doc_id, array_to_string(l[1:50], chr(10)) AS head, CAST(greatest(len(l) - 50, 0) AS INT) AS remaining, array_to_string(l[greatest(len(l) - 79, 1):], chr(10)) AS tail, replace(substr(text, 1, 60), chr(10), ' ') AS preview
    FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)""",
)
def head_preview(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", T.lines(F.col("text")).alias("l"))
    tail = F.slice("l", F.greatest(F.size("l") - 79, F.lit(1)), F.lit(80))
    return rows.select("doc_id", F.array_join(F.slice("l", 1, 50), "\n").alias("head"), F.greatest(F.size("l") - 50, F.lit(0)).alias("remaining"), F.array_join(tail, "\n").alias("tail"), F.replace(F.substring("text", 1, 60), F.lit("\n"), F.lit(" ")).alias("preview"))


URLS = ["http://www.a.example:8080/x.pdf", "https://me:pw@b.example/y.epub", "c.example/z", "https://d.example/w.html", "https://github.com/u/r", "https://www.youtube.com/watch?v=1"]


@query(
    "url_domain",
    rf"""SELECT url, substr(regexp_replace(CASE WHEN a <> '' THEN a ELSE p END, '^www\.', ''), 1, 50) AS domain,
    CASE WHEN ends_with(lower(url), '.pdf') THEN 'pdf' WHEN ends_with(lower(url), '.epub') THEN 'epub' WHEN contains(url, 'github.com') THEN 'repository' ELSE 'page' END AS route FROM (
    SELECT url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS a, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^?#]*)', 1) AS p
    FROM (SELECT url FROM pages UNION ALL SELECT * FROM ({values([(u,) for u in URLS])})))""",
)
def url_domain(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("url").union(spark.createDataFrame([(u,) for u in URLS], "url string"))
    low = F.lower("url")
    route = F.when(F.endswith(low, F.lit(".pdf")), "pdf").when(F.endswith(low, F.lit(".epub")), "epub").when(F.contains("url", F.lit("github.com")), "repository").otherwise("page")
    return rows.select("url", T.domain(F.col("url")).alias("domain"), route.alias("route"))


@query("href_extract", """SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY ALL""")
def href_extract(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return rows.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


NOTES = [(1, "see [[alpha]] and [[beta]] or [[alpha]]"), (2, "none"), (3, "[[gamma]] https://x.example/a, https://x.example/a. (https://y.example/b)"), (4, "[[beta]][[delta]]")]
NOTES_SQL = f"(SELECT * FROM ({values(NOTES)}) AS t(id, text))"


@query("wiki_links", rf"SELECT id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS pos, unnest(l) AS link FROM (SELECT id, regexp_extract_all(text, '\[\[(.*?)\]\]', 1) AS l FROM {NOTES_SQL})")
def wiki_links(spark, sf_dir):
    return spark.createDataFrame(NOTES, "id int, text string").select("id", F.posexplode(T.links(F.col("text"))).alias("pos", "link"))


@query("url_extract", f"SELECT * FROM ({values([(3, 'https://x.example/a'), (3, 'https://y.example/b')])}) AS t(id, url)")
def url_extract(spark, sf_dir):
    return spark.createDataFrame(NOTES, "id int, text string").select("id", F.explode(T.urls(F.col("text"))).alias("url"))


FENCES = [(1, "x\n```asm\nlda #1\nrts\n```\ny"), (2, "```\n10 PRINT 1\n```\n```basic\n20 GOTO 10\n```"), (3, "no code"), (4, "```6502\ninx\n```")]


@query("fenced_code", rf"SELECT id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS pos, unnest(l) AS code FROM (SELECT id, regexp_extract_all(text, '(?is)```(?:assembly|asm|6502|basic)?\n(.*?)\n```', 1) AS l FROM ({values(FENCES)}) AS t(id, text))")
def fenced_code(spark, sf_dir):
    return spark.createDataFrame(FENCES, "id int, text string").select("id", F.posexplode(T.fenced(F.col("text"))).alias("pos", "code"))


REPLIES = [(1, '```json\n[{"instruction": "a", "output": "b"}]\n```'), (2, '[{"instruction": "c", "output": "d"}, {"instruction": "e", "output": "f"}]'), (3, "not json"), (4, '```\n[{"instruction": "g", "output": "h"}]\n```')]


@query("fence_json_parse", f"SELECT * FROM ({values([(1, 'a', 'b'), (2, 'c', 'd'), (2, 'e', 'f'), (4, 'g', 'h')])}) AS t(id, instruction, output)")
def fence_json_parse(spark, sf_dir):
    bare = F.regexp_replace(T.strip(F.col("raw")), r"^```(?:json)?\s*|\s*```$", "")
    rows = spark.createDataFrame(REPLIES, "id int, raw string").select("id", F.from_json(bare, "array<struct<instruction:string,output:string>>").alias("p"))
    return rows.where("p is not null").select("id", F.inline("p")).where("instruction is not null")


@query(
    "chat_prompt_format",
    """SELECT conv_id, turn, '<|im_start|>system' || chr(10) || 'You help.' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || text || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || reply || '<|im_end|>' AS prompt
    FROM (SELECT *, lead(text) OVER w AS reply, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next = 'assistant'""",
)
def chat_prompt_format(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, sf_dir, "conversations").select("*", F.lead("text").over(w).alias("reply"), F.lead("role").over(w).alias("next"))
    return rows.where("role = 'user' and next = 'assistant'").select("conv_id", "turn", T.chat(F.lit("You help."), F.col("text"), F.lit(None).cast("string"), F.col("reply")).alias("prompt"))


@query("last_two_turns", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2 GROUP BY conv_id")
def last_two_turns(spark, sf_dir):
    last = read(spark, sf_dir, "conversations").withColumn("r", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where("r <= 2")
    said = F.sort_array(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("s"))))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(said, lambda x: x["s"]), "\n").alias("history"))
