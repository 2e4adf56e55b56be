"""Queries on intervals, graphs, sync, upserts, evaluation and status."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import constants as K
from loam.functions import text as T
from loam.operators import tables as O
from loam.plans.generation import _OFFSETS, _offsets
from loam.plans.registry import query, read, sql_list, values


@query(
    "interval_collisions",
    f"""WITH o AS ({_OFFSETS}), a AS (SELECT doc_id AS id, start AS s, start + n - 1 AS e FROM o), m AS (SELECT max(e) AS top FROM a), w AS (SELECT unnest(range(0, CAST((SELECT top FROM m) AS BIGINT) + 1, 4096)) AS s)
    SELECT a.id AS a_id, CAST(w.s // 4096 AS BIGINT) AS b_id FROM a JOIN w ON greatest(a.s, w.s) <= least(a.e, w.s + 4095)""",
)
def interval_collisions(spark, sf_dir):
    docs = _offsets(spark, sf_dir).select(F.col("doc_id").alias("id"), "start", (F.col("start") + F.col("_len") - 1).alias("end"))
    top = docs.agg(F.max("end")).first()[0] or 0
    windows = spark.range(top // 4096 + 1).select("id", (F.col("id") * 4096).alias("start"), (F.col("id") * 4096 + 4095).alias("end"))
    return O.overlaps(docs, windows, 4096)


RANGES = [(1, 0x0310, 0x0320), (2, 0xC000, 0xCFFF), (3, 0x0000, 0xFFFF), (4, 0x07F8, 0x07FF), (5, 0x1000, 0x10FF), (6, 0xFFFE, 0xFFFE)]
TAKEN = [(0xC100, 0xC1FF, "player"), (0x1080, 0x1200, "table")]
_RANGES = f"(SELECT * FROM ({values(RANGES)}) AS t(id, s, e))"


@query("region_safety", f"SELECT id, coalesce(string_agg(name, ', ' ORDER BY n), '') AS conflicts FROM {_RANGES} LEFT JOIN (SELECT * FROM ({values([(i, *c) for i, c in enumerate(K.CRITICAL)])}) AS c(n, rs, re, name)) ON greatest(s, rs) <= least(e, re) GROUP BY id")
def region_safety(spark, sf_dir):
    rows = spark.createDataFrame(RANGES, "id int, start int, end int")
    return O.regions_hit(rows, K.CRITICAL).select("id", F.array_join("conflicts", ", ").alias("conflicts"))


_ALL_TAKEN = values([(i, s, e, n) for i, (s, e, n) in enumerate(TAKEN + [(v, v, n) for v, n in K.VECTORS])])


@query("point_in_interval", f"SELECT id, (SELECT arg_min(name, n) FROM ({_ALL_TAKEN}) AS v(n, vs, ve, name) WHERE NOT (ve < s OR vs > e)) AS collision FROM {_RANGES}")
def point_in_interval(spark, sf_dir):
    return O.first_collision(spark.createDataFrame(RANGES, "id int, start int, end int"), TAKEN).select("id", "collision")


@query("safe_area", f"SELECT place, start FROM (SELECT * FROM ({values(list(enumerate(K.PROPOSED)))}) AS p(place, start)) WHERE NOT EXISTS (SELECT 1 FROM ({_ALL_TAKEN}) AS v(n, vs, ve, name) WHERE NOT (ve < start OR vs > start + 4095)) ORDER BY place LIMIT 1")
def safe_area(spark, sf_dir):
    return O.safe_area(spark, TAKEN)


_V2 = "CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END"


@query("sync_classify", f"WITH s AS (SELECT doc_id, md5(text) AS m FROM documents WHERE doc_id % 5 <> 0), c AS (SELECT CASE WHEN s.doc_id IS NULL THEN 'new' WHEN s.m <> md5({_V2.replace('doc_id', 'd.doc_id').replace('text', 'd.text')}) THEN 'updated' ELSE 'unchanged' END AS class FROM documents d LEFT JOIN s USING (doc_id)) SELECT class, count(*) AS n FROM c GROUP BY class")
def sync_classify(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), "doc_id", "text")
    state = docs.where("doc_id % 5 <> 0").select("name", F.md5(F.col("text").cast("binary")).alias("md5"))
    rows = docs.select("name", F.expr(_V2).alias("content"))
    return O.sync_classes(rows, state).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("upsert_replace", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels")
def upsert_replace(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    return O.upsert(labels, labels.where("doc_id % 3 = 0").withColumn("quality", (1 - F.col("quality")).cast("int")), "doc_id").select("doc_id", "quality", "toxic")


_EDGES = "SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM supplier, orders JOIN customer ON o_custkey = c_custkey, lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = s_suppkey"


def _edges(spark, sf_dir):
    """Which nation's suppliers deliver to which nation's customers."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    met = lines.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    met = met.join(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst")), F.col("o_custkey") == F.col("c_custkey"))
    met = met.join(read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src")), F.col("l_suppkey") == F.col("s_suppkey"))
    return met.select("src", "dst").distinct()


@query("graph_degree", f"WITH e AS ({_EDGES}) SELECT node, sum(o) AS n_out, sum(i) AS n_in FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node")
def graph_degree(spark, sf_dir):
    return O.degrees(_edges(spark, sf_dir))


_GROUPS = "SELECT n_nationkey AS node, r_name AS g FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name < 'B'"


@query("graph_proxy", f"WITH e AS ({_EDGES}), g AS ({_GROUPS}) SELECT DISTINCT coalesce(f.g, CAST(src AS VARCHAR)) AS src, coalesce(t.g, CAST(dst AS VARCHAR)) AS dst FROM e LEFT JOIN g f ON f.node = src LEFT JOIN g t ON t.node = dst WHERE (f.g IS NULL) <> (t.g IS NULL)")
def graph_proxy(spark, sf_dir):
    groups = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name < 'B'").select(F.col("n_nationkey").alias("node"), F.col("r_name").alias("group"))
    edges = _edges(spark, sf_dir)
    return O.proxy_edges(edges.select(F.col("src").cast("string"), F.col("dst").cast("string")), groups.withColumn("node", F.col("node").cast("string")))


@query("graph_semijoin", f"SELECT src, dst FROM ({_EDGES}) WHERE src IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) AND dst IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)")
def graph_semijoin(spark, sf_dir):
    return O.existing_edges(_edges(spark, sf_dir), read(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("node"))).select("src", "dst")


@query("graph_neighbours", f"SELECT src, dst FROM ({_EDGES}) WHERE src = 3 OR dst = 3")
def graph_neighbours(spark, sf_dir):
    return _edges(spark, sf_dir).where("src = 3 or dst = 3")


@query("group_centroid", "SELECT label, count(*) AS members, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS x, round(avg(CAST(embedding[2] AS DOUBLE)), 6) AS y FROM embeddings GROUP BY label")
def group_centroid(spark, sf_dir):
    at = lambda i: F.round(F.avg(F.get("embedding", i).cast("double")), 6)
    return read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("members"), at(0).alias("x"), at(1).alias("y"))


EXPECTED = ["the", "of", "ing", "der", "que"]


@query("coverage_score", f"SELECT conv_id, turn, array_to_string(p, ',') AS passed, round(100.0 * len(p) / {len(EXPECTED)}, 6) AS coverage, round(length(text) / 4.0 / 2.0, 6) AS tokens_per_sec FROM (SELECT *, list_filter({sql_list(EXPECTED)}, lambda w: contains(lower(text), w)) AS p FROM conversations WHERE role = 'assistant')")
def coverage_score(spark, sf_dir):
    rows = O.coverage(read(spark, sf_dir, "conversations").where("role = 'assistant'"), "text", EXPECTED)
    return rows.select("conv_id", "turn", F.array_join("passed", ",").alias("passed"), F.round("coverage", 6).alias("coverage"), F.round(O.throughput(F.length("text"), F.lit(2.0)), 6).alias("tokens_per_sec"))


@query("label_filter_stats", "SELECT source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS toxic, round(100.0 * sum(quality) / count(*), 6) AS good_percent FROM documents JOIN labels USING (doc_id) GROUP BY source")
def label_filter_stats(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id").groupBy("source")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"), F.round(F.try_divide(100.0 * F.sum("quality"), F.count(F.lit(1))), 6).alias("good_percent"))


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("status_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def status_counts(spark, sf_dir):
    out = None
    for t in TABLES:
        one = read(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("source_sizes", "SELECT source, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CASE WHEN sum(strlen(text)) < 1024 THEN 'B' WHEN sum(strlen(text)) < 1048576 THEN 'KB' ELSE 'MB' END AS unit FROM documents GROUP BY source")
def source_sizes(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).alias("bytes"))
    return rows.select("source", "files", "bytes", F.regexp_extract(T.human_size(F.col("bytes")), "([A-Z]+)$", 1).alias("unit"))


@query("anti_join_new_urls", "SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def anti_join_new_urls(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select("url").distinct().join(pages.where("page_id % 3 = 0").select("url"), "url", "left_anti")


@query("event_windows", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """Our own extension: hourly windows of the events table, the batch form of the streaming aggregate."""
    rows = read(spark, sf_dir, "events").groupBy("event_type", F.window(F.col("ts"), "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select("event_type", F.col("w.start").alias("hour"), "n", "total")
