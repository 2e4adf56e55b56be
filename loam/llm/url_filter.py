"""Operator 3: URL filters with redirect equivalence, by DataFrame operations alone.

Rules ``host/path`` block or allow a host, its subdomains and what lies below a path; the longest rule
that fits a URL decides it. URLs that redirects or canonical links connect are aliases: connected
components over those edges carry decisions to aliases that no rule fits. In a component one allowed
URL allows every such alias, else one blocked URL blocks them; without either, they are allowed.

A URL's key is its host (A-Z lower-cased), path and query; scheme and fragment don't tell URLs apart.
Keys are compared as 64-bit hashes. Edge ends count with their own rules, fetched or not. A null URL or
one without ``://`` has an empty host and path, fits no rule, has no alias and is allowed. Repeated rows
each get their row. The rules are a list of the driver's, and become one literal in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import Workspace
from loam.llm.components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def key(url: Column) -> Column:
    """The hash that stands for a URL; null where there is no host."""
    rest = F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(host(url) != "", F.xxhash64(host(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def decision(url_host: Column, url_path: Column, rules=RULES) -> Column:
    """struct(rule, action) of the longest rule that fits, else null; allow goes before block at one length."""
    ranked = sorted(rules, key=lambda r: (-len(r[1]), r[0], r[1]))
    if not ranked:
        return F.lit(None).cast("struct<h:string,p:string,rule:string,action:string>")
    table = F.array(*[F.struct(F.lit(t.partition("/")[0].lower()).alias("h"), F.lit(t[len(t.partition("/")[0]) :]).alias("p"), F.lit(t).alias("rule"), F.lit(a).alias("action")) for a, t in ranked])
    fits = lambda r: ((url_host == r["h"]) | F.endswith(url_host, F.concat(F.lit("."), r["h"]))) & F.startswith(url_path, r["p"])
    return F.get(F.filter(table, fits), 0)


def _resolved(base: Column, link: Column) -> Column:
    """An absolute URL for a link found in a page at ``base``."""
    link = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.concat(scheme, F.lit("://"), host(base))
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .when((link == "") | F.startswith(link, F.lit("#")), F.lit(None))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) URLs: canonical links and immediate refreshes that the pages' own markup states."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    tag = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv")).select("url", F.explode(tags).alias("tag"))
    canonical = F.col("tag").rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?\s*canonical\b")
    refresh = F.col("tag").rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b")
    value = r"(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    quoted = lambda name: F.concat(*[F.regexp_extract("tag", rf"(?is)\b{name}\s*=\s*{value}", i) for i in (1, 2, 3)])
    target = F.regexp_extract(quoted("content"), r"(?is)\burl\s*=\s*[\"']?([^\"']*)", 1)
    link = F.when(canonical, quoted("href")).when(refresh, target)
    found = tag.where(canonical | refresh).select("url", link.alias("link"))
    return found.select(F.col("url").alias("src"), _resolved(F.col("url"), F.col("link")).alias("dst")).where("dst is not null")


def filter_urls(pages: DataFrame, rules=RULES, edges: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages (page_id, url).

    edges: (src, dst) URLs of redirects and canonical links, in either direction.
    """
    ws = Workspace(pages.sparkSession, "urls")

    def judged_urls(df: DataFrame, column: str) -> DataFrame:
        """df with host, path, k and the rule d of its URL, a step at a time so that each is evaluated once."""
        df = df.withColumns({"host": host(F.col(column)), "path": path(F.col(column)), "k": key(F.col(column))})
        return df.withColumn("d", decision(F.col("host"), F.col("path"), rules))

    own = judged_urls(pages.select("page_id", "url"), "url").select("page_id", "host", "path", F.col("d.rule").alias("rule"), F.col("d.action").alias("action"), "k")
    if edges is None:
        return own.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"))
    own = ws.table(own)
    stated = ws.table(edges.select("src", "dst").withColumn("e", F.monotonically_increasing_id()))
    ends = judged_urls(stated.select("e", F.explode(F.array("src", "dst")).alias("url")), "url").select("e", "k", F.col("d.action").alias("action"))
    ends = ws.table(ends.where("k is not null"))
    links = ends.groupBy("e").agg(F.min("k").alias("a"), F.max("k").alias("b"))
    component = connected_components(ws, links)
    known = ends.where("action is not null").select("k", "action").distinct()
    judged = known.join(component, known["k"] == component["id"]).groupBy("component").agg(F.min("action").alias("shared"))  # allow < block
    alias = component.join(judged, "component").select(F.col("id").alias("k"), "shared")
    # URLs with a rule and rows without a key need no alias; they don't meet at a null key
    asks = own.where("action is null and k is not null").join(alias, "k", "left").withColumn("verdict", F.coalesce("shared", F.lit("allow")))
    rest = own.where("action is not null or k is null").withColumn("verdict", F.coalesce("action", F.lit("allow")))
    out = ["page_id", "host", "path", "rule", "verdict"]
    return asks.select(*out).unionByName(rest.select(*out))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, RULES, page_edges(pages))


ORACLE_SQL = r"""
WITH RECURSIVE rules(action, rule) AS (VALUES ('block','com/en/'), ('allow','example.com/en/7'), ('allow','net/de/'), ('block','example.net/de/8'), ('block','org/es/')),
r AS (SELECT action, rule, split_part(rule, '/', 1) AS h, substr(rule, length(split_part(rule, '/', 1)) + 1) AS p FROM rules),
tag AS (SELECT url AS src, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) AS tag FROM pages),
edge AS (SELECT src, replace(regexp_extract(tag, '(?is)\bhref\s*=\s*["'']([^"'']*)', 1), '&amp;', '&') AS dst FROM tag WHERE regexp_matches(tag, '(?is)\brel\s*=\s*["'']?\s*canonical')),
url AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT src FROM edge UNION ALL SELECT dst FROM edge) WHERE url IS NOT NULL),
u AS (SELECT url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM url),
v AS (SELECT url, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM u),
w AS (SELECT v.*, host || CASE WHEN tail = '' THEN '/' ELSE tail END AS k,
  (SELECT max_by(struct_pack(rule := rule, action := action), length(rule)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS d FROM v),
e AS (SELECT a.k AS a, b.k AS b FROM edge JOIN w a ON a.url = src JOIN w b ON b.url = dst WHERE a.host <> '' AND b.host <> ''),
reach(a, b) AS (SELECT a, b FROM (SELECT a, b FROM e UNION SELECT b, a FROM e) UNION SELECT reach.a, x.b FROM reach JOIN (SELECT a, b FROM e UNION SELECT b, a FROM e) x ON reach.b = x.a),
shared AS (SELECT reach.a AS k, min(d.action) AS action FROM reach JOIN w ON w.k = reach.b GROUP BY 1)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, d.rule AS rule, coalesce(d.action, shared.action, 'allow') AS verdict
FROM pages LEFT JOIN w USING (url) LEFT JOIN shared USING (k)
"""
