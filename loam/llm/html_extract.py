"""Operator 2: main text of web pages by a maximum-scoring subsequence.

A page is read once into a sequence of words and tags. Words score positive, tags negative, with
weights learned from labelled pages: those that mark their content with one ``article`` or ``main``
element show which words and tags lie inside and which outside. One linear scan finds the contiguous
region with the greatest sum, and the region's words are the text.

What a page marks as something else is no content wherever it lies: menus, headers, footers, sidebars,
forms, adverts, notices and comments, by element name or by a word of class, id or role. Such an
element counts as a single tag in the sequence, so that an advert between two paragraphs doesn't part
them, and its words are left out. An element that class, id or role would set apart but that holds most
of the page's content, as a wrapper of class "has-sidebar" does, is not: the scan decides about what lies
in it. Scripts, styles, comments of the markup and other elements without
running text are skipped.

Character references are decoded, white space inside a block becomes one space, blocks are joined by
one space in page order. Null and empty pages, and pages without words, give an empty text; every row
of the input gives one row. Unclosed elements end with the element around them.

The weights come to the driver: one row for each element name of HTML (others count as one), at most
``2 * len(NAMES)`` rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import small_batches

#: Element names of HTML, by what they do here.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = "script|style|noscript|template|textarea|select|svg|math|iframe|object|canvas|audio|video|title|map|datalist"
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
NAMES = INLINE | VOID | BLOCKS
ASIDE = frozenset("nav header footer aside form menu dialog button fieldset".split())
MARKED = frozenset("article main".split())
#: Words of class, id or role that say that an element is no content.
APART = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promos?|promotions?|banner|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|signup"
    r"|menus?|nav|navbar|navigation|navlinks|breadcrumbs?|sidebar|side|rail|widgets?|header|footer|masthead|comments?|disqus|replies|reply|respond|share|sharing|social|related|recommended|recirc"
    r"|copyright|legal|login|search|searchbox|toolbar|pagination|pager|complementary|contentinfo|form)(?:$|[\s_-])",
    re.I,
)
#: Elements that are never set apart by a class.
WHOLE = frozenset("html body main article".split())

#: What stands in a tag. It ends at a bare "<" too: quotes being only of two kinds, no character is then read from
#: more than three tags that don't end, so the search stays linear. Such a tag ends at its first ">".
_WITHIN = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({SILENT})\b(?:{_WITHIN}|[^>]*>).*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_WITHIN})|<(/?)([a-zA-Z][^\s/>]*)([^>]*>)|<[!?/][^>]*>",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def tokens(page: str) -> Iterator[re.Match]:
    """The tags and comments of a page. Behind its last ">" no tag can end, and only a comment is sought."""
    last, at = page.rfind(">") + 1, 0
    while m := TOKEN.search(page, at, last):
        if m.end() == last and (m[1] or m[0].startswith("<!--")):
            m = TOKEN.match(page, m.start())  # it may go on to the end
        yield m
        at = m.end()
    at = page.find("<!--", max(at, last))
    if at >= 0:
        yield TOKEN.match(page, at)


def _apart(name: str, attributes: str) -> bool:
    if name in ASIDE:
        return True
    if not attributes or name in WHOLE:
        return False
    return any(APART.search(next(x for x in m if x) if any(m) else "") for m in ATTRIBUTE.findall(attributes))


def _wrappers(page: str) -> set[int]:
    """Where elements begin that class, id or role would set apart, but that hold most of the page's content.

    Content is the words in ``article`` and ``main``, or all where there are none; those in elements set
    apart by name don't count.
    """
    open_: list[tuple[str, tuple[int, int, int] | None]] = []  # with the place and the counts before it, if set apart
    names: Counter = Counter()
    words = inside = asides = marked = at = 0
    held: list[tuple[int, int, int]] = []

    def close() -> str:
        nonlocal asides, marked
        name, began = open_.pop()
        names[name] -= 1
        asides -= name in ASIDE
        marked -= name in MARKED
        if began:
            held.append((began[0], words - began[1], inside - began[2]))
        return name

    for m in tokens(page):
        if m.start() > at and not asides:
            n = len(page[at : m.start()].split())
            words, inside = words + n, inside + n * (marked > 0)
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name or name in VOID:
            continue
        closing, attributes = (m[2], m[4]) if m[3] else (m[5], m[7])
        if not closing:
            apart = name not in ASIDE and _apart(name, attributes)
            if apart or name not in INLINE or names[name]:
                open_.append((name, (m.start(), words, inside) if apart else None))
                names[name] += 1
                asides += name in ASIDE
                marked += name in MARKED
        elif names[name]:
            while close() != name:
                pass
    if at < len(page) and not asides:
        n = len(page[at:].split())
        words, inside = words + n, inside + n * (marked > 0)
    while open_:
        close()
    return {start for start, n, k in held if (2 * k > inside if inside else 2 * n > words)}


def sequence(page: str) -> Iterator[tuple[str, str, bool]]:
    """(kind, value, marked) in page order: ("text", decoded text), ("tag", name) and ("gap", name).

    marked: whether it lies in an ``article`` or ``main`` element. A gap is an element set apart.
    """
    open_: list[str] = []  # block elements around
    names: Counter = Counter()  # how often each is open
    hidden = None  # how many were open when one set apart began
    wrappers = None
    marked = 0
    at = 0
    for m in tokens(page):
        if m.start() > at and hidden is None:
            yield "text", html.unescape(page[at : m.start()]), marked > 0
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        closing, attributes = (m[2], m[4]) if m[3] else (m[5], m[7])
        apart = hidden is None and not closing and name not in VOID and _apart(name, attributes)
        if apart and name not in ASIDE:
            wrappers = _wrappers(page) if wrappers is None else wrappers
            apart = m.start() not in wrappers
        if apart:
            yield "gap", name if name in NAMES else "other", marked > 0
            hidden = len(open_)
            open_.append(name)
            names[name] += 1
            continue
        if name in VOID or name in INLINE:
            # An inline element set apart, as a span of class "ad", ends with its own end tag.
            if closing and hidden is not None and names[name] and name in open_[hidden:]:
                at_ = hidden + open_[hidden:].index(name)
                names.subtract(open_[at_:])
                del open_[at_:]
            elif not closing and hidden is not None and name in INLINE and name == open_[hidden]:
                open_.append(name)
                names[name] += 1
        elif not closing:
            open_.append(name)
            names[name] += 1
            marked += name in MARKED and hidden is None
        elif names[name]:
            while True:
                last = open_.pop()
                names[last] -= 1
                if last in MARKED and (hidden is None or len(open_) < hidden):
                    marked -= 1
                if last == name:
                    break
        if hidden is not None:
            if len(open_) <= hidden:
                hidden = None
        else:
            yield "tag", name if name in NAMES else "other", marked > 0
    if at < len(page) and hidden is None:
        yield "text", html.unescape(page[at:]), marked > 0


#: Bounds of the weights: a word never counts against its region, a tag never for it.
LEAST_WORD, LEAST_TAG, MOST = 0.25, 0.05, 4.0
#: Of an element set apart (its words don't join the region), and of tags and words never seen.
GAP, UNSEEN_TAG, UNSEEN_WORD = 0.25, 0.5, 1.0


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The text of the contiguous region with the greatest score; the first of equal ones."""
    if not page:
        return ""
    items: list[tuple[bool, str]] = []  # (starts a block, text)
    best, best_from, best_to = 0.0, 0, 0
    run, start, breaks, link = 0.0, 0, True, False
    for kind, value, _ in sequence(page):
        if kind == "text":
            n = len(value.split())
            score = n * weights.get("a word" if link else "word", UNSEEN_WORD)
            items.append((breaks, value))
            breaks = False
        else:
            score = -GAP if kind == "gap" else -weights.get(value, UNSEEN_TAG)
            if value == "a":
                link = kind == "tag" and not link
            breaks = breaks or value not in INLINE
        if run <= 0:
            run, start = 0.0, len(items) - (kind == "text")
        run += score
        if run > best:
            best, best_from, best_to = run, start, len(items)
    blocks: list[list[str]] = []
    for begins, text in items[best_from:best_to]:
        if begins or not blocks:
            blocks.append([])
        blocks[-1].append(text)
    return " ".join(x for b in blocks if (x := " ".join("".join(b).split())))


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside, outside = Counter(), Counter()
    for batch in batches:
        for page in batch.column(0).to_pylist():
            if not page or not re.search(r"<(?:article|main)\b", page, re.I):
                continue
            link = False
            for kind, value, marked in sequence(page):
                if kind == "tag" and value == "a":
                    link = not link
                if kind == "text":
                    value, n = ("a word" if link else "word"), len(value.split())
                elif kind == "gap" or value in MARKED or value in ("html", "body", "head"):
                    continue
                else:
                    n = 1
                (inside if marked else outside)[value] += n
    kinds = sorted({*inside, *outside})
    yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([inside[k] for k in kinds], pa.int64()), pa.array([outside[k] for k in kinds], pa.int64())], names=["kind", "inside", "outside"])


def learn_weights(pages: DataFrame) -> dict[str, float]:
    """Sizes of the weights of words and tags, from the pages that mark their content.

    A word's weight is the logarithm of its odds of lying inside, a tag's that of its odds of lying
    outside.
    """
    rows = pages.select("html").mapInArrow(_labelled, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    out = {}
    for r in rows:
        odds = math.log((r["inside"] + 1) / (r["outside"] + 1))
        out[r["kind"]] = min(MOST, max(LEAST_WORD, odds)) if r["kind"].endswith("word") else min(MOST, max(LEAST_TAG, -odds))
    return out


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    small_batches(pages.sparkSession)
    weights = learn_weights(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, weights) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
