"""Column expressions on text: whitespace, needles, links, fences, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space at either end; SQL's trim removes spaces only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def any_of(c: Column, needles: list[str]) -> Column:
    """Whether a text holds one of the needles."""
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(c, F.lit(needle))
    return found


def distinct_hits(c: Column, needles: list[str]) -> Column:
    """How many of the needles a text holds."""
    total = F.lit(0)
    for needle in needles:
        total = total + F.contains(c, F.lit(needle)).cast("int")
    return total


def collapse_blank_runs(stripped: Column) -> Column:
    """An array of stripped lines without a blank line that follows a blank line (or opens the text)."""
    return F.filter(stripped, lambda x, i: (x != "") | ((i > 0) & (F.get(stripped, i - 1) != "")))


def links(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\[\[(.*?)\]\]"), F.lit(1))


def fenced(c: Column) -> Column:
    """Bodies of fenced code blocks."""
    return F.regexp_extract_all(c, F.lit(r"(?is)```(?:assembly|asm|6502|basic)?\n(.*?)\n```"), F.lit(1))


def urls(c: Column) -> Column:
    """Distinct absolute URLs in order, without punctuation that ends a sentence."""
    found = F.regexp_extract_all(c, F.lit(r"""https?://[^\s<>"')\]}\[|，、]+"""), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"""[.,:;!?)'"]+$""", "")))


def domain(url: Column) -> Column:
    """Authority (or path, without one) less a leading www., 50 characters at most."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^?#]*)", 1)
    return F.substring(F.regexp_replace(F.when(authority != "", authority).otherwise(path), r"^www\.", ""), 1, 50)


def title_case(stem: Column) -> Column:
    """Underscores to spaces; every letter that follows a non-letter upper, every other lower."""
    parts = F.regexp_extract_all(F.lower(F.replace(stem, F.lit("_"), F.lit(" "))), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")


def human_size(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.format_string("%.1f MB", n / float(1 << 20)))


def words(c: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != ""))


def chat(system: Column, user: Column, extra: Column, reply: Column) -> Column:
    """A conversation in the markup of chat models; ``extra`` is left out where it is null or empty."""
    asks = F.when(F.coalesce(extra, F.lit("")) != "", F.concat(F.lit("Input:\n"), extra, F.lit("\n"))).otherwise("")
    return F.concat(F.lit("<|im_start|>system\n"), system, F.lit("<|im_end|>\n<|im_start|>user\n"), user, F.lit("\n"), asks, F.lit("<|im_end|>\n<|im_start|>assistant\n"), reply, F.lit("<|im_end|>"))
