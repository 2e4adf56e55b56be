"""Text of HTML pages and EPUB books, in Arrow batches."""

from __future__ import annotations

import io
import zipfile
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


class _Text(HTMLParser):
    """Text nodes outside script and style. One flag says whether to skip, however deep the elements lie."""

    def __init__(self) -> None:
        super().__init__()
        self.kept: list[str] = []
        self.skip = False

    def handle_starttag(self, tag, attrs):
        self.skip = self.skip or tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip = self.skip and tag not in ("script", "style")

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.kept.append(data.strip())


def page_text(page: str | None) -> str:
    parser = _Text()
    parser.feed(page or "")
    parser.close()
    return "\n".join(parser.kept)


def book_text(content: bytes) -> str:
    """Texts of a book's pages, in the order of the archive; an unreadable archive has none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            return "\n".join(page_text(book.read(n).decode("utf-8", "replace")) for n in book.namelist() if n.lower().endswith((".xhtml", ".html", ".htm")))
    except zipfile.BadZipFile:
        return ""


@F.pandas_udf(StringType())
def html_text(pages: pd.Series) -> pd.Series:
    return pages.map(page_text)


@F.pandas_udf(StringType())
def epub_text(books: pd.Series) -> pd.Series:
    return books.map(book_text)


def extracted(binary: DataFrame, extractor) -> DataFrame:
    """binary files (path, content) with their text by a pluggable extractor column function, as for PDF."""
    return binary.select("path", extractor(F.col("content")).alias("text"))
