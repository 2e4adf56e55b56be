"""Recursive character splitting: chunks of bounded length along the coarsest separators that do."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", ".", " ", "")


def split_text(text: str, size: int = 2000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters; neighbours share up to ``overlap`` characters of whole pieces.

    A text is cut after the first separator that it holds; pieces that are still too long are cut by the
    finer ones. Pieces are then packed in order. Without the shared ends, the chunks make up the text.
    """

    def cut(part: str, seps: tuple[str, ...]) -> list[str]:
        if len(part) <= size:
            return [part]
        for i, s in enumerate(seps):
            if s == "":
                return [part[j : j + size] for j in range(0, len(part), size)]
            if s in part:
                bits = [b + s for b in part.split(s)]
                bits[-1] = bits[-1][: len(bits[-1]) - len(s)]
                return [x for b in bits if b for x in cut(b, seps[i + 1 :])]
        return [part[j : j + size] for j in range(0, len(part), size)]

    out: list[str] = []
    held: list[str] = []
    length = fresh = 0
    for piece in cut(text, separators):
        if held and length + len(piece) > size:
            out.append("".join(held))
            fresh = 0
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
        fresh += 1
    if fresh:
        out.append("".join(held))
    return out


def split_documents(docs: DataFrame, text: str = "text", size: int = 2000, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk_ix, chunk) of every document, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def parts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t or "", size, overlap))

    return docs.select("doc_id", F.posexplode(parts(F.col(text))).alias("chunk_ix", "chunk"))
