"""Offline stand-ins for models: a hashing embedder and a lexical reranker."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    """What turns a text column into vectors; a model runs in an iterator pandas UDF."""

    def __call__(self, text: Column) -> Column: ...


class Reranker(Protocol):
    def __call__(self, query: Column, text: Column) -> Column: ...


def hashing_embedder(dims: int = 64):
    """Word counts hashed into ``dims`` slots: built-in functions only."""

    def embed(text: Column) -> Column:
        slots = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != ""), lambda t: F.pmod(F.xxhash64(t), F.lit(dims)))
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("float"))

    return embed


def lexical_reranker(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text holds."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != ""))
    return F.try_divide(F.size(F.array_intersect(words(query), words(text))), F.size(words(query)))
