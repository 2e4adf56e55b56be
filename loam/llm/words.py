"""Word counts of a text column, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.llm.shingles import text_buffers, word_hashes


def word_counts(column: pa.Array) -> np.ndarray:
    data, at = text_buffers(column)
    parts = [np.diff(words_at) for *_, words_at, _, _ in word_hashes(data, at)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def size_in_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as a long; 0 for null."""

    def count(column: pa.Array) -> pa.Array:
        return pa.array(word_counts(column), pa.int64())

    return F.arrow_udf(count, "long")(text.cast("string"))
