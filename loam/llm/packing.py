"""Operator 9: packing into optimal length buckets.

The global histogram of lengths (one row a distinct length) decides the bucket boundaries: dynamic
programming finds the ``buckets`` boundaries for which padding every document to its bucket's boundary
adds the fewest tokens. Inside a bucket, batches of ``budget // boundary`` documents (one at least)
form in the order of length and doc_id, so a batch never exceeds the token budget unless a single
document does, which is then a batch of its own. No document is cut or dropped.

The histogram comes to the driver and is bounded: lengths up to ``EXACT`` have a bin each, longer ones
are binned by 1 / 1024 of their power of two, so a length of 2**31 adds 21 x 1024 bins at most. The
programme is exact for boundaries at bin ends. Ranks in buckets are range-partitioned running totals:
a bucket with a third of all rows spreads over many tasks.

A document's length is its number of tokens under op4's tokenizer, without an end id; ``packed`` takes
another measure of texts where a caller gives one, and counts words where none is given.

Null and empty texts have length 0 and lie in the first bucket. Repeated rows are packed as often as
they occur.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import Workspace, running_totals
from loam.llm.token_files import size_in_tokens
from loam.llm.words import size_in_words

BUCKETS, BUDGET, EXACT = 16, 16_384, 2_048


def bin_end(length: Column) -> Column:
    """The largest length of a length's bin."""
    step = F.when(length <= EXACT, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(1)))) - 10)).cast("long")
    return (F.ceil(length / step) * step).cast("long")


def boundaries(ends: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int) -> list[int]:
    """Ascending boundaries, at most ``buckets``, with the least padding in all.

    ends: ascending bin ends; counts and sums: documents and tokens of each bin. With C and S the
    running counts and sums, the best cost of the first j bins is ``U_j C_j - S_j`` plus the least of
    ``best_i + S_i - U_j C_i``: lines in U_j whose slopes fall as i grows, met with growing U_j, so the
    lower hull is walked once for each bucket.
    """
    m = len(ends)
    if not m:
        return []
    u = [int(x) for x in ends]
    c = [0, *np.cumsum(counts).tolist()]
    s = [0, *np.cumsum(sums).tolist()]
    best = [0] + [None] * m
    origin: list[list[int]] = []
    for _ in range(min(buckets, m)):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i
        at, after, came = 0, list(best), [-1] * (m + 1)
        for j in range(1, m + 1):
            if best[j - 1] is not None:
                line = (-c[j - 1], best[j - 1] + s[j - 1], j - 1)
                while len(hull) >= 2 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
                at = min(at, len(hull) - 1)
            while at + 1 < len(hull) and hull[at + 1][0] * u[j - 1] + hull[at + 1][1] <= hull[at][0] * u[j - 1] + hull[at][1]:
                at += 1
            cost = hull[at][0] * u[j - 1] + hull[at][1] + u[j - 1] * c[j] - s[j]
            if after[j] is None or cost < after[j]:
                after[j], came[j] = cost, hull[at][2]
        best = after
        origin.append(came)
    out, j, b = [], m, len(origin) - 1
    while j > 0:
        while origin[b][j] < 0:  # a bucket fewer was as good
            b -= 1
        out.append(u[j - 1])
        j = origin[b][j]
        b -= 1
    return out[::-1]


def pack(ws: Workspace, sized: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """sized (doc_id, length) with bucket, bucket_length, batch, slot and padding.

    bucket counts from 0, batch from 0 inside its bucket, slot from 0 inside its batch.
    """
    bins = sized.groupBy(bin_end(F.col("length")).alias("end")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens")).toPandas().sort_values("end")
    bounds = boundaries(bins["end"].to_numpy(), bins["n"].to_numpy(), bins["tokens"].to_numpy(), buckets)
    ends = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array(F.lit(0).cast("long"))
    dealt = sized.withColumn("bucket", F.size(F.filter(ends, lambda b: b < F.col("length"))).cast("int")).withColumn("bucket_length", F.get(ends, F.col("bucket")))
    ranked = running_totals(ws, dealt, ["bucket"], [F.col("length"), F.col("doc_id")], "length", ("_rank", "_before"))
    room = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1))), F.lit(1)).cast("long")
    return (
        ranked.withColumn("batch", F.floor(F.col("_rank") / room).cast("long")).withColumn("slot", F.pmod("_rank", room)).withColumn("padding", F.col("bucket_length") - F.col("length")).drop("_rank", "_before")
    )


def packed(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, size: Callable[[Column], Column] = size_in_words) -> DataFrame:
    """Every document packed by ``size`` of its text, in whose unit the budget is."""
    ws = Workspace(docs.sparkSession, "pack")
    sized = ws.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size(F.col("text")).alias("length")))
    return pack(ws, sized, buckets, budget)


def packed_by_tokens(docs: DataFrame) -> DataFrame:
    """Every document packed by its number of tokens, the budget in tokens."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return packed(docs, size=lambda text: size_in_tokens(text, path))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return packed_by_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
