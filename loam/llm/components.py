"""Connected components of an edge list, by DataFrame operations alone.

Each round every vertex of a remaining edge hooks onto the neighbour (or itself) with the smallest
pseudo-random priority of that round, and the edges are contracted to the vertices hooked onto. The
priorities change with every round, so long monotone chains don't occur and the vertices shrink by a
constant factor a round: O(log n) rounds are expected, whatever the ids look like. Once ``HELD`` edges or
fewer are left, the driver ends it.

Hot vertices: the minimum over a vertex's neighbours is a partial aggregate, and the relabelling
joins are plain shuffle joins, which adaptive execution splits at a skewed key. Every round's tables
are written below the shared folder, so no round's loss repeats an earlier one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import Workspace

#: Edges left at which the driver ends the rounds: 16 bytes each, and a round is a dozen queries' plans.
HELD = 50_000


def _roots(edges: pa.Table) -> pa.Table:
    """(id, root) of every vertex of edges (a, b)."""
    top: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := top.setdefault(v, v)) != v:
            top[v] = v = top[up]
        return v

    for a, b in zip(edges["a"].to_pylist(), edges["b"].to_pylist(), strict=True):
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    kind = edges.schema.field("a").type
    return pa.table({"id": pa.array(list(top), kind), "root": pa.array([root(v) for v in list(top)], kind)})


def connected_components(ws: Workspace, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every vertex with an edge, and the smallest id it can reach.

    Self loops, repeated and reversed edges and rows with a null end are harmless. Vertices without
    an edge don't appear; the caller's outer join gives them their own id.
    """
    e = F.col
    left = ws.table(
        edges.where(e(a) != e(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    )
    hooks: list[DataFrame] = []
    while n := left.count():
        if n <= HELD:
            hooks.append(ws.table(left.sparkSession.createDataFrame(_roots(left.toArrow()), f"id {left.schema['a'].dataType.simpleString()}, root {left.schema['b'].dataType.simpleString()}")))
            break
        turn = len(hooks)
        both = left.select(e("a").alias("id"), e("b").alias("to")).unionByName(left.select(e("b").alias("id"), e("a").alias("to")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), e(c)).alias("p"), e(c).alias("v"))  # noqa: B023, E731
        hook = ws.table(both.groupBy("id").agg(F.min(rank("to")).alias("m")).select("id", F.least(e("m"), rank("id"))["v"].alias("root")))
        hooks.append(hook)
        first = left.join(hook.select(e("id").alias("a"), e("root").alias("ra")), "a")
        both_ends = first.join(hook.select(e("id").alias("b"), e("root").alias("rb")), "b")
        after = ws.table(both_ends.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        ws.drop(left)
        left = after
    if not hooks:
        return left.select(e("a").alias("id"), e("b").alias("component"))
    # From the last round back: a vertex's final root is the final root of what it hooked onto.
    final = hooks[-1]
    for hook in reversed(hooks[:-1]):
        last = final.select(e("id").alias("root"), e("root").alias("top"))
        final = ws.table(hook.join(last, "root", "left").select("id", F.coalesce("top", "root").alias("root")))
    least = final.groupBy("root").agg(F.min("id").alias("component"))
    return ws.table(final.join(least, "root").select("id", "component"))
