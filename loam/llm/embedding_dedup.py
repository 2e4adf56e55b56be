"""Operator 5: near duplicates among embeddings by a subspace pigeonhole join.

Unit vectors with cosine >= c are within squared distance ``D = 2 (1 - c)``. Rotated and split into
blocks, two such vectors are within the proportional budget ``D_b = D * dims_b / dims`` in one block at
least, else the blocks' distances would sum to more than D. So each block is range-joined under its
budget and the union of the blocks' candidates is verified on the original vectors in double precision.

The range join of a block puts vectors into cells of width ``sqrt(D_b)`` along the block's first axis;
partners lie in the same or the next cell. Cells are cut into chunks of about ``CHUNK`` vectors, and a
pair of chunks is a *tile*, the unit of work: bounded in memory whatever a cell holds. A pair is
counted in the first block that brings it together. A tile returns, for each of its vectors with a
link, the number of links and the least partner of a spanning forest, never the pairs themselves.

Copies of a vector are one node with a weight. The cells are few, as coordinates lie within -1 and 1:
their sizes are what the driver reads. Vectors that are null, empty, zero or hold null or non-finite
components, and rows without an id, link with nothing; vectors of different lengths never link. Rows
that share a vec_id with different vectors count as one vertex; a row whose own vector can't take part
links with nothing, whatever other rows of its vec_id hold.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import Workspace
from loam.llm.components import connected_components
from loam.llm.vectors import by_dimension, is_usable, unit

BLOCKS, CHUNK, COSINE = 4, 8192, 0.95
#: Rows and columns compared at a time, and candidates verified at a time.
PANEL, SLICE = 1024, 1 << 15


@lru_cache(maxsize=8)
def rotation(d: int) -> np.ndarray:
    """A fixed pseudo-random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(20_240_607 + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def blocks(d: int) -> list[slice]:
    ends = [d * (b + 1) // min(BLOCKS, d) for b in range(min(BLOCKS, d))]
    return [slice(a, b) for a, b in zip([0, *ends], ends, strict=False)]


def budgets(d: int, cosine: float) -> list[float]:
    return [(2 * (1 - cosine) + 1e-9) * (s.stop - s.start) / d for s in blocks(d)]


def cells(turned: np.ndarray, cosine: float) -> np.ndarray:
    """The cell of each row in each block."""
    d = turned.shape[1]
    width = np.sqrt(np.array(budgets(d, cosine))) * (1 + 1e-6)
    return np.floor(turned[:, [s.start for s in blocks(d)]] / np.maximum(width, 1e-12)).astype(np.int64)


def _census(cosine: float):
    def run(batches):
        for batch in batches:
            for d, _, m in by_dimension(batch.column(0)):
                at = cells(unit(m) @ rotation(d), cosine)
                for b in range(at.shape[1]):
                    cell, n = np.unique(at[:, b], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), x)) for x in (d, b)] + [pa.array(cell), pa.array(n)], names=["d", "b", "cell", "n"])

    return run


def _deal(cosine: float, chunks: dict[tuple[int, int, int], int]):
    """A row for each tile that a vector takes part in; side 0: left, 1: right, 2: both."""

    def run(batches):
        for batch in batches:
            node = batch.column(0).to_numpy()
            for d, rows, m in by_dimension(batch.column(2)):
                at = cells(unit(m) @ rotation(d), cosine)
                for b in range(at.shape[1]):
                    tiles, sides, whose = [], [], []
                    for cell in np.unique(at[:, b]):
                        own = rows[at[:, b] == cell]
                        many, above, below = (chunks.get((d, b, int(cell) + x), 0) for x in (0, 1, -1))
                        chunk = (node[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % many
                        for i in range(many):
                            mine = own[chunk == i]
                            if not len(mine):
                                continue
                            meets = [(f"{d},{b},{cell},{min(i, j)},{cell},{max(i, j)}", 2 if i == j else int(j < i)) for j in range(many)]
                            meets += [(f"{d},{b},{cell},{i},{cell + 1},{j}", 0) for j in range(above)]
                            meets += [(f"{d},{b},{cell - 1},{j},{cell},{i}", 1) for j in range(below)]
                            for tile, side in meets:
                                tiles += [tile] * len(mine)
                                sides += [side] * len(mine)
                                whose.append(mine)
                    take = pa.array(np.concatenate(whose))
                    yield pa.RecordBatch.from_arrays([pa.array(tiles, pa.string()), pa.array(sides, pa.int32()), *[batch.column(i).take(take) for i in range(3)]], names=["tile", "side", "node", "weight", "embedding"])

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> None:
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)


def _tile(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        d, block = (int(x) for x in table.column("tile")[0].as_py().split(",")[:2])
        order = np.argsort(table.column("node").to_numpy(), kind="stable")
        node, weight, side = (table.column(c).to_numpy()[order] for c in ("node", "weight", "side"))
        _, _, m = next(by_dimension(table.column("embedding")))
        u = unit(m[order])
        y = u @ rotation(d)
        cut, most = blocks(d), budgets(d, cosine)
        coarse = y[:, cut[block]].astype(np.float32)
        norm = (coarse * coarse).sum(axis=1)
        left, right, both = np.flatnonzero(side != 1), np.flatnonzero(side != 0), bool(len(side) and side[0] == 2)
        links, parent = np.zeros(len(node), np.int64), np.arange(len(node))
        for i in range(0, len(left), PANEL):
            p = left[i : i + PANEL]
            for j in range(0, len(right), PANEL):
                q = right[j : j + PANEL]
                if both and q[-1] < p[0]:
                    continue
                near = norm[p, None] + norm[None, q] - 2 * (coarse[p] @ coarse[q].T) <= most[block] + 1e-5
                a, b = np.nonzero(near)
                a, b = p[a], q[b]
                if both:
                    a, b = a[a < b], b[a < b]
                for k in range(0, len(a), SLICE):
                    x, z = a[k : k + SLICE], b[k : k + SLICE]
                    good = (u[x] * u[z]).sum(axis=1) >= cosine
                    x, z = x[good], z[good]
                    apart = (y[x] - y[z]) ** 2
                    within = [apart[:, s].sum(axis=1) <= top for s, top in zip(cut, most, strict=True)]
                    first = within[block] & ~np.logical_or.reduce([np.zeros(len(x), bool), *within[:block]])
                    x, z = x[first], z[first]
                    np.add.at(links, x, weight[z])
                    np.add.at(links, z, weight[x])
                    _roots(len(node), x, z, parent)
        some = np.flatnonzero(links)
        for x in some:
            while parent[parent[x]] != parent[x]:
                parent[x] = parent[parent[x]]
        return pa.table({"node": node[some], "links": links[some], "root": node[parent[some]]})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding)."""
    ws = Workspace(vectors.sparkSession, "vectors")
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding")
    taking_part = is_usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    held = ws.table(rows.select("vec_id", F.when(taking_part, F.md5(F.to_json(F.struct("embedding")).cast("binary"))).alias("key"), "embedding"))
    nodes = ws.table(held.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding")))
    census = nodes.select("embedding").mapInArrow(_census(cosine), "d long, b long, cell long, n long").groupBy("d", "b", "cell").agg(F.sum("n").alias("n")).collect()
    chunks = {(r["d"], r["b"], r["cell"]): -(-r["n"] // CHUNK) for r in census}
    element = nodes.schema["embedding"].dataType.simpleString()
    dealt = nodes.select("node", "weight", "embedding").mapInArrow(_deal(cosine, chunks), f"tile string, side int, node long, weight long, embedding {element}")
    found = ws.table(dealt.groupBy("tile").applyInArrow(_tile(cosine), "node long, links long, root long"))
    component = connected_components(ws, found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("key", "node", "weight").join(linked, "node", "left").join(component.withColumnRenamed("id", "node"), "node", "left")
    known = known.select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    some = held.where("key is not null").select("vec_id", "key").join(known, "key").select("vec_id", "n_links", "component_id")
    none = held.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.95),
reach(a, b) AS (SELECT a, b FROM p UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
c AS (SELECT a AS vec_id, least(a, min(b)) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM v LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
