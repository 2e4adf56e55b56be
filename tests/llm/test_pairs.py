"""Near duplicates of texts and vectors, components and neighbours against brute force."""

from __future__ import annotations

import random
import re
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loam.llm import ann, embedding_dedup, jaccard_join
from loam.llm.common import Workspace
from loam.llm.components import connected_components
from loam.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < k else (tuple(words[i : i + k]) for i in range(len(words) - k + 1)))


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def by_force(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    holders = {}
    for n, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(n)
    near = {(a, b) for h in holders.values() for j, a in enumerate(h) for b in h[j + 1 :]}
    links = []
    for a, b in near:
        both = len(sets[a][1] & sets[b][1])
        if 100 * both >= percent * (len(sets[a][1]) + len(sets[b][1]) - both):
            links.append((sets[a][0], sets[b][0]))
    return components({i for i, _ in sets}, links)


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_of_documents(spark, sf, k, percent):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs, k, percent).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = by_force(rows, k, percent)
    assert {i: c for i, (_, c) in got.items()} == want
    assert {i: n for i, (n, _) in got.items()} == {i: len(shingles(t, k)) for i, t in rows}


def variants(seed, n, words, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(edits)):
            text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize(("short", "small", "ordered"), [(8, 32, 200_000), (1, 2, 200_000), (1, 4, 1)])
def test_jaccard_of_large_groups(spark, monkeypatch, short, small, ordered):
    """A cluster of many variants, copies of one text, and passages that texts share which link or just don't."""
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "ORDERED", ordered)
    texts = variants(1, 150, 120, 9) + variants(8, 90, 40, 4) + ["one text of a few words that many copy"] * 120
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"q{i}.{j}" for j in range(30)) for i in range(60)]
    texts += [passage + " " + " ".join(f"r{i}.{j}" for j in range(4 + i % 6)) for i in range(90)]
    rows = list(enumerate(texts))
    random.Random(2).shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 4, 85).collect()}
    assert got == by_force(rows, 4, 85)


def test_groups_of_one_prefix(spark, monkeypatch):
    """Texts of one size and prefix whose tails differ are members of one group, and compared with each other."""
    monkeypatch.setattr(jaccard_join, "ORDERED", 1)  # so that hashes alone order shingles
    monkeypatch.setattr(jaccard_join, "SMALL", 4)
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    texts = []
    for _ in range(60):
        text = list(base)
        at = rng.randrange(60)
        for j in range(1 + rng.randrange(2)):
            text[at + 5 * j] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(text))
    sets = list(shingle_sets(pa.array(texts), 4))
    prefixes = Counter((len(s), s[: jaccard_join.prefix_length(len(s), 85)].tobytes()) for s in {s.tobytes(): s for s in sets}.values())
    assert max(prefixes.values()) > 4  # more than SMALL
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == by_force(rows, 4, 85)


def test_jaccard_in_lots(spark, monkeypatch):
    """Tests of pairs dealt into many lots find the same links, and parities of sets of unlike sizes are compared."""
    draw = random.Random(5)
    rows = []
    for _ in range(6):
        base = [str(draw.randrange(400)) for _ in range(draw.choice([40, 1000, 1020]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(draw.randrange(6)):
                copy[draw.randrange(len(copy))] = str(draw.randrange(400))
            rows.append((len(rows), " ".join(copy + [str(draw.randrange(400)) for _ in range(draw.randrange(40) if len(base) > 40 else 0)])))
    for name, n in (("LOT", 40), ("SHINGLES", 40_000), ("CENTRED", 30), ("SHORT", 4), ("SMALL", 4)):
        monkeypatch.setattr(jaccard_join, name, n)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == by_force(rows, 4, 85)


def test_long_texts_that_differ_are_not_compared_whole(spark):
    draw = random.Random(6)
    rows = [(i, " ".join(["one shared run of words", *(str(draw.randrange(10**6)) for _ in range(n))])) for i, n in enumerate([5000, 5200, 4000, 4300])]
    none = np.zeros(0, np.uint64)
    schema = "doc_id long, n long, f1 long, f2 long, h1 long, h2 long, prefix array<long>, odd array<long>"
    sketches = spark.createDataFrame([*rows, (9, rows[0][1] + " and more")], "doc_id long, text string").mapInArrow(jaccard_join._sketch(5, 80, none, none.view(np.int64)), schema)
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (0, 9), (3, 9)], "x long, y long")
    assert [(r["x"], r["y"]) for r in jaccard_join._within_reach(pairs, sketches, 80).collect()] == [(0, 9)]


@pytest.mark.parametrize("left", [16, 0])
def test_rounds_end_when_few_pairs_are_left(spark, monkeypatch, left):
    """A group just over SMALL is enumerated where its pairs are few beside the table, and linked alike where it is recentred."""
    near = [" ".join(f"w{j}" if j != i else f"x{i}" for j in range(60)) for i in range(36)]
    rows = list(enumerate([*near, *(" ".join(f"y{i}z{j}" for j in range(6)) for i in range(600))]))
    rounds, labels = [], jaccard_join._near_labels
    monkeypatch.setattr(jaccard_join, "LEFT", left)
    monkeypatch.setattr(jaccard_join, "_near_labels", lambda links: rounds.append(1) or labels(links))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 0 if i < 36 else i for i, _ in rows}
    assert bool(rounds) == (left == 0)


def test_jaccard_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", "b"), (4, "Short One", None), (5, "short one", "c"), (6, "short  one\n", "c"), (None, "short one", "d"), (7, "long " * 50_000, "e"), (8, "long " * 50_000, "e"), (5, "short one", "c"), (9, "shört one", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").withColumn("n", F.lit(1)).withColumn("token", F.lit("x"))
    got = jaccard_join.jaccard_components(docs, 4, 85).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in got) == [(-1, 1, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (6, 1, 4), (7, 1, 7), (8, 1, 7), (9, 1, 9)]
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 7, 9]
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_jaccard_leaves_little_behind(spark):
    """Shuffle files and the tables that no later step reads are gone when the result is there."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for d in manager.localDirs() for f in Path(d.getPath()).rglob("shuffle_*.data")}
    tables = lambda: {f for f in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("loam-jaccard-*/*")}
    texts = variants(3, 60, 80, 6) + ["a few words that are copied"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before, had = shuffled(), tables()
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs, 4, 85).collect()}
    assert got == by_force(list(enumerate(texts)), 4, 85)
    kept = {c for f in tables() - had for c in spark.read.parquet(str(f)).columns}
    assert kept and not kept & {"prefix", "set", "packed", "token", "tokens"}
    end = time.time() + 20
    while shuffled() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - before


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(80)]
    edges += [(7, 7), (9, 3), (9, 3), (3, 9)]
    df = spark.createDataFrame([*edges, (None, 4)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(Workspace(spark, "test"), df).collect()}
    want = components({x for e in edges for x in e}, edges)
    loops = {x for e in edges for x in e} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {i: c for i, c in want.items() if i not in loops}
    assert connected_components(Workspace(spark, "test"), df.limit(0)).count() == 0


def vectors(n=300, d=16, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d))
    base[n // 3 : n // 2] = base[0] + 0.15 * rng.standard_normal((n // 2 - n // 3, d))
    base[n // 2 : n // 2 + 30] = base[1]
    return base


@pytest.mark.parametrize("held", [0, 20, 10_000])
def test_components_ended_by_the_driver(spark, monkeypatch, held):
    from loam.llm import components as module

    monkeypatch.setattr(module, "HELD", held)
    draw = random.Random(8)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)]
    got = {r["id"]: r["component"] for r in connected_components(Workspace(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == components({v for a, b in edges if a != b for v in (a, b)}, [(a, b) for a, b in edges if a != b])


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 40)  # several chunks a cell
    monkeypatch.setattr(embedding_dedup, "PANEL", 16)
    m = vectors()
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [1.0] * 15 + [None]), (1003, [float("nan")] + [1.0] * 15), (1004, [1.0, 2.0]), (1005, [2.0, 4.0]), (1006, []), (1007, [float("inf")] * 16), (None, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("key", F.lit(1)).withColumn("node", F.lit(2))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)]
    root = components(range(len(m)), links)
    for i in range(len(m)):
        assert got[i] == (int(near[i].sum()), root[i], root[i] == i)
    assert got[1004] == (1, 1004, True) and got[1005] == (1, 1004, False)
    for i in (1000, 1001, 1002, 1003, 1006, 1007):
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, False)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_every_row_of_a_repeated_id_stays(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (2, None), (2, [0.0, 0.0]), (2, [float("nan"), 1.0]), (3, [0.0, 1.0]), (3, []), (None, [1.0, 0.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect())
    assert got[2:] == [(1, 1, 1), (2, 0, 2), (2, 0, 2), (2, 0, 2), (2, 1, 1), (3, 0, 3), (3, 0, 3)]
    assert got[:2] == [(-1, 0, None)] * 2


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "ASKED", 8)
    monkeypatch.setattr(ann, "SHORT", 48)
    m = vectors(800, 16, 6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit(1))
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 800, 20))
    hits = 0
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda x: (-x[2], x[1]))
        scores = m @ m[q]
        for _, v, s in found:
            assert v != q and abs(scores[v] - s) < 1e-9
        best = sorted((i for i in range(800) if i != q), key=lambda i: (-(m[i] * m[q]).sum(), i))[:20]
        hits += len(set(best) & {v for _, v, _ in found})
    assert hits / (20 * len(got)) >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r["vec_id"]) for r in ann.search(few, few.where("vec_id = 0"), 20).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_of_every_dimension_and_id(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHORT", 4)
    monkeypatch.setattr(ann, "PROBED", 0.1)
    m = vectors(300, 8, 9)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(0, [9.0 * float(x) for x in m[0]])] * 40
    rows += [(1000 + i, [1.0, float(i)]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), 50).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sorted(got) == [*range(0, 300, 20), 1000]
    assert sorted(got.pop(1000)) == [1001, 1002, 1003, 1004]
    for q, found in got.items():
        assert len(found) == 50 and q not in found


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = df.orderBy("vec_id").collect()
    ids, m = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    hits = 0
    for q, found in got.items():
        score = m @ m[ids == q][0]
        best = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        hits += len(found & set(ids[best].tolist()))
    assert hits / (20 * len(got)) >= 0.9
