"""Language, quality, mixing, packing and the pipeline."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import language_id as L
from loam.llm import mixing as M
from loam.llm import packing as P
from loam.llm import quality as Q
from loam.llm.common import Workspace
from loam.llm.words import size_in_words

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_language_held_out(spark, docs):
    got = L.op7_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [r["lang_pred"] == r["lang"] for r in got if r["held_out"]]
    assert np.mean(held) >= 0.95


def test_language_edges(spark):
    rows = [("en", "the cat and the dog"), ("fr", "le chat et le chien"), (None, "xyz"), ("en", None), ("de", "123")]
    model = L.train(spark.createDataFrame(rows, "lang string, text string"))
    assert model.langs == ["en", "fr"]
    asked = [(1, "The dog"), (2, "chien"), (3, None), (4, ""), (5, "12 !!"), (6, "chatte"), (7, "ж"), (8, "the " * 50_000), (9, "½ ² ⅷ ①"), (None, "le")]
    df = spark.createDataFrame(asked, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict(df, model, "doc_id").collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5, 6, 8, None)] == ["en", "fr", "und", "und", "und", "fr", "en", "fr"]
    assert got[9] == ("und", 0.0) and L.words("The½dog x² ⅷ") == ["the", "dog", "x"]
    assert got[3][1] == got[5][1] == 0.0 and got[7][0] in ("en", "fr")
    kept = L.identified(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= {1, 2, 6, 8, None}
    none = L.train(spark.createDataFrame([], "lang string, text string"))
    assert {r["lang_pred"] for r in L.predict(df, none, "doc_id").collect()} == {"und"}


def test_unlearned_languages_go(spark, docs):
    strange = [
        (-1, "Кошка спит на диване у окна, а на улице идёт дождь"), (-2, "猫在沙发上睡觉 外面下雨"), (-3, "Η γάτα κοιμάται δίπλα στο παράθυρο"),
        (-4, "Il gatto dorme sul divano vicino alla finestra mentre fuori piove e la gente cammina per strada"), (-5, "Kot śpi na kanapie przy oknie podczas gdy na zewnątrz pada deszcz"),
    ]
    rows = docs.select("doc_id", "lang", "text").unionByName(spark.createDataFrame([(i, None, t) for i, t in strange], "doc_id long, lang string, text string"))
    kept = {r["doc_id"] for r in pipeline.language_stage(spark, rows, "").collect()}
    assert not kept & {i for i, _ in strange}
    assert {r["doc_id"] for r in docs.where(L.fold(F.col("doc_id")) == 2).collect()} <= kept
    # with one language of almost all texts its prior is near 1, which mustn't stand for evidence
    skewed = rows.where("lang = 'en' or lang is null or doc_id % 10 = 0")
    assert not {r["doc_id"] for r in pipeline.language_stage(spark, skewed, "").collect()} & {i for i, _ in strange}


def test_backoff_takes_the_longest_known():
    model = L.Model(["a", "b"], np.zeros(2), {"word": 0}, np.array([[-1.0, -2.0]]), [{"z": 0}, {"<z": 0}], [np.array([[-5.0, -1.0]]), np.array([[-1.0, -5.0]])])
    assert model.unseen("zz").argmax() == 0 and model.unseen("yz").argmax() == 1
    assert (model.unseen("q") == 0).all()


def test_quality_against_labels(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = Q.judged(docs, Q.train(docs), "doc_id").join(labels, "doc_id").collect()
    clean = [r["keep"] for r in rows if r["quality"] == 1]
    junk = [not r["keep"] for r in rows if r["quality"] == 0]
    assert np.mean(clean) >= 0.98 and np.mean(junk) >= 0.9


def test_every_shape_is_a_feature():
    texts = [" ".join("#" * (1 + i % 30) + "a!" * (1 + i // 30) for i in range(200)), "x" + "#" * 40, "x" + "#" * 41]
    many, one, other = (Q.features(Q._measured(t)) for t in texts)
    assert len(many) > 150 and one != other


def test_quality_edges(spark, docs):
    model = Q.train(docs)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A plain sentence of plain words, as any."), (5, "A!! B!! " * 200), (6, "word " * 100_000), (None, "x"), (7, "\x1c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep", F.lit("clash"))
    got = {r["doc_id"]: (r["score"], r["keep"]) for r in Q.judged(df, model, "doc_id").collect()}
    assert got[1] == got[2] == got[3] == (0.0, False)
    assert got[4][1] and not got[5][1] and not got[6][1]
    kept = Q.clean_only(df, model)
    assert kept.columns == df.columns and 4 in {r["doc_id"] for r in kept.collect()}
    assert Q.judged(df.limit(0), Q.train(df.limit(0)), "doc_id").count() == 0


def test_estimation_finds_the_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.7
    right = [0.95, 0.9, 0.8, 0.7]
    votes = np.stack([np.where(rng.random(20_000) < 0.3, Q.NONE, np.where(rng.random(20_000) < p, truth, ~truth)) for p in right], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, rates = Q.estimate(patterns, counts.astype(float), kinds=[range(4)])
    assert abs(prior[0] - 0.7) < 0.05
    for j, p in enumerate(right):
        assert abs(rates[0, j, Q.CLEAN] / (1 - rates[0, j, Q.NONE]) - p) < 0.06


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= x) - x for x in lengths)


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, 60, 40).tolist() + [0] * 5
    ends, counts = np.unique(lengths, return_counts=True)
    for k in (1, 2, 3):
        got = P.boundaries(ends, counts, ends * counts, k)
        best = min(padding(lengths, [*c, max(ends)]) for c in itertools.combinations(ends[:-1].tolist(), min(k, len(ends)) - 1))
        assert len(got) <= k and padding(lengths, got) == best
    assert P.boundaries(ends[:0], counts[:0], counts[:0], 3) == []
    assert padding(lengths, P.boundaries(ends, counts, ends * counts, 200)) == 0


def test_bins(spark):
    x = [0, 1, 2048, 2049, 3000, 5001, 10**6, 2**31]
    got = [(r["x"], r["e"]) for r in spark.createDataFrame([(v,) for v in x], "x long").select("x", P.bin_end(F.col("x")).alias("e")).collect()]
    for v, e in got:
        assert e >= v and (e == v if v <= 2048 else e - v <= v / 1000)


def test_batches(spark, docs):
    rows = P.packed(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    batches = {}
    for r in rows:
        assert r["padding"] == r["bucket_length"] - r["length"] >= 0
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for (bucket, batch), held in batches.items():
        assert len({r["bucket_length"] for r in held}) == 1
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
        assert len(held) * held[0]["bucket_length"] <= P.BUDGET or len(held) == 1
    odd = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "a b"), (3, "w " * 40_000)], "doc_id long, text string").withColumn("length", F.lit("clash"))
    assert sorted(r["length"] for r in P.packed(odd).collect()) == [0, 0, 0, 2, 40_000]
    assert P.packed(odd.limit(0)).count() == 0


def test_targets(spark):
    sizes = {"a": 100, "b": 10, "c": 1000, "d": 5, None: 50}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: (r["source_size"], r["weight"], r["target"]) for r in M.targets(Workspace(spark, "t"), df).collect()}
    assert {s: w for s, (_, w, _) in got.items()} == {"a": 3, "b": 1, "c": 2, "d": 3, None: 1}
    free, share, want = dict(got), 1.5 * sum(sizes.values()), {}
    while True:
        level = (share - sum(want.values())) / sum(w for _, w, _ in free.values())
        full = {s for s, (n, w, _) in free.items() if level * w >= 2 * n}
        if not full:
            want |= {s: level * w for s, (_, w, _) in free.items()}
            break
        want |= {s: 2.0 * free.pop(s)[0] for s in full}
    assert {s: t for s, (_, _, t) in got.items()} == pytest.approx(want)


def test_mix(spark, docs):
    got = M.op10_mixing(spark, "/root/testdata/sf0.01").collect()
    again = {r["doc_id"]: r["taken"] for r in M.op10_mixing(spark, "/root/testdata/sf0.01").collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got} and len(got) == docs.count()
    taken = {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken.setdefault((r["source"], r["target"]), []).append(r["taken"])
    for (_, target), t in taken.items():
        assert abs(sum(t) - target) <= 0.03 * target


def test_mix_edges(spark):
    rows = [(1, "a b", "x"), (2, None, "x"), (3, "", None), (4, "c " * 5000, None), (None, "d", "y"), (1, "a b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = M.mixed(df)
    assert out.columns == df.columns
    for r in out.groupBy(*df.columns).count().collect():
        assert r["count"] <= 2 * sum(x[0] == r["doc_id"] for x in rows)
    assert M.mixed(df.limit(0)).count() == 0


def test_word_sizes(spark):
    rows = [(None, 0), ("", 0), (" a\tb\x0bc\x1fd e ", 3), ("x" * 10**6, 1), ("é ü", 2)]
    df = spark.createDataFrame(rows, "t string, n int")
    assert all(r["n"] == r["s"] for r in df.withColumn("s", size_in_words(F.col("t"))).collect())


def test_pipeline_stages(spark, docs):
    sf, at, names = "/root/testdata/sf0.01", docs, docs.columns
    ws = Workspace(spark, "stages")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = [docs]
    for _, stage in pipeline.STAGES:
        at = ws.table(stage(spark, at, sf))
        seen.append(at)
        if len(seen) < 6:
            assert at.columns == names
    ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in seen]
    assert all(b <= a for a, b in itertools.pairwise(ids))
    clean = [i for i in ids[0] if labels.get(i) == 1]
    assert np.mean([i in ids[1] for i in clean]) >= 0.98
    assert len(ids[2]) >= 0.98 * len(ids[1])
    from tests.llm.test_pairs import by_force

    rows = [(r["doc_id"], r["text"]) for r in seen[2].collect()]
    assert ids[3] == set(by_force(rows, 5, 80).values())
    assert seen[5].count() == seen[4].count()


def test_pipeline_on_an_empty_table(spark, docs):
    at, ws = docs.limit(0), Workspace(spark, "stages")
    for _, stage in pipeline.STAGES:
        at = ws.table(stage(spark, at, ""))
    assert at.count() == 0


def test_ngrams_are_counted_as_defined():
    from collections import Counter

    wide = ["".join(chr(0x4E00 + 97 * i + j) for j in range(12)) for i in range(200)]  # five of so many characters don't fit 62 bits
    for found in (["a", "the", "them", "été", "𝔘a"], wide * 3):
        langs, n = [("en", "fr")[i % 2] for i in range(len(found))], list(range(1, len(found) + 1))
        want: Counter = Counter()
        for lang, word, times in zip(langs, found, n, strict=True):
            for size in range(1, L.LONGEST + 1):
                for g in L.grams(word, size):
                    want[lang, size, g] += times
        got = [tuple(r.values()) for batch in L._tally(langs, found, n) for r in batch.to_pylist()]
        assert len(got) == len(want) and {r[:3]: r[3] for r in got} == want


def test_unseen_words_are_scored_together(monkeypatch):
    model = L.Model(["a", "b"], np.zeros(2), {"word": 0}, np.array([[-1.0, -2.0]]), [{"z": 0}, {"<z": 0, "zz": 1}], [np.array([[-5.0, -1.0]]), np.array([[-1.0, -5.0], [-3.0, -4.0]])])
    texts = [*(f"word z{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)), None, "", "1", "word", "q"]
    asked, back_off = [], L.Model.back_off
    monkeypatch.setattr(L.Model, "back_off", lambda self, found: asked.append(len(found)) or back_off(self, found))
    monkeypatch.setattr(L.Scorer, "KEPT", 100)
    got = list(L.Scorer(model).judge(texts))
    assert len(got) == len(texts) and sum(asked) == 301 and len(asked) < 10  # not one by one
    for text, (lang, score, evidence) in zip(texts, got, strict=True):
        found = L.words(text or "")
        rows = [model.table[0] if w == "word" else back_off(model, [w])[0][0] for w in found]
        total = np.sum(rows, axis=0) if found else None
        assert (lang, score) == (("und", 0.0) if not found else (model.langs[int(total.argmax())], pytest.approx(1 / np.exp(total - total.max()).sum())))
        assert evidence == (0 if not found else pytest.approx(np.mean([w == "word" or "<z" in f"<{w}" or "zz" in w for w in found])))


def test_stage_tables_have_no_checksum_files(spark):
    from pathlib import Path

    ws = Workspace(spark, "plain")
    back = ws.table(spark.range(100).repartition(3))
    names = [p.name for p in Path(back._loam_path.removeprefix("file://")).iterdir()]
    assert sum(n.endswith(".parquet") for n in names) == 3 and not any(n.endswith(".crc") for n in names)
    assert sorted(r["id"] for r in back.collect()) == list(range(100))
    assert spark.sparkContext._jsc.hadoopConfiguration().get("fs.file.impl") != "org.apache.hadoop.fs.RawLocalFileSystem"  # the session's own files are as before
    ws.drop(back)
    assert not Path(back._loam_path.removeprefix("file://")).exists()
