"""Units whose scenarios the given tables don't hold."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loam.functions import backends as B
from loam.functions import text as T
from loam.functions.embed import hashing_embedder, lexical_reranker
from loam.functions.session import checkpointed
from loam.operators import chunks, corpus, generation, programs, render, retrieval, tables
from loam.sources import files, markup, sinks
from loam.streaming.sync import sync_stream


def one(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_titles(spark):
    df = spark.createDataFrame([("c64-x_o'neil",), ("élan_vital 2nd",), ("",)], "s string")
    assert [r[0] for r in df.select(T.title_case(F.col("s"))).collect()] == ["C64-X O'Neil", "Élan Vital 2Nd", ""]


def test_blank_runs(spark):
    df = spark.createDataFrame([(1, "\n\n a \n\n\n\tb\n \n"), (2, ""), (3, None)], "doc_id int, text string")
    assert {r["doc_id"]: r["clean"] for r in corpus.clean(df).collect()} == {1: "a\n\nb\n", 2: "", 3: None}


def test_chunks_make_up_the_text():
    text = "".join(f"Sentence {i} of a text. " + ("\n\n" if i % 9 == 0 else "") for i in range(400)) + "".join(f"{i}," for i in range(1500))
    parts = chunks.split_text(text, 300, 40)
    assert all(0 < len(p) <= 300 for p in parts)
    at = 0
    for p in parts:  # each begins inside or at the end of what came before
        start = text.index(p, max(0, at - 40 - 300))
        assert start <= at
        at = max(at, start + len(p))
    assert at == len(text) and chunks.split_text("", 10, 2) == [""] or chunks.split_text("", 10, 2) == []


def test_split_documents(spark):
    df = spark.createDataFrame([(1, "a b " * 2000), (2, None)], "doc_id int, text string")
    rows = chunks.split_documents(df, size=100, overlap=10).collect()
    assert all(len(r["chunk"]) <= 100 for r in rows) and {r["doc_id"] for r in rows} >= {1}


def test_greedy_is_sequential(spark):
    """A-B and B-C are similar, A-C isn't: A and C stay. Components would keep A alone."""
    ids = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    pairs = checkpointed(spark.createDataFrame([(1, 2), (2, 3), (4, 5), (4, 6), (5, 6), (6, 7)], "a long, b long"))
    assert one(retrieval.greedy_keep(ids, pairs, "id").where("kept"), "id") == [(1,), (3,), (4,), (7,)]


def test_greedy_of_copies_is_that_of_all_pairs(spark, monkeypatch):
    """Groups of copies and near copies, ids with several sets, and rows without an id or a word: as by all pairs."""
    import random

    monkeypatch.setattr(retrieval, "FIRST", 2)
    monkeypatch.setattr(retrieval, "LEADERS", 4)
    draw, rows = random.Random(3), []
    for _ in range(5):
        base = [f"w{draw.randrange(30)}" for _ in range(14)]
        rows += [" ".join(draw.choice([base, base, base[:-1], base[2:], [*base[4:], "new", f"w{draw.randrange(30)}"]])) for _ in range(9)]
    draw.shuffle(rows)
    rows = [*enumerate(rows), *((draw.randrange(45), t) for t in rows[::5]), (50, ""), (51, None), (None, rows[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {}
    for i, t in rows:
        sets.setdefault(i, set()).add(frozenset((t or "").split()))
    kept = {None}
    for i in sorted(x for x in sets if x is not None):
        if not any(5 * len(a & b) > 3 * len(a | b) for j in kept if j is not None for a in sets[j] for b in sets[i]):
            kept.add(i)
    got = retrieval.greedy_distinct(docs, "doc_id", "text", 60).collect()
    assert sorted(((r["doc_id"], r["kept"]) for r in got), key=str) == sorted(((i, i in kept) for i, _ in rows), key=str)


def test_greedy_leaves_no_shuffles(spark, sf):
    """What the similarity join and the rounds shuffled is gone when the result is there."""
    import time
    from pathlib import Path

    from loam.plans.retrieval import greedy_neardup

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for d in manager.localDirs() for f in Path(d.getPath()).rglob("shuffle_*.data")}
    before = shuffled()
    assert len(greedy_neardup(spark, sf).collect()) == spark.read.parquet(f"{sf}/documents.parquet").count()
    end = time.time() + 20
    while shuffled() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - before


def test_jaccard_in_lots(spark, monkeypatch):
    """The pairs of brute force, whatever the lots; rows without an id are in none (before: paired as their partner's own id)."""
    for name, value in (("PAIRS", 40), ("WORDS", 500), ("ORDERED", 20)):
        monkeypatch.setattr(retrieval, name, value)
    rows = [(i if i % 9 else None, " ".join(f"w{(i * i + j * (1 + i % 4)) % 23}" for j in range(3 + i % 12))) for i in range(1, 70)]
    sets = [(i, set(t.split())) for i, t in rows if i is not None]
    want = {(a, b) for a, x in sets for b, y in sets if a < b and 100 * len(x & y) > 60 * len(x | y)}
    got = retrieval.jaccard_pairs(spark.createDataFrame(rows, "id int, text string"), "id", "text", 60).collect()
    assert len(got) == len(want) > 40 and {(r["a"], r["b"]) for r in got} == want


@pytest.mark.parametrize("room", [64 << 20, 2000, 0])
def test_jaccard_candidates_are_sifted_as_they_are_formed(spark, monkeypatch, room):
    """Few of the pairs that share a rare word are stored where parities have room; sets of all sizes, the pairs of brute force."""
    import random

    draw, rows, stored = random.Random(5), [], retrieval.stored
    for size in (1, 2, 3, 9, 30, 70, 150, 400):
        for _ in range(5):
            base = draw.sample(range(900), size)
            rows += [base, base[: size - size // 5], [*base[size // 6 :], *draw.sample(range(900), size // 6)]]
    rows = [(i, " ".join(f"W{x}" for x in {*words, 6000 + i % 3})) for i, words in enumerate(rows)]
    sets = [(i, set(t.split())) for i, t in rows]
    want = {(a, b): round(len(x & y) / len(x | y), 6) for a, x in sets for b, y in sets if a < b and 100 * len(x & y) > 60 * len(x | y)}
    monkeypatch.setattr(retrieval, "FOLDED", room)
    kept = []
    monkeypatch.setattr(retrieval, "stored", lambda df: [out := stored(df), df.columns == ["g", "h"] and kept.append(out.count())][0])
    got = retrieval.jaccard_pairs(spark.createDataFrame(rows, "id int, text string").repartition(3), "id", "text", 60).collect()
    assert {(r["a"], r["b"]): round(r["similarity"], 6) for r in got} == want and len(got) == len(want) >= 40
    assert len(kept) == 1 and (room == 2000 or (kept[0] < 1.3 * len(want) if room else kept[0] > 1.5 * len(want)))


def test_jaccard_boundary(spark):
    """A similarity of exactly 0.6 isn't above 0.6."""
    rows = [(1, "a b c d"), (2, "a b c e"), (3, "a b c d f"), (4, "A  b\tc d"), (5, ""), (6, None)]
    got = one(retrieval.jaccard_pairs(spark.createDataFrame(rows, "id int, text string"), "id", "text", 60), "a", "b")
    assert got == [(1, 3), (1, 4), (3, 4)]


def test_boost_modes(spark):
    found = spark.createDataFrame([(1, 10, 0.5, 1.0), (1, 11, 1.0, 1.0), (1, 12, 0.9, 3.0)], "query_id int, vec_id int, distance double, w double")
    assert [r["vec_id"] for r in retrieval.boosted(found, F.col("w"), 3, "compat").orderBy("place").collect()] == [12, 11, 10]
    assert [r["vec_id"] for r in retrieval.boosted(found, F.col("w"), 3).orderBy("place").collect()] == [12, 10, 11]


def test_tail_split_of_a_tiny_corpus(spark):
    rows = spark.createDataFrame([(1, 0, 3), (2, 3, 4)], "doc_id int, start long, _len long")
    assert one(generation.tail_split(rows, 7, 0.1), "train", "val") == [(3, 0), (4, 0)]
    assert one(generation.tail_split(rows, 7, 0.5), "train", "val") == [(1, 3), (3, 0)]


def test_fill_leaves_other_braces(spark):
    got = spark.range(1).select(generation.fill(F.lit("{chunk} } {x {lang}"), chunk=F.lit("C"), lang=F.lit("L"))).first()[0]
    assert got == "C } {x L"


def test_type_precedence(spark):
    df = spark.createDataFrame([("fix and explain", "lda", None), ("explain", "lda", None), ("x", "RTS", None), ("x", "y", None), ("fix", "y", "theory")], "i string, o string, g string")
    assert [r[0] for r in df.select(corpus.pair_type(F.col("i"), F.col("o"), F.col("g"))).collect()] == ["bugfix", "theory", "code", "factual", "theory"]


def test_asm_rule(spark):
    df = spark.createDataFrame([("LDA #$01",), ("RTS",), ("LOOP: LDA",), ("LOOP LDA #1",), ("The and of",), ("x ; LDA",)], "line string")
    assert [r[0] for r in df.select(corpus.is_asm(F.col("line"))).collect()] == [False, False, False, True, True, False]


def test_branch_limits(spark):
    def far(n):
        return [r["finding"] for r in programs.branch_findings(spark.createDataFrame([(1, "bne end\n" + "nop\n" * n + "end: rts")], "code_id int, code string")).collect()]

    # the branch itself counts three bytes by this rule, and distances count from two bytes after its start
    assert far(126) == [] and far(127) == ["out of range"]


def test_program_bytes(spark):
    prg = programs.program_files(spark.createDataFrame([(1, '20 GOTO 10\n10 PRINT "Hi Goto"')], "code_id int, code string")).first()["prg"]
    assert bytes(prg[:2]) == b"\x01\x08" and b'"Hi Goto"' in bytes(prg) and bytes(prg).endswith(b"\x00\x00\x00")
    assert programs.crunch("print#1,a") == bytes([programs.K.BASIC_TOKENS["PRINT#"]]) + b"1,A"


def test_overlaps(spark):
    a = spark.createDataFrame([(1, 0, 9), (2, 10, 10), (3, 5, 100), (4, -7, -3)], "id int, start int, end int")
    b = spark.createDataFrame([(1, 9, 10), (2, 20, 60), (3, 101, 102), (4, -3, 0)], "id int, start int, end int")
    want = [(1, 1), (1, 4), (2, 1), (3, 1), (3, 2), (4, 4)]
    for width in (1, 7, 50):
        assert one(tables.overlaps(a, b, width), "a_id", "b_id") == want


def test_summary_and_listings(spark):
    rows = spark.createDataFrame([(0xC000, 0xC0FF, "b"), (0x0801, 0x9FFF, "a")], "start int, end int, purpose string")
    assert render.memory_summary(rows).first()[0] == "- $0801-$9FFF: a\n- $C000-$C0FF: b"
    data = spark.createDataFrame([(1, bytearray(range(10)))], "id int, data binary")
    assert render.bytes_listing(data).first()["listing"] == "!byte $00, $01, $02, $03, $04, $05, $06, $07\n!byte $08, $09"
    assert render.bytes_listing(data, "basic").first()["listing"] == "1000 DATA 0,1,2,3,4,5,6,7\n1010 DATA 8,9"
    lint = programs.lint(spark.createDataFrame([(1, "foo 1\nbne x")], "code_id int, code string"))
    assert render.findings_text(lint).first()["report"] == "[WARNING] line 1: unknown mnemonic 'FOO'\n[ERROR] line 2: undefined 'x'"
    code = spark.createDataFrame([("* = $c000 ; here\nlbl: lda #1\nend:\n!byte 1\n",)], "c string")
    assert code.select(render.normalised_source(F.col("c"))).first()[0] == "org $c000\nlbl\n        lda #1\nend\n!byte 1"


def test_facts(spark):
    rows = spark.createDataFrame([("gate", 7)], "name string, lane int")
    assert one(render.facts(rows, "What does {name} control?", "The {name} controls lane {lane}."), "instruction", "output") == [("What does gate control?", "The gate controls lane 7.")]
    notes = render.clock_notes(spark.createDataFrame([("A4", 440.0)], "note string, hertz double"), {"one": 1_000_000.0, "two": 2_000_000.0})
    assert one(notes, "clock", "number") == [("one", 7382), ("two", 3691)]
    q = spark.createDataFrame([("What is the gate?", "A door."), ("Why?", "x")], "q string, a string")
    assert [r[0] for r in q.select(render.inverted(F.col("q"), F.col("a"))).collect()] == ["Which thing is this: A door.", None]


def test_teacher(spark):
    class Odd:
        def generate(self, system, user):
            return {"ok": '[{"instruction": "a", "output": "b"}]', "bad": "no", "fail": None}.get(user) or 1 / 0

    tasks = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "fail")], "id int, prompt string")
    pairs, rest = B.parse_replies(B.ask(tasks, Odd), "id")
    assert one(pairs, "id", "instruction", "output") == [(1, "a", "b")] and one(rest, "id") == [(2,), (3,)]
    pairs, rest = B.parse_replies(B.ask(tasks), "id")
    assert pairs.count() == 3 and rest.count() == 0


def test_models_offline(spark):
    df = spark.createDataFrame([("a b a", "a c")], "t string, q string")
    v, s = df.select(hashing_embedder(8)(F.col("t")), lexical_reranker(F.col("q"), F.col("t"))).first()
    assert sum(v) == 3 and len(v) == 8 and s == 0.5


def test_pages_and_books(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("1.xhtml", "<p>one</p><script>no</script>")
        z.writestr("2.html", "<p>two &amp; three</p>")
        z.writestr("x.css", "no")
    (tmp_path / "c.epub").write_bytes(b"broken")
    books = spark.read.format("binaryFile").load(str(tmp_path))
    assert sorted(r["text"] for r in markup.extracted(books, markup.epub_text).collect()) == ["", "one\ntwo & three"]
    assert markup.page_text("<p>a<style>x</style>b<script><b>n</b></script>c") == "a\nb\nc"


def test_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "my_note.md").write_text("---\ntitle: 'T'\ntags: [a, \"b\"]\n---\nbody\n")
    (tmp_path / "plain_one.md").write_text("no head")
    (tmp_path / "list.md").write_text("---\ntags:\n  - x\n  - y\n---\nz")
    (tmp_path / "a.zip").write_text("x")
    (tmp_path / "p.html.txt").write_text("x")
    rows = files.allowed(files.scan(spark, str(tmp_path)))
    notes = files.front_matter(rows.where("ending = '.md'"))
    assert {r["name"]: (r["title"], r["tags"], r["body"]) for r in notes.collect()} == {"my_note.md": ("T", ["a", "b"], "body\n"), "plain_one.md": ("Plain One", ["imported", "note"], "no head"), "list.md": ("List", ["x", "y"], "z")}
    assert one(rows, "name") == [("list.md",), ("my_note.md",), ("plain_one.md",)]
    assert files.inventory(spark, str(tmp_path)).count() == 5
    assert [r["source_ix"] for r in files.gather(spark, [files.Source(str(tmp_path), (".md",), "NOTES"), files.Source(str(tmp_path / "sub"), (".md",), "SUB")]).orderBy("source_ix", "path").collect()] == [0, 0, 0, 1]
    assert files.first_filled(spark, [str(tmp_path / "none"), str(tmp_path / "sub")]) == str(tmp_path / "sub")
    assert "Source: my_note.md" in notes.where("title = 'T'").select(files.labelled(notes)).first()[0]


def test_json_and_programs(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2, "z": 3}\n')
    good, bad = files.json_lines(spark, str(tmp_path / "x.jsonl"), "a int")
    assert one(good, "a") == [(1,), (2,)] and one(bad, "value") == [("not json",)]
    (tmp_path / "x.prg").write_bytes(b"\x01\x08\xa9\x00")
    assert [(r["address"], bytes(r["body"])) for r in files.programs(spark, str(tmp_path)).collect()] == [(0x0801, b"\xa9\x00")]
    (tmp_path / "a.json").write_text(json.dumps([{"k": 1}, {"k": 2}]))
    assert files.json_array(spark, str(tmp_path / "a.json")).count() == 2


def test_tables_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(3), path)
    sinks.replace_table(spark.read.parquet(path).where("id > 0"), path)
    assert one(spark.read.parquet(path), "id") == [(1,), (2,)]
    assert sinks.load_index(spark, str(tmp_path / "i"), lambda: spark.range(2)).count() == 2
    assert sinks.load_index(spark, str(tmp_path / "i"), lambda: spark.range(9)).count() == 2


def test_sync_stream(spark, tmp_path):
    source, state, checkpoint = (str(tmp_path / x) for x in ("in", "state", "ck"))
    (tmp_path / "in").mkdir()

    def put(n, rows):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"name": k, "content": v}) for k, v in rows))
        sync_stream(spark, source, state, checkpoint).awaitTermination()
        return one(spark.read.schema("name string, md5 string, batch long").parquet(state + "/*"), "name", "batch")

    assert put(1, [("a", "x"), ("b", "y")]) == [("a", 0), ("b", 0)]
    assert put(2, [("a", "x"), ("b", "z"), ("c", "w")]) == [("a", 0), ("b", 0), ("b", 1), ("c", 1)]


def test_pages_clamp(spark):
    rows = spark.range(45)
    assert [r["row_no"] for r in corpus.page(rows, 9, 20, "id").collect()] == [41, 42, 43, 44, 45]
    assert corpus.page(rows, -3, 20, "id").count() == 20 and corpus.page(rows.limit(0), 2, 20, "id").count() == 0


@pytest.mark.parametrize("n", [0, 1023, 1024, 5 << 20])
def test_sizes(spark, n):
    want = f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1 << 20 else f"{n / (1 << 20):.1f} MB"
    assert spark.range(1).select(T.human_size(F.lit(n))).first()[0] == want


def test_neighbours_in_blocks(spark, sf, monkeypatch):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame([(90001, None), (90002, [1.0]), (90003, [None] * 64)], "vec_id long, embedding array<float>")
    corpus = rows.unionByName(odd.select(*[F.col(c).cast(rows.schema[c].dataType) for c in rows.columns]))
    asks = corpus.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    once = sorted(retrieval.knn(corpus, asks, 5).collect())
    assert once and not {r["vec_id"] for r in once} & {90001, 90003}
    monkeypatch.setattr(retrieval, "SMALL", 10)
    monkeypatch.setattr(retrieval, "LOT", 50)
    assert sorted(retrieval.knn(corpus, asks, 5).collect()) == once
