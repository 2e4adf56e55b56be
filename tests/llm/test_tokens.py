"""Token files: the words, the library's ids, the files."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loam.llm import token_files as T
from loam.llm.common import in_worker

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=300))
@settings(max_examples=200, deadline=None)
def test_words_hold_any_values(values):
    x = np.array(values, np.uint64)
    assert (T.unpack_ids(T.pack_ids(x)) == x).all()


@pytest.mark.parametrize("n", [4095, 4096, 4097, 13_000])
def test_blocks(n):
    x = np.random.default_rng(n).integers(0, 50_257, n).astype(np.uint64)
    x[::9] = 2**61
    packed = T.pack_ids(x)
    assert (T.unpack_ids(packed) == x).all()
    plain = T.pack_ids(x % 50_257)
    assert len(plain) < 3 * n + 100
    with pytest.raises(ValueError):
        T.unpack_ids(b"x" * 40)


def test_ids_are_the_library_s(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(T.Encoder, "PIECES", 500)
    rng = random.Random(1)
    texts = ["", " ", "\n", "a ", " a", "a  b", "a\n\nb", "a\n\n\nb", "a \nb", "x\n y", "x \n y", "tail\n\n", "tail \n", "é ü 12 <|endoftext|> x", "don't we'll 'x", "\x1c \x1d", "日本 語 ！", "a b", "a b c", "\tindent x", "long" * 5000]
    texts += ["".join(rng.choice(" \n\tab'1,é\x1c Z") for _ in range(rng.randrange(14))) for _ in range(4000)]
    library, ours = Tokenizer.from_file(PATH), T.Encoder(PATH)
    got = [x for i in range(0, len(texts), 700) for x in ours.encode(texts[i : i + 700])]
    for text, ids, e in zip(texts, got, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == e.ids, text


def test_lots_of_any_size(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(3)
    words = ["né", "the", "x9", "日本", "don't", "#", "", "\n", "\na", "mid,", "end.\"", "<|endoftext|>", "a  b", "\t"]
    texts = [None, "", *(" ".join(rng.choice(words) + rng.choice(["", "", ",", "***"]) for _ in range(rng.randrange(9))) for _ in range(1500)), None, "long " * 300]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch([x or "" for x in texts], add_special_tokens=False)]
    for lot, row in ((1 << 24, 1 << 18), (200, 7), (1, 1)):
        monkeypatch.setattr(T.Encoder, "LOT", lot)
        monkeypatch.setattr(T.Encoder, "ROW", row)
        ours = T.Encoder(PATH)
        for kind in (pa.string(), pa.large_string()):
            assert [x.tolist() for x in ours.encode(pa.array(texts, kind))] == want
    assert ours.encode([]) == []
    batches = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": pa.array(texts, pa.string())})
    for chars in (1, 100, 1 << 20):
        lots = list(T._lots(iter(batches.slice(at, 90) for at in range(0, len(texts), 90)), chars))
        assert [x for _, lot in lots for x in lot.to_pylist()] == texts and [x for doc, _ in lots for x in doc.to_pylist()] == list(range(len(texts)))
        sizes = [[len(x or "") for x in lot.to_pylist()] for _, lot in lots]
        assert all(sum(x) <= chars or len(x) == 1 for x in sizes)
        assert chars < 1 << 20 or len(lots) == 1


def test_spaces_outlast_the_table_s_thinning(monkeypatch):
    monkeypatch.setattr(T.Encoder, "PIECES", 20)
    ours = T.Encoder(PATH)
    want = [x.tolist() for x in ours.encode(["a ", "\n", " "])]
    for i in range(60):
        ours.encode([" ".join(f"w{i}x{j}" for j in range(40))] * 3)
    assert [x.tolist() for x in ours.encode(["a ", "\n", " "])] == want


def test_punctuation_takes_no_place_in_the_table():
    words = ["".join(random.Random(i).choices("abcdefgh", k=9)) for i in range(300)]
    ours = T.Encoder(PATH)
    ours.encode([" ".join(w + end for w in words) for end in ("", ",", ".", "***", ".###", "!!")])
    assert len(ours.known) < 2 * len(words) + 10  # the word after a space, and after a newline


def test_encoding_costs_a_part_of_the_library_s_time(monkeypatch):
    """CPU time, for texts whose words repeat, of encoding and packing together."""
    import time

    from tokenizers import Tokenizer

    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "false")
    rng = np.random.default_rng(5)
    words = np.array(["".join(x) for x in rng.choice(list("etaoinshrdlu"), (20_000, 8))])
    texts = [" ".join(words[np.minimum(rng.zipf(1.3, 500), len(words)) - 1]) for _ in range(2000)]
    library, ratios = Tokenizer.from_file(PATH), []
    for _ in range(3):
        ours = T.Encoder(PATH)
        began = time.process_time()
        T.pack_ids(np.concatenate(ours.encode(texts)).astype(np.uint64))
        between = time.process_time()
        for at in range(0, len(texts), 200):
            library.encode_batch_fast(texts[at : at + 200], add_special_tokens=False)
        ratios.append((between - began) / (time.process_time() - between))
    print(ratios)
    assert min(ratios) < 0.25


def test_lengths_are_the_library_s(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(T.Lengths, "PIECES", 500)
    monkeypatch.setattr(T.Lengths, "LOT", 300)
    rng = random.Random(2)
    texts = ["", " ", "\n", "a ", " a", "a  b", "a\n\nb", "a\n\n\nb", "x\n y", "tail\n\n", "12 <|endoftext|> x", "don't we'll 'x", "日本 語 ！", "a, b. a b! b", "\nnew, new", "long" * 5000]
    texts += ["".join(rng.choice(" \n\tab'1,é\x1c Z") for _ in range(rng.randrange(14))) for _ in range(4000)]
    texts += [" ".join(f"w{rng.randrange(10**9):x}" + rng.choice(["", ",", '."']) for _ in range(20)) for _ in range(200)]
    library, ours = Tokenizer.from_file(PATH), T.Lengths(PATH)
    for i in range(0, len(texts), 100):
        lot = texts[i : i + 100]
        assert ours.lengths(lot).tolist() == [len(e.ids) for e in library.encode_batch(lot, add_special_tokens=False)]
        assert len(ours.known) <= 250 and len(ours.known.older) < 250 + 2 * 20 * 100


def test_measuring_leaves_little_in_workers(spark):
    """Python workers outlive their tasks: what they keep of measured texts stays beside the next stage's memory."""
    import re

    import pyarrow as pa
    from pyspark.sql import functions as F

    texts = spark.range(0, 6000, 1, 1).select(F.concat_ws(" ", *[F.substring(F.md5((F.col("id") * 64 + i).cast("string")), 1, 9) for i in range(64)]).alias("text"))

    def held(batches):
        for batch in batches:
            with open("/proc/self/smaps_rollup") as f:
                yield pa.RecordBatch.from_arrays([pa.array([sum(map(int, re.findall(r"\nPrivate_Dirty:\s+(\d+)", f.read()))) >> 10] * batch.num_rows, pa.int64())], names=["mb"])

    most = lambda: spark.range(0, 8, 1, 1).mapInArrow(held, "mb long").agg(F.max("mb")).first()[0]
    before = most()
    assert texts.agg(F.sum(T.size_in_tokens(F.col("text"), PATH))).first()[0] > 64 * 6000
    assert most() - before < 150
    in_worker(1, list).append(2)
    assert in_worker(1, list) == [2]
    in_worker(2)
    assert in_worker(1, list) == []


def test_other_stages_let_go_of_the_table():
    from loam.llm import language_id, quality

    for other in (quality._patterns, language_id._count_words):
        table = T.measurer(PATH)
        assert T.measurer(PATH) is table
        assert not list(other(iter(())))
        assert T.measurer(PATH) is not table


def test_files(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(T, "SEGMENT", 50)
    rows = [(5, "five words are in here", "x"), (1, None, "x"), (3, "", "x"), (2, "b " * 3000, "y"), (None, "no id", "z"), (3, "again", "x"), (3, "again", "x"), (-4, "<|endoftext|>", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    path = "file://" + str(tmp_path / "ids")
    T.write_tokens(docs, path, PATH)
    library = Tokenizer.from_file(PATH)
    want, at = [], 0
    for doc, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [tuple(r) for r in T.digest(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert T.export(spark, path, str(tmp_path / "bin")) == T.read_tokens(spark, path).count()
    T.write_tokens(docs.limit(0), path + "0", PATH)
    assert T.digest(spark, path + "0").count() == 0


def test_packing_counts_tokens(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from loam.llm import packing

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "x" * 30_000), (-4, "a  b\t<|endoftext|>"), (-5, "one two\n")]
    library = Tokenizer.from_file(PATH)
    want = {r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert {r["doc_id"]: r["length"] for r in packing.op9_packing(spark, sf).collect()} == want
    want |= {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in odd}
    rows = corpus_pipeline.packing_stage(spark, docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")), sf).collect()
    assert {r["doc_id"]: r["length"] for r in rows} == want
    batches = {}
    for r in rows:
        batches.setdefault((r["bucket"], r["batch"]), []).append(r["bucket_length"])
    assert all(sum(held) <= packing.BUDGET or len(held) == 1 for held in batches.values())
