"""Operator 7: language identification, words first, with backoff to shorter character n-grams.

The model counts the words of labelled texts by language. A known word scores the logarithm of its
frequency in each language. An unseen word backs off: of its character n-grams (with marks for its
ends), the longest length of which any is known scores it, from ``LONGEST`` down to 1. A text's score
for a language is the sum over its words and the logarithm of the language's share of labelled texts;
the greatest wins, ties going to the language that comes first by code point. ``score`` is the
winner's posterior probability.

Words are runs of letters, lower-cased. Texts that are null or without a letter are ``und`` with score
0, as are all texts where nothing was labelled. Labelled rows need a text with a letter and a language.

The posterior says which language, not whether it is any of them: a text of unknown words has the
prior's. So ``identified`` asks for evidence too, the share of a text's words that are known or hold
a known n-gram of the longest length; it doesn't depend on the languages' shares.

The model is bounded whatever the corpus: the ``WORDS`` most frequent words and the ``GRAMS`` most
frequent n-grams of each length, counted over all labelled texts, with one number for each language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import Workspace, in_worker

WORDS, GRAMS, LONGEST = 50_000, 10_000, 5
#: Distinct words that a task counts before it passes them on.
HELD = 300_000
#: Characters of words whose n-grams are counted at once.
CHARS = 1 << 20
#: Least evidence: held-out texts of sf0.01 and sf0.1 have 0.9 and more, sentences in other languages 0.3 and less.
EVIDENCE = 0.4
#: Every byte of UTF-8, a space for ASCII characters that are no letters.
_ASCII = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def words(text: str) -> list[str]:
    found = text.lower().encode("utf-8", "surrogatepass").translate(_ASCII).decode("utf-8", "surrogatepass").split()
    if found and not "".join(found).isalpha():  # what is no letter beyond ASCII separates words too
        found = [w for part in found for w in ((part,) if part.isalpha() else "".join(c if c.isalpha() else " " for c in part).split())]
    return found


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    in_worker("language")
    by_lang: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, c in by_lang.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])
        by_lang.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if found := words(text):
                c = by_lang.setdefault(lang, Counter())
                c.update(found)
                c[""] += 1  # the number of texts
                if sum(map(len, by_lang.values())) > HELD:
                    yield from out()
    yield from out()


def _tally(langs: list[str], found: list[str], n: list[int]) -> Iterator[pa.RecordBatch]:
    """The n-grams of words, each word with its language and how often it counts: a batch for each length.

    Runs of n characters are numbers, n digits to the base of the distinct characters, whose ranks stand for them
    where they grow too large; strings are made of distinct ones only.
    """
    names = sorted(set(langs))
    text = "".join([f"<{w}>" for w in found])
    size = np.array([len(w) + 2 for w in found])
    digits, digit = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    lang, often = (np.repeat(np.array(x, np.int64), size) for x in ([names.index(x) for x in langs], n))
    ends = np.cumsum(size)
    rest = np.repeat(ends, size) - np.arange(len(text))  # characters from here to the word's end
    key, bound = lang, len(names)
    for length in range(1, LONGEST + 1):
        if bound * len(digits) >= 1 << 62:
            ranks, key = np.unique(key, return_inverse=True)
            bound = len(ranks)
        key, bound = key[: len(text) - length + 1] * len(digits) + digit[length - 1 :], bound * len(digits)
        whole = rest[: len(key)] >= length
        if length == 1:  # without the marks
            whole[ends - 1] = whole[ends - size] = False
        at = np.flatnonzero(whole)
        at = at[np.argsort(key[at])]
        first = np.flatnonzero(np.diff(key[at], prepend=-1))
        if len(first):
            some = at[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()).take(pa.array(lang[some])), pa.array(np.full(len(some), length, np.int32)), pa.array([text[i : i + length] for i in some.tolist()], pa.string()), pa.array(np.add.reduceat(often[at], first))],
                names=["lang", "size", "gram", "n"],
            )


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, chars = ([], [], []), 0
    for batch in batches:
        for to, column in zip(held, batch.columns, strict=True):
            to += column.to_pylist()
        chars += sum(map(len, held[1][-batch.num_rows :]))
        if chars > CHARS:
            yield from _tally(*held)
            held, chars = ([], [], []), 0
    if held[0]:
        yield from _tally(*held)


class Model:
    """Log frequencies by language: a row of numbers for each known word and n-gram."""

    def __init__(self, langs: list[str], prior: np.ndarray, known: dict[str, int], table: np.ndarray, tail: list[dict[str, int]], tails: list[np.ndarray]):
        self.langs, self.prior, self.known, self.table, self.tail, self.tails = langs, prior, known, table, tail, tails

    def back_off(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The scores of unseen words by language, and whether each holds a known n-gram of the longest length."""
        scores, resembles = np.zeros((len(found), len(self.langs))), np.zeros(len(found), bool)
        left = range(len(found))
        for size in range(len(self.tail), 0, -1):
            known, at, whose, starts, missed = self.tail[size - 1], [], [], [], []
            for i in left:
                if rows := [known[g] for g in grams(found[i], size) if g in known]:
                    whose.append(i)
                    starts.append(len(at))
                    at += rows
                else:
                    missed.append(i)
            if whose:
                scores[whose] = np.add.reduceat(self.tails[size - 1][at], starts, axis=0) / np.diff([*starts, len(at)])[:, None]
                resembles[whose] = size == len(self.tail)
            left = missed
        return scores, resembles

    def unseen(self, word: str) -> np.ndarray:
        return self.back_off([word])[0][0]


class _Numbers(dict):
    """Word -> number; a new word gets the next number and is put in a list."""

    def __init__(self, known: dict[str, int]):
        super().__init__(known)
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class Scorer:
    """A model in a Python worker, with the scores of words met before."""

    #: Words kept, and texts whose new words are scored at once.
    KEPT, TOGETHER = 50_000, 64

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.numbers, self.table = _Numbers(self.model.known), self.model.table
        self.backed = np.ones(len(self.table), bool)
        self.used = self.base = len(self.table)

    def _learn(self) -> None:
        """Put the new words into the table."""
        fresh, self.numbers.fresh = self.numbers.fresh, []
        if not fresh:
            return
        scores, resembles = self.model.back_off(fresh)
        stop = self.used + len(fresh)
        if stop > len(self.table):
            room = max(4096, len(fresh), self.used - self.base)
            self.table = np.concatenate([self.table[: self.used], np.zeros((room, len(self.model.langs)))])
            self.backed = np.concatenate([self.backed[: self.used], np.zeros(room, bool)])
        self.table[self.used : stop], self.backed[self.used : stop] = scores, resembles
        self.used = stop

    def judge(self, texts: list[str | None]) -> Iterator[tuple[str, float, float]]:
        """The language of each text, its posterior probability and the evidence."""
        for i in range(0, len(texts), self.TOGETHER):
            if self.used - self.base > self.KEPT:
                self.forget()
            number = self.numbers.__getitem__
            held = [np.fromiter(map(number, words(t)), np.int64) if t and self.model.langs else () for t in texts[i : i + self.TOGETHER]]
            self._learn()
            yield from map(self._judge, held)

    def _judge(self, at: np.ndarray) -> tuple[str, float, float]:
        if not len(at):
            return "und", 0.0, 0.0
        total = self.model.prior + self.table[at].sum(axis=0)
        best = int(total.argmax())
        return self.model.langs[best], float(1.0 / np.exp(total - total[best]).sum()), float(self.backed[at].mean())


def _logs(rows: pa.Table, langs: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Rows of (key, counts by language) as additively smoothed log frequencies."""
    counts = np.zeros((rows.num_rows, len(langs)))
    if not rows.num_rows:
        return {}, counts
    place = {x: i for i, x in enumerate(langs)}
    by = rows.column("by").combine_chunks()
    each = by.flatten()
    sizes = np.diff(by.offsets.to_numpy())
    lang = np.array([place[x] for x in each.field("lang").to_pylist()])
    counts[np.repeat(np.arange(rows.num_rows), sizes), lang] = each.field("n").to_numpy()
    return {k: i for i, k in enumerate(rows.column("key").to_pylist())}, np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * (rows.num_rows + 1)))


def _most_frequent(counted: DataFrame, key: str, most: int) -> pa.Table:
    """(key, by) of the most frequent keys, at most so many, in the order of keys.

    A histogram over levels of frequency, a 64th of a doubling each, says from which level on they are
    few enough; a level is taken whole or not at all, and only what is taken comes to the driver.
    """
    by = F.collect_list(F.struct("lang", "n")).alias("by")  # as many as there are languages
    level = F.floor(F.log2(F.sum("n")) * 64).cast("int").alias("level")
    rows = counted.groupBy(F.col(key).alias("key")).agg(level, by)
    levels = rows.groupBy("level").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect()
    total, least = 0, None
    for r in levels:
        total += r["n"]
        if total > most:
            break
        least = r["level"]
    if least is None:  # no key, or all are equally frequent and too many: the first ones by name
        return rows.orderBy("key").limit(most).select("key", "by").toArrow()
    return rows.where(F.col("level") >= least).select("key", "by").toArrow().sort_by("key")


def train(labelled: DataFrame) -> Model:
    """A model of labelled (lang, text); rows with a null in either don't count."""
    rows = labelled.select(F.col("lang").cast("string"), F.col("text").cast("string")).where("lang is not null and text is not null")
    counted = rows.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = Workspace(labelled.sparkSession, "language").table(counted)
    texts = {r["lang"]: r["n"] for r in counted.where("word = ''").collect()}
    langs = sorted(texts)
    known, table = _logs(_most_frequent(counted.where("word <> ''"), "word", WORDS), langs)
    parts = counted.where("word <> ''").select("lang", "word", "n").mapInArrow(_count_grams, "lang string, size int, gram string, n long")
    parts = Workspace(labelled.sparkSession, "language").table(parts.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")))
    tails = [_logs(_most_frequent(parts.where(F.col("size") == size), "gram", GRAMS), langs) for size in range(1, LONGEST + 1)]
    prior = np.log(np.array([texts[x] for x in langs], float) / max(1, sum(texts.values())))
    return Model(langs, prior, known, table, [k for k, _ in tails], [t for _, t in tails])


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` of docs with lang_pred and score, predicted from text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            got = list(scorer.judge(batch.column(batch.num_columns - 1).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x for x, *_ in got], pa.string()), pa.array([s for _, s, _ in got], pa.float64())], names=[*keep, "lang_pred", "score"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    from pyspark.sql import types as T

    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 4; null for null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(fold(F.col("doc_id")) != 2).select("lang", "text"))
    rows = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "text")
    return predict(rows, model, "doc_id", "held_out")


def identified(docs: DataFrame, model: Model, wanted: list[str] | None = None, least: float = 0.5, evidence: float = EVIDENCE) -> DataFrame:
    """The rows of docs, with all their columns, in a wanted language (default: any learned) with the least score and evidence."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    wanted = frozenset(model.langs if wanted is None else wanted)

    def passes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        in_worker("language")
        scorer = Scorer(sent.value)
        for texts in batches:
            yield pa.array([lang in wanted and score >= least and backed >= evidence for lang, score, backed in scorer.judge(texts.to_pylist())], pa.bool_())

    passes.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.where(F.arrow_udf(passes, "boolean")(F.col("text").cast("string")))
