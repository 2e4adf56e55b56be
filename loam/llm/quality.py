"""Operator 8: quality classifier from weak labels.

Overlapping heuristics each vote a document clean or junk, or abstain. Expectation-maximisation over
the vote patterns of all documents estimates how often each heuristic is right about either class and
how common junk is, without any label. The posterior of a document's pattern is its weak label; weak
labels of a bounded sample train a linear scorer on hashed features of the text, and the scorer judges
every document: ``keep`` where its probability of clean is at least ``KEEP``.

The driver sees one row for each vote pattern, at most 3 ** 10, and the sample's hashed features, at
most ``SAMPLE`` documents (those with the least hashes of doc_id) of ``SLOTS`` features each.
Every word of a text counts, by its whole shape.

Documents that are null, empty or without a word have score 0 and are rejected. Repeated rows are
judged alike. In an empty table, or one without a vote, nothing is trained and every text with a word
has score 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.common import in_worker, small_batches

SAMPLE, SLOTS, KEEP = 20_000, 1 << 12, 0.5
ROUNDS, STEPS, RATE, DECAY = 100, 400, 2.0, 1e-5

_CLASS = bytearray(range(256))
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = ord("a") if _c in "abcdefghijklmnopqrstuvwxyz" or _i >= 128 else ord("A") if "A" <= _c <= "Z" else ord("0") if "0" <= _c <= "9" else _i
_CLASS = bytes(_CLASS)
_RUN = re.compile(rb"([aA0])\1+")
_BLANK = b" \t\n\r\x0b\x0c"
_PLAIN = bytes(c for c in range(256) if c >= 128 or chr(c).isalnum()) + _BLANK + b".,;:'\"()?!-"
#: How far back a word's repetition is looked for.
BACK = (1, 2, 3, 5)


def _odd(raw: bytes) -> int:
    return len(raw.translate(None, _PLAIN))


class Measures:
    """What heuristics and features read of a text with at least one word."""

    def __init__(self, raw: bytes, words: list[bytes]):
        n, total = len(words), len(raw.translate(None, _BLANK))
        often = Counter(words)
        self.n = n
        kinds = raw.translate(_CLASS)
        letters = kinds.count(b"a") + kinds.count(b"A")
        self.letters = letters / total
        self.upper = kinds.count(b"A") / max(1, letters) if letters >= 20 else -1.0
        self.odd = _odd(raw) / len(raw)
        self.shapes = Counter()
        for kind, count in Counter(kinds.split()).items():  # few, so that runs are shortened once for many words
            self.shapes[_RUN.sub(rb"\1", kind)] += count
        self.bare = sum(c for s, c in self.shapes.items() if not (b"a" in s or b"A" in s or b"0" in s)) / n
        self.decked = sum(c for s, c in self.shapes.items() if _odd(s) >= 2 or s.endswith(b"!!")) / n
        self.wordlike = sum(c for s, c in self.shapes.items() if s.strip(b".,;:!?'\"()-") in (b"a", b"Aa")) / n
        self.distinct = len(often) / n
        self.most = max(often.values()) / n
        same = np.fromiter(map(hash, words), np.int64, n)
        self.again = max((int(np.count_nonzero(same[b:] == same[:-b])) / n for b in BACK if n > b), default=0.0)
        self.mean = total / n


CLEAN, JUNK, NONE = 1, 0, 2


def _vote(value: float, clean: bool, junk: bool) -> int:
    return JUNK if junk else CLEAN if clean else NONE


def votes(m: Measures) -> tuple[int, ...]:
    """A vote of each heuristic. Most know one kind of junk, and abstain on what lacks it."""
    long = m.n >= 20
    return (
        _vote(m.odd, False, m.odd > 0.04),
        _vote(m.decked, False, m.decked > 0.15),
        _vote(m.bare, False, m.bare > 0.15),
        _vote(m.upper, False, m.upper > 0.6),
        _vote(m.distinct, m.distinct > 0.5, long and m.distinct < 0.35),
        _vote(m.again, m.again < 0.1, m.n >= 5 and m.again > 0.3),
        _vote(m.most, False, long and m.most > 0.3),
        _vote(m.letters, m.letters > 0.9, long and m.letters < 0.75),
        _vote(m.mean, 3 <= m.mean <= 12, long and (m.mean < 2 or m.mean > 20)),
        _vote(m.wordlike, m.wordlike > 0.6, long and m.wordlike < 0.3),
    )


N_VOTES = 10


def features(m: Measures) -> dict[int, float]:
    """Hashed features: shares of word shapes, and levels of the measures."""
    out: dict[int, float] = {}

    def add(name: bytes, value: float) -> None:
        h = zlib.crc32(name)
        slot = h % SLOTS
        out[slot] = out.get(slot, 0.0) + (value if h >> 31 else -value)

    for shape, count in m.shapes.items():
        add(b"shape:" + shape, count / m.n)
    for name in ("upper", "odd", "bare", "decked", "distinct", "most", "again", "letters", "wordlike"):
        value = getattr(m, name)
        add(f"{name}:{int(10 * value) if value >= 0 else 'none'}".encode(), 1.0)
        add(name.encode(), max(value, 0.0))
    add(f"n:{min(8, m.n.bit_length())}".encode(), 0.3)
    return out


def _measured(text: str | None) -> Measures | None:
    if not text or text.isspace():
        return None
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    return Measures(raw, words) if words else None


#: Kinds of junk that heuristics know, by their place: markup and symbols, shouting, repetition.
KINDS = ((0, 1, 2, 7, 8, 9), (3,), (4, 5, 6))


def _outcomes(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns == k for k in (JUNK, CLEAN, NONE)], axis=2).astype(float)


def estimate(patterns: np.ndarray, counts: np.ndarray, kinds=KINDS) -> tuple[np.ndarray, np.ndarray]:
    """(prior of each class, P(outcome | class) of each heuristic) by expectation-maximisation.

    patterns: one row a distinct pattern of votes; counts: documents of each. Class 0 is clean, the
    others are kinds of junk, on which a heuristic has accuracies of its own: one that knows repetition
    is blind to symbols. An outcome is a vote or abstaining, which tells something too. The start puts
    patterns without junk votes into clean and others into the kind with most of them, which fixes what
    the classes mean; outcomes are smoothed by one imagined document each.
    """
    outcome = _outcomes(patterns)
    against = np.stack([(patterns[:, list(k)] == JUNK).sum(axis=1) for k in kinds], axis=1)
    q = np.full((len(patterns), 1 + len(kinds)), 0.02)
    q[np.arange(len(patterns)), np.where(against.any(axis=1), 1 + against.argmax(axis=1), 0)] = 1.0
    q /= q.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        w = (counts[:, None] * q).T
        prior = (w.sum(axis=1) + 1) / (counts.sum() + len(w))
        rates = np.tensordot(w, outcome, axes=(1, 0)) + 1.0
        rates /= rates.sum(axis=2, keepdims=True)
        q = _classes(patterns, prior, rates)
    return prior, rates


def _classes(patterns: np.ndarray, prior: np.ndarray, rates: np.ndarray) -> np.ndarray:
    score = np.log(prior) + np.tensordot(_outcomes(patterns), np.log(rates), axes=([1, 2], [1, 2]))
    q = np.exp(score - score.max(axis=1, keepdims=True))
    return q / q.sum(axis=1, keepdims=True)


def posterior(patterns: np.ndarray, prior: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Probability of clean given each pattern."""
    return _classes(patterns, prior, rates)[:, 0]


def fit(at: np.ndarray, value: np.ndarray, doc: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Weights of a logistic scorer (the last is the bias) for soft labels, by full gradient steps.

    at, value, doc: slot, number and document of each feature; goal: the label of each document.
    """
    share = np.array([goal.mean(), 1 - goal.mean()]).clip(0.02)
    weight = goal / share[0] + (1 - goal) / share[1]  # both classes count alike
    weight /= weight.sum()
    w, speed = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    for _ in range(STEPS):
        z = np.bincount(doc, w[at] * value, len(goal)) + w[-1]
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - goal)
        g = np.append(np.bincount(at, slope[doc] * value, SLOTS), slope.sum())
        speed = 0.9 * speed - RATE * (g + DECAY * w)
        w = w + speed
    return w


class Quality:
    """A trained model."""

    def __init__(self, prior: np.ndarray, rates: np.ndarray, weights: np.ndarray | None):
        self.prior, self.rates, self.weights = prior, rates, weights
        self.weak: dict[tuple[int, ...], float] = {}  # by pattern of votes, 3 ** 10 at most

    def judge(self, text: str | None) -> tuple[float, float]:
        """(weak label, score) of a text."""
        m = _measured(text)
        if m is None:
            return 0.0, 0.0
        pattern = votes(m)
        if (weak := self.weak.get(pattern)) is None:
            weak = self.weak[pattern] = float(posterior(np.array([pattern]), self.prior, self.rates)[0])
        if self.weights is None:
            return weak, 0.5
        f = features(m)
        z = float((self.weights[list(f)] * np.array(list(f.values()))).sum() + self.weights[-1])
        return weak, float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    in_worker("quality")
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if (m := _measured(text)) is not None:
                counts["".join(map(str, votes(m)))] += 1
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "n"])


def train(docs: DataFrame) -> Quality:
    """The model of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = texts.select("text").mapInArrow(_patterns, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    as_rows = lambda p: np.array([[int(c) for c in x] for x in p], np.int64).reshape(-1, N_VOTES)
    patterns, counts = as_rows([r["pattern"] for r in seen]), np.array([r["n"] for r in seen], float)
    if not len(seen) or not (patterns != NONE).any():
        return Quality(np.full(2, 0.5), np.full((2, N_VOTES, 3), 1 / 3), None)
    prior, rates = estimate(patterns, counts)
    # The hash bound passes about twice the sample, the limit makes it exact, and only these texts are measured again.
    share = min(1.0, 2 * SAMPLE / counts.sum())
    hashed = texts.withColumn("_h", F.xxhash64("doc_id")).where(F.pmod("_h", F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = hashed.select("text", "_h").mapInArrow(_keyed, "h long, pattern string, slots array<long>, numbers array<double>").orderBy("h", "pattern").limit(SAMPLE).toArrow()
    if not rows.num_rows:
        return Quality(prior, rates, None)
    slots, numbers = rows.column("slots").combine_chunks(), rows.column("numbers").combine_chunks()
    doc = np.repeat(np.arange(rows.num_rows), np.diff(slots.offsets.to_numpy()))
    goal = posterior(as_rows(rows.column("pattern").to_pylist()), prior, rates)
    return Quality(prior, rates, fit(slots.flatten().to_numpy(), numbers.flatten().to_numpy(), doc, goal))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(h, m) for h, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True) if (m := _measured(text)) is not None]
        f = [features(m) for _, m in found]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([h for h, _ in found], pa.int64()),
                pa.array(["".join(map(str, votes(m))) for _, m in found], pa.string()),
                pa.array([list(x) for x in f], pa.list_(pa.int64())),
                pa.array([list(x.values()) for x in f], pa.list_(pa.float64())),
            ],
            names=["h", "pattern", "slots", "numbers"],
        )


def judged(docs: DataFrame, model: Quality, *keep: str) -> DataFrame:
    """The columns ``keep`` of docs with weak, score and keep."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sent.value.judge(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([w for w, _ in got], pa.float64()), pa.array([s for _, s in got], pa.float64()), pa.array([s >= KEEP for _, s in got], pa.bool_())], names=[*keep, "weak", "score", "keep"]
            )

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("weak", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType())])
    return rows.mapInArrow(run, schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs, train(docs), "doc_id")


def clean_only(docs: DataFrame, model: Quality | None = None) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs) if model is None else model)

    def passes(texts: pa.Array) -> pa.Array:
        in_worker("quality")
        return pa.array([sent.value.judge(t)[1] >= KEEP for t in texts.to_pylist()], pa.bool_())

    return docs.where(F.arrow_udf(passes, "boolean")(F.col("text").cast("string")))
