"""Operator 4: token ids of documents in a word-aligned binary format.

A *segment* holds the ids of whole documents: ``MAGIC``, the number of ids and blocks as 32-bit
integers, the word offset of each block (and of the end) as 32-bit integers, then 64-bit words. Ids are
packed in blocks of ``BLOCK``; a block starts at its offset and ends within its last word, so blocks
decode independently and all at once. A word has a 4-bit selector on top and as many ids of equal
width below, the lowest bits first; selector ``ESCAPE`` says that the next word is a literal value
that no width fits. Widths are Simple-8b's.

A file is a Parquet table with one row a segment: shard, segment, the ids before it in its shard, its
doc_ids and their token counts, and the payload. Shards are ranges of ascending doc_id, so rows in
(shard, segment) order hold the documents in order. Parquet's committer makes a lost task's part
invisible, and any reader of Spark's stores can open it; ``export`` copies payloads to plain files
where a local reader wants them.

Texts: null is empty, and has the end id alone. Rows with a null doc_id come first; rows that repeat a
doc_id are in the order of their texts. The tokenizer is the library's own, and the literal text of a
special token is that token, as the library has it by default.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import Workspace, in_worker

MAGIC = b"LOAM-S8B"
BLOCK = 4096
#: Ids after which a segment ends with its document.
SEGMENT = 1 << 20
#: Fixed values of the format: (ids in a word, bits of each) by selector, most ids first.
LAYOUT = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
_COUNTS = np.array([n for n, _ in LAYOUT] + [0, 1], np.int64)
END = 2


# ---------------------------------------------------------------- words


#: Values of a block while it is packed or unpacked, and room for the longest word that begins in it.
_STRIDE = BLOCK + 60


def _in_a_row(fits: np.ndarray, count: int) -> np.ndarray:
    """Where so many true values in a row begin."""
    have = 1
    while have < count:
        step = min(have, count - have)
        fits, have = fits[:-step] & fits[step:], have + step
    return fits


def pack_ids(ids: np.ndarray) -> bytes:
    """A segment of unsigned 64-bit values."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return MAGIC + np.array([0, 0, 0], "<u4").tobytes()
    grid = np.zeros((blocks, _STRIDE), np.uint64)
    grid[:-1, :BLOCK] = ids[: (blocks - 1) * BLOCK].reshape(-1, BLOCK)
    grid[-1, : n - (blocks - 1) * BLOCK] = ids[(blocks - 1) * BLOCK :]
    grid = grid.ravel()
    begin = np.arange(blocks) * _STRIDE
    end = begin + BLOCK
    end[-1] = begin[-1] + n - (blocks - 1) * BLOCK
    # The selector with the most ids whose width all the next ids have; beyond the block's end everything fits.
    most = int(grid.max())
    small = grid.astype(np.uint16) if most < 1 << 16 else grid
    choice = np.full(len(grid), ESCAPE, np.int8)
    for s in range(len(LAYOUT) - 1, -1, -1):
        count, bits = LAYOUT[s]
        if most < 1 << bits:
            choice[:] = s  # all fit
        else:
            fits = _in_a_row(small < small.dtype.type(1 << bits), count)
            np.copyto(choice[: len(fits)], s, where=fits)
    step = _COUNTS[choice]
    after = np.minimum((np.arange(len(grid)) + step).reshape(blocks, _STRIDE), end[:, None]).ravel()
    # All blocks are walked in step, a word of each at a time; one that has ended stays at its end.
    place, begins = begin, np.zeros(len(grid), bool)
    while (place < end).any():
        for _ in range(16):
            begins[place] = True
            place = after[place]
    begins[end] = False
    first = np.flatnonzero(begins)
    selector = choice[first]
    escapes = selector == ESCAPE
    where = np.arange(len(first)) + np.cumsum(escapes) - escapes
    words = np.zeros(len(first) + int(escapes.sum()), np.uint64)
    words[where] = selector.astype(np.uint64) << np.uint64(60)
    words[where[escapes] + 1] = grid[first[escapes]]
    for s, (count, bits) in enumerate(LAYOUT):
        rows = np.flatnonzero(selector == s)
        if len(rows):
            spot = first[rows]
            values = grid[spot]
            for i in range(1, count):
                values |= grid[spot + i] << np.uint64(i * bits)
            words[where[rows]] |= values
    offsets = np.append(where[np.searchsorted(first, begin)], len(words))
    return MAGIC + np.array([n, blocks], "<u4").tobytes() + offsets.astype("<u4").tobytes() + words.astype("<u8").tobytes()


def unpack_ids(segment: bytes) -> np.ndarray:
    """The values of a segment, as unsigned 64-bit integers."""
    if segment[:8] != MAGIC:
        raise ValueError("not a token segment")
    n, blocks = (int(x) for x in np.frombuffer(segment, "<u4", 2, 8))
    if not n:
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(segment, "<u4", blocks + 1, 16).astype(np.int64)
    words = np.frombuffer(segment, "<u8", int(offsets[-1]), 16 + 4 * (blocks + 1))
    selector = (words >> np.uint64(60)).astype(np.int64)
    literal = np.zeros(len(words), bool)
    last = -2
    for i in np.flatnonzero(selector == ESCAPE):  # a literal may look like an escape
        if i != last + 1:
            literal[i + 1] = True
            last = i
    selector = np.where(literal, 14, selector)
    counts = np.array([c for c, _ in LAYOUT] + [1, 0], np.int64)[selector]
    before = np.cumsum(counts) - counts
    start = before + np.repeat(np.arange(blocks) * _STRIDE - before[offsets[:-1]], np.diff(offsets))
    out = np.zeros(blocks * _STRIDE, np.uint64)
    out[start[literal]] = words[literal]
    for s, (count, bits) in enumerate(LAYOUT):
        rows = np.flatnonzero(selector == s)
        if len(rows):
            spot, values = start[rows], words[rows]
            for i in range(count):  # what a block's last word holds beyond its ids falls into the room after the block
                out[spot + i] = (values >> np.uint64(i * bits)) & np.uint64((1 << bits) - 1)
    return out.reshape(blocks, _STRIDE)[:, :BLOCK].ravel()[:n]


# ---------------------------------------------------------------- tokenizing


#: White space that no piece may hold: runs of spaces and newlines that make tokens of their own, and others.
_RUNS = ("  ", "\n\n\n", "\n\n ", "\n \n", " \n\n", " \n ")
_ODD = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_ODD_SPACE = re.compile(r"[^\S \n]")
_ENDING = ".,;:!?*$%&#|\"')"
#: In Arrow's regular expressions: what a text with any of the above holds, letters alone, and letters that such punctuation ends.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
_UNEVEN = "|".join([*_RUNS, f"[{_SPACES}]", r"[ \n][ \n]\z"])
_LETTERS = r"\A\n?\pL+"
_ENDED = rf"{_LETTERS}[{re.escape(_ENDING)}]+\z"
#: New pieces given to the library as one text.
TOGETHER = 256


class _Pieces:
    """Texts as pieces whose ids, one after another, are the library's ids of the text.

    A byte-level pre-tokenizer starts a token at a single space or newline between non-spaces, so a
    text's ids are those of its pieces: a word with the space before it, or a newline with the word
    after it. Pieces met before have their ids from a table; new ones go through the library, many in
    one text with newlines between, which are single tokens and so show where each ends. That doesn't
    hold for longer or other white space, or where a special token is spelt out: such texts go through
    the library whole. In the table a piece is the word alone, or with the newline before it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.dtype = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.space, newline = (self.library.encode(x, add_special_tokens=False).ids[:2] for x in (" ", "\n"))
        self.plain = len(newline) == len(self.space) == 1
        self.newline = newline[0] if newline else -1

    def _needs_library(self, text: str) -> bool:
        if any(run in text for run in _RUNS) or text[-2:].isspace() and len(text) > 1:
            return True
        odd = any(c in text for c in _ODD) if text.isascii() else _ODD_SPACE.search(text)
        return bool(odd) or any(x in text for x in self.special)

    def _ask(self, bare: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts without newlines from the library, with newlines between, and where each begins and ends."""
        texts = ["\n".join(bare[i : i + TOGETHER]) for i in range(0, len(bare), TOGETHER)]
        parts = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(chain(part, (self.newline,)) for part in parts), np.int64)[:-1]
        ends = np.append(np.flatnonzero(ids == self.newline), len(ids)) if bare else np.zeros(0, np.int64)
        if len(ends) != len(bare):
            raise AssertionError("a piece held a newline")
        return ids, np.append(0, ends[:-1] + 1)[: len(ends)], ends

    def _split(self, texts: list[str]) -> tuple[list[int], list[int], list[int], list[str]]:
        """Texts that go through the library whole; the other ones, the number of pieces of each, and the pieces."""
        pieces, counts, whose, direct = [], [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.plain or self._needs_library(text):
                direct.append(i)
            else:
                parts = ("\n" + text).replace("\n", " \n").split(" ")
                pieces += parts[1:]
                counts.append(len(parts) - 1)
                whose.append(i)
        return direct, whose, counts, pieces

    def _whole(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids


class Encoder(_Pieces):
    """The library's ids of texts, with the ids of repeated pieces kept.

    The pieces of many texts are found, told apart and looked up by Arrow. The table holds words without the
    punctuation after them: letters end a token where punctuation begins, so "word," has the ids of "word" and of ",".
    """

    #: Pieces kept at most, of which the most used half stays when there are more.
    PIECES = 500_000
    #: Characters of text whose pieces are told apart together.
    LOT = 1 << 23
    #: Pieces whose ids are put one after another at a time, or those of one text.
    ROW = 1 << 18

    def __init__(self, path: str):
        super().__init__(path)
        self.known, self.tails, self.tail_ids = pa.array(["", "\n"]), {}, []
        self.starts, self.sizes, self.uses = (np.array(x, np.int64) for x in ([0, 1], [1, 1], [1 << 40, 1 << 40]))
        self.pool = np.array([*self.space[:1], max(self.newline, 0)], self.dtype)

    def _learn(self, fresh: pa.Array) -> None:
        """Put new pieces into the table."""
        # the newline that separates stands before the piece after it, and counts to it where it belongs there
        after = pc.starts_with(fresh, "\n").to_numpy(zero_copy_only=False).astype(np.int64)
        bare = pc.replace_substring(pc.binary_join_element_wise(" ", fresh, ""), " \n", "", max_replacements=1)
        ids, begins, ends = self._ask(bare.to_pylist())
        at = len(self.pool) + 1
        self.pool = np.concatenate([self.pool, np.array([self.newline], self.dtype), ids.astype(self.dtype)])
        self.starts, self.sizes = np.append(self.starts, at + begins - after), np.append(self.sizes, ends - begins + after)
        self.uses = np.append(self.uses, np.zeros(len(fresh), np.int64))
        self.known = pa.concat_arrays([self.known, fresh])

    def _tail(self, tail: str) -> int:
        if tail not in self.tails:
            self.tails[tail] = len(self.tail_ids)
            self.tail_ids.append(np.array(self._whole(tail), self.dtype))
        return self.tails[tail]

    def _thin(self) -> None:
        best = np.sort(np.argsort(-self.uses, kind="stable")[: self.PIECES // 2])
        pool, sizes = _flat(self.pool, self.starts[best], self.sizes[best]), self.sizes[best]
        self.known = self.known.take(pa.array(best))
        self.pool, self.sizes, self.starts, self.uses = pool, sizes, np.cumsum(sizes) - sizes, self.uses[best] >> 1
        self.uses[:2] = 1 << 40  # the library can't be asked for these two, so they stay

    def _bound(self) -> None:
        if len(self.tails) > self.PIECES:
            self.tails, self.tail_ids = {}, []
        if len(self.known) > self.PIECES:
            self._thin()

    def _look_up(self, pieces: pa.Array, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them those of each of different pieces begin and how many they are; new pieces are learned."""
        ended = pc.match_substring_regex(pieces, _ENDED)
        stems = pc.if_else(ended, pc.utf8_rtrim(pieces, characters=_ENDING), pieces).dictionary_encode()
        names = stems.dictionary
        number = pc.fill_null(pc.index_in(names, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = len(self.known) + np.arange(len(new))
            self._learn(names.take(pa.array(new)))
        one = number[stems.indices.to_numpy()]
        self.uses += np.bincount(one, uses, len(self.uses)).astype(np.int64)
        starts, sizes = self.starts[one], self.sizes[one]
        made = np.flatnonzero(ended.to_numpy(zero_copy_only=False))
        if not len(made):
            return self.pool, starts, sizes
        tails = pc.replace_substring_regex(pieces.take(pa.array(made)), _LETTERS, "").dictionary_encode()
        tail = np.array([self._tail(x) for x in tails.dictionary.to_pylist()])[tails.indices.to_numpy()]
        ends = np.cumsum([len(x) for x in self.tail_ids])
        n2 = np.array([len(x) for x in self.tail_ids])[tail]
        # stem and tail of each in turn, out of the pool with the tails behind it
        pool, at = np.concatenate([self.pool, *self.tail_ids]), len(self.pool) + (ends[tail] - n2)
        both = np.stack([starts[made], at], 1).ravel(), np.stack([sizes[made], n2], 1).ravel()
        sizes[made] += n2
        starts[made] = len(self.pool) + np.cumsum(sizes[made]) - sizes[made]
        return np.concatenate([self.pool, _flat(pool, *both)]), starts, sizes

    def _lot(self, texts: pa.Array) -> list[np.ndarray]:
        out = [np.zeros(0, self.dtype)] * len(texts)
        filled = pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0)
        whole = pc.match_substring_regex(texts, _UNEVEN) if self.plain else filled
        for x in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, x))
        whole = pc.and_(filled, pc.fill_null(whole, False))
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)):
            out[i] = np.array(self._whole(texts[i].as_py()), self.dtype)
        split = np.flatnonzero(pc.and_not(filled, whole).to_numpy(zero_copy_only=False))
        if not len(split):
            return out
        # A text gets a newline put before it, and so begins with an empty piece and that newline.
        newline, nothing = (pa.scalar(x, texts.type) for x in ("\n", ""))
        texts = pc.binary_join_element_wise(newline, texts.take(pa.array(split)), nothing)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        bounds, coded = lists.offsets.to_numpy(), lists.values.dictionary_encode()
        which, pieces = coded.indices.to_numpy(), coded.dictionary.cast(pa.string())
        del lists, texts
        pool, starts, sizes = self._look_up(pieces, np.bincount(which))
        at = 0
        while at < len(split):
            stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + self.ROW, "right")) - 1)
            some = which[bounds[at] : bounds[stop]]
            n = sizes[some]
            ids = _flat(pool, starts[some], n)
            ends = np.cumsum(n)[bounds[at + 1 : stop + 1] - bounds[at] - 1].tolist()
            for i, a, b in zip(split[at:stop].tolist(), [0, *ends[:-1]], ends, strict=True):
                out[i] = ids[a + 2 : b]
            at = stop
        self._bound()
        return out

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if column.nbytes > 1 << 29:
            column = column.cast(pa.large_string())  # newlines grow, and offsets of 32 bits end
        return [ids for at, stop in _portions(column, self.LOT) for ids in self._lot(column.slice(at, stop - at))]


def _flat(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of the pool, one after another."""
    stop = np.cumsum(sizes)
    return pool[np.repeat(starts - (stop - sizes), sizes) + np.arange(int(stop[-1]) if len(stop) else 0)]


class _Sizes(dict):
    """Piece -> number of its ids, from here or an older table; ``~i`` for the i-th new piece, until it is learned."""

    def __init__(self, older: dict[str, int]):
        super().__init__({"": 1, "\n": 1})
        self.older, self.fresh = older, []

    def __missing__(self, piece: str) -> int:
        size = self.older.get(piece)
        if size is None:
            size = ~len(self.fresh)
            self.fresh.append(piece)
        self[piece] = size
        return size


class Lengths(_Pieces):
    """How many ids the library gives texts. Only the numbers of pieces' ids are kept, in a bounded table.

    A Python worker keeps the table from task to task, beside another worker's and the executor's heap, so it is small:
    a piece costs its name and a place in a dict. When the younger half is full it becomes the older one, and
    pieces not met since then go.
    """

    #: Pieces kept at most, in both halves; more only where one portion of texts has more.
    PIECES = 1_000_000
    #: New pieces given to the library at once, whose encodings are held together.
    LOT = 64 * TOGETHER
    #: Characters of text measured at a time.
    CHARS = 1 << 19

    def __init__(self, path: str):
        super().__init__(path)
        self.known, self.tails = _Sizes({}), {}

    def _learn(self) -> np.ndarray:
        """Put the new pieces into the table; their sizes."""
        fresh = self.known.fresh
        whole, made, stems, tails = [], [], [], []
        n = len(fresh)
        for i in range(n):
            # Letters end a token where punctuation begins, so "word," has the ids of "word" and of ",".
            stem = fresh[i].rstrip(_ENDING)
            if len(stem) < len(fresh[i]) and stem.lstrip("\n").isalpha():
                made.append(i)
                stems.append(self.known[stem])
                tails.append(fresh[i][len(stem) :])
            else:
                whole.append(i)
        whole += range(n, len(fresh))  # new stems
        sizes = np.zeros(len(fresh), np.int64)
        for at in range(0, len(whole), self.LOT):
            lot = whole[at : at + self.LOT]
            _, begins, ends = self._ask([fresh[i][1:] if fresh[i][0] == "\n" else " " + fresh[i] for i in lot])
            sizes[lot] = ends - begins + [fresh[i][0] == "\n" for i in lot]
        if made:
            new = list({t for t in tails if t not in self.tails})
            self.tails |= zip(new, (len(e.ids) for e in self.library.encode_batch_fast(new, add_special_tokens=False)), strict=True)
            one = np.array(stems)
            sizes[made] = np.where(one < 0, sizes[np.maximum(~one, 0)], one) + [self.tails[t] for t in tails]
        self.known.update(zip(fresh, sizes.tolist(), strict=True))
        self.known.fresh = []
        return sizes

    def _bound(self) -> None:
        if len(self.known) > self.PIECES // 2:
            self.known.older = {}
            self.known = _Sizes(self.known)
        if len(self.tails) > self.PIECES // 2:
            self.tails = {}

    def lengths(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        out = np.zeros(len(texts), np.int64)
        direct, whose, counts, pieces = self._split(texts)
        for i in direct:
            out[i] = len(self._whole(texts[i]))
        if whose:
            sizes = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
            if self.known.fresh:
                new = sizes < 0
                sizes[new] = self._learn()[~sizes[new]]
            out[whose] = np.add.reduceat(sizes, np.cumsum(counts) - counts) - 1  # without the newline put before the text
            self._bound()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def measurer(path: str) -> Lengths:
    return in_worker(("lengths", path), lambda: Lengths(path))


# ---------------------------------------------------------------- files

SCHEMA = "shard int, segment int, ids_before long, n_ids long, doc_ids array<long>, n_tokens array<int>, payload binary"


def _portions(texts: pa.Array, chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of so many characters at most, or of one text."""
    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
    at, n = 0, len(lengths)
    while at < n:
        stop, size = at, 0
        while stop < n and (stop == at or size + lengths[stop] <= chars):
            size += lengths[stop]
            stop += 1
        yield at, stop
        at = stop


def size_in_tokens(text: Column, path: str) -> Column:
    """Ids of a text under the tokenizer at ``path``, without an end id, as a long; 0 for null."""

    def count(column: pa.Array) -> pa.Array:
        tokens = measurer(path)
        parts = [tokens.lengths(column.slice(at, stop - at).to_pylist()) for at, stop in _portions(column, tokens.CHARS)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())

    return F.arrow_udf(count, "long")(text.cast("string"))


def _lots(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[list[pa.Array]]:
    """The columns of several batches together, of so many characters and texts at most, or of one text."""
    held, size = [], 0
    for batch in batches:
        for at, stop in _portions(batch.column(1), chars):
            part = batch.slice(at, stop - at)
            n = len(part) + (pc.sum(pc.utf8_length(part.column(1))).as_py() or 0)
            if held and size + n > chars:
                yield [pa.concat_arrays(x) for x in zip(*(x.columns for x in held), strict=True)]
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield [pa.concat_arrays(x) for x in zip(*(x.columns for x in held), strict=True)]


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, shard = encoder(path), TaskContext.get().partitionId()
        segment = before = held = 0
        docs, sizes, ids, last = [], [], [], np.array([end], tokens.dtype)

        def flush() -> pa.RecordBatch:
            nonlocal segment, before, held, docs, sizes, ids
            values = np.concatenate(ids).astype(np.uint64)
            row = {"shard": shard, "segment": segment, "ids_before": before, "n_ids": len(values), "doc_ids": docs, "n_tokens": sizes, "payload": pack_ids(values)}
            segment, before, held, docs, sizes, ids = segment + 1, before + len(values), 0, [], [], []
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        for whose, texts in _lots(batches, tokens.LOT):
            for doc, got in zip(whose.to_pylist(), tokens.encode(texts), strict=True):
                docs.append(doc)
                sizes.append(len(got) + 1)
                ids += [got, last]
                held += len(got) + 1
                if held >= SEGMENT:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Write docs (doc_id, text) as a token file at ``path``."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    dealt.mapInArrow(_encode(tokenizer, end), SCHEMA).write.parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def export(spark, path: str, folder: str) -> int:
    """Copy the payloads to ``folder``/<shard>-<segment>.bin of the driver, one segment at a time; their number."""
    from pathlib import Path

    Path(folder).mkdir(parents=True, exist_ok=True)
    n = 0
    for row in read_tokens(spark, path).select("shard", "segment", "payload").toLocalIterator():
        Path(folder, f"{row.shard:06d}-{row.segment:06d}.bin").write_bytes(row.payload)
        n += 1
    return n


def _digest(base: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_ids(row["payload"]).astype("<u4")
                sizes = np.array(row["n_tokens"], np.int64)
                stops = np.cumsum(sizes)
                start = base[row["shard"]] + row["ids_before"] + stops - sizes
                view = memoryview(ids)
                sums = [zlib.crc32(view[j - n : j]) for j, n in zip(stops.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(sizes), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return run


def digest(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    shards = read_tokens(spark, path).groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # a row a shard
    base, at = {}, 0
    for row in shards:
        base[row["shard"]] = at
        at += row["n"]
    return read_tokens(spark, path).mapInArrow(_digest(base), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{Workspace(spark, 'tokens').root}/ids"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return digest(spark, path)
