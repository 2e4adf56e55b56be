"""Hashed word shingles of Arrow text columns, vectorised over the bytes of many documents.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z; neither touches
a byte of a multi-byte UTF-8 sequence, so bytes give the same words as code points. A shingle is the
64-bit hash of a run of words; sets of hashes stand for sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
#: Bytes of text hashed at a time: the temporaries stay within a processor's cache.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> _S33)
    x *= _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


def _odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTE = _odd(256, 11)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = _odd(64, 23)
_powers = np.ones(1, dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    """Weights of the first n places in a word; a longer table extends a shorter one."""
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 4096) - 1, 0x9E3779B97F4A7C15 | 1, np.uint64)]))
    return _powers


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of length n + 1) of a string column; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    at = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, at


def word_hashes(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first doc, end doc, word hashes, word offsets by doc, word starts, word lengths) of chunks of whole documents."""
    n, first = len(at) - 1, 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK, side="right")) - 1)
        end = min(end, n)
        raw = data[at[first] : at[end]]
        solid = ~_SPACE[raw]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        cuts = (at[first:end] - at[first])[at[first:end] < at[end]]
        begins[cuts] = solid[cuts]  # a document's first byte never continues the one before it
        starts = np.flatnonzero(begins)
        if not len(starts):
            yield first, end, np.zeros(0, np.uint64), np.zeros(end - first + 1, np.int64), starts, starts
            first = end
            continue
        where = np.flatnonzero(solid)
        head = np.flatnonzero(begins[where])
        lengths = np.diff(np.append(head, len(where)))
        place = np.arange(len(where)) - np.repeat(head, lengths)
        terms = _BYTE[raw[where]] * _power(int(lengths.max()) + 1)[place]
        hashes = mix(np.add.reduceat(terms, head) + lengths.astype(np.uint64))
        words_at = np.searchsorted(starts, at[first : end + 1] - at[first])
        yield first, end, hashes, words_at, starts, lengths
        first = end


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order.

    Texts with 1 to k - 1 words have one shingle, the whole sequence; without words, none.
    """
    data, at = text_buffers(column)
    for first, end, words, words_at, _, _ in word_hashes(data, at):
        runs = None
        if len(words) >= k:
            m = len(words) - k + 1
            runs = words[:m] * _PLACE[0]
            for i in range(1, k):
                runs += words[i : m + i] * _PLACE[i]
            runs = mix(runs)
        for d in range(end - first):
            i, j = int(words_at[d]), int(words_at[d + 1])
            if j - i >= k:
                yield np.unique(runs[i : j - k + 1])
            elif j > i:
                yield mix(np.array([(words[i:j] * _PLACE[32 : 32 + j - i]).sum() + np.uint64(j - i)], dtype=np.uint64))
            else:
                yield np.zeros(0, np.uint64)
