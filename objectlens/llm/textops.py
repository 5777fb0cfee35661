"""Vectorised text primitives over Arrow buffers, shared by the operators of this subpackage.

Texts arrive as Arrow string columns.  The functions here work on the concatenated UTF-8 bytes of
a run of documents (a chunk), so that no Python string is made per word.  A null text counts as
empty everywhere.  A chunk holds whole documents only: a document longer than ``CHUNK_BYTES`` is
a chunk of its own, never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20

U64 = np.uint64
_rng = np.random.RandomState(20240817)
#: One random 64-bit value for each byte, and an odd base for the rolling sums.
BYTE_VALUES = _rng.randint(0, 1 << 62, 256, dtype=np.int64).astype(U64) * U64(4) + _rng.randint(0, 4, 256).astype(U64)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
ODDS = (_rng.randint(0, 1 << 62, 64, dtype=np.int64).astype(U64) << U64(1)) | U64(1)

_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        factors = np.full(n, BASE if which == "up" else BASE_INVERSE, U64)
        factors[0] = 1
        _powers[which] = np.cumprod(factors)
    return _powers[which][:n]


def _lut(word: str, lower: bool) -> np.ndarray:
    lut = np.arange(256).astype(np.uint8)
    if lower:
        lut[65:91] += 32
    if word == "spaces":  # [^\x20\x09-\x0D]+; the byte 0 is a word byte and shares the value of 255, which UTF-8 never has
        lut[0] = 255
        lut[[9, 10, 11, 12, 13, 32]] = 0
    else:  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
        lut[np.r_[0:48, 58:97, 123:128]] = 0
        if lower:
            lut[65:91] = np.arange(97, 123)
    return lut


#: Byte to word byte, 0 where a byte ends a word.
SPACES = _lut("spaces", False)
SPACES_LOWER = _lut("spaces", True)
ALNUM_LOWER = _lut("alnum", True)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the int64 offsets of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def spans(off: np.ndarray, limit: int = CHUNK_BYTES, most: int = 1023) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about ``limit`` bytes, ``most`` documents at most."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1), n, lo + most)
        yield lo, hi
        lo = hi


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each chunk of a column."""
    data, off = buffers(column)
    for lo, hi in spans(off, limit):
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, given a 64-bit value for each element; equal spans hash alike wherever they stand."""
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _power("up", len(values) + 1)[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * _power("down", len(values) + 1)[starts] + (ends - starts).astype(U64) * ODDS[63])


def word_bounds(mapped: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words and the words in each document; mapped is 0 where a byte ends a word."""
    n = len(mapped)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    is_word = mapped != 0
    begin, finish = is_word.copy(), is_word.copy()
    begin[1:] &= ~is_word[:-1]
    finish[:-1] &= ~is_word[1:]
    inner = off[(off > 0) & (off < n)]
    begin[inner] = is_word[inner]
    finish[inner - 1] = is_word[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


def words(data: np.ndarray, off: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts, ends of the words of a chunk, and the words in each document."""
    mapped = lut[data]
    starts, ends, counts = word_bounds(mapped, off)
    return (span_hash(BYTE_VALUES[mapped], starts, ends) if len(starts) else np.zeros(0, U64)), starts, ends, counts


def windows(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words within a document: (hashes, index of the first word, windows in each document)."""
    per = np.maximum(counts - k + 1, 0)
    n = len(hashes) - k + 1
    if n <= 0 or not per.sum():
        return np.zeros(0, U64), np.zeros(0, np.int64), per
    first = np.repeat(np.cumsum(counts) - counts - (np.cumsum(per) - per), per) + np.arange(per.sum())
    acc = np.zeros(n, U64)
    for j in range(k):
        acc += hashes[j : j + n] * ODDS[j]
    return mix(acc[first]), first, per


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int, lut: np.ndarray = SPACES_LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each document: (hashes, offsets).

    A document of fewer words, but not none, has its whole sequence as its one shingle.  Hashes
    have 64 - 10 bits, as the chunk's document number leads the sort key.
    """
    h, _, _, counts = words(data, off, lut)
    win, _, per = windows(h, counts, k)
    few = np.flatnonzero((counts > 0) & (counts < k))
    if len(few):
        first = np.cumsum(counts) - counts
        whole = np.zeros(len(few), U64)
        for j in range(k - 1):
            on = counts[few] > j
            whole[on] += h[first[few][on] + j] * ODDS[j]
        win = np.concatenate([win, mix(whole + counts[few].astype(U64) * ODDS[62])])
    owner = np.concatenate([np.repeat(np.arange(len(per)), per), few]).astype(U64)
    key = np.sort((owner << U64(54)) | (win >> U64(10)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key & U64((1 << 54) - 1), np.searchsorted(key, np.arange(len(per) + 1).astype(U64) << U64(54))


def with_columns(batch: pa.RecordBatch, names: list[str], **columns: pa.Array) -> pa.RecordBatch:
    """The named columns of a batch, then the new ones."""
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(columns.values()), names=names + list(columns))
