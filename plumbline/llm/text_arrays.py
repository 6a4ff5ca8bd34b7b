"""Words, hashes and n-grams of whole Arrow columns of text, as NumPy arrays.

The patterns used by the operators treat every byte from 0x80 up alike, so words can
be found on the UTF-8 bytes: no Python string is made for a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# Bytes of text handled at once; one longer text is a piece of its own.
PIECE_BYTES = 256 << 10

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUES = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64)[_LOWER]


def _class_table(separators: Iterator[int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


# [^\x20\x09-\x0D]+
SPACED = _class_table([0x20, *range(0x09, 0x0E)])
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z is lower-cased: digits, letters, all beyond ASCII
ALNUM = _class_table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def _libc() -> ctypes.CDLL | None:
    try:
        library = ctypes.CDLL("libc.so.6")
        return library if hasattr(library, "malloc_trim") else None
    except OSError:
        return None


_LIBC = _libc()


def give_back() -> None:
    """Return freed memory to the system: a worker stays alive between tasks, and others need it."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


class Texts(NamedTuple):
    """UTF-8 bytes of several texts, one after the other, and where each begins."""

    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Byte spans of words, in order, and the first word of each text."""

    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray


def texts_of(column: pa.Array) -> Texts:
    """The bytes behind a string column; NULL is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return Texts(raw[at[0] : at[-1]], at - at[0])


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of a batch whose texts have about `limit` bytes together."""
    ends = texts_of(batch.column(column)).offsets
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        part = batch.slice(start, stop - start)
        yield part, texts_of(part.column(column))
        start = stop
    give_back()


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a published finaliser)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def _powers(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, `size` of them at least, kept in the process."""
    if not _POWERS or len(_POWERS[0]) < size:
        size = 1 << max(20, int(size).bit_length())

        def series(base: np.uint64) -> np.ndarray:
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        _POWERS[:] = [series(_BASE), series(_INVERSE)]
    return _POWERS


def prefix_hash(data: np.ndarray, values: np.ndarray = _BYTE_VALUES) -> np.ndarray:
    """Running polynomial hash; `span_hash` takes spans out of it."""
    power, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * power[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans have equal hashes wherever they lie."""
    _, inverse = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(texts: Texts, is_word: np.ndarray) -> Words:
    """Maximal runs of word bytes that do not cross from one text into the next."""
    data, offsets = texts
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = is_word[data]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    first = inside[1:-1] & ~inside[:-2]
    first[filled] = inside[1:-1][filled]
    last = inside[1:-1] & ~inside[2:]
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[ends] = inside[1:-1][ends]
    starts = np.flatnonzero(first)
    return Words(starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets))


def word_hashes(texts: Texts, found: Words) -> np.ndarray:
    """Hashes of words with A-Z lower-cased."""
    return span_hash(prefix_hash(texts.data), found.starts, found.ends)


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of `n` words on end, one for each word that has n - 1 behind it in the array."""
    count = max(len(hashes) - n + 1, 0)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        out = mix(out + hashes[k : k + count]) * _BASE
    return mix(out)


def shingles(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text and where each text's begin.

    A text of fewer words, but not none, has its whole sequence as its only one.
    """
    counts = np.diff(offsets)
    grams = ngram_hashes(hashes, n)
    of = np.repeat(np.arange(len(counts)), np.maximum(counts - n + 1, 0))
    gone = np.repeat(offsets[:-1], np.maximum(counts - n + 1, 0))
    within = np.arange(len(of)) - np.repeat(np.cumsum(np.maximum(counts - n + 1, 0)) - np.maximum(counts - n + 1, 0), np.maximum(counts - n + 1, 0))
    values = grams[gone + within]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = [ngram_hashes(hashes[offsets[i] : offsets[i + 1]], int(counts[i]))[0] for i in short]
        of = np.concatenate([of, short])
        values = np.concatenate([values, np.array(whole, dtype=np.uint64) + counts[short].astype(np.uint64)])
    order = np.lexsort((values, of))
    of, values = of[order], values[order]
    if len(of):
        new = np.ones(len(of), dtype=bool)
        new[1:] = (of[1:] != of[:-1]) | (values[1:] != values[:-1])
        of, values = of[new], values[new]
    return values, np.searchsorted(of, np.arange(len(counts) + 1))
