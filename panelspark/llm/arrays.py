"""Array helpers shared by the operators: UTF-8 buffers, words, rolling hashes and packed columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FIRST, _SECOND = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LOW = np.uint64(0xFFFFFFFF)
NO_ID = np.iinfo(np.int64).max


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * _FIRST
    h = (h ^ (h >> np.uint64(27))) * _SECOND
    return h ^ (h >> np.uint64(31))


@cache
def byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up = np.full(n, MULTIPLIER, np.uint64)
    down = np.full(n, pow(int(MULTIPLIER), -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of codes[start:end] for many spans, from one running sum."""
    up, down = _powers(max(1, int(len(codes) + 1).bit_length()))
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _SECOND)


def column(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    got = table.column(name)
    if isinstance(got, pa.ChunkedArray):
        got = got.combine_chunks() if got.num_chunks != 1 else got.chunk(0)
        if isinstance(got, pa.ChunkedArray):
            got = pa.concat_arrays(got.chunks)
    return got


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the n + 1 borders of its rows; a null row is empty."""
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    _, borders, data = texts.buffers()
    at = np.frombuffer(borders, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def ids(values: pa.Array) -> np.ndarray:
    """Document ids; a row without an id counts as later than every other."""
    return values.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def slices(borders: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer row is a range of its own."""
    low, n = 0, len(borders) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(borders, borders[low] + most, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def word_spans(raw: np.ndarray, borders: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word (a run of bytes b with inside[b]) and the words before each row."""
    is_word = np.zeros(len(raw) + 2, np.bool_)
    is_word[1:-1] = inside[raw]
    cut = np.zeros(len(raw) + 1, np.bool_)
    cut[borders] = True
    start = np.flatnonzero(is_word[1:-1] & (~is_word[:-2] | cut[:-1]))
    end = np.flatnonzero(is_word[1:-1] & (~is_word[2:] | cut[1:])) + 1
    return start, end, np.searchsorted(start, borders)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, np.bool_)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Bytes of a word: all but space, tab, line feed, vertical tab, form feed and carriage return.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes of a word in lower-cased text: digits, a-z and all of a character beyond ASCII.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[0x41:0x5B] += 0x20


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _TO_LOWER[raw]


def gather(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """raw[start:end] of many spans, one after another."""
    size = end - start
    if len(size) == 0:
        return raw[:0]
    before = np.cumsum(size) - size
    return raw[np.repeat(start - before, size) + np.arange(int(size.sum()))]


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every k consecutive codes; mix it before use."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, factor = codes, 1, int(MULTIPLIER)
    while done * 2 <= k:  # hashes of 2d codes from those of d
        shifted = out[done:]
        out = out[: len(shifted)] * np.uint64(factor)
        out += shifted
        done, factor = done * 2, factor * factor % (1 << 64)
    for j in range(done, k):
        out = out[:n] * MULTIPLIER + codes[j : j + n]
    return out[:n]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 0, 3): owner 0 0 2 2 2 and place 0 1 0 1 2."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def parts(table: pa.Table, name: str, kind) -> list[np.ndarray]:
    """The arrays packed in a binary column, one per row."""
    return [np.frombuffer(x.as_buffer(), kind) for x in column(table, name)]


def joined(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)
