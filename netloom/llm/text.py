"""Array helpers for text columns inside Arrow batches.

Texts are handled as UTF-8 bytes: blanks and ASCII letters keep their byte
values there, so words can be found, lower-cased and hashed without a Python
string for each.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

Batches = Iterator[pa.RecordBatch]
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def released(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, at whose end the worker gives back what it freed: workers are
    used again by later stages, whose memory would else come on top."""

    def held(batches: Batches) -> Batches:
        yield from run(batches)
        _give_back()

    return held


def _give_back() -> None:
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling hash's base and of its inverse, for n positions at least."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            up, down = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
            up[0] = down[0] = 1
            _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Rolling sums S with span_hash(S, i, j) a hash of values[i:j]."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values, none of which crosses a row."""
    if len(inside) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.ones(len(inside), bool), np.ones(len(inside), bool)
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    at = offsets[(offsets > 0) & (offsets < len(inside))]
    before[at], after[at - 1] = True, True
    return np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1


def blank_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``."""
    return spans(~_BLANK[data], offsets)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return _LOWER[data]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of some rows, and each row's range among them."""
    start, end = blank_words(data, offsets)
    return span_hash(prefix_hash(lower(data)), start, end), np.searchsorted(start, offsets)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; the whole of it if there are fewer; none of nothing."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    size = min(n, size)
    out = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        out = out * _BASE + words[j : n - size + 1 + j]
    return mix(out)


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = utf8(column)
    for lo, hi in chunks(offsets):
        words, ranges = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        for a, b in zip(ranges[:-1], ranges[1:], strict=True):
            yield np.unique(shingle_hashes(words[a:b], size))


def _letters() -> np.ndarray:
    """For each code point of the basic plane: its lower-case form if it is a letter, else a blank."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        if (x := chr(c)).isalpha():
            out[c] = ord(low) if len(low := x.lower()) == 1 else c
    return out


LETTERS = _letters()


def _alphabet() -> np.ndarray:
    """For each code point of the basic plane its lower-case form if words hold it, else 0."""
    out = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        if (x := chr(c)).isalnum():
            out[c] = ord(low) if len(low := x.lower()) == 1 else c
    return out


WORD = _alphabet()


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the rows' offsets among them."""
    first = (data & 0xC0) != 0x80
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(first, out=at[1:])
    return np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32), at[offsets]


def letters(points: np.ndarray) -> np.ndarray:
    """Letters in lower case, everything else as blanks; letters outside the basic plane are folded into 16 bits."""
    high = points >> np.uint32(16)
    if not high.any():
        return LETTERS[points]
    out = LETTERS[points & np.uint32(0xFFFF)]
    at = np.flatnonzero(high)
    out[at] = [0xE000 + c % 0x1000 if chr(c).isalpha() else 32 for c in points[at].tolist()]
    return out
