"""Texts of an Arrow column as one byte array: word spans, hashes and counts without a loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Separators of words: space and the ASCII control characters from tab to carriage return.
BREAK = np.zeros(256, dtype=bool)
BREAK[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes that one pass of numpy works on, unless a single text is longer.
SLICE = 2 << 20
_LONG_WORD = 64

_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n)
            self.up, self.down = _powers(self.base, self.n), _powers(self.inverse, self.n)
        return self.up[:n], self.down[:n]


_words_powers = _Powers(_WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of about ``limit`` bytes; NULL counts as empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    texts = texts.fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, side="right")) - 1)
        yield row, end, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of the first of its words (and the total)."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    np.logical_not(BREAK[data], out=inside[:-1])
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets[:-1]] = True
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first))
    ends = np.flatnonzero(before & (~inside | first))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word's bytes: eight at a time, mixed in between; XXH64 for long words."""
    import xxhash

    size = ends - starts
    out = size.astype(np.uint64) * np.uint64(_BASE)
    eights = np.ndarray(len(data) + 1, dtype="<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    left, at = np.flatnonzero(size <= _LONG_WORD), 0
    while len(left):
        part, rest = eights[starts[left] + at], size[left] - at
        cut = rest < 8
        part[cut] &= (np.uint64(1) << (8 * rest[cut]).astype(np.uint64)) - np.uint64(1)
        out[left] = mix(out[left] ^ part) + np.uint64(_WORD_BASE)
        left, at = left[rest > 8], at + 8
    for k in np.flatnonzero(size > _LONG_WORD).tolist():
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes())
    return out


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n consecutive words, whatever texts they belong to."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    up, down = _words_powers.upto(len(words))
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up, out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])


def sliding(values: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over each run of n values, by doubling."""
    if len(values) < n:
        return values[:0]
    width, out = 1, values
    while 2 * width <= n:
        out = best(out[:-width], out[width:])
        width *= 2
    if width < n:
        out = best(out[: len(values) - n + 1], out[n - width : len(values) - width + 1])
    return out
