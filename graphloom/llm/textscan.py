"""Vectorised text scanning over Arrow string columns.

Everything here works on one flat byte buffer per chunk of rows, so the cost
per byte is a few NumPy passes and no Python object is made per word.  Chunks
are bounded by bytes (`CHUNK`), not by rows, so a batch of very long texts
uses no more memory than a batch of short ones; a single text longer than the
bound is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK = 2 << 20
_U = np.uint64
_LONGEST = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def keys(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values that depend on the seed only."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + mix(np.full(1, seed, dtype=_U)))


_BYTE = keys(11, 256)
_PLACE = keys(12, _LONGEST) | _U(1)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def class_table(separators: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, byte after folding) for each of the 256 byte values."""
    word = np.ones(256, dtype=bool)
    word[list(separators)] = False
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    return word, fold


WHITE = bytes([0x20, *range(0x09, 0x0E)])
PUNCT = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: `[^\x20\x09-\x0D]+`, as it stands.
RAW_WORDS = class_table(WHITE, False)
#: `[^\x20\x09-\x0D]+` after lower-casing A-Z.
SPACE_WORDS = class_table(WHITE, True)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z (so A-Z are word bytes).
PLAIN_WORDS = class_table(bytes(b for b in PUNCT if not 65 <= b <= 90), True)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) in slices of at most `most` bytes or one row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def rows_of(offsets: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For sorted places: how many lie before each offset (so the slice of row r is out[r]:out[r+1])."""
    return np.searchsorted(places, offsets, "left")


class Words:
    """The words of a chunk: byte bounds, row bounds (`first[r]:first[r+1]`) and a 64-bit hash each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray], hashed: bool = True):
        is_word = table[0][data]
        edge = is_word.copy()
        edge[1:] &= ~is_word[:-1]
        begins = offsets[:-1]
        begins = begins[begins < len(data)]
        edge[begins] = is_word[begins]
        self.start = np.flatnonzero(edge)
        last = is_word.copy()
        last[:-1] &= ~is_word[1:] | edge[1:]
        self.end = np.flatnonzero(last) + 1
        self.first = rows_of(offsets, self.start)
        self.hash = hash_runs(table[1][data][is_word], self.end - self.start) if hashed else None


def hash_runs(body: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the byte runs of these sizes that `body` is made of."""
    if not len(size):
        return np.zeros(0, dtype=_U)
    begin = np.zeros(len(size), dtype=np.int64)
    np.cumsum(size[:-1], out=begin[1:])
    place = np.arange(len(body), dtype=np.int64)
    place -= np.repeat(begin, size)
    place &= _LONGEST - 1
    h = np.add.reduceat(_BYTE[body] * _PLACE[place], begin)
    for i in np.flatnonzero(size > _LONGEST):
        h[i] = xxhash.xxh3_64_intdigest(body[begin[i] : begin[i] + size[i]].tobytes())
    return mix(h + size.astype(_U) * _U(0x9E3779B97F4A7C15))


def run_bounds(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows' bounds among their k-grams, and each k-gram's first unit (rows with fewer units have none)."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    bound = np.zeros(len(first), dtype=np.int64)
    np.cumsum(count, out=bound[1:])
    start = np.arange(bound[-1], dtype=np.int64) + np.repeat(first[:-1] - bound[:-1], count)
    return bound, start


_STEP = keys(13, 64) | _U(1)


def grams(unit: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k units from each place on (places whose k-gram runs over the end are cut off).

    Built by doubling: log2(k) passes, whatever k is.
    """
    if len(unit) < k:
        return np.zeros(0, dtype=_U)
    out, have, power, size, level = None, 0, unit, 1, 0
    while True:
        if k & size:
            if out is None:
                out = power
            else:
                n = len(power) - have
                out = mix(out[:n] * _STEP[32 + level] + power[have : have + n])
            have += size
        if have == k:
            return out[: len(unit) - k + 1]
        power = power[:-size] * _STEP[level] + power[size:]
        power ^= power >> _U(29)
        size, level = size * 2, level + 1


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values."""
    have, power, size, out = 0, x, 1, None
    while True:
        if w & size:
            n = len(x) - have - size + 1
            out = power[:n] if out is None else np.minimum(out[:n], power[have : have + n])
            have += size
        if have == w:
            return out
        power = np.minimum(power[:-size], power[size:])
        size *= 2
