"""Hashes of the words of many texts at once, straight from Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; longer texts are cut at blanks.
CHUNK = 1 << 20
_U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def least_over(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by doubling."""
    done, out = 1, x
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=_U64) * _U64(0x9E3779B97F4A7C15))
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_BASE = _U64(0x5851F42D4C957F2D)  # 5 modulo 8, so its powers repeat late


def _hashes(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data`` and the places they start; ``firsts`` are places where a word must start anew."""
    solid = ~_BLANK[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = firsts[firsts < len(data)]
    begins[inner] = solid[inner]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, _U64), starts
    at = np.flatnonzero(solid)
    first_of_word = np.searchsorted(at, starts)
    lengths = np.diff(np.append(first_of_word, len(at)))
    place = np.arange(len(at)) - np.repeat(first_of_word, lengths)
    powers = np.full(int(lengths.max()), _BASE)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    return mixed(np.add.reduceat(_BYTE_VALUES[_LOWER[data[at]]] * powers[place], first_of_word)), starts


def word_hashes(column: pa.StringArray) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, hashes)`` of the words of every text, A-Z in lower case; a null or blank text has none."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    null = column.is_null().to_numpy(zero_copy_only=False)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        low, high = int(offsets[row]), int(offsets[end])
        if end == row + 1 and high - low > CHUNK:
            yield row, _long_text(data[low:high])
        else:
            hashes, starts = _hashes(data[low:high], offsets[row:end] - low)
            cuts = np.searchsorted(starts, offsets[row : end + 1] - low)
            for i in range(row, end):
                yield i, hashes[:0] if null[i] else hashes[cuts[i - row] : cuts[i - row + 1]]
        row = end


def _long_text(data: np.ndarray) -> np.ndarray:
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        if end < len(data):
            blanks = np.flatnonzero(_BLANK[data[at:end]])
            while not len(blanks) and end < len(data):  # one word longer than a chunk
                end = min(len(data), end + CHUNK)
                blanks = np.flatnonzero(_BLANK[data[at:end]])
            end = at + int(blanks[-1]) + 1 if len(blanks) and end < len(data) else end
        parts.append(_hashes(data[at:end], np.zeros(1, np.int64))[0])
        at = end
    return np.concatenate(parts)
