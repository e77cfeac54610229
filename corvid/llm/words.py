"""Words of Arrow columns of texts as 64-bit hashes, by numpy over the column's bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that a chunk of whole texts holds before the next begins; a longer text is a chunk alone.
CHUNK = 1 << 21
#: What separates words: ASCII white space, as bytes.split() takes it; "\n" ends lines as well.
WHITE = b" \t\n\r\x0b\x0c"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BASE, _STEP = 0xD6E8FEB86659FD93, 1 << 16


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _B
    z ^= z >> np.uint64(27)
    z *= _A
    return z ^ (z >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1, modulo 2 ** 64."""
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_LOW, _HIGH, _DOWN = powers(_BASE, _STEP), powers(pow(_BASE, _STEP, 1 << 64), _STEP), powers(pow(_BASE, -1, 1 << 64), _STEP)
#: Sums of the first 0, 1, ... powers.
_FIRST = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LOW)])


class Runs:
    """Hashes of stretches of a sequence of hashes, by prefix sums: each costs two look-ups, wherever it begins."""

    _BASE = 0xA0761D6478BD642F
    _up = _down = np.ones(1, np.uint64)

    def __init__(self, h: np.ndarray):
        if len(Runs._up) <= len(h):
            size = 2 * len(h) + 1
            Runs._up, Runs._down = powers(self._BASE, size), powers(pow(self._BASE, -1, 1 << 64), size)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * Runs._up[: len(h)], out=self.sums[1:])

    def __call__(self, first: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[first + size] - self.sums[first]) * Runs._down[first])


@dataclass
class Chunk:
    """Some texts of a column: their bytes, each word's hash and place, and the first word of each text and line.

    line_* has an entry for each line of each text, lines of no words and of empty texts
    among them: the text it belongs to, its number there, its first word, one past its last.
    """

    first: int
    data: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def bounds(self) -> np.ndarray:
        """First word of each text, and the number of words at the end."""
        return np.searchsorted(self.starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        breaks = np.flatnonzero(self.data == 10)
        begins = np.concatenate([self.offsets[:-1], breaks + 1])
        text = np.concatenate([np.arange(len(self.offsets) - 1), np.searchsorted(self.offsets, breaks, side="right") - 1])
        order = np.lexsort((begins, text))
        begins, text = begins[order], text[order]
        lead = np.searchsorted(text, np.arange(len(self.offsets) - 1))
        number = np.arange(len(text)) - lead[text]
        a = np.searchsorted(self.starts, begins)
        # The next line begins where the next text does, at the latest; texts follow each other without a gap.
        return text, number, a, np.append(a[1:], len(self.starts))

    def odd_gaps(self) -> np.ndarray:
        """Sums of gaps between words that are not one space: entry k counts those before word k."""
        gap = self.starts[1:] - self.ends[:-1]
        odd = (gap != 1) | (self.data[self.ends[:-1]] != 32) if len(gap) else np.zeros(0, bool)
        return np.concatenate([[0, 0], np.cumsum(odd)])[: len(self.starts) + 1] if len(self.starts) else np.zeros(1, np.int64)


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each word, the sum of its bytes, each and 1, times the power of _BASE of the byte's place in it.

    Prefix sums over _STEP bytes at a time, so that they stay in the processor's cache; a longer word is summed by itself.
    """
    out, sums, i = np.empty(len(starts), np.uint64), np.zeros(_STEP + 1, np.uint64), 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + _STEP, side="right"))
        if i == j:
            at = np.arange(ends[i] - base)
            out[i] = (_LOW[at & (_STEP - 1)] * _HIGH[at >> 16] * (data[base : ends[i]] + np.uint64(1))).sum()
            i += 1
            continue
        a, b = starts[i:j] - base, ends[i:j] - base
        np.cumsum(data[base : ends[j - 1]] * _LOW[: b[-1]], out=sums[1 : b[-1] + 1])
        out[i:j] = (sums[b] - sums[a]) * _DOWN[a] + _FIRST[b - a]
        i = j
    return out


def _hashed(data: np.ndarray, offsets: np.ndarray, first: int) -> Chunk:
    # WHITE is the space and the bytes 9 to 13.
    solid = (data != 32) & (data - np.uint8(9) > 4)
    head, tail = solid.copy(), solid.copy()
    head[1:] &= ~solid[:-1]
    tail[:-1] &= ~solid[1:]
    cut = offsets[:-1][offsets[:-1] < offsets[1:]]
    head[cut] = solid[cut]
    tail[cut[1:] - 1] = solid[cut[1:] - 1]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return Chunk(first, data, offsets, mix(_sums(data, starts, ends) + (ends - starts).astype(np.uint64) * _A), starts, ends)


def chunks(column: pa.Array) -> Iterator[Chunk]:
    """The texts of a string column without nulls, in runs of about CHUNK bytes; first is the place of a run's first text."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1)
        yield _hashed(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], a)
        a = b
